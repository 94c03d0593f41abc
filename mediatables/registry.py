"""All registered queries outside the language-model subpackage, and their SQL."""

from __future__ import annotations

from . import queries_assets, queries_media, queries_text

MODULES = (queries_text, queries_media, queries_assets)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
