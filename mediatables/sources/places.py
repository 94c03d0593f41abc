"""Folders by name, as pyarrow opens them."""

from __future__ import annotations

import os


def opened(place: str):
    """The file system of a folder (``file``, ``s3``, ``gs``, ``hdfs`` or a plain path), and its path there."""
    from pyarrow import fs

    if place.startswith("file:"):
        place = "/" + place.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), os.path.abspath(place))
