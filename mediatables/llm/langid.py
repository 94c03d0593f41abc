"""Language identification by fusing evidence in Bayes' rule.

The log posterior of a language is the sum of four terms:

* the text: byte trigrams of its letters under a multinomial per language, with
  ``unknown`` as a flat alternative; trigrams overlap, so a text counts as at most
  ``EFFECTIVE`` independent ones however long it is (the whole text is read);
* the language that the markup declares, right with probability ``DECLARED``;
* the suffix of the address, for suffixes that belong to one language;
* the host's prior: soft counts of all texts grouped by host, smoothed towards its
  registered domain's, and those towards the whole corpus's.

Missing evidence is neutral. The trigram model is fitted on at most ``FIT_ROWS`` labelled
rows, picked by a hash of their id; host, domain and corpus counts cover every row and
are grouped aggregations. Two passes read the text; it is shuffled only where the table of
host priors is too large to broadcast.

A row is accepted if its best language is not ``unknown`` and has a posterior of at least
``least``. Null, empty and letterless text has no text evidence and is never accepted.
Ties go to the first language in code point order. An empty table gives an empty table; all
input columns pass through, and new ones are in the one struct column named by ``out``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, by_bytes, cut, encoded, kept

FIT_ROWS = 2_000
#: Languages that a model may hold.
MOST_LANGUAGES = 64
EFFECTIVE = 60
DECLARED = 0.9
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 100.0
BUCKETS = 1 << 16
UNKNOWN = "unknown"
#: Suffixes of one language (fixed values).
SUFFIXES = {"at": "de", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "uk": "en", "us": "en"}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of neighbouring texts, and where each text's begin (one more at the end)."""
    data = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b"  ", np.uint8)]
    starts = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))
    code = (data[:-2].astype(np.uint32) << np.uint32(16)) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | data[2:]
    kept = np.flatnonzero((data[1:-1] != 32) & ~((data[:-2] == 32) & (data[2:] == 32)))
    bucket = ((code[kept] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return bucket, np.searchsorted(kept, starts)


def fit(labelled: DataFrame, text: str, label: str, row_id: str, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram bucket in each, from a bounded sample.

    Rows without a label or text, and those labelled as the reject class, teach nothing.
    """
    bounded_batches(labelled.sparkSession)
    base = labelled.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{text}`").cast("string").alias("text"))
    known = base.where(F.col("label").isNotNull() & F.col("text").isNotNull() & (F.col("label") != UNKNOWN))
    picked = known.select("row_id").orderBy(F.xxhash64("row_id"), "row_id").limit(rows)
    some = known.join(F.broadcast(picked), "row_id", "left_semi").select("label", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, part in batch.groupby("label"):
                bucket, _ = grams(encoded(part["text"]))
                n = np.bincount(bucket, minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"label": label, "bucket": at, "n": n[at]})

    rows_ = some.mapInPandas(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows_["label"].unique())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    table = np.zeros((len(names), BUCKETS))
    for k, name in enumerate(names):
        part = rows_[rows_["label"] == name]
        table[k, part["bucket"].to_numpy()] += part["n"].to_numpy()
    # a tenth of each language is anything at all: names, codes and other words
    return names, np.log(0.9 * table / table.sum(axis=1, keepdims=True) + 0.1 / BUCKETS).astype(np.float32)


def likelihoods(docs: DataFrame, text: str, model: np.ndarray) -> Column:
    """Log likelihood of a text in each language and, last, in none; null without letters."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = kept("languages", shared.value, lambda: shared.value)
        flat = -np.log(BUCKETS)  # no language: all buckets alike
        for batch in batches:
            texts, out = encoded(batch), []
            for a, b in by_bytes(texts, 1 << 18):
                bucket, at = grams(texts[a:b])
                sums = [np.concatenate(([0.0], np.cumsum(row[bucket], dtype=np.float64))) for row in table]
                n = np.diff(at)
                mean = np.stack([(s[at[1:]] - s[at[:-1]]) / np.maximum(n, 1) for s in sums] + [np.full(len(n), flat)], axis=1)
                mean *= np.minimum(n, EFFECTIVE)[:, None]
                out += [m if c else None for m, c in zip(mean, n, strict=True)]
            yield pd.Series(out)

    # not deterministic, for the optimizer: else a filter on the result would score each text twice
    return score.asNondeterministic()(F.col(f"`{text}`").cast("string"))


def _soft(scores: Column) -> Column:
    """Probabilities from log scores."""
    top = F.array_max(scores)
    odds = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def _added(*terms: Column) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = F.zip_with(out, t, lambda a, b: a + b)
    return out


def host_of(url: Column) -> Column:
    """The host of an address, in lower case, without port and credentials."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a name without dots has no domain of its own."""
    return F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise(F.lit(""))


def identify(docs: DataFrame, languages: list[str], model: np.ndarray, text: str = "text", declared: str | None = None, host: Column | None = None, out: str = "language", least: float = 0.5) -> DataFrame:
    """``docs`` with ``out``: ``lang, posterior, accepted, evidence`` (the text's best language)."""
    names = [*languages, UNKNOWN]
    size = len(names)
    none = F.array(*[F.lit(0.0)] * size)
    where = F.coalesce(host, F.lit("")) if host is not None else F.lit("")

    def table(rows: dict[str, list[float]], key: Column) -> Column:
        out_ = F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[key] if rows else F.lit(None)
        return F.coalesce(out_, none)

    def favour(name: str, p: float) -> list[float]:
        return [float(np.log(p if x == name else (1 - p) / (size - 1))) for x in names]

    said = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{declared}`"), F.lit("")), "^([A-Za-z]+)", 1)) if declared else F.lit("")
    claim = table({x: favour(x, DECLARED) for x in languages}, said)
    suffix = table({s: favour(x, 0.8) for s, x in SUFFIXES.items() if x in languages}, F.when(where.contains("."), F.substring_index(where, ".", -1)).otherwise(F.lit("")))
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), likelihoods(docs, text, model).alias("ll"), claim.alias("claim"), suffix.alias("suffix"), where.alias("host"))
    # ---- priors: corpus, then domain, then host, each smoothed towards the one before
    soft = scored.where("ll is not null").select("host", _soft(_added(F.col("ll"), F.col("claim"))).alias("p"))
    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(size)]
    hosts = cut(soft.groupBy("host").agg(*sums).withColumn("domain", domain_of(F.col("host"))))
    totals = hosts.agg(*[F.sum(f"n{i}") for i in range(size)]).first()
    corpus = np.array([t or 0.0 for t in totals]) + 1.0
    corpus /= corpus.sum()
    counts = F.array(*[F.col(f"n{i}") for i in range(size)])

    def smoothed(n: Column, prior: Column, weight: float) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x) + weight
        return F.zip_with(n, prior, lambda a, p: (a + weight * p) / total)

    domains = hosts.where("domain <> ''").groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(size)])
    base = F.array(*map(F.lit, corpus.tolist()))
    domains = domains.select("domain", smoothed(counts, base, DOMAIN_WEIGHT).alias("above"))
    priors = hosts.join(domains, "domain", "left").select("host", smoothed(counts, F.coalesce("above", base), HOST_WEIGHT).alias("prior"))
    priors = cut(priors.select("host", F.transform("prior", lambda p: F.log(p)).alias("prior")))
    fused = scored.join(priors, "host", "left")
    terms = _added(F.coalesce("ll", none), F.col("claim"), F.col("suffix"), F.coalesce("prior", F.transform(base, lambda p: F.log(p))))
    fused = fused.select("row", "ll", _soft(terms).alias("p"))
    labels = F.array(*map(F.lit, names))
    best = F.get(labels, (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    heard = F.get(labels, (F.array_position("ll", F.array_max("ll")) - 1).cast("int"))
    verdict = F.struct(best.alias("lang"), F.array_max("p").alias("posterior"), (F.col("ll").isNotNull() & (best != UNKNOWN) & (F.array_max("p") >= least)).alias("accepted"), heard.alias("evidence"))
    return fused.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out], verdict.alias(out))
