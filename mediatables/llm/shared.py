"""Helpers that the operators of this subpackage share.

Nothing here gathers rows on the driver: :func:`cut` writes a table into the
folder that the cluster names in ``spark.checkpoint.dir`` and reads it back, and
:func:`components` labels a graph with joins alone.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import BATCH_BYTES, bounded_batches  # noqa: F401

T = TypeVar("T")
#: Words are maximal runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


# --------------------------------------------------------------------------- tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one in the warehouse only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/cuts"
    return named


def cut(df: DataFrame, tidy: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    A lost executor costs at most the step being written; what was cut is read again.
    With ``tidy`` the session lets go of the shuffle files that the written plan no longer needs;
    tables of a few rows don't need that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    del df
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._cut_path
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of rows, written as JSON, up to which a table is broadcast.
BROADCAST_BYTES = 8 << 20


def light(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its rows take no more than ``most`` bytes.

    A larger table is joined by sorting, where adaptive execution splits the hot keys of the other side.
    """
    taken = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (taken or 0) <= most else df


_kept: dict[str, tuple[object, object]] = {}


def kept(name: str, of: object, make: Callable[[], T]) -> T:
    """What a worker keeps between batches and tasks: one thing, made anew for another ``name`` or ``of``.

    Workers outlive a stage, so what the last operator kept goes when the next begins.
    """
    known = _kept.get(name)
    if known is None or known[0] is not of:
        _kept.clear()
        _kept[name] = known = (of, make())
    return known[1]


def partitions_for(df_rows: int, rows_each: int, least: int = 1) -> int:
    """How many groups keep each near ``rows_each`` rows."""
    return max(least, -(-df_rows // rows_each))


# --------------------------------------------------------------------------- components


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """Connected components: ``node, component`` for each node of an edge (smallest id reachable).

    Alternate large-star and small-star joins: every node hands its larger neighbours, then
    its smaller ones, on to the smallest of all. Both keep what is connected, and each lowers
    the sum of the edges' ends until only stars around the smallest ids are left, which is
    what ends the loop; no number of rounds does. A path takes a logarithmic number of rounds
    in any order of its ids. Edges stay distributed; the driver sees one flag a round.
    Null ends and loops are left out; an empty table gives an empty table.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())  # u is the larger end
    while True:
        several = e.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("u")
        inner = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
        if not several.union(inner).limit(1).count():
            break
        around = e.select("u", F.col("v").alias("w")).union(e.select(F.col("v").alias("u"), F.col("u").alias("w"))).groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("low"))
        large = cut(e.select("u", F.col("v").alias("at")).join(around.select(F.col("u").alias("at"), "low"), "at").select("u", F.col("low").alias("v")).distinct())
        drop_cut(e)
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        handed = large.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = cut(handed.union(least.select("u", F.col("low").alias("v"))).distinct())
        drop_cut(large)
    labels = cut(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    drop_cut(e)
    return labels


# --------------------------------------------------------------------------- hashing in tasks

#: Odd multipliers of the rolling hashes, and seeds of their tables of bytes.
FIRST, SECOND = (0x9E3779B97F4A7C15, 20240601), (0xD1342543DE82EF95, 20240602)


@lru_cache(maxsize=4)
def _bytes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Powers that a worker keeps at most.
_KEPT_POWERS = 1 << 19
_powers: dict[int, list[np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; a worker keeps no long tables."""
    known = _powers.get(base)
    if known and len(known[0]) >= n:
        return known[0][:n], known[1][:n]
    tables = []
    for by in (base, pow(base, -1, 1 << 64)):
        row = np.full(1 << (n - 1).bit_length() if n <= _KEPT_POWERS else n, by, np.uint64)
        row[0] = 1
        tables.append(np.cumprod(row, dtype=np.uint64))
    if n <= _KEPT_POWERS:
        _powers[base] = tables
    return tables[0][:n], tables[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a new array)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any stretch of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray, constants: tuple[int, int] = FIRST) -> None:
        up, self.down = _power(constants[0], len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_bytes(constants[1])[data] * up[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int, upto: int | None = None) -> np.ndarray:
        """The hash of every window of ``length`` bytes (of the first ``upto`` starts)."""
        n = len(self.sums) - length if upto is None else upto
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])


def encoded(texts: Iterator) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def by_bytes(items: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most ``most`` bytes together (one item at least)."""
    start = total = 0
    for i, x in enumerate(items):
        if i > start and total + len(x) > most:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(items):
        yield start, len(items)
