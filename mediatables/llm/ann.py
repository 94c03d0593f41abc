"""Approximate nearest neighbours: multiprobe p-stable hashing.

Each of ``tables`` tables hashes a vector by ``functions`` Gaussian projections cut into
cells of one width (a 2-stable family, so the distance of two projections follows the
Euclidean distance). A query visits the buckets around its own in the order of their
estimated success: the probability, for a neighbour at the distance that a bounded
sample shows, of falling into the bucket, from how near the query lies to each cell's
edges. It stops when the visited buckets hold ``success`` of that probability. The
candidates of all tables are merged and ranked by their exact distance.

Buckets are packed into groups of about ``SLICE`` vectors; a bucket that holds more is
salted over several groups, which the queries visit all. A task compares its group with
the queries that probe it by one matrix product and keeps ``k`` rows a query. Nothing is
capped: a query for which the visited buckets hold fewer than ``k`` vectors is answered by
the whole table in blocks.

The fit looks at ``SAMPLE`` vectors at most (the width and the neighbour distance come
from them); every vector is indexed. Vectors that are null, zero, or hold null or
non-finite components take no part; each dimension is searched by itself. Equal distances rank by the smaller id; of rows that repeat an id the one of
the lowest dimension and least bytes counts, an empty table gives an empty table, and columns besides the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, mix
from .vectors import dimensions, matrix, one_each, packed_vectors, sample_matrix

TABLES, FUNCTIONS, WIDTH, SUCCESS = 6, 8, 2.0, 0.42
SLICE = 8_192
SAMPLE = 4_096
_FOUND = "query_id long, vec_id long, score double"


class Tables:
    """The projections of all tables, and how far a neighbour is expected."""

    def __init__(self, sample: np.ndarray, tables: int, functions: int, width: float, k: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        spread = float(np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
        self.width = width * spread
        self.axes = rng.standard_normal((tables, sample.shape[1], functions))
        self.shift = rng.uniform(0, self.width, (tables, functions))
        some = sample[:128]
        apart = np.sqrt(np.maximum(0, (some**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * some @ sample.T))
        apart.sort(axis=1)
        self.near = float(np.median(apart[:, min(k, len(sample) - 1)])) or 1e-3 * spread
        self.moves = np.array(list(product((-1, 0, 1), repeat=functions)), np.int64)
        self.odd = np.random.default_rng(seed + 1).integers(1, 2**63, functions, dtype=np.uint64) | np.uint64(1)

    def cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each projection, and how far into it the vector lies."""
        at = (x @ self.axes[table] + self.shift[table]) / self.width
        cell = np.floor(at)
        return cell.astype(np.int64), (at - cell) * self.width

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        return mix((cells.view(np.uint64) * self.odd).sum(axis=-1, dtype=np.uint64)).view(np.int64)

    def probes(self, x: np.ndarray, table: int, success: float) -> Iterator[np.ndarray]:
        """For each query its buckets, the likeliest first, up to the wanted success."""
        cell, inside = self.cells(x, table)
        norm = np.vectorize(lambda z: 0.5 * (1 + erf(z / 2**0.5)))
        edge = norm((np.arange(-1, 3)[:, None, None] * self.width - inside) / self.near)
        chance = np.maximum(edge[1:] - edge[:-1], 1e-300)
        pick = np.arange(cell.shape[1])
        for i in range(len(x)):
            p = chance[self.moves + 1, i, pick].prod(axis=1)
            order = np.argsort(-p, kind="stable")
            upto = int(np.searchsorted(np.cumsum(p[order]) / p.sum(), success)) + 1
            yield self.bucket(cell[i] + self.moves[order[:upto]])


def _nearest(k: int):
    """Queries and points of one group: the ``k`` nearest points in the buckets that each query visits."""

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            x, ids = matrix(points["vec"]), points["vec_id"].to_numpy()
            lengths, bucket = (x**2).sum(axis=1), points["bucket"].to_numpy()
            for a in range(0, len(queries), 256):
                part = queries.iloc[a : a + 256]
                q = matrix(part["vec"])
                own = (q**2).sum(axis=1)
                rough = own[:, None] + lengths[None] - 2 * q @ x.T
                for i, (query, visits) in enumerate(zip(part["vec_id"], part["buckets"], strict=True)):
                    allowed = ids != query
                    if visits is not None and len(visits):
                        allowed &= np.isin(bucket, visits)
                    at = np.flatnonzero(allowed)
                    if not len(at):
                        continue
                    d = rough[i, at]
                    if len(at) > k:  # near ties stay, for the exact distance to settle
                        at = at[d <= np.partition(d, k - 1)[k - 1] + 1e-9 * (own[i] + lengths.max())]
                    exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[at], exact))[:k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of the candidates of all tables; a query has few, so its group is small."""
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "one")).select("query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", "one.score")


def nearest(table: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id", tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, success: float = SUCCESS, slice_rows: int = SLICE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``is_query`` (over ``vec_id``) holds."""
    spark = table.sparkSession
    vectors = cut(one_each(packed_vectors(table, vector, vec_id)))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, n in dimensions(vectors):
        if n > 1:
            out = out.union(_of_dimension(vectors.where(F.col("dim") == dim).select("vec_id", "vec"), dim, n, is_query, k, tables, functions, width, success, slice_rows).select(*out.columns))
    return out


def _of_dimension(vectors: DataFrame, dim: int, n: int, is_query: Column, k: int, tables: int, functions: int, width: float, success: float, slice_rows: int) -> DataFrame:
    """:func:`nearest` among ``n`` vectors of one dimension."""
    spark = vectors.sparkSession
    model = spark.sparkContext.broadcast(Tables(sample_matrix(vectors, SAMPLE), tables, functions, width, k))
    groups = -(-n // slice_rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            x = matrix(batch["vec"]) if len(batch) else np.empty((0, dim))
            for t in range(tables):
                yield batch.assign(table=t, bucket=m.bucket(m.cells(x, t)[0]))

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            for a in range(0, len(batch), 128):
                part = batch.iloc[a : a + 128]
                x = matrix(part["vec"])
                for t in range(tables):
                    yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "table": t, "buckets": list(m.probes(x, t, success))})

    points = vectors.mapInPandas(hashed, "vec_id long, vec binary, table int, bucket long")
    queries = vectors.where(is_query)
    sizes = cut(points.groupBy("table", "bucket").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("salts")))
    group = F.pmod(F.xxhash64("bucket", "salt"), F.lit(groups)).cast("int").alias("group")
    dealt = points.join(sizes, ["table", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), "salts").cast("int")).select("table", group, "bucket", "vec_id", "vec")
    visits = queries.mapInPandas(probing, "vec_id long, table int, buckets array<long>").select("vec_id", "table", F.explode("buckets").alias("bucket"))
    visits = visits.join(sizes, ["table", "bucket"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("vec_id", "table", "bucket", group)
    visits = visits.groupBy("vec_id", "table", "group").agg(F.collect_set("bucket").alias("buckets")).join(queries, "vec_id").select("table", "group", "vec_id", "vec", "buckets")
    found = dealt.groupBy("table", "group").cogroup(visits.groupBy("table", "group")).applyInPandas(_nearest(k), _FOUND)
    top = cut(_top(found, k))
    # ---- queries that found too few are answered by all rows, in blocks
    few = cut(queries.join(top.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)), F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "vec"))
    blocks = few.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "vec_id", "vec", F.lit(None).cast("array<long>").alias("buckets"))
    everywhere = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"), "vec_id", "vec", F.lit(0).cast("long").alias("bucket"))
    if few.limit(1).count():
        rest = everywhere.groupBy("group").cogroup(blocks.groupBy("group")).applyInPandas(_nearest(k), _FOUND)
        top = _top(top.select("query_id", "vec_id", "score").union(rest), k)
    return top
