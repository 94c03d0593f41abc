"""Near-duplicate vectors: subspace pigeonhole join.

Unit vectors of cosine t are at squared distance 2 - 2t. After one random rotation they
are split into blocks of ``BLOCK_DIM`` dimensions; if all blocks of a pair were farther
apart than their share of that budget (in proportion to their dimensions), so would be
the pair, so every pair of cosine t or more lies within the share in some block. Each
block is joined by range: a grid over its two first coordinates gives each vector a
home cell, and it visits the other cells that its radius reaches; the pairs of a cell
within the radius in that block are compared in full, in double precision, on the
original vectors, some rows at a time: a part full of near copies needs no more memory. A pair that several blocks find counts in the first of them only.

Equal vectors form one class first, whose size weighs the link counts, so a vector that
very many rows share costs one row. Cells that hold many vectors are dealt out in parts of
``PART`` rows a side. A task returns one row a vector (its links and a root of its local
component), never pairs; joins over those roots give the components.

The grid's edges come from a sample of ``SAMPLE`` vectors at most; they steer the work only,
never the result. Vectors that are null, zero, or hold null or non-finite components link
with nothing and stay as their own component; so do vectors of a dimension that no other
has (each dimension is joined by itself). Rows without an id are left
out; of rows that repeat an id the one of the lowest dimension and least bytes counts. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut
from .vectors import dimensions, matrix, one_each, packed_vectors, sample_matrix

BLOCK_DIM = 16
PART = 16_384
#: Pairs of a part that a task holds at a time, however many lie near.
PAIRS = 1 << 20
SAMPLE = 4_096


class Blocks:
    """The rotation, each block's dimensions and radius, and its grid."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, part: int, seed: int = 5) -> None:
        d = sample.shape[1]
        self.turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
        self.cuts = [(a, min(d, a + BLOCK_DIM)) for a in range(0, d, BLOCK_DIM)]
        self.budget = 2 - 2 * cosine
        self.share = np.array([self.budget * (b - a) / d for a, b in self.cuts]) + 1e-9
        side = max(1, int(np.ceil(np.sqrt(rows / part))))
        z = self.unit(sample) @ self.turn
        inner = np.linspace(0, 1, side + 1)[1:-1]
        self.edges = [[np.quantile(z[:, min(a + k, b - 1)], inner) for k in range(2)] for a, b in self.cuts]
        self.side = side

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x**2).sum(axis=1, keepdims=True))

    def visits(self, z: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and home cell for each cell up to its home that a vector's radius reaches."""
        a, b = self.cuts[block]
        r, lo, hi, at = np.sqrt(self.share[block]), [], [], []
        for k in range(2):
            column, edge = z[:, min(a + k, b - 1)], self.edges[block][k]
            lo.append(np.searchsorted(edge, column - r))
            hi.append(np.searchsorted(edge, column + r))
            at.append(np.searchsorted(edge, column))
        home = at[0] * self.side + at[1]
        rows, cells = [], []
        for i in range(self.side):
            for j in range(self.side):
                cell = i * self.side + j
                there = np.flatnonzero((lo[0] <= i) & (i <= hi[0]) & (lo[1] <= j) & (j <= hi[1]) & (cell <= home))
                rows.append(there)
                cells.append(np.full(len(there), cell))
        row, cell = np.concatenate(rows), np.concatenate(cells)
        return row, cell, home[row]


def _rooted(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each component, when pairs join those that ``root`` names."""
    i, j = np.concatenate([i, np.arange(len(root))]), np.concatenate([j, root])
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _linked(model, cosine: float):
    """One part of a cell: links of each vector and a root of its local component."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, block = model.value, int(key[0])
        a, b = m.cuts[block]
        ids, size, home = rows["vec_id"].to_numpy(), rows["size"].to_numpy(), rows["is_home"].to_numpy()
        left, right = np.flatnonzero(rows["is_left"].to_numpy()), np.flatnonzero(~rows["is_left"].to_numpy())
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        if len(left) and len(right):
            raw = matrix(rows["vec"])
            norm = np.sqrt((raw**2).sum(axis=1))
            z = m.unit(raw) @ m.turn
            part = z[:, a:b].astype(np.float32)
            length = (part**2).sum(axis=1)
            limit = np.float32(m.share[block] + 1e-5)
            step = max(1, PAIRS // len(right))
            for at in range(0, len(left), step):
                x = left[at : at + step]
                near = length[x][:, None] + length[right][None] - 2 * (part[x] @ part[right].T) <= limit
                i, j = np.nonzero(near)
                i, j = x[i], right[j]
                keep = ~home[j] | (ids[i] < ids[j])  # of two in their home cell, once
                i, j = i[keep], j[keep]
                good = []
                for c in range(0, len(i), 1 << 16):
                    p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                    cos = (raw[p] * raw[q]).sum(axis=1) / (norm[p] * norm[q])
                    apart = (z[p] - z[q]) ** 2
                    within = np.array([apart[:, e:f].sum(axis=1) <= s for (e, f), s in zip(m.cuts, m.share, strict=True)])
                    good.append(np.flatnonzero((cos >= cosine) & within[block] & ~within[:block].any(axis=0)) + c)
                if good:
                    good = np.concatenate(good)
                    i, j = i[good], j[good]
                    np.add.at(links, i, size[j])
                    np.add.at(links, j, size[i])
                    root = _rooted(root, i, j)
        some = np.flatnonzero(links)
        return pd.DataFrame({"vec_id": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def near_vectors(table: DataFrame, cosine: float = 0.9, vector: str = "embedding", vec_id: str = "vec_id", part: int = PART) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept`` for links of at least ``cosine``."""
    everyone = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id")).where("vec_id is not null").distinct()

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(digest=[hashlib.blake2b(v, digest_size=16).digest() for v in batch["vec"]])

    packed = packed_vectors(table, vector, vec_id).mapInPandas(digested, "vec_id long, dim int, vec binary, digest binary")
    vectors = cut(one_each(packed))
    lone = everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = [_of_dimension(vectors.where(F.col("dim") == dim), cosine, part) for dim, _ in dimensions(vectors)]
    if not parts:
        return lone
    out = everyone.join(reduce(DataFrame.union, parts), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _of_dimension(vectors: DataFrame, cosine: float, part: int) -> DataFrame:
    """``vec_id, n_links, component_id`` of the vectors of one dimension."""
    spark = vectors.sparkSession
    classes = cut(vectors.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    reps = cut(vectors.join(classes.select(F.col("rep").alias("vec_id"), "size"), "vec_id").select("vec_id", "size", "vec"))
    rows = reps.count()
    model = spark.sparkContext.broadcast(Blocks(sample_matrix(reps, SAMPLE), rows, cosine, part))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            if not len(batch):
                continue
            z = m.unit(matrix(batch["vec"])) @ m.turn
            for block in range(len(m.cuts)):
                row, cell, home = m.visits(z, block)
                for at in range(0, len(row), 4096):
                    r, c = row[at : at + 4096], cell[at : at + 4096]
                    yield batch.iloc[r].assign(block=block, cell=c, is_home=c == home[at : at + 4096])

    placed = cut(reps.mapInPandas(dealt, "vec_id long, size long, vec binary, block int, cell int, is_home boolean"))
    parts = placed.groupBy("block", "cell").agg(F.greatest(F.ceil(F.count_if("is_home") / part), F.lit(1)).cast("int").alias("lefts"), F.greatest(F.ceil(F.count("*") / part), F.lit(1)).cast("int").alias("rights"))
    placed = placed.join(parts, ["block", "cell"])
    salt = F.xxhash64("vec_id")
    sides = ["block", "cell", "left", "right", "vec_id", "size", "vec", "is_home", "is_left"]
    lefts = placed.where("is_home").withColumn("left", F.pmod(salt, "lefts").cast("int")).withColumn("right", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("is_left", F.lit(True)).select(*sides)
    rights = placed.withColumn("right", F.pmod(salt, "rights").cast("int")).withColumn("left", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("is_left", F.lit(False)).select(*sides)
    found = cut(lefts.union(rights).groupBy("block", "cell", "left", "right").applyInPandas(_linked(model, cosine), "vec_id long, links long, root long"))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    named = classes.join(counts, classes.rep == counts.vec_id, "left").drop("vec_id").join(labels, classes.rep == labels.node, "left")
    named = named.select("digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return vectors.select("vec_id", "digest").join(named, "digest").select("vec_id", "n_links", "component_id")
