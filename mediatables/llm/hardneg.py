"""Hard negatives by segment summaries.

A vector of whole numbers is cut into segments, and of each segment its mean and its
deviation (the length of what is left without the mean) are stored. Over a segment of ``m`` components
an inner product is ``m`` times the product of the means plus at most, and minus at least, the
product of the deviations; summed over segments that bounds a score from both sides. Segments are refined
level by level (``LEVELS`` components each); what no bound settles is scored exactly.

* **Cells.** Rows of one dimension are grouped by label and by the side of their projections on a few
  directions of a bounded sample (``SAMPLE`` rows at most; it steers the work only). A cell keeps
  the range of the means and the largest deviation of each coarse segment. There are at most
  ``GROUPS * 2**BITS`` cells whatever the table's size, so their summaries are a broadcast of bounded size;
  a cell's rows are dealt out in parts of ``PART``.
* **Positives.** An anchor looks through its own cell first. Its fifth best score there is the bar that the upper
  bound of another cell of its label must reach before any of that cell's parts gets the anchor.
* **Negatives.** Each positive sets a window of scores. An anchor visits the cells whose bounds reach
  into one of its windows; best cells first do not matter, as each task returns the best ``k`` of its part a window
  and Spark keeps the best of those.
* **In a task**, a part meets the anchors that visit it, at most ``ANCHORS`` at a time. Rows come
  in slices; before a slice is scored, its bounds are held against the bars that earlier slices have set, level by level,
  and only rows that some anchor still needs, and anchors that need some row, go on.

Scores are exact: sums below 2**53 are taken in doubles, larger ones in whole numbers of any size (beyond 64
bits they are clipped on return). On vectors that are spread evenly over a sphere, bounds of coarse segments
settle little; nothing but work depends on that.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component (256 times it included) take no part. Of rows that repeat
an id the one of the smallest label and vector takes part. Only vectors of one dimension have a score.
Equal scores go by the smaller id. An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, cut, drop_cut
from .vectors import dimensions

LEVELS = (16, 4)
GROUPS, BITS = 64, 6
PART = 16_384
ANCHORS = 4_096
SLICE = 2_048
SAMPLE = 4_096
#: Slack of bounds, as a share of the two vectors' lengths: single precision is off by less.
SLACK = 1e-5
_LOW = np.iinfo(np.int64).min


# --------------------------------------------------------------------------- summaries


def segments(dim: int, width: int) -> np.ndarray:
    """Where the segments of about ``width`` components begin."""
    return np.arange(0, dim, width)


def summary(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean (times the root of the segment's length) and deviation of each segment of each row.

    With means scaled so, products of both are sums over components.
    """
    at = segments(x.shape[1], width)
    size = np.diff(np.append(at, x.shape[1]))
    mean = np.add.reduceat(x, at, axis=1) / np.sqrt(size)
    square = np.add.reduceat(x * x, at, axis=1)
    return mean, np.sqrt(np.maximum(square - mean**2, 0))


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What each product of a row of ``a`` and one of ``b`` is at least and at most, but for rounding."""
    means, spread = a[0] @ b[0].T, a[1] @ b[1].T
    return means - spread, means + spread


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers (held in doubles)."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = np.abs(a).max() * np.abs(b).max() * a.shape[1]  # no sum of some of the products is larger
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = [[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in b] for u in a]
    return np.array([[min(max(s, _LOW + 1), 2**63 - 1) for s in row] for row in exact], np.int64)


# --------------------------------------------------------------------------- vectors


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        flat = np.floor(np.asarray(lists.flatten(), np.float64) * 256)
        upto = np.asarray(lists.offsets) - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
        ok = np.array([b > a and bool(np.isfinite(flat[a:b]).all()) for a, b in zip(upto, upto[1:], strict=False)], bool)
        rows = np.flatnonzero(ok)
        packed = [flat[upto[i] : upto[i + 1]].tobytes() for i in rows]
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.diff(upto)[rows], pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "label", "dim", "vec"])


def whole_vectors(table: DataFrame, vector: str, vec_id: str, label: Column) -> DataFrame:
    """``vec_id, label, dim, vec``: each component as floor(256 * x), in doubles, as bytes."""
    rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null or isnan(x))")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.label", "one.v")
    return one.mapInArrow(_whole, "vec_id long, label long, dim int, vec binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


# --------------------------------------------------------------------------- cells


class Cells:
    """Directions and medians that tell a vector's cell, and each cell's summary."""

    def __init__(self, sample: np.ndarray, rows: int) -> None:
        self.bits = min(BITS, max(0, int(np.ceil(np.log2(max(1, rows / GROUPS / PART))))), sample.shape[1])
        sample = np.clip(sample, -1e6, 1e6)
        centred = sample - sample.mean(axis=0)
        _, turned = np.linalg.eigh(centred.T @ centred)
        self.turn = turned[:, ::-1][:, : self.bits]
        self.middle = np.median(sample @ self.turn, axis=0)

    def of(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        side = (x @ self.turn > self.middle) @ (1 << np.arange(self.bits))
        return (group << BITS) | side.astype(np.int64)

    def known(self, summaries: list) -> None:
        """Boxes of means and largest deviations of the cells that have rows."""
        self.cell = np.array([r["cell"] for r in summaries], np.int64)
        self.parts = np.array([r["parts"] for r in summaries], np.int64)
        self.low, self.high, self.spread = (np.array([r[k] for r in summaries]) for k in ("low", "high", "spread"))

    def reach(self, mean: np.ndarray, spread: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each vector's scores with the rows of each cell."""
        up, down = np.maximum(mean, 0), np.minimum(mean, 0)
        most = up @ self.high.T + down @ self.low.T
        least = up @ self.low.T + down @ self.high.T
        apart = spread @ self.spread.T + slack[:, None] * np.sqrt(np.maximum(self.low**2, self.high**2).sum(axis=1) + (self.spread**2).sum(axis=1))
        return least - apart, most + apart


_SUMMARY = "cell long, n long, low array<double>, high array<double>, spread array<double>"


def _boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a cell and batch: its rows' means' range and largest deviations."""
    for batch in batches:
        if len(batch):
            mean, spread = summary(_matrix(batch["vec"]), LEVELS[0])
            cell = batch["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            begin = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0))
            n = np.diff(np.append(begin, len(cell)))
            box = [list(f.reduceat(x[order], begin, axis=0)) for f, x in ((np.minimum, mean), (np.maximum, mean), (np.maximum, spread))]
            yield pd.DataFrame({"cell": cell[order][begin], "n": n, "low": box[0], "high": box[1], "spread": box[2]})


def _summaries(placed: DataFrame, segments_: int, part: int) -> DataFrame:
    every = [F.array(*[f(F.col(c)[k]) for k in range(segments_)]).alias(c) for c, f in (("low", F.min), ("high", F.max), ("spread", F.max))]
    made = placed.select("cell", "vec").mapInPandas(_boxes, _SUMMARY)
    return made.groupBy("cell").agg(F.ceil(F.sum("n") / part).cast("long").alias("parts"), *every)


# --------------------------------------------------------------------------- search in a task


def _best(pair: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries of each ``pair`` number: highest score, then smaller id."""
    order = np.lexsort((ids, -score, pair))
    begin = np.flatnonzero(np.append(True, np.diff(pair[order]) > 0)) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


class _Kept:
    """The best ``k`` rows of each window so far, and the bar that a window's next one must reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.bar = k, floor.copy()
        self.window, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        window, score, ids = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.ids, ids)))
        best = _best(window, score, ids, self.k)
        self.window, self.score, self.ids = window[best], score[best], ids[best]
        if len(best):
            worst = np.flatnonzero(np.append(np.diff(self.window) > 0, True))
            full = worst[np.bincount(self.window)[self.window[worst]] == self.k]
            self.bar[self.window[full]] = np.maximum(self.bar[self.window[full]], self.score[full])


def search(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> _Kept:
    """The best ``k`` of rows ``x`` in each window: of anchor ``owner``, with a score of ``low`` to ``high``.

    ``same`` looks for rows of the anchor's label but the anchor itself, else for those of other labels.
    """
    kept = _Kept(low, k)
    length_a, length = np.sqrt((a * a).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    mine = [tuple(s.astype(np.float32) for s in summary(a, w)) for w in LEVELS]
    top = np.full(len(a), _LOW)
    np.maximum.at(top, owner, high)
    for at in range(0, len(x), SLICE):
        rows, who = np.arange(at, min(len(x), at + SLICE)), np.arange(len(a))
        bar = np.full(len(a), np.iinfo(np.int64).max)
        np.minimum.at(bar, owner, kept.bar)
        for level, width in enumerate(LEVELS):
            theirs = tuple(s.astype(np.float32) for s in summary(x[rows], width))
            least, most = bounds(tuple(s[who] for s in mine[level]), theirs)
            slack = (SLACK * length_a[who])[:, None] * length[rows][None]
            open_ = ~((most + slack < bar[who][:, None]) | (least - slack > top[who][:, None]))  # what is no number stays open
            open_ &= (a_labels[who][:, None] == labels[rows][None]) == same
            rows, who = rows[open_.any(axis=0)], who[open_.any(axis=1)]
            if not len(rows):
                break
        if not len(rows):
            continue
        score = scores(a[who], x[rows])
        good = (score >= bar[who][:, None]) & (score <= top[who][:, None]) & ((a_labels[who][:, None] == labels[rows][None]) == same)
        if same:
            good &= a_ids[who][:, None] != ids[rows][None]
        i, j = np.nonzero(good)
        i, s, r = who[i], score[i, j], ids[rows[j]]
        # the windows of each anchor, in turn (``owner`` is sorted)
        first, last = np.searchsorted(owner, np.arange(len(a))), np.searchsorted(owner, np.arange(len(a)), side="right")
        for turn in range(int((last - first).max(initial=0))):
            window = first[i] + turn
            there = np.flatnonzero(window < last[i])
            window = window[there]
            within = (s[there] >= kept.bar[window]) & (s[there] <= high[window])
            kept.add(window[within], s[there][within], r[there][within])
    return kept


def _searched(same: bool, k: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        from_part = group["is_row"].to_numpy()
        rows, asked = group[from_part], group[~from_part]
        empty = pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("anchor_id", "positive_id", "vec_id", "score")})
        if not len(rows) or not len(asked):
            return empty
        asked = asked.sort_values(["vec_id", "positive_id"])
        ids = asked["vec_id"].to_numpy()
        new = np.append(True, np.diff(ids) != 0)
        owner, one = np.cumsum(new) - 1, np.flatnonzero(new)
        kept = search(
            _matrix(rows["vec"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(asked["vec"].iloc[one]), ids[one], asked["label"].to_numpy()[one],
            owner, asked["low"].to_numpy(), asked["high"].to_numpy(), same, k,
        )
        if not len(kept.window):
            return empty
        return pd.DataFrame({"anchor_id": ids[kept.window], "positive_id": asked["positive_id"].to_numpy()[kept.window], "vec_id": kept.ids, "score": kept.score})

    return run


_SIDES = ["cell", "part", "chunk", "is_row", "vec_id", "positive_id", "label", "vec", "low", "high"]


def _found(placed: DataFrame, visits: DataFrame, same: bool, k: int) -> DataFrame:
    """The best ``k`` of each window over the parts that its anchor visits: ``anchor_id, positive_id, vec_id, score, rank``.

    ``visits`` has ``cell, part, vec_id, positive_id, label, vec, low, high``.
    """
    sizes = visits.groupBy("cell", "part").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("chunks"))
    sized = visits.join(sizes, ["cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(3)), "chunks").cast("int")).withColumn("is_row", F.lit(False))
    none = F.lit(0).cast("long")
    rows = placed.join(sizes, ["cell", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"is_row": F.lit(True), "positive_id": none, "low": none, "high": none})
    parts = rows.select(*_SIDES).union(sized.select(*_SIDES)).groupBy("cell", "part", "chunk").applyInPandas(_searched(same, k), "anchor_id long, positive_id long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --------------------------------------------------------------------------- the operator


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), vector: str = "embedding", vec_id: str = "vec_id", part: int = PART) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` and ``label`` are expressions over the table's own columns. A negative's score is
    ``window[0]`` to ``window[1]`` hundredths of its positive's.
    """
    bounded_batches(table.sparkSession)
    anchors = table.where(is_anchor).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id")).distinct().withColumn("is_anchor", F.lit(True))
    vectors = cut(whole_vectors(table, vector, vec_id, label).join(anchors, "vec_id", "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False))))
    parts = [_of_dimension(vectors.where(F.col("dim") == dim), dim, n, positives, negatives, window, part) for dim, n in dimensions(vectors)]
    if not parts:
        return vectors.select(*[F.col("vec_id").alias(c) if c != "rank" else F.lit(1).alias("rank") for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]).where("false")
    return reduce(DataFrame.union, parts)


def _of_dimension(vectors: DataFrame, dim: int, rows: int, positives: int, negatives: int, window: tuple[int, int], part: int) -> DataFrame:
    spark = vectors.sparkSession
    some = vectors.select("vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    cells = Cells(_matrix([r["vec"] for r in some]), rows)

    def placed_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=cells.of(_matrix(batch["vec"]), batch["label_group"].to_numpy()) if len(batch) else np.empty(0, np.int64))

    grouped = vectors.select("vec_id", "label", "vec", "is_anchor", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).alias("label_group"))
    in_cells = cut(grouped.mapInPandas(placed_in, "vec_id long, label long, vec binary, is_anchor boolean, label_group long, cell long"))
    summaries = _summaries(in_cells, len(segments(dim, LEVELS[0])), part).collect()  # GROUPS * 2**BITS rows at most
    cells.known(summaries)
    known = spark.sparkContext.broadcast(cells)
    several = spark.createDataFrame([(int(r["cell"]), int(r["parts"])) for r in summaries], "cell long, parts long")
    placed = cut(in_cells.join(F.broadcast(several), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")))
    anchors = placed.where("is_anchor").select("vec_id", "label", "vec", "label_group", F.col("cell").alias("home"))

    def visits(asked: DataFrame, same: bool, away: bool) -> DataFrame:
        """The parts of the cells that a window's bounds reach: of its label's group, or of any."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = known.value
            for batch in batches:
                for at in range(0, len(batch), 512):
                    some = batch.iloc[at : at + 512]
                    x = _matrix(some["vec"])
                    mean, spread = summary(x, LEVELS[0])
                    least, most = m.reach(mean, spread, SLACK * np.sqrt((x * x).sum(axis=1)))
                    go = ~((most < some["low"].to_numpy()[:, None]) | (least > some["high"].to_numpy()[:, None]))
                    if same:
                        go &= (m.cell >> BITS)[None] == some["label_group"].to_numpy()[:, None]
                    if away:
                        go &= m.cell[None] != some["home"].to_numpy()[:, None]
                    i, j = np.nonzero(go)
                    n = m.parts[j]
                    i, j, begin = np.repeat(i, n), np.repeat(j, n), np.repeat(np.cumsum(n) - n, n)
                    number = np.arange(len(i)) - begin
                    for k in range(0, len(i), 8192):
                        out = some.iloc[i[k : k + 8192]].drop(columns=["label_group", "home"])
                        yield out.assign(cell=m.cell[j[k : k + 8192]], part=number[k : k + 8192].astype(np.int32))

        return asked.mapInPandas(run, "vec_id long, positive_id long, label long, vec binary, low long, high long, cell long, part int")

    lowest, highest = F.lit(_LOW), F.lit(2**63 - 1)
    unbound = anchors.withColumns({"positive_id": F.lit(-1).cast("long"), "low": lowest, "high": highest}).select("vec_id", "positive_id", "label", "vec", "low", "high", "label_group", "home")
    at_home = unbound.withColumnRenamed("home", "cell").join(F.broadcast(several), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    near = cut(_found(placed, at_home, True, positives))
    bar = near.where(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("bar"))
    further = unbound.join(bar, "vec_id", "left").withColumn("low", F.coalesce("bar", "low")).drop("bar")
    far = cut(_found(placed, visits(further.select(unbound.columns), True, True), True, positives))
    drop_cut(in_cells)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = near.drop("rank").union(far.drop("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    best = cut(best.select(F.col("anchor_id").alias("vec_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # ---- windows: 100 * score from window[0] to window[1] times the positive's
    score = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(score * window[0] / 100).cast("long"), F.floor(score * window[1] / 100).cast("long")
    asked = anchors.join(best, "vec_id").withColumns({"low": low, "high": high}).where("low <= high")
    found = _found(placed, visits(asked.select("vec_id", "positive_id", "label", "vec", "low", "high", "label_group", "home"), False, False), False, negatives)
    return found.join(best.select(F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score"), ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
