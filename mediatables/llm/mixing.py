"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share all
words; a target stops at ``most`` times its source's words and the excess is shared again by
weight until none is above: the common share per weight rises until no further source
is above its bound, and the driver sees two sums a round.

Rates: among all document rates that give each source its target, entropy balancing takes
those nearest to one (least relative entropy, each document a unit). They are tilted
exponentially by what a document adds to the constraint, its size: ``exp(lambda_source *
size / mean size)``, at most ``most``. The multipliers solve the convex dual: every Newton
step sums its gradient and curvature over the documents in one grouped aggregation (documents
of one source and size are added up first, exactly) and is taken on the gradient's
logarithm, kept within the bracket that earlier steps proved. The driver sees one residual a step.

Copies: documents stand in a fixed order (source, falling size class, hash) and each gets the
whole numbers that the running sum of rates passes at it, so the copies of any stretch are
right to within one. The running sum is taken within buckets of bounded size, over the buckets
of a class and over the classes of a source, in exact decimals, so a source of any size is
many tasks' work and reruns agree. What rounding left is closed, large sizes first, by one
copy more or less of a few documents of each size class. Tables of rows a source are broadcast
where they have no more than ``LIGHT_ROWS`` rows, and else joined by sorting.

Null text has no words (size 0, taken 0). Rows equal in source, id and size get equal copies.
Sources without words have target 0. An empty table gives an empty table. Very long texts
only count their words; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .shared import WORD, cut

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a bucket of the running sum.
BUCKET = 50_000
#: Size classes, four an octave; texts of over 2**31 words share the last.
CLASSES = 128
#: Documents of a size class that may close what rounding left.
CHOICES = 8
#: Newton steps at most (an error beyond), and the relative distance from its target that ends them.
STEPS, NEAR = 60, 1e-6
#: Rows of some hundred bytes that are broadcast.
LIGHT_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows at most, marked for broadcast if they are few."""
    return F.broadcast(df) if rows <= LIGHT_ROWS else df


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (a row each) with ``number``: their place in code point order from 0, null last."""
    order = F.col("source").asc_nulls_last()
    ranged = cut(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), tidy=False)
    counts = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())  # a row a partition
    before = [(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
    starts = sources.sparkSession.createDataFrame(before, "range int, start long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranged.join(F.broadcast(starts), "range").withColumn("number", F.col("start") + within).drop("range", "start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``key, source_size, target`` from ``key, source, source_size`` (one row a source); other columns stay."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    w = cut(numbered(sources).withColumns({"weight": weight.cast("long"), "bound": most * F.col("source_size")}), tidy=False)
    share = 0.0
    while True:
        free = F.col("bound") > share * F.col("weight")
        held, weighed, size = w.agg(F.sum(F.when(~free, F.col("bound"))), F.sum(F.when(free, F.col("weight"))), F.sum("source_size")).first()
        higher = ((size or 0) - (held or 0)) / weighed if weighed else share
        if higher <= share:
            break
        share = higher
    return w.withColumn("target", F.least(F.col("bound").cast("double"), F.lit(share) * F.col("weight"))).drop("source", "number", "weight", "bound")


def balanced(mass: DataFrame, goals: DataFrame, sources: int, most: int = MOST, steps: int = STEPS, near: float = NEAR) -> DataFrame:
    """``key, multiplier``: the dual's solution. ``mass`` has ``key, tilt, words`` (words in all documents of a tilt), ``goals`` ``key, target``,
    ``sources`` rows.

    A target of ``most`` times the words or more has an infinite multiplier; null where there are no words.
    """
    words = mass.groupBy("key").agg(F.sum("words").alias("all"), F.sum(F.col("words") * F.col("tilt")).alias("leaning"))
    bounded = F.col("target") >= most * F.col("all") * (1 - near)
    start = F.when(bounded, F.lit(math.inf)).otherwise(F.log(F.col("target") / F.col("all")) * F.col("all") / F.col("leaning"))  # a step from zero
    state = goals.join(few(words, sources), "key").where("target > 0 and all > 0")
    state = cut(state.select("key", "target", start.alias("multiplier"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")), tidy=False)
    for _ in range(steps):
        rate = F.least(F.exp(F.col("multiplier") * F.col("tilt")), F.lit(float(most)))
        value = F.sum(F.col("words") * rate).alias("value")
        slope = F.sum(F.when(rate < most, F.col("words") * rate * F.col("tilt")).otherwise(0.0)).alias("slope")
        sums = mass.join(few(state.where(F.col("multiplier") < math.inf), sources), "key").groupBy("key").agg(value, slope)
        met = state.join(few(sums, sources), "key", "left")
        off = F.when(F.col("value").isNull(), 0.0).otherwise(F.abs(F.col("target") - F.col("value")) / F.col("target"))
        low = F.when(F.col("value") < F.col("target"), F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(F.col("value") > F.col("target"), F.col("multiplier")).otherwise(F.col("high"))
        met = met.select("key", "target", "multiplier", low.alias("low"), high.alias("high"), off.alias("off"), (F.col("multiplier") + F.log(F.col("target") / F.col("value")) * F.col("value") / F.col("slope")).alias("step"))
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        middle = F.when(F.col("low") == -math.inf, F.col("high") - 2).when(F.col("high") == math.inf, F.col("low") + 2).otherwise((F.col("low") + F.col("high")) / 2)
        moved = F.when(F.col("off") <= near, F.col("multiplier")).when(inside, F.col("step")).otherwise(middle)
        seen = Observation()
        state = cut(met.select("key", "target", moved.alias("multiplier"), "low", "high", "off").observe(seen, F.max("off").alias("off")), tidy=False).drop("off")
        if (seen.get["off"] or 0.0) <= near:
            return state.select("key", F.round("multiplier", 9).alias("multiplier"))  # sums of doubles differ in their last bits from run to run
    raise RuntimeError(f"no solution to within {near} after {steps} steps")


def rate_of(multiplier: Column, tilt: Column, most: int) -> Column:
    """The rate of a document; null multipliers give none."""
    return F.coalesce(F.when(multiplier == math.inf, F.lit(float(most))).otherwise(F.least(F.exp(multiplier * tilt), F.lit(float(most)))), F.lit(0.0))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, text: str = "text", doc_id: str = "doc_id", source: str = "source", tilt: Column | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    ``tilt`` is a positive expression over ``size`` and ``mean`` (its source's mean size, of documents with words); by default their ratio.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`").cast("string")).alias("size"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    items = cut(rows.groupBy(key.alias("key"), "source", "doc_id", "size").agg(F.count("*").alias("rows")))
    sizes = cut(items.groupBy("key", "source", "size").agg(F.sum("rows").alias("n")), tidy=False)
    words = F.sum(F.col("size") * F.col("n"))
    per = cut(sizes.groupBy("key", "source").agg(words.alias("source_size"), (words / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean")), tidy=False)
    sources = per.count()
    goals = cut(targets(per, weights, most), tidy=False)
    lean = (tilt if tilt is not None else F.col("size") / F.col("mean")).cast("double")
    mass = cut(sizes.where("size > 0").join(few(goals, sources), "key").groupBy("key", lean.alias("tilt")).agg(words.alias("words")), tidy=False)
    goals = goals.join(few(balanced(mass, goals, sources, most), sources), "key", "left")
    rated = items.join(few(goals.select("key", "mean", "multiplier"), sources), "key").withColumn("rate", rate_of(F.col("multiplier"), lean, most).cast("decimal(20,9)"))
    # ---- copies: running sum of rates within buckets, over buckets, over size classes
    buckets = -(-items.count() // bucket) or 1
    rated = rated.withColumn("class", F.least(F.floor(4 * F.log2(F.col("size") + 1)), F.lit(CLASSES - 1)).cast("int")).withColumn("hash", F.xxhash64("doc_id", "size")).withColumn("part", F.pmod("hash", F.lit(buckets)))
    sums = cut(rated.groupBy("key", "class", "part").agg(F.sum("rate").alias("sum")), tidy=False)
    earlier = Window.unboundedPreceding, -1
    classes = sums.groupBy("key", "class").agg(F.sum("sum").alias("sum"))
    classes = classes.select("key", "class", F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy(F.desc("class")).rowsBetween(*earlier)), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum("sum").over(Window.partitionBy("key", "class").orderBy("part").rowsBetween(*earlier)), F.lit(0))
    classes_most = sources * CLASSES
    offsets = sums.select("key", "class", "part", inside.alias("inside")).join(few(classes, classes_most), ["key", "class"]).select("key", "class", "part", (F.col("above") + F.col("inside")).alias("offset"))
    within = Window.partitionBy("key", "class", "part").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rated.join(few(offsets, classes_most * buckets), ["key", "class", "part"]).withColumn("upto", F.col("offset") + F.sum("rate").over(within))
    half = F.lit("0.5").cast("decimal(20,9)")
    copies = F.floor(F.col("upto") + half) - F.floor(F.col("upto") - F.col("rate") + half)
    placed = cut(placed.select("key", "source", "doc_id", "size", "rows", "class", "hash", F.col("rate").cast("double").alias("rate"), F.least(copies, F.lit(most)).cast("int").alias("copies")))
    # ---- close what rounding left with a few documents of each class, the largest first, and the one that then fits best
    weight = F.col("size") * F.col("rows")
    gaps = placed.groupBy("key").agg(F.sum(weight * F.col("copies")).alias("got")).join(few(goals, sources), "key").select("key", (F.col("target") - F.col("got")).alias("gap"))
    may = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0) & (weight > 0) & (weight < 2 * F.abs("gap"))
    one = placed.join(few(cut(gaps, tidy=False), sources), "key").where(may).groupBy("key", "class", F.pmod("hash", F.lit(CHOICES)).alias("choice"), "gap").agg(F.min(F.struct("hash", "doc_id", "size", weight.alias("weight"))).alias("one"))
    able = one.groupBy("key", "gap").agg(F.sort_array(F.collect_list(F.struct(F.col("one.weight").alias("weight"), "one.hash", "one.doc_id", "one.size")), asc=False).alias("able"))  # CHOICES rows a class
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<boolean>").alias("taken"))

    def closer(state: Column, x: Column) -> Column:
        fits = x["weight"] <= state["left"]
        return F.struct((state["left"] - F.when(fits, x["weight"]).otherwise(0)).alias("left"), F.concat(state["taken"], F.array(fits)).alias("taken"))

    able = able.withColumn("state", F.aggregate("able", start, closer)).select("key", "gap", "state.left", F.arrays_zip("able", F.col("state.taken").alias("taken")).alias("x"))
    last = F.array_min(F.transform(F.filter("x", lambda x: ~x["taken"] & (x["able"]["weight"] < 2 * F.col("left"))), lambda x: F.struct(F.abs(F.col("left") - x["able"]["weight"]).alias("off"), x["able"].alias("able"))))["able"]
    taken = F.transform(F.filter("x", lambda x: x["taken"]), lambda x: x["able"])
    moves = able.select("key", F.signum("gap").cast("int").alias("move"), F.explode(F.concat(taken, F.filter(F.array(last), lambda x: x.isNotNull()))).alias("x"))
    moves = moves.select(F.col("key").alias("moved_key"), F.col("x.doc_id").alias("moved_id"), F.col("x.size").alias("moved_size"), "move")
    same = (F.col("key") == F.col("moved_key")) & F.col("doc_id").eqNullSafe(F.col("moved_id")) & (F.col("size") == F.col("moved_size"))
    closed = placed.join(few(moves, classes_most * CHOICES), same, "left").withColumn("copies", (F.col("copies") + F.coalesce("move", F.lit(0))).cast("int"))
    out = closed.join(few(goals.select("key", "source_size", "target"), sources), "key").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it (rows without copies are gone)."""
    plan = mixture(docs, weights, most, text, doc_id, source).where("copies > 0").select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), "copies").distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    same = F.col("row")[doc_id].eqNullSafe(F.col("mix_id")) & F.col("row")[source].eqNullSafe(F.col("mix_source")) & (word_count(F.col("row")[text].cast("string")) == F.col("mix_size"))
    out = rows.join(plan, same).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*[F.col("row")[c].alias(c) for c in names])
