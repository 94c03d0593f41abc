"""Running sums over keys that may hold most of a table.

A window over a key is one task's work. Here a key's rows are cut into ranges of its order, at
places that a bounded sample suggests: each range gets its own running sum, one row a range
goes into a second running sum, and a join hands every range what lies before it. So a key of any
size takes as many tasks as it has ranges, and only rows of the same key and order value stay together.

The sample steers the work only: whatever the ranges, sums are those of one window over the
key (of doubles, up to the last bits, as they are added in another order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample, and ranges of all keys together: what the driver holds and Spark broadcasts.
SAMPLE, RANGES = 16_384, 512


def in_ranges(rows: DataFrame, key: str, order: str, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """``rows`` with ``range_no``: which stretch of its key's order a row lies in (0 for keys with few rows).

    A key gets ranges by its share of the sample, taken by a hash of key and order, so equal tables
    are cut alike. Null keys are a key; a null order lies before all others.
    """
    some = rows.select(key, order).where(F.col(order).isNotNull())
    picked = some.orderBy(F.xxhash64(key, order), key, order).limit(sample)
    step = max(1, sample // ranges)
    ordered = Window.partitionBy(key).orderBy(order)
    # the window is over the sample's rows alone
    places = picked.withColumn("place", F.row_number().over(ordered)).where(F.col("place") % step == 0)
    cuts = places.groupBy(key).agg(F.array_sort(F.collect_set(order)).alias("cuts")).collect()
    if not cuts:
        return rows.withColumn("range_no", F.lit(0))
    held = rows.sparkSession.createDataFrame(cuts, places.groupBy(key).agg(F.collect_set(order).alias("cuts")).schema)
    held = F.broadcast(held.withColumnRenamed(key, "cut_key"))
    most = max(len(c["cuts"]) for c in cuts).bit_length()
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(most))])
    # how many cuts are at or below the order, by halving: beyond the last one a comparison is null
    at = F.aggregate(strides, F.lit(0), lambda n, stride: n + F.when(F.get("cuts", n + stride - 1) <= F.col(order), stride).otherwise(0))
    return rows.join(held, F.col(key).eqNullSafe(F.col("cut_key")), "left").withColumn("range_no", at).drop("cut_key", "cuts")


def running_sums(rows: DataFrame, key: str, order: str, values: dict[str, Column], ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """``rows`` with a column a name: the sum of its value over the rows of the key that come before (0 for the first).

    Null values count as 0. Rows of equal key and order get different sums, in any order among themselves.
    """
    own, total, before = ({n: f"_{kind}_{n}" for n in values} for kind in ("own", "total", "before"))
    cut = in_ranges(rows.withColumns({own[n]: F.coalesce(v, F.lit(0)) for n, v in values.items()}), key, order, ranges, sample)
    cut = cut.withColumn("_key", F.struct(key))  # a struct of null equals itself, so null keys meet in a plain join
    inside = Window.partitionBy("_key", "range_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_key", "range_no").agg(*[F.sum(own[n]).alias(total[n]) for n in values])
    earlier = totals.select("_key", "range_no", *[F.coalesce(F.sum(total[n]).over(across), F.lit(0)).alias(before[n]) for n in values])
    summed = cut.withColumns({own[n]: F.coalesce(F.sum(own[n]).over(inside), F.lit(0)) for n in values}).join(earlier, ["_key", "range_no"])
    return summed.withColumns({n: F.col(own[n]) + F.col(before[n]) for n in values}).drop("_key", "range_no", *own.values(), *before.values())


def running_sum(rows: DataFrame, key: str, order: str, value: Column, name: str, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """:func:`running_sums` of one value."""
    return running_sums(rows, key, order, {name: value}, ranges, sample)


def row_numbers(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the place of each row in its key's order, from 0."""
    return running_sum(rows, key, order, F.lit(1).cast("long"), name)
