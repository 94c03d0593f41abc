"""Sampled signals as rows ``series_id, idx, value`` (and ``rate``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_sum


def signal_levels(s: DataFrame) -> DataFrame:
    """Duration, peak and RMS level per series; silence has no level, and ``floored_db`` stops at -120."""
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    db = F.when(rms > 0, 20 * F.log10(rms))
    return s.groupBy("series_id").agg((F.count("*") / F.max("rate")).alias("duration"), F.max(F.abs("value")).alias("peak"), db.alias("rms_db"), F.greatest(F.coalesce(db, F.lit(-120.0)), F.lit(-120.0)).alias("floored_db"))


def mix_channels(s: DataFrame) -> DataFrame:
    """``series_id, channel, idx, value`` to one frame each: ``peak`` over channels and ``mono`` mean."""
    return s.groupBy("series_id", "idx").agg(F.max(F.abs("value")).alias("peak"), F.avg("value").alias("mono"))


def _loud(db: float):
    return F.abs("value") > 10 ** (db / 20)


def quiet_edges(s: DataFrame, threshold_db: float = -50.0) -> DataFrame:
    """Seconds before the first and after the last loud frame; all quiet gives zeros and ``silent``."""
    loud = F.when(_loud(threshold_db), F.col("idx"))
    a = s.groupBy("series_id").agg(F.min(loud).alias("a"), F.max(loud).alias("b"), F.max("idx").alias("n"), F.max("rate").alias("rate"))
    return a.select("series_id", F.coalesce(F.col("a") / F.col("rate"), F.lit(0.0)).alias("leading"), F.coalesce((F.col("n") - F.col("b")) / F.col("rate"), F.lit(0.0)).alias("trailing"), F.when(F.col("a").isNull(), "silent").alias("reason"))


def trim_quiet(s: DataFrame, threshold_db: float = -50.0, pad_ms: float = 40.0) -> DataFrame:
    """Samples from the first to the last loud one with padding, numbered anew; all quiet gives no rows."""
    loud = F.when(_loud(threshold_db), F.col("idx"))
    pad = F.floor(F.lit(pad_ms) / 1000 * F.max("rate")).cast("long")
    edge = s.groupBy("series_id").agg((F.min(loud) - pad).alias("a"), (F.max(loud) + pad).alias("b"))
    kept = s.join(edge, "series_id").where("idx between a and b")
    return kept.withColumn("idx", F.col("idx") - F.greatest("a", F.lit(0))).drop("a", "b")


def truncate_signal(s: DataFrame, seconds: float) -> DataFrame:
    return s.where(F.col("idx") < F.floor(F.lit(seconds) * F.col("rate")))


def taper_edges(s: DataFrame, ms: float) -> DataFrame:
    """Linear fade of n = ms of samples at both ends, unless the series is shorter than two fades."""
    n = F.floor(F.lit(ms) / 1000 * F.col("rate")).cast("long")
    total = s.groupBy("series_id").agg(F.count("*").alias("total"))
    step = F.least(F.col("idx"), F.col("total") - 1 - F.col("idx"))
    ramp = F.when((F.col("n") > 0) & (F.col("total") >= 2 * F.col("n")) & (step < F.col("n")), F.when(F.col("n") == 1, 0.0).otherwise(step / (F.col("n") - 1))).otherwise(1.0)
    return s.withColumn("n", n).join(total, "series_id").withColumn("value", F.col("value") * ramp).drop("n", "total")


def normalize_peak(s: DataFrame, peak_db: float = -1.0) -> DataFrame:
    """Scaled so that the largest sample has the wanted level; silence stays."""
    peak = s.groupBy("series_id").agg(F.max(F.abs("value")).alias("peak"))
    return s.join(peak, "series_id").withColumn("value", F.when(F.col("peak") > 0, F.col("value") * (10 ** (peak_db / 20)) / F.col("peak")).otherwise(F.col("value"))).drop("peak")


#: Samples of a block in which neighbours are looked up; the first of each is in the block before it as well.
BLOCK = 65_536


def _with_next(s: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``s`` with ``next``: the sample that follows, or the same one where none does."""
    number = F.floor(F.col("idx") / block)
    halo = s.withColumn("block", F.explode(F.when(F.col("idx") % block == 0, F.array(number, number - 1)).otherwise(F.array(number))))
    order = Window.partitionBy(*keys, "block").orderBy("idx")
    follows = F.when(F.lead("idx").over(order) == F.col("idx") + 1, F.lead("value").over(order))
    return halo.withColumn("next", F.coalesce(follows, "value")).where(F.col("block") == number).drop("block")


def _regridded(s: DataFrame, keys: list[str], to_rate: Column, block: int = BLOCK) -> DataFrame:
    """``*keys, idx, value`` at the rate ``to_rate``, in one pass over blocks of each series."""
    step = to_rate / F.col("rate")
    fewer = F.col("rate") >= to_rate
    first, end = F.ceil(F.col("idx") * step), F.ceil((F.col("idx") + 1) * step)
    spread = _with_next(s.withColumn("to_rate", to_rate), keys, block)
    spread = spread.withColumn("to", F.explode(F.when(fewer, F.array(F.floor(F.col("idx") * step))).otherwise(F.sequence(first, end - 1))))
    past = F.col("to") * F.col("rate") / F.col("to_rate") - F.col("idx")
    value = F.when(fewer, F.col("value")).otherwise(F.col("value") + (F.col("next") - F.col("value")) * past)
    return spread.groupBy(*keys, F.col("to").alias("idx")).agg(F.avg(value).alias("value"))


def regrid_signal(s: DataFrame, to_rate: int, block: int = BLOCK) -> DataFrame:
    """A bucket mean per sample of the new rate (fewer samples), or a straight line between neighbours (more).

    A sample that none follows is held, so the new series lasts as long as the old one.
    """
    return _regridded(s, ["series_id"], F.lit(to_rate), block).withColumn("rate", F.lit(to_rate))


def concat_signals(s: DataFrame, order: DataFrame, gap_seconds: float, block: int = BLOCK) -> DataFrame:
    """Series of each group one after the other: ``group_id, idx, value``; gaps are left out as silence.

    ``order`` has ``group_id, pos, series_id``. Series of other rates get the rate of their group's first.
    A group's offsets are a running sum in ranges of positions, so a group may hold any share of the series.
    """
    facts = s.groupBy("series_id").agg((F.max("idx") + 1).alias("n"), F.max("rate").alias("own_rate"))
    at = order.join(facts, "series_id")
    at = at.join(at.groupBy("group_id").agg(F.min_by("own_rate", "pos").alias("to")), "group_id")
    n, step = F.col("n"), F.col("to") / F.col("own_rate")
    size = F.when(F.col("own_rate") == F.col("to"), n).when(F.col("own_rate") > F.col("to"), F.floor((n - 1) * step) + 1).otherwise(F.ceil(n * step))
    at = running_sum(at, "group_id", "pos", size + F.floor(F.lit(gap_seconds) * F.col("to")), "offset")
    placed = s.join(at.select("series_id", "group_id", "pos", "to", "offset"), "series_id")
    same = placed.where("rate = to").select("group_id", (F.col("idx") + F.col("offset")).alias("idx"), "value")
    other = _regridded(placed.where("rate <> to").withColumnRenamed("to", "goal"), ["group_id", "pos", "offset"], F.col("goal"), block)
    return same.union(other.select("group_id", (F.col("idx") + F.col("offset")).alias("idx"), "value"))


def signal_quality_gate(levels: DataFrame, least_seconds: float = 3.0) -> DataFrame:
    """``ok`` and a reason: too short or nearly silent is rejected, over two minutes is a warning."""
    reason = F.when(F.col("duration") < least_seconds, "too short").when(F.col("peak") < 0.01, "nearly silent").when(F.col("duration") > 120, "long")
    return levels.withColumn("reason", reason).withColumn("ok", ~F.coalesce(reason.isin("too short", "nearly silent"), F.lit(False)))
