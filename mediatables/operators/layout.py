"""Clips on timelines: sequential placement, stitching, overlap search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import frames_to_timecode
from .prefix import running_sum, running_sums


def place_sequential(clips: DataFrame, start: int = 0, gap: int = 0) -> DataFrame:
    """``track, pos, length`` (``actual`` where known) laid end to end: adds ``record_frame, end_frame, drift``.

    A track's offsets are a running sum over its clips, in ranges of positions, so a track may hold any share of them.
    """
    used = F.coalesce("actual", "length") if "actual" in clips.columns else F.col("length")
    placed = running_sum(clips.withColumn("used", used), "track", "pos", F.col("used") + gap, "before")
    placed = placed.withColumn("record_frame", (F.lit(start) + F.col("before")).cast("long"))
    return placed.withColumn("end_frame", (F.col("record_frame") + F.col("used")).cast("long")).withColumn("drift", F.col("used") != F.col("length")).drop("used", "before")


def placement_rows(placed: DataFrame, rate: Column) -> DataFrame:
    """What a manifest keeps of placed clips: ``status`` placed and ``timeline_timecode`` of the record frame at the timeline's ``rate``."""
    return placed.withColumn("status", F.lit("placed")).withColumn("timeline_timecode", frames_to_timecode(F.col("record_frame"), rate))


def intended_range(clips: DataFrame, start: int = 0, gap: int = 0) -> DataFrame:
    """The frames of a track that ``track, length`` clips are about to take: ``track, start, end``.

    The gap after the last clip counts, and a range has one frame at least.
    """
    return clips.groupBy("track").agg(F.lit(start).cast("long").alias("start"), (F.lit(start) + F.greatest(F.coalesce(F.sum(F.col("length") + gap), F.lit(0)), F.lit(1))).cast("long").alias("end"))


#: A trimmed clip counts only if more seconds than these remain.
LEAST_TRIMMED = 0.1


def stitch_offsets(chunks: DataFrame, sentence_gap: float = 0.25, paragraph_gap: float = 0.6) -> DataFrame:
    """``doc_id, chunk_index, duration, ends_paragraph`` gets ``start, end`` in seconds.

    Where ``trimmed`` (seconds left without quiet edges) is known it is the clip's length, if more than
    ``LEAST_TRIMMED`` remains. Each clip but the last is followed by a gap; the last one's would stand before nothing.
    """
    length = F.col("duration")
    if "trimmed" in chunks.columns:
        length = F.when(F.col("trimmed") > LEAST_TRIMMED, F.col("trimmed")).otherwise(length)
    gap = F.when(F.col("ends_paragraph"), paragraph_gap).otherwise(sentence_gap)
    timed = running_sum(chunks.withColumn("clip", length), "doc_id", "chunk_index", F.col("clip") + gap, "start")
    return timed.withColumn("start", F.col("start").cast("double")).withColumn("end", F.col("start") + F.col("clip")).drop("clip")


def resume_frame(placed: DataFrame) -> DataFrame:
    """Where each track goes on: the latest end of what was placed, a frame at least each."""
    return placed.groupBy("track").agg(F.max(F.col("record_frame") + F.greatest(F.lit(1), F.col("end_frame") - F.col("record_frame"))).alias("resume_frame"))


def _nodes(first: Column, last: Column) -> Column:
    """The fewest aligned stretches of 2**level cells that make up the cells from ``first`` to ``last``.

    At each level at most two: the leftmost if its number is odd, and the rightmost if its is even.
    """
    levels = F.sequence(F.lit(0), F.length(F.bin(last - first + 1)))

    def stretches(level: Column) -> Column:
        low = -F.call_function("shiftright", -first, level)  # rounded up
        high = F.call_function("shiftright", last + 1, level)  # rounded down; none at or beyond it
        pick = lambda node, taken: F.when(taken, F.struct(level.cast("int").alias("level"), node.cast("long").alias("node")))
        return F.array(pick(low, (low < high) & (low % 2 != 0)), pick(high - 1, (low < high) & (high % 2 != 0)))

    return F.array_compact(F.flatten(F.transform(levels, stretches)))


#: Rows of a side that one cell of a grid holds: bounds what a task keeps at a time, and a cell's pairs by its square.
GRID_ROWS = 2048


def _grid(a: DataFrame, b: DataFrame, key: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` with ``row, col`` to join on besides: a hot key becomes a grid of many cells.

    Of a key with n rows in ``a`` and m in ``b``, those of ``a`` are dealt to n / size grid rows by their hash and copied to
    every column, and those of ``b`` the other way round, so each pair meets in one cell. No pair is left out, and for its
    n x m pairs at most 2 x n x m / size + n + m rows are dealt. Rows that are equal in every column stay together.
    """
    parts = lambda side, name: side.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    hot = parts(a, "rows").join(parts(b, "cols"), key).where("rows > 1 or cols > 1").hint("shuffle_hash")  # few rows, so the sides need no sort for them
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as tasks put together by their few bytes would make most of the pairs each

    def dealt(side: DataFrame, own: str, of: str, other: str, others: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*[F.col(c) for c in side.columns]), F.coalesce(F.col(of), F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce(F.col(others), F.lit(1)) - 1)
        return side.join(hot, key, "left").select(*side.columns, at.alias(own), F.explode(copies).alias(other)).repartition(tasks, *key, "row", "col")

    return dealt(a, "row", "rows", "col", "cols"), dealt(b, "col", "cols", "row", "rows")


def _stabbed(points: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Each point of ``track, at, ...`` with each range of ``track, first, last, ...`` (ends included) that holds it.

    A range becomes its stretches of cells of ``width``, a logarithmic number however long it is; a point
    asks for the stretch around it at each level that some range has. The stretches of a range are
    apart, so a pair meets in one of them only, and a hot stretch is dealt out by :func:`_grid`.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    held = ranges.withColumn("n", F.explode(_nodes(cell("first"), cell("last")))).select("*", "n.level", "n.node").drop("n")
    levels = [r[0] for r in held.select("level").distinct().collect()]  # 64 at most
    if not levels:
        levels = [0]
    asked = points.withColumn("level", F.explode(F.array(*[F.lit(k).cast("int") for k in sorted(levels)])))
    asked = asked.withColumn("node", F.call_function("shiftright", cell("at"), F.col("level")))
    asked, held = _grid(asked, held, ["track", "level", "node"], GRID_ROWS)
    return asked.join(held, ["track", "level", "node", "row", "col"]).where("at between first and last").drop("level", "node", "row", "col")


def overlap_conflicts(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of one track whose half-open ranges overlap: ``track, left_id, right_id``.

    Both sides have ``track, id, start, end`` in whole numbers. Of two ranges that overlap either the left
    one starts within the right one, or the right one starts later and within the left one: both
    are searches of points in ranges. ``width`` is the cell of the search, near the median length; ranges of
    any length cost a few rows. Null bounds and empty ranges have no pairs; rows that repeat an id
    have theirs each.
    """

    def sides(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        whole = side.where("track is not null and start is not null and `end` is not null and `end` > start")
        points = whole.select("track", F.col("id").alias(f"{name}_id"), F.col("start").cast("long").alias("at"), F.col("end").cast("long").alias("until"))
        return points, whole.select("track", F.col("id").alias(f"{name}_id"), F.col("start").cast("long").alias("first"), (F.col("end") - 1).cast("long").alias("last"))

    (a, in_a), (b, in_b) = sides(left, "left"), sides(right, "right")
    later = in_a.withColumn("first", F.col("first") + 1).where("first <= last")
    return _stabbed(a, in_b, width).select("track", "left_id", "right_id").union(_stabbed(b, later, width).select("track", "left_id", "right_id"))


def open_end_pairs(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of one track whose right range ends after the left one starts: ``track, left_id, right_id``.

    A left range has no end: it holds every right end past its start, up to the last there is. As
    many rows come out as there are pairs, near half of a track's left ranges times its right ones;
    :func:`open_end_counts` counts them without making any, and :func:`open_end_places` holds all of them in a row a range.
    """
    points = right.where("track is not null and `end` is not null").select("track", F.col("id").alias("right_id"), F.col("end").cast("long").alias("at"))
    most = F.broadcast(points.agg(F.max("at").alias("last")))  # one row for all tracks: one a track would bring a hot track's ranges into one task
    starts = left.where("track is not null and start is not null").select("track", F.col("id").alias("left_id"), (F.col("start") + 1).cast("long").alias("first"))
    return _stabbed(points, starts.crossJoin(most).where("first <= last"), width).select("track", "left_id", "right_id")


def open_end_counts(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """For each left range, how many right ranges of its track end after its start: ``track, left_id, n`` (n over 0).

    No pair is made: right ends and left starts become one row per track and moment, in bins of
    ``width``; a start gets the ends of all later bins and, by a running sum, the later ones of its own.
    """
    ends = right.where("track is not null and `end` is not null").groupBy("track", F.col("end").alias("at")).agg(F.count("*").alias("ends"))
    starts = left.where("track is not null and start is not null").select("track", F.col("id").alias("left_id"), F.col("start").alias("at"))
    points = ends.union(starts.select("track", "at", F.lit(0).cast("long").alias("ends"))).groupBy("track", "at").agg(F.sum("ends").alias("ends")).withColumn("bin", F.floor(F.col("at") / width))
    inside = Window.partitionBy("track", "bin").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy("track").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    later = points.groupBy("track", "bin").agg(F.sum("ends").alias("ends")).select("track", "bin", F.coalesce(F.sum("ends").over(beyond), F.lit(0)).alias("later"))
    counts = points.withColumn("own", F.coalesce(F.sum("ends").over(inside), F.lit(0))).join(later, ["track", "bin"]).select("track", "at", (F.col("own") + F.col("later")).alias("n"))
    return starts.join(counts, ["track", "at"]).where("n > 0").groupBy("track", "left_id").agg(F.sum("n").alias("n"))


def open_end_places(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of :func:`open_end_pairs` in as many rows as there are ranges: ``track, side, id, n, place``.

    A left range has a link with every right one that ends after its start: with the ``n`` latest. ``place`` is
    how many ranges of the own side come before in that order (right ones that end later, left ones that start earlier), so a left and
    a right row of one track are a pair if and only if the right one's place is below the left one's ``n``, and
    just as well if the left one's place is below the right one's ``n``. Ranges without a track or the bound that counts have no pairs: ``n`` 0, no place.
    """
    sides = left.select("track", F.lit("left").alias("side"), "id", F.col("start").cast("long").alias("at")).union(right.select("track", F.lit("right").alias("side"), "id", F.col("end").cast("long").alias("at")))
    whole = sides.where("track is not null and at is not null")
    moments = whole.groupBy("track", "at").agg(F.count_if(F.col("side") == "left").alias("starts"), F.count_if(F.col("side") == "right").alias("ends"))
    ends = moments.groupBy("track").agg(F.sum("ends").alias("all_ends"))
    before = running_sums(moments, "track", "at", {"started": F.col("starts"), "ended": F.col("ends")}).join(ends, "track")
    later = F.col("all_ends") - F.col("ended") - F.col("ends")
    known = before.select("track", "at", "started", later.alias("later"))
    is_left = F.col("side") == "left"
    placed = whole.join(known, ["track", "at"]).select("track", "side", "id", F.when(is_left, F.col("later")).otherwise(F.col("started")).alias("n"), F.when(is_left, F.col("started")).otherwise(F.col("later")).alias("place"))
    return placed.union(sides.where("track is null or at is null").select("track", "side", "id", F.lit(0).cast("long"), F.lit(None).cast("long")))


def overlap_places(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of :func:`overlap_conflicts` in as many rows as there are ranges: ``track, side, id, n, starts, ends, upto, beyond``.

    ``n`` is how many ranges of the other side overlap the row's. ``starts`` and ``ends`` say how many of the own
    side start, and end, before it; ranges of a side that are equal have both equal. ``upto`` of the other side start before its end, and ``beyond`` of them end by its start, so
    a left and a right row of one track are a pair if and only if ``starts`` of one is below ``upto`` of the other and
    its ``ends`` not below that one's ``beyond``. Null bounds and empty ranges have no pairs: ``n`` 0 and no places. No pair is made.
    """
    sides = left.select("track", F.lit("left").alias("side"), "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    sides = sides.union(right.select("track", F.lit("right").alias("side"), "id", F.col("start").cast("long"), F.col("end").cast("long")))
    valid = F.coalesce(F.col("track").isNotNull() & (F.col("end") > F.col("start")), F.lit(False))
    whole = sides.where(valid)
    bounds = whole.select("track", "side", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit("s").alias("kind")), F.struct(F.col("end").alias("at"), F.lit("e").alias("kind")))).alias("b"))
    counted = {f"{side}_{kind}": F.count_if((F.col("side") == side) & (F.col("b.kind") == kind)).alias(f"{side}_{kind}") for side in ("left", "right") for kind in "se"}
    moments = bounds.groupBy("track", F.col("b.at").alias("at")).agg(*counted.values())
    sums = running_sums(moments, "track", "at", {f"{c}_before": F.col(c) for c in counted})

    def of(kind: str, own: bool, upto_now: bool = False) -> Column:
        value = lambda side: F.col(f"{side}_{kind}_before") + (F.col(f"{side}_{kind}") if upto_now else F.lit(0))
        return F.when(F.col("side") == ("left" if own else "right"), value("left")).otherwise(value("right"))

    at_start = whole.join(sums.withColumnRenamed("at", "start"), ["track", "start"]).select("track", "side", "id", "end", of("s", True).alias("starts"), of("e", False, True).alias("beyond"))
    placed = at_start.join(sums.withColumnRenamed("at", "end"), ["track", "end"]).select("track", "side", "id", "starts", of("e", True).alias("ends"), of("s", False).alias("upto"), "beyond")
    rows = placed.select("track", "side", "id", (F.col("upto") - F.col("beyond")).alias("n"), "starts", "ends", "upto", "beyond")
    none = [F.lit(None).cast("long") for _ in range(4)]
    return rows.union(sides.where(~valid).select("track", "side", "id", F.lit(0).cast("long"), *none))


def overlap_windows(series: DataFrame, size: int, overlap: int) -> DataFrame:
    """``series_id, idx, value`` cut into overlapping windows: adds ``start, weight`` (raised cosine, floor 1e-3).

    Windows start every ``max(32, size - overlap)`` and the last is moved back to end with the series.
    """
    stride = max(32, size - overlap)
    extent = series.groupBy("series_id").agg((F.max("idx") + 1).alias("extent"))
    cells = series.where("idx >= 0").join(extent, "series_id")
    # a row's windows by arithmetic, so no table of their cells is made: those whose unmoved start lies near, and the last
    last = F.floor((F.greatest(F.lit(1), F.col("extent") - overlap) - 1) / stride)
    low = F.greatest(F.lit(0), F.floor((F.col("idx") - size) / stride) + 1)
    high = F.least(F.floor(F.col("idx") / stride), last)
    near_by = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    starts = F.array_distinct(F.transform(F.concat(near_by, F.array(last)), lambda k: F.greatest(F.lit(0), F.least(k * stride, F.col("extent") - size))))
    cells = cells.withColumn("len", F.least(F.lit(size), F.col("extent"))).withColumn("start", F.explode(F.filter(starts, lambda x: (x <= F.col("idx")) & (F.col("idx") < x + F.col("len")))))
    ramp = F.least(F.lit(overlap), F.floor(F.col("len") / 2))
    near = F.least(F.col("idx") - F.col("start"), F.col("start") + F.col("len") - 1 - F.col("idx"))
    weight = F.greatest(F.lit(1e-3), F.when(near < ramp, 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * (near + 0.5) / ramp)).otherwise(1.0))
    return cells.withColumn("weight", weight).select("series_id", "idx", "start", "weight", "value")


def overlap_blend(windows: DataFrame) -> DataFrame:
    """Windows put together again by weighted average: ``series_id, idx, value``."""
    total = F.greatest(F.sum("weight"), F.lit(1e-6))
    return windows.groupBy("series_id", "idx").agg((F.sum(F.col("weight") * F.col("value")) / total).alias("value"))
