"""Running sums in ranges, searches of ranges, and series at other rates, against plain versions."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mediatables.operators import layout, prefix, signal


def test_running_sum_equals_the_window(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.randint(0, 9)) for i in range(3000)] + [(f"t{i % 40}", i, i) for i in range(200)] + [(None, 4, 1), (None, 5, None), ("one", None, 3), ("one", 2, 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "track string, pos int, v long")
    w = Window.partitionBy("track").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    for ranges, sample in ((64, 512), (1, 16), (4096, 4096)):
        got = prefix.running_sum(df, "track", "pos", F.col("v"), "s", ranges, sample)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert prefix.running_sum(df.where("false"), "track", "pos", F.col("v"), "s").count() == 0


def test_a_hot_key_is_cut_into_ranges_of_like_size(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 100).otherwise(-1).alias("track"), (F.col("id") * F.col("id")).alias("pos"))
    sizes = [r["count"] for r in prefix.in_ranges(df, "track", "pos", 64, 4096).where("track = -1").groupBy("range_no").count().collect()]
    assert len(sizes) > 32 and max(sizes) < 6 * sum(sizes) / len(sizes)


def test_order_of_two_columns_numbers_rows(spark):
    rows = [(i % 2, f"2024-01-{i % 28 + 1:02d}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "user int, ts string, id int").withColumn("order", F.struct("ts", "id"))
    got = {r.id: r.n for r in prefix.row_numbers(df, "user", "order", "n").collect()}
    for user in (0, 1):
        mine = sorted((t, i) for u, t, i in rows if u == user)
        assert [got[i] for _, i in mine] == list(range(len(mine)))


def test_placing_of_odd_clips(spark):
    clips = spark.createDataFrame([("a", 1, 10, None), ("a", 2, 5, 4), ("a", 3, 7, None), ("b", 9, 1, None)], "track string, pos int, length long, actual long")
    got = {(r.track, r.pos): (r.record_frame, r.end_frame, r.drift) for r in layout.place_sequential(clips, 100, 2).collect()}
    assert got == {("a", 1): (100, 110, False), ("a", 2): (112, 116, True), ("a", 3): (118, 125, False), ("b", 9): (100, 101, False)}
    ends = {r.track: (r.start, r.end) for r in layout.intended_range(clips.withColumn("length", F.when(F.col("track") == "b", -2).otherwise(F.col("length"))), 100, 2).collect()}
    assert ends == {"a": (100, 128), "b": (100, 101)}


def test_trimmed_clips_count_only_if_enough_is_left(spark):
    chunks = spark.createDataFrame([(1, 0, 2.0, 1.5, False), (1, 1, 2.0, 0.1, True), (1, 2, 2.0, None, False), (1, 3, 2.0, 0.2, True)], "doc_id int, chunk_index int, duration double, trimmed double, ends_paragraph boolean")
    got = [(round(r.start, 6), round(r.end, 6)) for r in layout.stitch_offsets(chunks).orderBy("chunk_index").collect()]
    assert got == [(0.0, 1.5), (1.75, 3.75), (4.35, 6.35), (6.6, 6.8)]


# --------------------------------------------------------------------------- ranges


def _ranges(spark, rows):
    return spark.createDataFrame(rows, "track int, id int, start long, end long")


def _random_ranges(rng, n, upto):
    out = []
    for i in range(n):
        s = rng.randint(-upto, upto)
        out.append((rng.randint(0, 2), i, s, s + rng.choice([0, 1, 2, 5, 40, upto, -3])))
    return [*out, (None, 900, 0, 9), (0, 901, None, 5), (0, 902, 1, None), (1, 903, -upto * 9, upto * 9), (1, 903, -upto * 9, upto * 9)]


@pytest.mark.parametrize(("width", "upto"), [(1, 30), (7, 200), (1000, 100), (3, 10**12)])
def test_overlaps_equal_brute_force(spark, width, upto):
    rng = random.Random(width)
    a, b = _random_ranges(rng, 120, upto), _random_ranges(rng, 120, upto)
    whole = lambda rows: [r for r in rows if None not in r and r[2] < r[3]]
    want = sorted((x[0], x[1], y[1]) for x in whole(a) for y in whole(b) if x[0] == y[0] and y[2] < x[3] and y[3] > x[2])
    assert sorted(tuple(r) for r in layout.overlap_conflicts(_ranges(spark, a), _ranges(spark, b), width).collect()) == want
    started = [r for r in a if r[0] is not None and r[2] is not None]
    ended = [r for r in b if r[0] is not None and r[3] is not None]
    want = sorted((x[0], x[1], y[1]) for x in started for y in ended if x[0] == y[0] and y[3] > x[2])
    assert sorted(tuple(r) for r in layout.open_end_pairs(_ranges(spark, a), _ranges(spark, b), width).collect()) == want
    assert layout.overlap_conflicts(_ranges(spark, a).where("false"), _ranges(spark, b), width).count() == 0


def test_overlaps_in_grids_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(layout, "GRID_ROWS", 3)
    test_overlaps_equal_brute_force(spark, 7, 200)
    test_overlaps_equal_brute_force(spark, 1000, 100)


def test_open_ends_bring_no_track_together(spark):
    rows = _ranges(spark, [(0, 1, 0, 9)])
    plan = layout.open_end_pairs(rows, rows, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[track#\d+\],", plan)  # as it would be one task's work for a hot track


def test_a_hot_key_becomes_a_grid(spark):
    rows = lambda n, name: spark.range(n).select(F.lit("hot").alias("track"), F.col("id").alias(name)).union(spark.createDataFrame([("cold", 1), (f"only {name}", 2)], "track string, n long"))
    a, b = layout._grid(rows(2000, "x"), rows(500, "y"), ["track"], 100)
    for side, copies in ((a, {"hot": 2000 * 5, "cold": 1, "only x": 1}), (b, {"hot": 500 * 20, "cold": 1, "only y": 1})):
        assert {r["track"]: r["count"] for r in side.groupBy("track").count().collect()} == copies
    pairs = a.join(b, ["track", "row", "col"])
    assert pairs.select("track", "x", "y").distinct().count() == pairs.count() == 2000 * 500 + 1
    cells = [r["count"] for r in pairs.where("track = 'hot'").groupBy("row", "col").count().collect()]
    assert len(cells) == 20 * 5 and max(cells) < 3 * 100 * 100


@pytest.mark.parametrize(("seed", "upto"), [(1, 30), (2, 200), (3, 10**12)])
def test_places_tell_all_open_end_pairs(spark, seed, upto):
    rng = random.Random(seed)
    a, b = _random_ranges(rng, 120, upto), _random_ranges(rng, 120, upto)
    want = sorted((x[0], x[1], y[1]) for x in a if x[0] is not None and x[2] is not None for y in b if x[0] == y[0] and y[3] is not None and y[3] > x[2])
    rows = layout.open_end_places(_ranges(spark, a), _ranges(spark, b)).collect()
    ours, theirs = [r for r in rows if r.side == "left"], [r for r in rows if r.side == "right"]
    assert (len(ours), len(theirs)) == (len(a), len(b))
    here = [(x, y) for x in ours for y in theirs if x.track == y.track and None not in (x.place, y.place)]
    assert sorted((x.track, x.id, y.id) for x, y in here if y.place < x.n) == want
    assert sorted((x.track, x.id, y.id) for x, y in here if x.place < y.n) == want
    assert sum(x.n for x in ours) == sum(y.n for y in theirs) == len(want)
    assert layout.open_end_places(_ranges(spark, a).where("false"), _ranges(spark, b).where("false")).count() == 0


@pytest.mark.parametrize(("seed", "upto"), [(4, 30), (5, 200), (6, 10**12)])
def test_places_tell_all_overlaps(spark, seed, upto):
    rng = random.Random(seed)
    a, b = _random_ranges(rng, 120, upto), _random_ranges(rng, 120, upto)
    whole = lambda rows: [r for r in rows if None not in r and r[2] < r[3]]
    want = sorted((x[0], x[1], y[1]) for x in whole(a) for y in whole(b) if x[0] == y[0] and y[2] < x[3] and y[3] > x[2])
    rows = layout.overlap_places(_ranges(spark, a), _ranges(spark, b)).collect()
    ours, theirs = [r for r in rows if r.side == "left"], [r for r in rows if r.side == "right"]
    assert (len(ours), len(theirs)) == (len(a), len(b))
    here = [(x, y) for x in ours for y in theirs if x.track == y.track and None not in (x.starts, y.starts)]
    assert sorted((x.track, x.id, y.id) for x, y in here if y.starts < x.upto and y.ends >= x.beyond) == want
    assert sorted((x.track, x.id, y.id) for x, y in here if x.starts < y.upto and x.ends >= y.beyond) == want
    assert sum(x.n for x in ours) == sum(y.n for y in theirs) == len(want)
    assert layout.overlap_places(_ranges(spark, a).where("false"), _ranges(spark, b).where("false")).count() == 0


def test_a_range_is_few_stretches_that_tile_it(spark):
    rng = random.Random(3)
    rows = [(0, 0), (5, 5), (-7, -7), (-8, 7), (0, 2**40), (-(2**40) - 1, 2**40 + 1)] + [tuple(sorted((rng.randint(-500, 500), rng.randint(-500, 500)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("n", layout._nodes(F.col("a"), F.col("b")))
    for a, b, nodes in df.collect():
        tiles = sorted((n.node << n.level, (n.node + 1) << n.level) for n in nodes)
        assert tiles[0][0] == a and tiles[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(tiles, tiles[1:]))
        assert len(tiles) <= 2 * max(1, (b - a + 1).bit_length())


# --------------------------------------------------------------------------- rates


def _series(values):
    return [("s", i, float(v)) for i, v in enumerate(values)]


@pytest.mark.parametrize(("own", "to", "block"), [(2, 5, 4), (4, 8, 3), (3, 3, 2), (8, 3, 4), (1, 7, 1), (7, 1, 5)])
def test_other_rates_equal_plain_lines_and_means(spark, own, to, block):
    values = [((k * 37) % 11) - 5.0 for k in range(41)]
    got = {r.idx: r.value for r in signal.regrid_signal(spark.createDataFrame(_series(values), "series_id string, idx long, value double").withColumn("rate", F.lit(own)), to, block).collect()}
    want = {}
    if own >= to:
        for k, v in enumerate(values):
            want.setdefault(k * to // own, []).append(v)
        want = {k: sum(v) / len(v) for k, v in want.items()}
    else:
        for j in range(-(-len(values) * to // own)):
            i = j * own // to
            after = values[min(i + 1, len(values) - 1)]
            want[j] = values[i] + (after - values[i]) * (j * own / to - i)
    assert sorted(got) == sorted(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_series_of_several_rates_follow_each_other(spark):
    rows = [("a", i, 1.0, 2) for i in range(4)] + [("b", i, float(i), 4) for i in range(6)] + [("c", i, float(i), 1) for i in range(2)]
    order = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "a"), (2, 1, "c"), (2, 2, "a")], "group_id int, pos int, series_id string")
    got = signal.concat_signals(spark.createDataFrame(rows, "series_id string, idx long, value double, rate int"), order, 0.5, block=2)
    by = {g: [(r.idx, r.value) for r in got.where(F.col("group_id") == g).orderBy("idx").collect()] for g in (1, 2)}
    assert by[1] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0), (5, 0.5), (6, 2.5), (7, 4.5), (9, 0.0), (10, 0.5), (11, 1.0), (12, 1.0), (14, 1.0), (15, 1.0), (16, 1.0), (17, 1.0)]
    assert by[2] == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 1.0)]


def test_windows_of_each_row_equal_those_cut_from_the_series(spark):
    lengths, rows = {"a": 1, "b": 31, "c": 40, "d": 41, "e": 200, "f": 333}, []
    for name, n in lengths.items():
        rows += [(name, i, float(i)) for i in range(n) if i % 7 != 3 or i == n - 1]
    rows += [("e", 5, 1.0), (None, 1, 1.0), ("f", None, 1.0)]  # a place twice, no series, no place
    df = spark.createDataFrame(rows, "series_id string, idx long, value double")
    for size, overlap in ((40, 8), (100, 90), (33, 0)):
        want = []
        for name, n in lengths.items():
            starts = {max(0, min(x, n - size)) for x in range(0, max(1, n - overlap), max(32, size - overlap))}
            want += [(name, i, s) for x, i, _ in rows if x == name and i is not None for s in starts if s <= i < s + min(size, n)]
        windows = layout.overlap_windows(df, size, overlap)
        assert sorted((r.series_id, r.idx, r.start) for r in windows.collect()) == sorted(want)
        plan = windows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1  # the rows' windows, not the windows' cells
