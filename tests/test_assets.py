"""Plans in words, several roots, bundles, lossy pictures and clip fallbacks on small inputs."""

import random

from pyspark.sql import functions as F

from mediatables.functions import timecode as TC
from mediatables.operators import layout, manifest, pixels
from mediatables.plans import images
from mediatables.sources import inventory

IMAGE = "image_id long, width long, height long, content string, compressed boolean"


def test_plan_texts(spark):
    rows = [(1, 1920, 1080, "photo", True), (2, 3840, 2160, "photo", False), (3, 500, 400, "anime", False), (4, 1000, 1000, None, None)]
    got = {r.image_id: r for r in images.plan_preview(spark.createDataFrame(rows, IMAGE)).collect()}
    assert got[1].plan == "nomos-webphoto x4 (x4) -> Lanczos to 3840x2160" and got[1].pass_sizes == ["7680x4320"] and got[1].notes == [images.LOSSY_NOTE]
    assert got[2].status == "skipped" and got[2].plan == "resample only -> 3840x2160" and got[2].skipped == "already 3840x2160, at or above 4k — nothing to upscale"
    assert got[2].peak_mpix == 8.3 and got[2].pass_sizes == []
    assert got[3].model == "anime" and got[3].notes == [images.ART_NOTE] and got[3].pass_sizes == ["2000x1600", "4000x3200"]
    assert got[3].plan == "anime x4 -> fast2x x2 (x8) -> Lanczos to 3840x3072"
    assert got[4].model == "nomos2-realplksr" and got[4].notes == [] and got[4].scale_for_4k == 3.84


def test_model_asked_for_and_bad_targets(spark):
    one = spark.createDataFrame([(1, 1000, 1000, "anime", True)], IMAGE)
    forced = images.plan_preview(one, "x20", override="ultrasharp").first()
    assert forced.model == "ultrasharp" and forced.notes == ["large job: peaks at 1024 MPix in RAM"] and forced.pass_sizes[-1] == "32000x32000"
    assert images.plan_preview(one, override="nothing").first().error == "unknown model"
    bad = images.plan_preview(one, "wide").first()
    assert (bad.status, bad.error, bad.plan, bad.skipped) == ("failed", "unknown target", None, None)
    assert images.plan_preview(one.limit(0)).count() == 0


def test_roots_and_named_files(spark, tmp_path):
    (tmp_path / "a/sub").mkdir(parents=True)
    for name, size in (("a/x.PNG", 5), ("a/y.txt", 1), ("a/sub/z.png", 2), ("n.raw", 3)):
        (tmp_path / name).write_bytes(b"." * size)
    roots = [str(tmp_path / "a"), str(tmp_path / "n.raw")]
    names = lambda deep: [(r.name, r.size) for r in inventory.discover(*inventory.list_roots(spark, roots, deep), ("png",)).collect()]
    assert names(False) == [("n.raw", 3), ("x.PNG", 5)]
    assert names(True) == [("z.png", 2), ("n.raw", 3), ("x.PNG", 5)]


def test_named_files_repeat_and_nulls_go(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, size long")
    got = inventory.discover(f([("a/b.png", 4), ("a/b.png", 3), (None, 1)]), f([("a/b.png", 9), ("c", None)]), ("png",)).collect()
    assert [(r.path, r.size) for r in got] == [("c", None), ("a/b.png", 3)]


def test_bundle_falls_back_to_its_profile(spark):
    rows = [
        ("v/zz.wav", None), ("v/voice.MP3", None), ("v/transcript.txt", "﻿  hello \n"), ("v/reference.txt", " \n"), ("v/profile.json", '{"transcript": "from profile", "language": "de", "options": {"speed": "1.2"}, "more": 1}'),
        ("w/a.flac", None), ("w/sample.txt", "﻿ said \n"), ("w/profile.json", "{bad"),
        ("x/profile.json", '{"description": "no audio"}'),
    ]
    f = spark.createDataFrame(rows, "path string, text string")
    got = {r.dir: r for r in inventory.assemble_bundles(inventory.described(f.select("path")), f.where("text is not null")).collect()}
    assert (got["v"].reference, got["v"].transcript, got["v"].transcript_text, got["v"].language, got["v"].options) == ("v/voice.MP3", "v/reference.txt", "from profile", "de", {"speed": "1.2"})
    assert (got["w"].reference, got["w"].transcript_text, got["w"].language) == ("w/a.flac", "said", None)
    assert (got["x"].valid, got["x"].description, got["x"].transcript_text) == (False, "no audio", None)


def test_lossy_extension_needs_no_pixels(spark):
    files = spark.createDataFrame([(1, "a.JPG"), (2, "b.png"), (3, "c.webp"), (4, None), (4, "d.png")], "image_id long, path string")
    grid = spark.range(64 * 64).select(F.lit(2).cast("long").alias("image_id"), F.floor(F.col("id") / 64).alias("y"), (F.col("id") % 64).alias("x"))
    grid = grid.select("image_id", "y", "x", *[(F.floor(F.col("x") / 8) * 30 % 256).alias(c) for c in "rgb"])
    got = {r.image_id: r.compressed for r in pixels.looks_compressed(grid, files).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_frames_of_unread_files_come_from_their_clips(spark):
    segments = spark.createDataFrame([(i, f) for i, f in enumerate("abcd")], "index int, file_path string")
    facts = spark.createDataFrame([("a", 8000, 2.5)], "path string, rate int, duration double")
    edges = spark.createDataFrame([], "path string, leading double, trailing double, reason string")
    clips = spark.createDataFrame([("a", 1, None, None), ("b", None, "00:00:02:01", None), ("c", 0, "bad", " 7 ")], "file_path string, stored long, code string, frames string")
    got = manifest.enrich_segments(segments, facts, edges, clips, TC.parse_rate(F.lit("25"))).collect()
    assert {r.file_path: r.source_frames for r in got} == {"a": 62, "b": 51, "c": 7, "d": None}
    assert {r.file_path: r.rate for r in got}["a"] == 8000


def test_placed_rows_have_status_and_timecode(spark):
    clips = spark.createDataFrame([("A1", 0, 30), ("A1", 1, 10)], "track string, pos int, length int")
    got = layout.placement_rows(layout.place_sequential(clips, 25, 5), TC.parse_rate(F.lit("25"))).orderBy("pos").collect()
    assert [(r.status, r.timeline_timecode) for r in got] == [("placed", "00:00:01:00"), ("placed", "00:00:02:10")]


def test_images_look_their_chains_up_in_their_own_row(spark):
    """Rows that repeat an id take the best chain of all of them; no image is sorted once a chain."""
    rng = random.Random(7)
    rows = [(rng.randint(0, 60), rng.choice([40, 320, 900, 2500, 4000]), rng.choice([30, 240, 700]), rng.choice(["anime", "photo"]), rng.random() < 0.5) for _ in range(200)]
    rows += [(k, 300 + k, 200, "photo", True) for k in range(100, 140)]
    planned = images.plan_images(spark.createDataFrame(rows, IMAGE), "8k")
    kind = lambda content, compressed: "anime" if content == "anime" else "nomos-webphoto" if compressed else "nomos2-realplksr"
    ranks = {}
    for i, width, height, content, compressed in rows:
        m = 7680 / max(width, height)
        if m > 1:
            ranks.setdefault(i, []).extend((c[2] < m, -c[2] if c[2] < m else 0, c[3], c[4], c[2], c[1]) for c in images.chains() if c[0] == kind(content, compressed))
    got = planned.collect()
    assert len(got) == len(rows)
    assert all((r.steps, r.passes) == (("+".join(min(ranks[r.image_id])[5]), min(ranks[r.image_id])[3]) if r.image_id in ranks else ("", 0)) for r in got)
    assert "SortAggregate" not in planned._jdf.queryExecution().executedPlan().toString()
