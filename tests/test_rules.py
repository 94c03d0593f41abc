"""Pinned cases of rules that the given tables don't show."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from mediatables.functions import text as T
from mediatables.functions import timecode as TC
from mediatables.operators import layout, manifest, signal
from mediatables.operators import text as ops
from mediatables.plans import images
from mediatables.sources import files, inventory, snapshot
from mediatables.streaming import intake


def _one(spark, expr, **columns):
    row = [tuple(columns.values())]
    return spark.createDataFrame(row, list(columns)).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("Dr. Smith left. He ran.", ["Dr. Smith left.", "He ran."]),
    ("Tea, milk, etc. Then we go. Yes!", ["Tea, milk, etc. Then we go.", "Yes!"]),
    ("At 9 a.m. Sharp. J. R. Tolkien wrote.", ["At 9 a.m. Sharp.", "J. R. Tolkien wrote."]),
    ("Wait... What? Fine.", ["Wait... What?", "Fine."]),
    ('He said "Go." Then left.', ['He said "Go."', "Then left."]),
    ("Pi is 3.14 today. see it. Ok.", ["Pi is 3.14 today. see it.", "Ok."]),
    ("今日は。明日も！はい", ["今日は。", "明日も！", "はい"]),
])
def test_narration_sentences(spark, text, want):
    assert [s.strip() for s in _one(spark, T.sentences_narration(F.col("t")), t=text)] == want


@pytest.mark.parametrize(("text", "want"), [
    ("Wait... What? Fine.", ["Wait...", "What?", "Fine."]),
    ("Wait... what? Fine.", ["Wait... what?", "Fine."]),
    ("It is approx. 5 items. Mt. Fuji rises.", ["It is approx. 5 items.", "Mt. Fuji rises."]),
    ("The u.s.a. team won. Good.", ["The u.s.a. team won.", "Good."]),
])
def test_prose_sentences(spark, text, want):
    assert [s.strip() for s in _one(spark, T.sentences_prose(F.col("t")), t=text)] == want


def test_bullets_open_paragraphs(spark):
    docs = spark.createDataFrame([(1, "Intro line\nwrapped\n- one\ncontinued\n2) two\n\nNext")], "doc_id long, text string")
    got = [r.text for r in ops.explode_paragraphs(docs).orderBy("paragraph_index").collect()]
    assert got == ["Intro line wrapped", "- one continued", "2) two", "Next"]


@pytest.mark.parametrize("limit", [20, 50, 99, 300])
def test_audit_finds_nothing(spark, limit):
    text = "See https://a.example/x,y (now). " + "word " * 90 + "x" * 120 + ", and - so on; more: yes. Ｅｎｄ é\n\n* a bullet\r\nand more"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "﻿Hi.")], "doc_id long, text string")
    assert ops.chunk_audit(ops.chunk_corpus(docs, max_chars=limit), docs, limit).collect() == []


def test_balanced_packing(spark):
    sentence = "A" + "b" * 43 + "."
    docs = spark.createDataFrame([(1, " ".join([sentence] * 5))], "doc_id long, text string")
    assert ops.chunk_corpus(docs, "prose", 100).count() == 3


@pytest.mark.parametrize(("spec", "code", "frames"), [("30", "00:01:00:00", 1800), ("29.97 DF", "00:10:00;00", 17982), ("29.97 DF", "01:00:00;00", 107892), ("24", "100:00:00:00", 8640000)])
def test_timecode_both_ways(spark, spec, code, frames):
    rate = TC.parse_rate(F.col("s"))
    assert _one(spark, TC.timecode_to_frames(F.col("c"), rate), s=spec, c=code) == frames
    assert _one(spark, TC.frames_to_timecode(F.col("f"), rate), s=spec, f=frames) == code


@pytest.mark.parametrize("spec", ["25 DF", "0", "fast", "", "-24"])
def test_bad_rates_are_null(spark, spec):
    assert _one(spark, TC.parse_rate(F.col("s")), s=spec) is None


def test_skipped_drop_frame_label_is_null(spark):
    assert _one(spark, TC.timecode_to_frames(F.col("c"), TC.parse_rate(F.col("s"))), s="29.97 DF", c="00:01:00;00") is None


def test_layout_uses_actual_lengths(spark):
    clips = spark.createDataFrame([(1, i, n, None) for i, n in enumerate((106, 107, 100, 107))], "track int, pos int, length long, actual long")
    got = layout.place_sequential(clips, 515)
    assert [r.record_frame for r in got.orderBy("pos").collect()] == [515, 621, 728, 828]


def test_overlap_touching_ends_do_not_meet(spark):
    a = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 200)], "track int, id int, start long, end long")
    b = spark.createDataFrame([(1, 9, 100, 150), (2, 8, 0, 500)], "track int, id int, start long, end long")
    assert [tuple(r) for r in layout.overlap_conflicts(a, b, 30).collect()] == [(1, 2, 9)]


def test_selection_rejects_reversed_ranges(spark):
    seg = spark.createDataFrame([("s", i, "failed") for i in range(9)], "script_id string, index int, status string")
    assert sorted(r["index"] for r in manifest.select_work(seg, "2,4-5").collect()) == [1, 3, 4]
    with pytest.raises(Exception, match="not a selection"):
        manifest.select_work(seg, "9-7").collect()


def _wav(tag, width, channels, rate, body):
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * width * channels, width * channels, width * 8)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def test_wav_widths_agree(spark, tmp_path):
    values = [0.0, 0.5, -0.5, 0.25]
    made = {
        "u8": _wav(1, 1, 1, 10, bytes(int(v * 128) + 128 for v in values)), "i16": _wav(1, 2, 1, 10, struct.pack("<4h", *(int(v * 32768) for v in values))),
        "i24": _wav(1, 3, 1, 10, b"".join(struct.pack("<i", int(v * 2**23))[:3] for v in values)), "f32": _wav(3, 4, 1, 10, struct.pack("<4f", *values)), "bad": b"RIFFxx",
    }
    for name, data in made.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    facts = {r.path.rsplit("/", 1)[1]: r for r in files.wav_catalogue(spark, str(tmp_path)).collect()}
    assert not facts["bad.wav"].ok and all(facts[f"{k}.wav"].frames == 4 for k in made if k != "bad")
    rows = files.sample_rows(files.wav_samples(spark, str(tmp_path), 3)).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v")).collect()
    assert len(rows) == 4 and all([x["value"] for x in r.v] == values for r in rows)


def test_text_files_of_all_encodings(spark, tmp_path):
    for name, data in {"a": b"\xef\xbb\xbfhello", "b": "café".encode("cp1252"), "c": b"  \n", "d": "né".encode()}.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r.path[-5]: (r.text, r.reason) for r in files.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got["a"] == ("hello", None) and got["b"][0] == "café" and got["c"][1] == "empty" and got["d"] == ("né", None)
    strict = {r.path[-5]: r.reason for r in files.read_text_corpus(spark, str(tmp_path), True).collect()}
    assert strict["b"] == "not UTF-8"


def test_manifest_reads_leniently_and_snapshots_pick_the_last(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.json").write_text('{"version": 1, "extra": 2, "segments": [{"index": 1, "status": "weird"}, {"index": 0, "status": "placed", "new": 3}]}')
    rows = files.read_manifest(spark, str(tmp_path / "m"))
    assert [(r["index"], r.status) for r in rows.collect()] == [(0, "placed"), (1, "pending")]
    for n in (1, 2):
        snapshot.write_snapshot(spark.range(n), str(tmp_path / "s"), n)
    assert snapshot.read_snapshot(spark, str(tmp_path / "s")).count() == 2


def test_inventory_takes_any_case_and_bundles(spark):
    f = spark.createDataFrame([("d/clip.Mp4", 3), ("d/old.webm", 1), ("d/n.txt", 1), ("d/clip.Mp4", 3)], "path string, size long")
    assert [r.name for r in inventory.scan_inventory(f, inventory.VIDEO).collect()] == ["clip.Mp4", "old.webm"]
    twice = [("a.mp4", 9), ("a.mp4", None), ("a.mp4", 7), ("a.mp4", 8), ("b.mp4", None), ("b.mp4", 5), (None, 1)] * 3
    for rows in (twice, twice[::-1]):
        least = inventory.scan_inventory(spark.createDataFrame(rows, "path string, size long").coalesce(1), inventory.VIDEO, "size")
        assert least.columns[:2] == ["path", "size"] and [(r.path, r["size"]) for r in least.collect()] == [("b.mp4", 5), ("a.mp4", 7)]
    b = inventory.described(spark.createDataFrame([("v/zz.wav",), ("v/Reference.wav",), ("v/transcript.txt",), ("w/.hidden.wav",), ("w/note.md",)], "path string"))
    got = {r.dir: (r.reference, r.transcript, r.valid) for r in inventory.assemble_bundles(b).collect()}
    assert got == {"v": ("v/Reference.wav", "v/transcript.txt", True), "w": (None, None, False)}


def test_settled_files_wait_and_forget(spark, tmp_path):
    rows = [("a", 5, "m1", "new", 0.0), ("a", 9, "m2", "mod", 1.0), ("a", 9, "m2", "mod", 3.0), ("a", 9, "m2", "mod", 4.0), ("a", 0, "", "deleted", 5.0), ("a", 9, "m2", "new", 6.0), ("a", 9, "m2", "mod", 8.0), ("b", 0, "m", "new", 1.0), ("b", 0, "m", "mod", 9.0)]
    df = spark.createDataFrame(rows, "path string, size long, modified string, kind string, at double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed"))
    out = intake.drained(intake.settled_files(stream))
    assert sorted(r.ts.second for r in out.collect()) == [3, 8]


def test_a_file_with_one_event_settles(spark, tmp_path):
    rows = [("a", 5, "m", "new", 1.0), ("b", 7, "m", "new", 2.0), ("c", 0, "m", "new", 2.0), ("d", 4, "m", "new", 1.0), ("d", 4, "m", "deleted", 2.0)]
    df = spark.createDataFrame(rows, "path string, size long, modified string, kind string, at double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = intake.settled_files(spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed")), settle_seconds=0.5)
    query = stream.writeStream.format("memory").queryName("one_event").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            got = sorted((r.path, r.size) for r in spark.table("one_event").collect())
            if len(got) >= 2:
                break
            query.awaitTermination(0.5)
        query.awaitTermination(1)
        assert sorted((r.path, r.size) for r in spark.table("one_event").collect()) == [("a", 5), ("b", 7)]
    finally:
        query.stop()


def test_feather_weights(spark):
    series = spark.range(40).select(F.lit(1).alias("series_id"), F.col("id").alias("idx"), F.lit(1.0).alias("value"))
    w = {r.idx: r.weight for r in layout.overlap_windows(series, 40, 8).collect()}
    assert w[0] == pytest.approx(max(1e-3, 0.5 - 0.5 * math.cos(math.pi * 0.5 / 8))) and w[7] == pytest.approx(0.5 - 0.5 * math.cos(math.pi * 7.5 / 8)) and w[8] == w[20] == 1.0 and w[39] == w[0]


def test_regrid_draws_lines_and_holds_the_last_value(spark):
    s = spark.createDataFrame([(1, i, float(i), 2) for i in range(4)], "series_id int, idx long, value double, rate int")
    assert sorted((r.idx, r.value, r.rate) for r in signal.regrid_signal(s, 5).collect()) == [(j, pytest.approx(min(j * 2 / 5, 3.0)), 5) for j in range(10)]
    assert sorted((r.idx, r.value) for r in signal.regrid_signal(s, 1).collect()) == [(0, 0.5), (1, 2.5)]


@pytest.mark.parametrize(("tag", "channels", "bits", "align"), [(1, 0, 16, 2), (3, 1, 16, 2), (1, 1, 40, 5), (1, 2, 16, 2), (1, 1, 16, 0), (7, 1, 8, 1)])
def test_odd_wav_files_are_error_rows(spark, tmp_path, tag, channels, bits, align):
    fmt = struct.pack("<HHIIHH", tag, channels, 8000, 8000 * align, align, bits)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", 20) + bytes(20)
    (tmp_path / "x.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    facts, _ = files.wav_facts((tmp_path / "x.wav").read_bytes())
    assert not facts["ok"] and facts["error"]
    assert files.wav_samples(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("target", "multiplier", "error"), [("x2", 2.0, None), ("2.5x", 2.5, None), ("200x100", 2.0, None), ("400", 4.0, None), ("4k", 38.4, None), ("x0", 0.0, "unknown target"), ("x33", 33.0, "over 32 times"), ("huge", None, "unknown target")])
def test_targets(spark, target, multiplier, error):
    got = _one(spark, images.parse_target(F.col("w"), F.col("h"), F.col("t")), w=100, h=100, t=target)
    assert got.multiplier == multiplier and got.error == error


def test_duration_falls_back(spark):
    rate = TC.parse_rate(F.lit("25"))
    rows = [(2.0, 9, "00:00:01:00", "7", 50), (None, 9, "00:00:01:00", "7", 9), (0.0, 0, "00:00:01:00", "7", 25), (None, None, "bad", " 7 ", 7), (None, None, None, "x", 0)]
    table = spark.createDataFrame(rows, "s double, stored long, code string, frames string, want long")
    assert all(r.got == r.want for r in table.withColumn("got", TC.duration_frames(F.col("s"), F.col("stored"), F.col("code"), F.col("frames"), rate)).collect())


def test_generator_errors_are_rows(spark):
    def setup():
        return lambda row: {"made": row["text"].upper(), "n": 10 // len(row["text"])}

    work = spark.createDataFrame([("a", "xy"), ("b", "")], "key string, text string")
    got = {r.key: (r.made, r.n, r.error) for r in manifest.apply_generator(work, setup, "made string, n long").collect()}
    assert got["a"] == ("XY", 5, None) and got["b"][:2] == (None, None) and "ZeroDivisionError" in got["b"][2]

    def broken():
        raise OSError("no model")

    assert all(r.error == "OSError: no model" for r in manifest.apply_generator(work, broken, "made string").collect())


def test_summaries(spark):
    runs = spark.createDataFrame([("b", "failed", 1.0), ("a", "failed", 2.0), ("c", "success", 3.0), ("d", "skipped", 0.0)], "path string, status string, elapsed double")
    assert tuple(manifest.transcription_summary(runs).first()) == (4, 1, 1, 2, "a,b", 6.0, 2)
    segments = spark.createDataFrame([(1, 0, "generated", False), (1, 1, "placed", True), (1, 2, "failed", None), (2, 0, "generated", True)], "script_id int, index int, status string, cached boolean")
    got = {r.script_id: tuple(r)[1:] for r in manifest.narration_summary(segments).collect()}
    assert got == {1: (3, 1, 1, 1, 1, "3", 3), 2: (1, 0, 1, 0, 0, "", 0)}


def test_keys_and_names(spark):
    table = spark.createDataFrame([({"b": "2", "a": "1"}, "r"), ({"a": "1", "b": "2"}, "r"), ({"a": "1"}, None)], "m map<string,string>, r string")
    keys = [r[0] for r in table.select(manifest.settings_key(F.col("m"), F.col("r"))).collect()]
    assert keys[0] == keys[1] != keys[2] and all(len(k) == 16 for k in keys)
    assert _one(spark, inventory.output_name(F.col("s"), F.col("l"), F.col("m"), F.col("e")), s="img", l="4 K", m="ultrasharp", e="JPEG") == "img_4K_ultrasharp.jpg"


def test_segments_get_facts_and_edges(spark):
    segments = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "index int, file_path string")
    facts = spark.createDataFrame([("a", 8000, 2.5), ("b", 8000, 1.0)], "path string, rate int, duration double")
    edges = spark.createDataFrame([("a", 0.12345, 0.5, None), ("b", 0.0, 0.0, "silent")], "path string, leading double, trailing double, reason string")
    got = {r["index"]: (r.rate, r.leading_silence_seconds) for r in manifest.enrich_segments(segments, facts, edges).collect()}
    assert got == {1: (8000, 0.1235), 2: (8000, None), 3: (None, None)}


def test_files_are_listed_and_exported(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "b.MP4").write_bytes(b"xx")
    (tmp_path / "in" / "sub" / "a.mov").write_bytes(b"x")
    flat = inventory.scan_inventory(inventory.list_files(spark, str(tmp_path / "in")), inventory.VIDEO)
    deep = inventory.scan_inventory(inventory.list_files(spark, str(tmp_path / "in"), recursive=True), inventory.VIDEO, "size")
    assert [r.name for r in flat.collect()] == ["b.MP4"] and [r.name for r in deep.collect()] == ["a.mov", "b.MP4"]
    files.write_json(deep.select("name", F.lit(None).cast("string").alias("error")), str(tmp_path / "out"))
    assert sorted(x for p in (tmp_path / "out").glob("*.json") for x in p.read_text().split()) == ['{"name":"a.mov","error":null}', '{"name":"b.MP4","error":null}']


def test_incremental_work_runs_once(spark, tmp_path):
    feed, target = str(tmp_path / "feed"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(f"t{i}",) for i in range(k, k + 3)], "text string").coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(feed)
    q = intake.incremental(stream, target, lambda b: b.withColumn("key", F.sha2("text", 256)), "key").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(target).collect()) == ["t0", "t1", "t2", "t3"]


def test_python_workers_get_texts_by_their_bytes(spark):
    import pandas as pd

    docs = spark.range(300).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("e\u0301"), 50_000).alias("text"))
    held = F.pandas_udf(lambda s: pd.Series([int(s.str.len().sum())] * len(s)), "long")
    for make in (ops.normalize_corpus, lambda d: ops.explode_sentences(d.withColumn("paragraph_index", F.lit(0)))):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647")
        made = make(docs)
        assert made.agg(F.max(held("text"))).first()[0] < 8_000_000
