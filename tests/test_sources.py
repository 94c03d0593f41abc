"""Snapshots of several writers, byte ranges of sound files, lookups by key, pictures."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatables.sources import files, snapshot, wav


def _names(path):
    return sorted(p.name for p in path.iterdir())


def test_one_of_two_writers_wins(spark, tmp_path):
    place = tmp_path / "t"
    first, second = snapshot._SnapshotWriter({"path": str(place), "number": "1"}, spark.range(1).schema), snapshot._SnapshotWriter({"path": str(place), "number": "1"}, spark.range(1).schema)
    batches = lambda n: iter(spark.range(n).toArrow().to_batches())
    done, late = first.write(batches(3)), second.write(batches(5))  # both have written before either commits
    second.write(batches(9))  # an attempt whose message never came
    second.commit([late])
    with pytest.raises(RuntimeError, match="another writer"):
        first.commit([done])
    assert _names(tmp_path) == ["t"] and snapshot.read_snapshot(spark, str(place)).count() == 5
    with pytest.raises(Exception, match="another writer"):
        snapshot.write_snapshot(spark.range(7), str(place), 1)
    assert _names(tmp_path) == ["t"] and snapshot.read_snapshot(spark, str(place)).count() == 5


def test_a_killed_writer_leaves_the_last_snapshot(spark, tmp_path):
    place = tmp_path / "t"
    snapshot.write_snapshot(spark.range(4).repartition(3), str(place), 1)
    dead = snapshot._SnapshotWriter({"path": str(place), "number": "2"}, spark.range(1).schema)
    dead.write(iter(spark.range(9).toArrow().to_batches()))
    assert snapshot.read_snapshot(spark, str(place)).count() == 4
    bad = spark.range(50).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken row"):
        snapshot.write_snapshot(bad, str(place), 2)
    assert snapshot.read_snapshot(spark, str(place)).count() == 4
    snapshot.write_snapshot(spark.range(0), str(place), 2)
    assert snapshot.read_snapshot(spark, str(place)).count() == 0


def test_a_table_of_another_identity_is_moved_aside(spark, tmp_path):
    place = str(tmp_path / "t")
    snapshot.write_snapshot(spark.range(1), place, 1, "script-a")
    snapshot.write_snapshot(spark.range(2), place, 2, "script-a")
    snapshot.write_snapshot(spark.range(3), place, 1, "script-b")
    snapshot.write_snapshot(spark.range(4), place, 1, "script-c")
    assert _names(tmp_path) == ["t", "t.mismatched-1", "t.mismatched-2"]
    assert [snapshot.read_snapshot(spark, f"{place}{x}").count() for x in ("", ".mismatched-1", ".mismatched-2")] == [4, 2, 3]


def _riff(tag, width, channels, body, magic=b"RIFF", said=None, before=b""):
    fmt = struct.pack("<HHIIHH", tag, channels, 100, 100 * width * channels, width * channels, width * 8)
    return magic + struct.pack("<I", 0) + b"WAVE" + before + b"fmt " + struct.pack("<I", 16) + fmt + b"LIST\x03\x00\x00\x00abc\x00" + b"data" + struct.pack("<I", len(body) if said is None else said) + body


def test_ranges_of_a_file_equal_the_whole(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {
        "a": _riff(1, 2, 2, rng.integers(-(2**15), 2**15, 2 * 5003).astype("<i2").tobytes()),
        "b": _riff(3, 4, 1, rng.standard_normal(999).astype("<f4").tobytes()),
        "c": _riff(1, 3, 1, bytes(rng.integers(0, 256, 3 * 777 + 2, dtype=np.uint8))),  # ends in a part of a frame
        "d": b"RIFFnothing",
    }
    for name, data in made.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    ranges, whole = wav.wav_ranges(spark, str(tmp_path), 64, 1000), files.wav_samples(spark, str(tmp_path), 64)
    key = lambda r: (r.path.rpartition("/")[2], r.channel, r.block, r.rate, tuple(r.samples))
    assert sorted(map(key, ranges.collect())) == sorted(map(key, whole.collect()))
    one = wav.wav_ranges(spark, str(tmp_path / "a.wav"), 64, 1000)
    assert one.rdd.getNumPartitions() > 10 and one.where("channel = 0").agg(F.sum(F.size("samples"))).first()[0] == 5003


def test_sizes_beyond_32_bits(spark, tmp_path):
    body = np.arange(100, dtype="<i2").tobytes()
    wide = b"ds64" + struct.pack("<IQQQI", 28, 0, len(body), 100, 0)
    (tmp_path / "w.wav").write_bytes(_riff(1, 2, 1, body, b"RF64", 0xFFFFFFFF, wide) + b"tail\x04\x00\x00\x00zzzz")
    (tmp_path / "o.wav").write_bytes(_riff(1, 2, 1, body, said=0xFFFFFFFF))
    (tmp_path / "t.wav").write_bytes(_riff(1, 2, 1, body, said=5000))
    got = {r.path.rpartition("/")[2]: r.n for r in wav.wav_ranges(spark, str(tmp_path)).groupBy("path").agg(F.sum(F.size("samples")).alias("n")).collect()}
    assert got == {"w.wav": 100, "o.wav": 100, "t.wav": 100}


def test_lookups_skip_row_groups(spark, tmp_path):
    table = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("key"), "id")
    snapshot.write_keyed(table, str(tmp_path / "k"), "key", 500)
    wanted = table.where("id in (7, 31000)").select("key").collect()
    found = snapshot.look_up(spark, str(tmp_path / "k"), "key", [r.key for r in wanted])
    assert sorted(r.id for r in found.collect()) == [7, 31000]
    scan = found._jdf.queryExecution().executedPlan()
    read = _metrics(scan)
    assert read and 2 <= max(read) <= 5_000


def _metrics(plan):
    """Rows that the scans of an executed plan gave out."""
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet") or "FileScan" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def _png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + b"\1\2\3" * w) * h)) + chunk(b"IEND", b"")


def test_pictures_are_catalogued(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_png(5, 3))
    (tmp_path / "b.png").write_bytes(b"no picture")
    got = {r.path.rpartition("/")[2]: (r.width, r.height, r.channels, r.error) for r in files.image_catalogue(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (5, 3, 3, None), "b.png": (None, None, None, "not decodable")}


def test_segments_of_text_manifests_read_back(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"script_sha256": "x", "segments": [{"index": 2, "status": "failed"}]}))
    assert [(r["index"], r.status) for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [(2, "failed")]
