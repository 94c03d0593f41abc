"""Drop folders, forgetting, archives and incremental work as streams, over restarts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from mediatables.streaming import folder, intake


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, intake.ROCKSDB)
    yield
    spark.conf.set(name, before)


def _run(stream, place, timers=False):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start(f"{place}/out")
    if not query.awaitTermination(6 if timers else 60):  # timers in processing time never let it end
        query.stop()
    return query


def _events(spark, place):
    rows = spark.read.schema(folder.SCHEMA).parquet(f"{place}/out").collect()
    return sorted((r.ts, r.path.rpartition("/")[2], r.kind, (r.old_path or "").rpartition("/")[2], r.size) for r in rows)


def _drop(place, name, data, at):
    (place / name).write_bytes(data)
    os.utime(place / name, (at, at))


def test_a_folder_tells_what_happens_over_restarts(spark, tmp_path):
    inbox, place = tmp_path / "in", tmp_path / "job"
    (inbox / "below").mkdir(parents=True)
    stream = lambda: folder.folder_events(spark, str(inbox), f"file://{place}/listings", ("png", "jpg"))
    _drop(inbox, "a.PNG", b"xx", 1000)
    _drop(inbox, "b.jpg", b"yyy", 1001)
    for name in (".hidden.png", "note.txt", "below/c.png"):
        _drop(inbox, name, b"z", 1002)
    _run(stream(), place)
    first = [e[1:] for e in _events(spark, place)]
    assert first == [("a.PNG", "created", "", 2), ("b.jpg", "created", "", 3)]
    # the job is down while files change, move and go
    _drop(inbox, "a.PNG", b"xxxx", 1005)
    (inbox / "b.jpg").rename(inbox / "moved.jpg")
    _drop(inbox, "d.png", b"d", 1006)
    _run(stream(), place)
    second = [e[1:] for e in _events(spark, place)][2:]
    assert second == [("a.PNG", "modified", "", 4), ("b.jpg", "deleted", "", 3), ("d.png", "created", "", 1), ("moved.jpg", "moved", "b.jpg", 3)]
    _run(stream(), place)  # nothing new
    (inbox / "d.png").unlink()
    _run(stream(), place)
    _drop(inbox, "d.png", b"d", 1006)
    _run(stream(), place)
    assert [e[1:] for e in _events(spark, place)][6:] == [("d.png", "deleted", "", 1), ("d.png", "created", "", 1)]
    assert len(list((place / "listings").glob("listing-*.json"))) <= 2  # older ones went with their batches


def test_a_batch_of_listings_is_the_same_again(tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    _drop(inbox, "a.png", b"x", 1000)
    options = {"path": str(inbox), "state": str(tmp_path / "s")}
    one = folder.FolderReader(options)
    start, end = one.initialOffset(), one.latestOffset()
    rows = [r for p in one.partitions(start, end) for r in one.read(p)]
    _drop(inbox, "b.png", b"x", 1000)
    other = folder.FolderReader(options)  # the process that wrote the listing has died
    assert [r for p in other.partitions(start, end) for r in other.read(p)] == rows
    later = other.latestOffset()
    assert later["listing"] == end["listing"] + 1 and len(other.partitions(end, later)[0].events) == 1
    assert other.partitions(later, later) == [] and other.latestOffset() == later


def test_copies_and_moves_are_told_apart():
    same = [5, 100]
    assert folder.changes({"a": same}, {"a": same, "b": same}, 1) == [("b", 5, 100, "created", None, 1)]
    got = folder.changes({"a": same, "b": same}, {"c": same, "d": same, "e": same}, 1)
    assert [(e[0], e[3], e[4]) for e in got] == [("a", "deleted", None), ("b", "deleted", None), ("c", "moved", "a"), ("d", "moved", "b"), ("e", "created", None)]


def test_new_files_without_listings(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("a.png", ".b.png", "c.txt"):
        (inbox / name).write_bytes(b"x")
    got = intake.drained(intake.intake_stream(spark, str(inbox), ("png",))).collect()
    assert [(r.path.rpartition("/")[2], r["size"]) for r in got] == [("a.png", 1)]


def _state_rows(query):
    return query.lastProgress.stateOperators[0].numRowsTotal


def test_deleted_files_are_forgotten_and_count_again(spark, tmp_path, rocksdb):
    inbox, place = tmp_path / "in", tmp_path / "job"
    inbox.mkdir()
    stream = lambda: intake.deduped_events(folder.folder_events(spark, str(inbox), f"{place}/listings", ("png",)), ["path"], ["size", "modified"])
    handled = lambda: sorted((r.path.rpartition("/")[2], r.kind) for r in spark.read.parquet(f"{place}/out").collect())
    for k in range(5):
        _drop(inbox, f"{k}.png", b"x", 1000 + k)
    assert _state_rows(_run(stream(), place)) == 5 and len(handled()) == 5
    for k in range(3):
        (inbox / f"{k}.png").unlink()
    assert _state_rows(_run(stream(), place)) == 2 and len(handled()) == 5
    _drop(inbox, "0.png", b"x", 1000)  # dropped again, the very same file: new work
    _drop(inbox, "4.png", b"xy", 1009)
    assert _state_rows(_run(stream(), place)) == 3
    assert handled() == sorted([(f"{k}.png", "created") for k in range(5)] + [("0.png", "created"), ("4.png", "modified")])


def test_events_of_one_mark_go_on_once(spark, tmp_path, rocksdb):
    rows = [("a", 1, "created", 1.0), ("a", 1, "modified", 2.0), ("a", 2, "modified", 3.0), ("a", 2, "deleted", 4.0), ("a", 2, "created", 5.0), (None, None, "created", 1.0), (None, None, "created", 2.0), ("b", None, "created", 1.0), ("b", 0, "modified", 2.0)]
    df = spark.createDataFrame(rows, "path string, size long, kind string, at double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "feed"))
    got = intake.drained(intake.deduped_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed")), ["path"], ["size"])).collect()
    assert sorted((r.path or "", r.ts.second) for r in got) == [("", 1), ("a", 1), ("a", 3), ("a", 5), ("b", 1), ("b", 2)]


def test_marks_expire(spark, tmp_path, rocksdb):
    feed, place = str(tmp_path / "feed"), tmp_path / "job"
    df = spark.createDataFrame([("a",), ("b",)], "path string").withColumn("ts", F.current_timestamp())
    df.coalesce(1).write.parquet(feed)
    stream = lambda expire: intake.deduped_events(spark.readStream.schema(df.schema).parquet(feed), ["path"], expire=expire)
    _run(stream(2.0), place, timers=True)
    time.sleep(0.5)
    df.where("path = 'a'").coalesce(1).write.mode("append").parquet(feed)
    _run(stream(2.0), place, timers=True)
    assert sorted(r.path for r in spark.read.parquet(f"{place}/out").collect()) == ["a", "a", "b"]


def test_archived_files_keep_apart(spark, tmp_path):
    for d in ("in", "in/x"):
        (tmp_path / d).mkdir()
    for name, data in (("in/a.png", b"1"), ("in/x/a.png", b"2"), ("in/b", b"3")):
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("in/a.png", "in/x/a.png", "in/b", "in/b", "in/gone.png")], "path string")
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in folder.archived(paths, str(tmp_path / "done")).collect()}
    assert got["in/gone.png"].archived is None and all(r.error is None for r in got.values()) and len(got) == 4
    assert sorted(p.name for p in (tmp_path / "done").iterdir()) == ["a.png", "a_2.png", "b"]
    assert {p.read_bytes() for p in (tmp_path / "done").iterdir()} == {b"1", b"2", b"3"}
    assert all(r.archived is None for r in folder.archived(paths, str(tmp_path / "done")).collect())  # run again: nothing left


def test_incremental_work_reads_new_rows_only(spark, tmp_path):
    feed, older, target = (str(tmp_path / n) for n in ("feed", "older", "out"))
    schema = "text string, big long, parts array<string>"
    rows = lambda a, b: spark.createDataFrame([(f"t{i}", 2**60 + i if i % 2 else None, [str(i)]) for i in range(a, b)], schema)
    transform = lambda s: s.withColumn("key", F.sha2("text", 256)).withColumn("more", F.struct("big"))
    transform(rows(0, 50)).select("key").coalesce(1).write.parquet(older)

    def run():
        known = spark.readStream.schema("key string").parquet(older)
        query = intake.incremental(spark.readStream.schema(schema).parquet(feed), target, transform, "key", known).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    rows(40, 300).coalesce(1).write.parquet(feed)
    assert run().lastProgress.numInputRows == 260 + 50
    rows(290, 310).coalesce(1).write.mode("append").parquet(feed)
    assert run().lastProgress.numInputRows == 20  # the target's 250 rows are not read
    got = {r.text: r for r in spark.read.parquet(target).collect()}
    assert sorted(got) == sorted(f"t{i}" for i in range(50, 310)) and spark.read.parquet(target).count() == 260
    assert got["t51"].big == 2**60 + 51 and got["t52"].big is None and got["t51"].parts == ["51"] and got["t51"].more.big == 2**60 + 51


def test_first_events_need_no_python_call_a_key(spark, tmp_path):
    feed, schema = str(tmp_path / "feed"), "user long, kind_ string, ts timestamp"
    rows = [(k, t, n) for n in (3.0, 1.0, 2.0) for k in (*range(40), None) for t in ("a", None)]
    frame = lambda rows: spark.createDataFrame(rows, "user long, kind_ string, at double").select("user", "kind_", F.timestamp_seconds("at").alias("ts"))
    frame(rows).repartition(3).coalesce(1).write.parquet(feed)
    stream = lambda: intake.deduped_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed), ["user", "kind_"])
    plan = stream()._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Deduplicate" in plan
    _run(stream(), tmp_path)
    frame([(5, "a", 0.0), (77, "a", 9.0), (77, "a", 8.0), (78, None, None)]).coalesce(1).write.mode("append").parquet(feed)
    _run(stream(), tmp_path)  # known keys stay known over a restart, whatever their time
    got = [(r.user, r.kind_, r.mark, r.kind, r.ts and r.ts.second) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want = [(k, t, "", "created", 1) for k in (*range(40), None) for t in ("a", None)] + [(77, "a", "", "created", 8), (78, None, "", "created", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_first_events_of_many_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(intake, "_ADDED", 10)
    batches = [pa.RecordBatch.from_pydict({"k": [i % 5, i % 9, None], "ts": [i, 50 - i, i]}) for i in range(30)]
    for whole in (True, False):
        rows = [r for b in intake._firsts(["k"], whole)(iter(batches)) for r in b.to_pylist()]
        least = {}
        for r in rows:
            least[r["k"]] = min(r["ts"], least.get(r["k"], 99))
        want = {k: min(t for b in batches for x, t in zip(*b.to_pydict().values(), strict=True) if x == k) for k in (*range(9), None)}
        assert least == want and (len(rows) == 10) == whole
