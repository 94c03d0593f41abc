"""Drop folders and event feeds as Structured Streaming."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, IntegralType, StringType, TimestampNTZType, TimestampType

from .folder import folder_events


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A table of events as a stream, in event time."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    stream = events.parquet(path) if not name.endswith(".parquet") or _is_folder(spark, path) else events.option("pathGlobFilter", name).parquet(parent)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def intake_stream(spark: SparkSession, folder: str, extensions: tuple[str, ...], state: str | None = None) -> DataFrame:
    """Files of a folder with a wanted suffix, those already there included; hidden names are left out.

    With ``state``, a shared folder for listings, events of all kinds come (see :mod:`.folder`);
    without it new files only: ``path, size, modified``.
    """
    if state:
        return folder_events(spark, folder, state, extensions)
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "[^.]*").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def settled(events: DataFrame, key: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """``key, start, end, events`` of each burst, once it has been quiet for ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", lateness).groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def settled_files(events: DataFrame, settle_seconds: float = 1.5, give_up_seconds: float = 300.0) -> DataFrame:
    """``path, size, ts`` of files whose size stayed the same and above zero for the settling time.

    ``events`` has ``path, size, modified, kind, ts``; ``kind`` deleted forgets a file and its state, so
    dropping it again is new work, and one that keeps changing is given up. A file settles by
    a later event of the same size, or by a timer in processing time when none comes, so one
    event is enough; ``ts`` is then that of the last event.
    """

    def step(key, batches, state: GroupState):
        import pandas as pd

        nothing = (-1, 0.0, 0.0, 0, "", "", None)
        size, since, first, begun, mark, done, last = state.get if state.exists else nothing
        out, now = [], state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            if size > 0 and done != "given up" and now - begun <= 1000 * give_up_seconds:
                out.append((key[0], size, last))
                done = mark
            state.update((size, since, first, 0, mark, done, last))
            yield pd.DataFrame(out, columns=["path", "size", "ts"])
            return
        gone = waits = False
        for batch in batches:
            for e in batch.sort_values("ts").itertuples():
                at = e.ts.timestamp()
                gone = e.kind == "deleted"
                if gone:
                    size, since, first, begun, mark, done, last = nothing
                    waits = False
                    continue
                mark, last = f"{e.size}|{e.modified}", e.ts
                if mark == done or done == "given up" and e.size == size:
                    continue
                if e.size != size or done:
                    size, since, first, done, begun, waits = int(e.size), at, first or at, "", begun or now, True
                if at - first > give_up_seconds or now - begun > 1000 * give_up_seconds:
                    done, waits = "given up", False
                elif size > 0 and at - since >= settle_seconds:
                    out.append((key[0], size, e.ts))
                    done, first, begun, waits = mark, 0.0, 0, False
        if gone:
            if state.exists:
                state.remove()
        else:
            state.update((size, since, first, begun, mark, done, last))
            if waits:
                state.setTimeoutDuration(max(1, int(1000 * settle_seconds)))
        yield pd.DataFrame(out, columns=["path", "size", "ts"])

    kept = "size long, since double, first double, begun long, mark string, done string, last timestamp"
    return events.groupBy("path").applyInPandasWithState(step, "path string, size long, ts timestamp", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Columns of a binary file; contents are pruned from the scan where nothing asks for them.
BINARY = "path string, modificationTime timestamp, length long, content binary"
#: What keeps keyed state with timers and expiry.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastHandled(StatefulProcessor):
    """The mark of the last event of a key that went on; deleted keys are forgotten."""

    def __init__(self, keys: list[str], expire_ms: int | None) -> None:
        self.keys, self.expire_ms = keys, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "mark string", self.expire_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        known = self.last.get()  # None where there is no state
        mark = before = known[0] if known is not None else None
        out = []
        for batch in rows:
            for e in batch.sort_values("ts", kind="stable").itertuples():
                if e.kind == "deleted":
                    mark = None
                elif e.mark != mark:
                    mark = e.mark
                    out.append((*key, e.mark, e.kind, e.ts))
        if mark is None:
            if before is not None:
                self.last.clear()
        elif mark != before or self.expire_ms:
            self.last.update((mark,))
        yield pd.DataFrame(out, columns=[*self.keys, "mark", "kind", "ts"])

    def close(self) -> None:
        pass


#: Rows that a task adds up at a time.
_ADDED = 1 << 17


def _firsts(keys: list[str], whole: bool):
    """The least ``ts`` of each key in a task; without ``whole`` a part of the task's rows at a time, so some keys come again."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def least(tables: list) -> pa.Table:
            return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("ts", "min")]).rename_columns([*keys, "ts"])

        held, size, goal = [], 0, _ADDED
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += len(batch)
            if size > goal:
                held = [least(held)]
                if not whole:
                    yield from held.pop().to_batches()
                size = sum(len(t) for t in held)
                goal = _ADDED + 2 * size
        if held:
            yield from least(held).to_batches()

    return run


def _plain(kind: DataType) -> bool:
    """Whether values are equal for Arrow where they are for Spark."""
    return isinstance(kind, (IntegralType, BooleanType, DateType, TimestampType, TimestampNTZType, BinaryType)) or kind == StringType()


def _first_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, ts``: the first event of each key that is new; known keys are kept by Spark's own operator, without Python."""
    types = events.select(*keys, "ts").schema
    one = events.select(*keys, "ts").mapInArrow(_firsts(keys, False), types).repartition(*keys).mapInArrow(_firsts(keys, True), types)
    return one.dropDuplicates(keys)  # a batch has one row a key by now


def deduped_events(events: DataFrame, keys: list[str], same: list[str] | None = None, expire: float | None = None) -> DataFrame:
    """``*keys, mark, kind, ts``: events that differ in ``same`` from the last one of their keys that went on.

    ``mark`` is the values of ``same``. ``kind`` deleted (if there is such a column) forgets the keys and does not
    go on, so the same file dropped again is new; ``expire`` seconds without an event forget them as well. State is one
    short row for each key that is known now. It needs the ``ROCKSDB`` store; events of one batch go by ``ts``.
    Where nothing is ever forgotten and any event of known keys is the same, Python sees whole batches and no single key.
    """
    if not same and not expire and "kind" not in events.columns and "ts" not in keys and all(_plain(events.schema[c].dataType) for c in [*keys, "ts"]):
        return _first_events(events, keys).select(*keys, F.lit("").alias("mark"), F.lit("created").alias("kind"), "ts")
    kind = F.col("kind") if "kind" in events.columns else F.lit("created")
    mark = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in same or ()])
    marked = events.select(*keys, mark.alias("mark"), kind.alias("kind"), "ts")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema)
    processor = _LastHandled(keys, int(1000 * expire) if expire else None)
    return marked.groupBy(*keys).transformWithStateInPandas(processor, types, "append", "processingTime" if expire else "none")


def progress_counts(events: DataFrame, status: str) -> DataFrame:
    """Running totals per status."""
    return events.groupBy(status).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, mode: str = "append", linger: float = 0.0) -> DataFrame:
    """Run a stream over all that is there now, and read what it wrote (the last state of each row in complete mode).

    A stream whose timers run in processing time would go on for ever: it ends once it has had no rows
    for ``linger`` seconds, which must cover the longest timer, and two batches.
    """
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"
    place = f"{base}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)  # read when the stream starts; the session's own choice comes back
    try:
        if mode == "append":
            query = writer.format("parquet").start(f"{place}/out")
        else:
            query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/out")).start()
        quiet = None
        while not query.awaitTermination(0.2):
            last = query.recentProgress[-2:]
            if len(last) < 2 or any(p.numInputRows for p in last):
                quiet = None
            elif quiet is None:
                quiet = time.monotonic()
            elif time.monotonic() - quiet >= linger:
                query.stop()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def incremental(stream: DataFrame, target: str, transform, key: str, known: DataFrame | None = None):
    """Append what ``transform`` makes of new rows whose ``key`` has not been seen, in folders ``batch=N`` of ``target``.

    Seen keys are in the stream's own state, so a batch reads its new rows and never the target. ``known`` is a
    stream of keys that were handled elsewhere (an older target, say); of one batch they count
    first. A batch that runs again overwrites its own folder. Rows of one key in a batch give one of them; a null key is a key.
    """
    made = transform(stream)
    whole = F.struct(*made.columns)
    rows = made.select(F.col(key).alias("seen_key"), whole.alias("whole"))
    if known is not None:
        rows = rows.union(known.select(F.col(key).cast(made.schema[key].dataType), F.lit(None).cast(made.select(whole).schema[0].dataType)))
    kind = rows.schema["whole"].dataType.simpleString()

    def step(_, batches, state: GroupState):
        import pandas as pd

        first, handled = [], state.exists
        for batch in batches:
            handled = handled or bool(batch["whole"].isna().any())
            first = first or batch["whole"].dropna().iloc[:1].tolist()
        state.update((True,))
        yield pd.DataFrame({"whole": [] if handled else first})

    fresh = rows.groupBy("seen_key").applyInPandasWithState(step, f"whole {kind}", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    return fresh.writeStream.foreachBatch(lambda batch, number: batch.select("whole.*").write.mode("overwrite").parquet(f"{target}/batch={number}"))
