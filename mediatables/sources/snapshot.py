"""Snapshots of a table, one winner a number.

Tasks write Parquet files into a folder beside the table's own, named by a token of the write, and hand
their names on as commit messages. The commit drops what no message names (files of
attempts that failed or ran twice), and moves the folder to ``snapshot_id=N`` in one step. Of two
writers of one number the first to move wins and the other fails without a trace; a writer
that dies leaves a folder that no reader looks at.

A table belongs to what made it: with another ``identity`` (a hash of script and settings, say) the whole
old table is moved aside to ``<path>.mismatched-K`` and never overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .places import opened

IDENTITY = "_identity.json"


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    rows: int


class _SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.number, self.identity = int(options["number"]), options.get("identity")
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def _schema(self):
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(self.schema)

    def write(self, iterator: Iterator) -> _Written:
        import pyarrow.parquet as pq

        system, folder = opened(self.staging)
        system.create_dir(folder)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=system)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return _Written(None, 0)
        out.close()
        return _Written(name, rows)

    def _aside(self, system, path: str) -> None:
        from pyarrow import fs

        there = lambda p: system.get_file_info(p).type != fs.FileType.NotFound
        if self.identity is None or not there(f"{path}/{IDENTITY}"):
            return
        with system.open_input_stream(f"{path}/{IDENTITY}") as f:
            if json.loads(f.read())["identity"] == self.identity:
                return
        k = 1
        while there(f"{path}.mismatched-{k}"):
            k += 1
        system.move(path, f"{path}.mismatched-{k}")

    def commit(self, messages: list) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, staging = opened(self.staging)
        path, named = opened(self.path)[1], {m.name for m in messages if m is not None and m.name}
        system.create_dir(staging)
        for f in system.get_file_info(fs.FileSelector(staging)):
            if f.base_name not in named:
                system.delete_file(f.path)
        if not named:
            pq.write_table(self._schema().empty_table(), f"{staging}/part-0.parquet", filesystem=system)
        with system.open_output_stream(f"{staging}/_SUCCESS") as f:
            f.write(json.dumps({"rows": sum(m.rows for m in messages if m is not None)}).encode())
        self._aside(system, path)
        system.create_dir(path)
        if self.identity is not None:
            with system.open_output_stream(f"{path}/{IDENTITY}") as f:
                f.write(json.dumps({"identity": self.identity}).encode())
        target = f"{path}/snapshot_id={self.number}"
        try:
            if system.get_file_info(target).type != fs.FileType.NotFound:
                raise FileExistsError(target)
            system.move(staging, target)  # fails as well if another writer's folder has come meanwhile
        except OSError as lost:
            self._drop(system, staging)
            raise RuntimeError(f"snapshot {self.number} of {self.path} was written by another writer") from lost

    @staticmethod
    def _drop(system, staging: str) -> None:
        from pyarrow import fs

        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)

    def abort(self, messages: list) -> None:
        self._drop(*opened(self.staging))


class Snapshots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _SnapshotWriter(self.options, schema)


def write_snapshot(table: DataFrame, path: str, number: int, identity: str | None = None) -> None:
    """A whole snapshot beside the earlier ones; a number that is taken is an error and changes nothing."""
    table.sparkSession.dataSource.register(Snapshots)
    writer = table.write.format("snapshots").option("number", str(number)).mode("append")
    (writer.option("identity", identity) if identity is not None else writer).save(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot whose writer finished."""
    from pyarrow import fs

    system, folder = opened(path)
    numbers = [int(f.base_name.partition("=")[2]) for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("snapshot_id=") and system.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File]
    return spark.read.parquet(f"{path}/snapshot_id={max(numbers)}")


def write_keyed(table: DataFrame, path: str, key: str, rows: int = 100_000) -> None:
    """A table for lookups: ranges of the key a file, sorted, in small row groups with bloom filters on the key."""
    ordered = table.repartitionByRange(key).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(rows), "parquet.block.row.count.limit": str(rows)}
    ordered.write.mode("errorifexists").options(**options).parquet(path)


def look_up(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The rows of some keys; the scan skips row groups whose range or filter rules every one out."""
    read = spark.read.parquet(path)
    return read.where(read[key].isin(*values))
