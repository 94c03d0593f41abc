"""A drop folder as a stream of events: created, modified, moved and deleted files.

The source lists the folder for every batch and keeps each listing that differs from the last one in a
``state`` folder, numbered; an offset is such a number. A batch is what lies between two listings, so one that is run again
after a failure gives the same rows, and a stream that starts again knows what went while it was down.
Files that are there at the start are created. A file that goes while one of the same size and time comes
has been moved: the new path has a ``moved`` row, with ``old_path``, and the old path a ``deleted`` one.
Listings that no batch can ask for any more are removed.

    spark.dataSource.register(folder.FolderEvents)
    spark.readStream.format("folder_events").option("state", shared).load(path)

Both folders are named as pyarrow does (``file``, ``s3``, ``gs``, ``hdfs`` or a plain path) and must be
shared by driver and executors. Hidden names are left out, folders below only on demand.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.places import opened

SCHEMA = "path string, size long, modified timestamp, kind string, old_path string, ts timestamp"
#: Events of a task.
EVENTS = 10_000


def listed(place: str, extensions: tuple[str, ...], recursive: bool) -> dict[str, list[int]]:
    """Size and time (microseconds) of each file with a wanted suffix."""
    from pyarrow import fs

    system, path = opened(place)
    found = {}
    for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive)):
        if f.type == fs.FileType.File and not f.base_name.startswith(".") and (not extensions or f.extension.lower() in extensions):
            found[f.path] = [f.size, f.mtime_ns // 1000]
    return found


def changes(old: dict[str, list[int]], new: dict[str, list[int]], at: int) -> list[tuple]:
    """The events between two listings, in order of paths."""
    gone: dict[tuple, list[str]] = {}
    for path in sorted(old.keys() - new.keys(), reverse=True):
        gone.setdefault(tuple(old[path]), []).append(path)
    out = [(path, *old[path], "deleted", None, at) for path in old.keys() - new.keys()]
    for path in sorted(new):
        if path not in old:
            before = gone.get(tuple(new[path]))
            out.append((path, *new[path], "moved" if before else "created", before.pop() if before else None, at))
        elif old[path] != new[path]:
            out.append((path, *new[path], "modified", None, at))
    return sorted(out, key=lambda e: (e[0], e[3]))


class _Events(InputPartition):
    def __init__(self, events: list[tuple]) -> None:
        self.events = events


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.place, self.state = options["path"], options["state"]
        self.extensions = tuple(x.strip().lower() for x in options.get("extensions", "").split(",") if x.strip())
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.last: tuple[int, dict] | None = None

    def _file(self, number: int) -> str:
        return f"listing-{number:012d}.json"

    def _kept(self) -> list[int]:
        from pyarrow import fs

        system, path = opened(self.state)
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True))]
        return sorted(int(n[8:-5]) for n in names if n.startswith("listing-") and n.endswith(".json"))

    def _listing(self, number: int) -> dict:
        if not number:
            return {"at": 0, "files": {}}
        system, path = opened(self.state)
        with system.open_input_stream(f"{path}/{self._file(number)}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        if self.last is None:
            number = max(self._kept(), default=0)
            self.last = number, self._listing(number)["files"]
        number, known = self.last
        now = listed(self.place, self.extensions, self.recursive)
        if now != known:
            number += 1
            system, path = opened(self.state)
            system.create_dir(path)
            with system.open_output_stream(f"{path}/.{self._file(number)}") as f:
                f.write(json.dumps({"at": time.time_ns() // 1000, "files": now}).encode())
            system.move(f"{path}/.{self._file(number)}", f"{path}/{self._file(number)}")
            self.last = number, now
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start == end:
            return []
        old, new = self._listing(start["listing"]), self._listing(end["listing"])
        events = changes(old["files"], new["files"], new["at"])
        return [_Events(events[k : k + EVENTS]) for k in range(0, len(events), EVENTS)]

    def read(self, partition: _Events) -> Iterator[tuple]:
        when = lambda micros: datetime.fromtimestamp(micros / 1e6, timezone.utc)
        for path, size, modified, kind, old_path, at in partition.events:
            yield path, size, when(modified), kind, old_path, when(at)

    def commit(self, end: dict) -> None:
        system, path = opened(self.state)
        for number in self._kept():
            if number < end["listing"]:
                system.delete_file(f"{path}/{self._file(number)}")


class FolderEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(self.options)


def folder_events(spark: SparkSession, folder: str, state: str, extensions: Iterable[str] = (), recursive: bool = False) -> DataFrame:
    """``path, size, modified, kind, old_path, ts`` of what happens in a folder, as a stream."""
    spark.dataSource.register(FolderEvents)
    reader = spark.readStream.format("folder_events").option("state", state).option("recursive", str(recursive).lower())
    return reader.option("extensions", ",".join(extensions)).load(folder)


def archived(handled: DataFrame, target: str, path: str = "path") -> DataFrame:
    """Move handled files into another folder: ``path, archived, error``.

    The move happens in tasks, when the result is written, so it belongs at the end of a batch. A name
    that is taken gets ``_2``, ``_3`` and so on. A file that has gone already is no error, so a batch may run
    again. The folder's next listing shows the file as deleted, which lets its state go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        to, folder = opened(target)
        to.create_dir(folder)
        for batch in batches:
            rows = []
            for source in batch["path"]:
                system, place = opened(source)
                name = place.rpartition("/")[2]
                stem, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
                free, k = f"{folder}/{name}", 1
                while to.get_file_info(free).type != fs.FileType.NotFound:
                    k += 1
                    free = f"{folder}/{stem}_{k}{dot}{ext}"
                try:
                    if system.get_file_info(place).type == fs.FileType.NotFound:
                        rows.append((source, None, None))
                    else:
                        system.move(place, free)
                        rows.append((source, free, None))
                except OSError as failed:
                    rows.append((source, None, str(failed)))
            yield pd.DataFrame(rows, columns=["path", "archived", "error"])

    # one task a name: two files of one name never choose the same free one at once
    named = handled.select(F.col(path).alias("path")).distinct().repartition(F.regexp_extract("path", r"([^/]*)$", 1))
    return named.mapInPandas(run, "path string, archived string, error string")
