"""Large sound files by byte ranges.

Planning reads the headers alone; a file's samples are cut into ranges of whole blocks, so one file
is many tasks' work and no task holds more than ``SPLIT`` bytes. Sizes beyond 32 bits come from
an RF64 header, or are the rest of the file where a writer left the field open.
Many small files are better read by :func:`.files.wav_samples`, which lists and opens them in tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import BLOCK, checked, decoded
from .places import opened

#: Bytes of samples that one task reads.
SPLIT = 32 << 20
SCHEMA = "path string, channel int, block long, rate int, samples array<double>"
_OPEN = 0xFFFFFFFF


def header(file, size: int) -> tuple[dict, int, int]:
    """Facts of a RIFF or RF64 file, and where its samples begin and how many bytes they are; never reads them."""
    facts: dict = {"ok": False, "error": None, "truncated": False}
    head = file.read_at(12, 0) if size >= 12 else b""
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        return facts | {"error": "not a RIFF/WAVE file"}, 0, 0
    at, wide, start, length = 12, None, -1, 0
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"ds64" and n >= 16:
            wide = struct.unpack("<Q", file.read_at(8, at + 16))[0]
        elif name == b"fmt ":
            chunk = file.read_at(min(n, 40), at + 8)
            if len(chunk) >= 16:
                tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", chunk)
                tag = struct.unpack_from("<H", chunk, 24)[0] if tag == 0xFFFE and len(chunk) >= 26 else tag
                facts |= {"format": tag, "channels": channels, "rate": rate, "width": bits // 8, "align": align}
        elif name == b"data":
            said = wide if n == _OPEN and wide is not None else size - at - 8 if n == _OPEN else n
            start, length = at + 8, min(said, size - at - 8)
            facts["truncated"] = length < said
            n = said
        at += 8 + n + (n & 1)
    facts = checked(facts, start >= 0, length)
    return facts, start, facts["frames"] * facts["align"] if facts["ok"] else 0


class _Range(InputPartition):
    def __init__(self, path: str, facts: dict, start: int, length: int, block: int) -> None:
        self.path, self.facts, self.start, self.length, self.block = path, facts, start, length, block


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.place, self.block, self.split = options["path"], int(options.get("block", BLOCK)), int(options.get("split", SPLIT))

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        system, path = opened(self.place)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(".")), key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                facts, start, length = header(file, f.size)
            if facts["ok"]:
                each = self.block * facts["align"]
                step = max(1, self.split // each)
                out += [_Range(f.path, facts, start + k * each, min(step * each, length - k * each), k) for k in range(0, -(-length // each), step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.place)
        facts, each = partition.facts, self.block * partition.facts["align"]
        with system.open_input_file(partition.path) as file:
            for k in range(0, partition.length, each):
                data = file.read_at(min(each, partition.length - k), partition.start + k)
                x = decoded(memoryview(data), facts)
                n = x.shape[1]
                columns = [pa.array([partition.path] * n), pa.array(range(n), pa.int32()), pa.array([partition.block + k // each] * n, pa.int64()), pa.array([facts["rate"]] * n, pa.int32()), pa.array(list(x.T), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "channel", "block", "rate", "samples"])


class WavRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def wav_ranges(spark: SparkSession, path: str, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """``path, channel, block, rate, samples`` of a file or the files of a folder; broken files give no rows."""
    spark.dataSource.register(WavRanges)
    return spark.read.format("wav_ranges").option("block", str(block)).option("split", str(split)).load(path)
