"""Text corpora, WAV files, manifests and snapshots as tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FACTS = "path string, ok boolean, error string, format int, channels int, rate int, width int, frames long, duration double, truncated boolean"
#: Bytes of a sample that can be read, by format: whole numbers and floating point.
WIDTHS = {1: (1, 2, 3, 4), 3: (4, 8)}
#: Samples of a block row.
BLOCK = 16_384
SEGMENTS = "version int, script_sha256 string, max_chars int, merge_paragraphs boolean, segments array<struct<index: int, text: string, char_count: int, paragraph_index: int, status: string, attempts: int, error: string, file_path: string, duration_seconds: double>>"


def read_text_corpus(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``path, text, reason``: UTF-8 with or without a mark, else Windows-1252; blank or (strict) invalid files have a reason."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    if strict:
        decoded = F.when(valid, text)
    else:
        western = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else bytes(b).decode("cp1252", "replace")), StringType())
        decoded = F.when(valid, text).otherwise(western(F.when(~valid, F.col("content"))))
    out = raw.select("path", F.regexp_replace(decoded, "^﻿", "").alias("text"))
    reason = F.when(F.col("text").isNull(), "not UTF-8").when(~F.col("text").rlike(r"(?U)\S"), "empty")
    return out.withColumn("reason", reason)


def checked(facts: dict, found: bool, length: int) -> dict:
    """Facts with an error, or with frames and duration of ``length`` bytes of samples."""
    if "format" not in facts or not found:
        return facts | {"error": "no fmt or data chunk"}
    if facts["format"] not in WIDTHS or not facts["rate"]:
        return facts | {"error": "unsupported format"}
    if facts["width"] not in WIDTHS[facts["format"]] or not facts["channels"]:
        return facts | {"error": "unsupported sample width or no channels"}
    if facts["align"] != facts["channels"] * facts["width"]:
        return facts | {"error": "block size does not fit channels and width"}
    frames = length // facts["align"]
    return facts | {"ok": True, "frames": frames, "duration": frames / facts["rate"]}


def wav_facts(data: bytes) -> tuple[dict, memoryview]:
    """What a RIFF file says about itself, and its sample bytes; never raises."""
    facts: dict = {"ok": False, "error": None, "truncated": False}
    body = memoryview(b"")
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return facts | {"error": "not a RIFF/WAVE file"}, body
    at, found = 12, False
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        chunk = memoryview(data)[at + 8 : at + 8 + size]
        if name == b"fmt " and len(chunk) >= 16:
            tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", chunk)
            if tag == 0xFFFE and len(chunk) >= 26:
                tag = struct.unpack_from("<H", chunk, 24)[0]
            facts |= {"format": tag, "channels": channels, "rate": rate, "width": bits // 8, "align": align}
        elif name == b"data":
            body, found = chunk, True
            facts["truncated"] = len(chunk) < size
        at += 8 + size + (size & 1)
    facts = checked(facts, found, len(body))
    return facts, body[: facts["frames"] * facts["align"]] if facts["ok"] else body


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FACTS.split(", ")]
    for batch in batches:
        rows = [{"path": p} | wav_facts(bytes(c))[0] for p, c in zip(batch["path"], batch["content"], strict=True)]
        yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("format", "channels", "rate", "width", "frames")})


def wav_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row of facts per file; a broken file has an error instead of a failure."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_rows, FACTS)


def decoded(body: memoryview, facts: dict) -> np.ndarray:
    """Frames by channels, full scale at one."""
    tag, width, data = facts["format"], facts["width"], bytes(body)
    if tag == 3:
        x = np.frombuffer(data, "<f4" if width == 4 else "<f8").astype(np.float64)
    elif width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{width}") / 2.0 ** (8 * width - 1)
    return x.reshape(-1, facts["channels"])


def wav_samples(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``path, channel, block, rate, samples``: rows of at most ``block`` samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                facts, body = wav_facts(bytes(content))
                if facts["ok"]:
                    x = decoded(body, facts)
                    for k in range(0, len(x), block):
                        yield pd.DataFrame({"path": p, "channel": range(x.shape[1]), "block": k // block, "rate": facts["rate"], "samples": list(x[k : k + block].T)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, channel int, block long, rate int, samples array<double>")


def sample_rows(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``series_id, channel, idx, value, rate`` of block rows."""
    return blocks.select(F.col("path").alias("series_id"), "channel", F.col("block").alias("b"), "rate", F.posexplode("samples").alias("at", "value")).select("series_id", "channel", (F.col("b") * block + F.col("at")).alias("idx"), "value", "rate")


def image_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, channels, error`` of image files; undecodable ones have an error."""
    files = spark.read.format("binaryFile").load(path).select("path")
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"))
    same = F.regexp_replace("path", "^file:/+", "file:/")
    return files.withColumn("k", same).join(images.withColumn("k", same).drop("path"), "k", "left").drop("k").withColumn("error", F.when(F.col("width").isNull(), "not decodable"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Segments of manifest files, leniently: unknown keys are ignored and an unknown status is pending."""
    runs = spark.read.schema(SEGMENTS).option("multiLine", "true").json(path)
    rows = runs.select(F.input_file_name().alias("manifest"), "script_sha256", F.inline("segments"))
    return rows.withColumn("status", F.when(F.col("status").isin("pending", "generated", "placed", "failed"), F.col("status")).otherwise("pending")).orderBy("manifest", "index")


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out, as result exports and timestamp manifests are."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
