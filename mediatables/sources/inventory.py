"""File inventories and the planning of batch work over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIDEO = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg")
LEGACY = ("avi", "mpg", "webm")


def described(paths: DataFrame, path: str = "path") -> DataFrame:
    """``dir, name, stem, ext`` of each path; the extension in lower case."""
    p = F.col(path)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return paths.withColumn("name", name).withColumn("dir", F.regexp_replace(p, r"/?[^/]*$", "")).withColumn("ext", F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1))).withColumn("stem", F.regexp_replace(name, r"(.)\.[^.]+$", "$1"))


def list_files(spark: SparkSession, root: str | list[str], recursive: bool = False) -> DataFrame:
    """``path, size, modified`` of the files of a folder or several; contents are pruned from the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scan_inventory(files: DataFrame, extensions: tuple[str, ...], order: str = "name") -> DataFrame:
    """Files of the wanted extensions once each, in order of lower-case name, path, or size and path.

    Of rows that repeat a path the one of the least size counts (a null size is larger than any), then the least in its other columns.
    """
    rows = described(files).where(F.col("ext").isin(*extensions))
    first = [F.col("size").isNull(), F.col("size")] if "size" in files.columns else []
    least = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(first)], F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    kept = rows.groupBy("path").agg(F.min(least).alias("least")).select("least.row.*")
    keys = {"name": [F.lower("name"), F.col("path")], "path": [F.col("path")], "size": [F.col("size"), F.col("path")]}[order]
    return kept.orderBy(*keys)


def list_roots(spark: SparkSession, roots: list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files found in folders, and files among ``roots`` themselves, for :func:`discover`; a root that is missing raises."""
    plain = lambda p: F.regexp_replace(p, "^file:/+", "/")
    named = plain(F.col("path")).isin([r if not r.startswith("file:") else "/" + r[5:].lstrip("/") for r in roots])
    found = list_files(spark, roots, recursive)
    return found.where(~named), found.where(named)


def discover(listed: DataFrame, explicit: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Files of folders by extension and files named one by one whatever theirs, once each, smallest first.

    Both sides have ``path, size``; a path that has several sizes counts with the least, a null path not at all.
    """
    wanted = described(listed).where(F.col("ext").isin(*extensions)).select("path", "size")
    both = wanted.unionByName(explicit.select("path", "size")).where("path is not null")
    return described(both.groupBy("path").agg(F.min("size").alias("size"))).orderBy("size", "path")


def plan_tasks(inventory: DataFrame, target: str, legacy: tuple[str, ...] = LEGACY) -> DataFrame:
    """Destination of each file: legacy containers become mp4 and are encoded anew; collisions are flagged."""
    old = F.col("ext").isin(*legacy)
    name = F.when(old, F.concat("stem", F.lit(".mp4"))).otherwise(F.col("name"))
    planned = inventory.withColumn("destination", F.concat(F.lit(target.rstrip("/") + "/"), name)).withColumn("requires_reencode", old)
    return planned.withColumn("dest_conflict", F.count("*").over(Window.partitionBy("destination")) > 1)


def skip_existing(tasks: DataFrame, existing: DataFrame, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Tasks with ``already_exists`` and a status: skipped, dry_run or pending."""
    there = existing.select(F.col("path").alias("destination"), F.lit(True).alias("already_exists")).distinct()
    out = tasks.join(there, "destination", "left").withColumn("already_exists", F.coalesce("already_exists", F.lit(False)))
    return out.withColumn("status", F.when(F.col("already_exists") & ~F.lit(overwrite), "skipped").when(F.lit(dry_run), "dry_run").otherwise("pending"))


def missing_sidecar(inventory: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files without a text file of their stem beside them; ``shared_stem`` marks those that would share one."""
    there = described(sidecars.select("path")).where("ext = 'txt'").select("dir", "stem").distinct()
    shared = inventory.withColumn("shared_stem", F.count("*").over(Window.partitionBy("dir", "stem")) > 1)
    return shared.join(there, ["dir", "stem"], "left_anti")


def number_outputs(names: DataFrame, existing: DataFrame, base: str = "base") -> DataFrame:
    """``output``: colliding names get ``_2``, ``_3`` and so on, past the numbers that exist."""
    taken = existing.groupBy(base).agg(F.max("number").alias("upto"))
    order = Window.partitionBy(base).orderBy("path")
    n = F.row_number().over(order) + F.coalesce("upto", F.lit(0))
    return names.join(taken, base, "left").withColumn("n", n).withColumn("output", F.when(F.col("n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("n").cast("string")))).drop("upto", "n")


def output_name(stem: Column, label: Column, model: Column, ext: Column) -> Column:
    return F.concat(stem, F.lit("_"), F.replace(label, F.lit(" "), F.lit("")), F.lit("_"), model, F.lit("."), F.when(F.lower(ext) == "jpeg", "jpg").otherwise(F.lower(ext)))


def duplicate_files(files: DataFrame, content: str = "content", extra: str = "") -> DataFrame:
    """``fingerprint, copies, first_id``: 16 hex digits of SHA-256 over the bytes, for those that occur more than once."""
    key = F.substring(F.sha2(F.concat(F.col(content), F.lit(extra)), 256), 1, 16)
    return files.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


#: Names in order of preference, and what counts as audio (fixed values).
REFERENCES, TRANSCRIPTS, PROFILE = ("reference", "sample", "voice"), ("reference.txt", "transcript.txt", "sample.txt"), "profile.json"
AUDIO = ("wav", "flac", "ogg", "oga", "opus", "aiff", "aif", "mp3", "w64", "caf", "m4a", "aac", "mp4", "wma", "webm", "mkv", "mov")
_PROFILE = "transcript string, language string, description string, options map<string,string>"


def assemble_bundles(files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Per folder its best reference, first transcript and whether it is valid: ``dir, reference, transcript, valid``.

    ``files`` is a described inventory; audio named reference, sample or voice comes before others by name.
    With ``texts`` (``path, text`` of small files) come ``transcript_text`` (the first transcript's, trimmed; where it
    is empty or missing, the one in profile.json), ``language, description, options``; a profile that is no
    JSON object counts as none.
    """
    shown = files.where(~F.col("name").startswith("."))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, REFERENCES)), F.lower("stem")), F.lit(0))
    audio = shown.where(F.col("ext").isin(*AUDIO)).groupBy("dir").agg(F.min_by("path", F.struct(F.when(rank == 0, 99).otherwise(rank), F.lower("name"), "name")).alias("reference"))
    place = F.array_position(F.array(*map(F.lit, TRANSCRIPTS)), F.lower("name"))
    text = shown.where(place > 0).groupBy("dir").agg(F.min_by("path", F.struct(place, "name")).alias("transcript"))
    out = shown.select("dir").distinct().join(audio, "dir", "left").join(text, "dir", "left").withColumn("valid", F.col("reference").isNotNull())
    if texts is None:
        return out
    spoken = F.regexp_replace("text", r"^[\s\x{FEFF}]+|\s+$", "")
    said = texts.groupBy(F.col("path").alias("transcript")).agg(F.min(F.when(spoken != "", spoken)).alias("spoken"))
    named = described(texts).where(F.col("name") == PROFILE).groupBy("dir").agg(F.min("text").alias("text")).select("dir", F.from_json("text", _PROFILE).alias("profile"))
    out = out.join(said, "transcript", "left").join(named, "dir", "left")
    told = F.coalesce("spoken", "profile.transcript").alias("transcript_text")
    return out.select("dir", "reference", "transcript", "valid", told, "profile.language", "profile.description", "profile.options")
