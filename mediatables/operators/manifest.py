"""Resumable work: manifests of segments, keys, attempts, gates and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import duration_frames

STATUSES = ("pending", "generated", "placed", "failed")


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def settings_key(settings: Column, reference: Column) -> Column:
    """16 hex digits over the sorted settings and a reference hash."""
    return F.substring(F.sha2(F.concat(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(settings)))), F.lit("|"), F.coalesce(reference, F.lit(""))), 256), 1, 16)


def work_key(version: Column, model: Column, voice: Column, text: Column, seed: Column) -> Column:
    """24 hex digits over all that decides a result."""
    return F.substring(F.sha2(F.concat_ws("|", version, model, voice, F.coalesce(seed.cast("string"), F.lit("-")), text), 256), 1, 24)


def attempt_seed(base: Column, index: Column, attempt: Column) -> Column:
    return F.pmod(base + index + attempt * 7919, F.lit(2**31 - 1))


def build_manifest(chunks: DataFrame, docs: DataFrame, max_chars: int, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pending segments, and one run per script with its hash and parameters."""
    segments = chunks.select(F.col("doc_id").alias("script_id"), F.col("chunk_index").alias("index"), "text", "char_count", "paragraph_index", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    counts = segments.groupBy("script_id").agg(F.count("*").alias("segments"))
    runs = docs.select(F.col("doc_id").alias("script_id"), content_key(F.col("text")).alias("script_sha256"), F.lit(max_chars).alias("max_chars"), F.lit(merge).alias("merge_paragraphs")).join(counts, "script_id")
    return segments, runs


def manifest_mismatch(version: Column, sha: Column, max_chars: Column, merge: Column, old: Column) -> Column:
    """Why an old run can't be resumed, or null: version, then text, size and merge flag."""
    return F.when(~version.eqNullSafe(old["version"]), "version").when(~sha.eqNullSafe(old["script_sha256"]), "script text").when(~max_chars.eqNullSafe(old["max_chars"]), "max_chars").when(~merge.eqNullSafe(old["merge_paragraphs"]), "merge_paragraphs")


def resync_manifest(fresh: DataFrame, old: DataFrame, redo: DataFrame | None = None) -> DataFrame:
    """New segments with the state of the old ones of their index; ``redo`` (script_id, index) starts over."""
    state = old.select("script_id", "index", F.col("status").alias("was"), F.col("attempts").alias("tried"))
    out = fresh.drop("status", "attempts").join(state, ["script_id", "index"], "left")
    if redo is not None:
        out = out.join(redo.select("script_id", "index", F.lit(True).alias("again")), ["script_id", "index"], "left")
    else:
        out = out.withColumn("again", F.lit(False))
    kept = ~F.coalesce("again", F.lit(False)) & F.col("was").isin(*STATUSES)
    return out.withColumn("status", F.when(kept, F.col("was")).otherwise("pending")).withColumn("attempts", F.when(kept, F.coalesce("tried", F.lit(0))).otherwise(0)).drop("was", "tried", "again")


def cache_lookup(work: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows whose key is cached, and the others with equal work once."""
    known = cache.select(key).distinct()
    return work.join(known, key, "left_semi"), work.join(known, key, "left_anti").dropDuplicates([key])


def select_work(segments: DataFrame, numbers: str | None = None, failed_only: bool = False) -> DataFrame:
    """By a list of 1-based numbers such as ``5,7-9``, else failed ones only, else pending and failed."""
    if numbers:
        spark = segments.sparkSession
        ranges = spark.createDataFrame([(numbers,)], "spec string").select(F.explode(F.split("spec", ",")).alias("r"))
        first, last = F.split("r", "-")[0].cast("int"), F.element_at(F.split("r", "-"), -1).cast("int")
        bad = F.raise_error(F.concat(F.lit("not a selection: "), "r"))
        wanted = ranges.select(F.explode(F.when((first >= 1) & (last >= first), F.sequence(first, last)).otherwise(bad)).alias("number")).distinct()
        return segments.join(F.broadcast(wanted), F.col("index") + 1 == F.col("number"), "left_semi")
    return segments.where(F.col("status").isin(*(["failed"] if failed_only else ["pending", "failed"])))


def publish_gate(segments: DataFrame) -> DataFrame:
    """Segments of scripts without a failed one."""
    blocked = segments.where("status = 'failed'").select("script_id").distinct()
    return segments.join(blocked, "script_id", "left_anti")


def status_counts(segments: DataFrame) -> DataFrame:
    """Per script: totals by status and the numbers of the failed, at most as many as it has segments."""
    s = F.col("status")
    return segments.groupBy("script_id").agg(
        F.count("*").alias("total"), F.count_if(s.isin("generated", "placed")).alias("complete"), F.count_if(s == "placed").alias("placed"), F.count_if(s == "failed").alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(s == "failed", F.col("index") + 1))), ",").alias("failed_numbers"),
    )


def suspicion(duration: Column, expected: Column, peak: Column, length: Column) -> Column:
    """Why an attempt looks wrong, or null."""
    return F.when((duration < 0.15) | (peak < 1e-4), "empty").when(duration > 2.5 * expected + 3, "too long").when((length > 40) & (duration < 0.3 * expected), "too short")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Per chunk the earliest attempt without a warning, else the one nearest the expected duration.

    ``attempts`` has ``chunk, attempt, duration, expected, warning, error``; if all failed, ``status`` is failed.
    """
    off = F.abs(F.log(F.greatest("duration", F.lit(1e-3)) / F.col("expected")))
    warned = F.col("warning").isNotNull()
    rank = F.struct(warned.alias("w"), F.when(warned, off).otherwise(0.0).alias("off"), F.col("attempt").alias("attempt"))
    ok = F.col("error").isNull()
    return attempts.groupBy("chunk").agg(F.min(F.when(ok, rank)).alias("best"), F.count("*").alias("tries")).select("chunk", "tries", F.col("best.attempt").alias("attempt"), F.coalesce("best.w", F.lit(True)).alias("warned"), F.when(F.col("best").isNull(), "failed").otherwise("generated").alias("status"))


def retry_budget(attempts: DataFrame, most: int) -> DataFrame:
    """Tries spent per chunk, the last error if none succeeded, and whether more may follow."""
    won = F.count_if(F.col("error").isNull()) > 0
    return attempts.groupBy("chunk").agg(F.count("*").alias("spent"), F.when(~won, F.max_by("error", "attempt")).alias("error"), (~won & (F.count("*") < most)).alias("again"))


def resolve_identity(items: DataFrame, library: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each item's library row by the first of ``keys`` that matches; of equal keys the later row wins."""
    out = items
    for k in keys:
        last = library.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_{k}")).agg(F.max("library_id").alias(f"by_{k}"))
        out = out.join(last, F.col(k) == F.col(f"_{k}"), "left").drop(f"_{k}")
    first = F.coalesce(*[F.col(f"by_{k}") for k in keys])
    how = F.coalesce(*[F.when(F.col(f"by_{k}").isNotNull(), k) for k in keys])
    return out.withColumn("library_id", first).withColumn("matched_by", how).drop(*[f"by_{k}" for k in keys])


def recover_missing(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Complete segments whose ``file_path`` and ``cached_file`` are both gone become failed."""
    there = files.select("path").distinct()
    out = segments.join(there.select(F.col("path").alias("file_path"), F.lit(True).alias("a")), "file_path", "left")
    out = out.join(there.select(F.col("path").alias("cached_file"), F.lit(True).alias("b")), "cached_file", "left")
    gone = F.col("status").isin("generated", "placed") & F.col("a").isNull() & F.col("b").isNull()
    return out.withColumn("status", F.when(gone, "failed").otherwise(F.col("status"))).drop("a", "b")


def enrich_segments(segments: DataFrame, facts: DataFrame, edges: DataFrame, clips: DataFrame | None = None, timeline: Column | None = None) -> DataFrame:
    """Audio facts and quiet edges of each segment's file; silent or unread files keep null edges.

    With ``clips`` (``file_path, stored, code, frames``: what an editor says of a clip) and the ``timeline`` rate comes
    ``source_frames``: of the file's duration, else of the clip, else null. A path has one row on each side.
    """
    e = edges.where("reason is null").select(F.col("path").alias("file_path"), F.round("leading", 4).alias("leading_silence_seconds"), F.round("trailing", 4).alias("trailing_silence_seconds"))
    f = facts.select(F.col("path").alias("file_path"), *[c for c in facts.columns if c != "path"])
    out = segments.join(f, "file_path", "left").join(e, "file_path", "left")
    if clips is None:
        return out
    told = duration_frames(F.col("duration"), F.col("stored"), F.col("code"), F.col("frames"), timeline)
    return out.join(clips, "file_path", "left").withColumn("source_frames", F.nullif(told, F.lit(0).cast("long"))).drop("stored", "code", "frames")


def run_summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per status and the exit code: one if anything failed."""
    s = F.col("status")
    return results.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("success", "skipped", "failed", "dry_run")], F.when(F.count_if(s == "failed") > 0, 1).otherwise(0).cast("long").alias("exit_code"))


def transcription_summary(results: DataFrame) -> DataFrame:
    """Of all files: found, ok, skipped, failed, the failed ones' paths in order, seconds; exit code two if any failed.

    ``results`` has ``path, status, elapsed``. The list is as long as the failures of one run.
    """
    s = F.col("status")
    counts = [F.count("*").alias("found"), F.count_if(s == "success").alias("ok"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failed")]
    failed = F.array_join(F.array_sort(F.collect_list(F.when(s == "failed", F.col("path")))), ",").alias("failed_paths")
    return results.agg(*counts, failed, F.sum("elapsed").alias("elapsed"), F.when(F.count_if(s == "failed") > 0, 2).otherwise(0).cast("long").alias("exit_code"))


def narration_summary(segments: DataFrame) -> DataFrame:
    """Per script: segments, generated in this run, cached, placed, failed with their numbers; exit code three if any failed.

    ``segments`` has ``script_id, index, status, cached`` (complete before this run).
    """
    s, complete = F.col("status"), F.col("status").isin("generated", "placed")
    cached = F.coalesce("cached", F.lit(False))
    return segments.groupBy("script_id").agg(
        F.count("*").alias("total"), F.count_if(complete & ~cached).alias("generated"), F.count_if(complete & cached).alias("cached"), F.count_if(s == "placed").alias("placed"), F.count_if(s == "failed").alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(s == "failed", F.col("index") + 1))), ",").alias("failed_numbers"), F.when(F.count_if(s == "failed") > 0, 3).otherwise(0).cast("long").alias("exit_code"),
    )


def voiceover_summary(results: DataFrame) -> DataFrame:
    """Per script: seconds, chunks, cached, warned, and audio seconds per wall second (0 without time)."""
    wall = F.sum("wall")
    return results.groupBy("script_id").agg(F.sum("duration").alias("seconds"), F.count("*").alias("chunks"), F.count_if("cached").alias("cached"), F.count_if(F.col("warning").isNotNull()).alias("warned"), F.when(wall > 0, F.sum("duration") / wall).otherwise(0.0).alias("speed"))


def run_metrics(results: DataFrame) -> DataFrame:
    """Output megapixels a second per model."""
    return results.groupBy("model").agg(F.sum("mpix").alias("mpix"), F.max("seconds").alias("slowest"), (F.sum("mpix") / F.greatest(F.sum("seconds"), F.lit(1e-6))).alias("rate"))


def registry_enrich(rows: DataFrame, registry: DataFrame, name: str) -> DataFrame:
    """The registry's row for each name, case-folded and through aliases; unknown names have ``known`` false."""
    flat = registry.select(F.explode(F.concat(F.array("id"), "aliases")).alias("alias"), "*").withColumn("alias", F.lower("alias"))
    return rows.join(flat, F.lower(F.trim(name)) == F.col("alias"), "left").withColumn("known", F.col("alias").isNotNull()).drop("alias", "aliases")


def route_by_language(rows: DataFrame, registry: DataFrame, lang: str = "lang") -> DataFrame:
    """A row per model that takes the row's language, or one with a reason."""
    takes = registry.select(F.col("id").alias("model"), F.explode("languages").alias("takes"))
    return rows.join(takes, F.col(lang) == F.col("takes"), "left").withColumn("reason", F.when(F.col("model").isNull(), F.concat(F.lit("no model for "), F.coalesce(F.col(lang), F.lit("unknown"))))).drop("takes")


def reset_watch_state(items: DataFrame) -> DataFrame:
    """All items unwatched, with ``was_set`` for those that were not."""
    was = (F.coalesce("view_offset", F.lit(0)) != 0) | (F.coalesce("view_count", F.lit(0)) > 0)
    return items.withColumn("was_set", was).withColumn("view_offset", F.when(was, F.lit(0)).otherwise(F.col("view_offset"))).withColumn("view_count", F.when(was, F.lit(0)).otherwise(F.col("view_count")))


def apply_generator(work: DataFrame, setup: Callable[[], Callable[[dict], dict]], made: str, key: str = "key") -> DataFrame:
    """Run a caller's generator over rows of work: ``key``, the columns of ``made`` (a schema), ``error``.

    ``setup`` runs once a partition (it may load a model) and returns a function from a row to
    what it makes. A row that raises has its error and nulls; a setup that raises gives every row
    of the partition that error.
    """
    names = [c.strip().split()[0] for c in made.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed, generate = None, None
        try:
            generate = setup()
        except Exception as e:  # a caller's code may raise anything
            failed = f"{type(e).__name__}: {e}"
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                got, error = {}, failed
                if generate is not None:
                    try:
                        got = generate(row)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append({key: row[key], "error": error} | {n: got.get(n) for n in names})
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return work.mapInPandas(run, f"{key} {work.schema[key].dataType.simpleString()}, {made}, error string")
