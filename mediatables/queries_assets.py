"""Registered queries over plans in words, several roots, bundles, clips' fallbacks and manifests of many segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import timecode as TC
from .operators import layout, manifest, pixels, signal
from .plans import images
from .queries_media import _CLIPS, _DROP1, _DROP10, _IMAGES, _INVENTORY, _SIGNAL, _chain_rows, _clips, _images, _inventory, _signal, _t
from .sources import inventory

_NTSC = "29.97 df"


def _preview(s, d, target, tier, override):
    out = images.plan_preview(_images(s, d), target, tier, override)
    return out.withColumns({c: F.array_join(c, "|") for c in ("pass_sizes", "notes")})


def plan_preview(s, d):
    return _preview(s, d, "4k", "balanced", None)


def plan_preview_forced(s, d):
    """A model asked for, at a size that takes several passes and much memory."""
    return _preview(s, d, "16k", "balanced", "ultrasharp")


def scan_roots(s, d):
    """Pages as files of folders by extension; every ninth is named itself, whatever its extension."""
    inv = _inventory(s, d).select("page_id", "path", "size")
    return inventory.discover(inv.where("page_id % 9 <> 0"), inv.where("page_id % 9 = 0"), ("html",)).select("path", "size", "name", "ext")


def looks_compressed(s, d):
    """Pictures of 64 columns from events; one of the three bears a lossy format's extension."""
    e = _t(s, d, "events")
    p = e.select((F.col("event_id") % 3).alias("image_id"), F.floor(F.col("event_id") / 192).cast("int").alias("y"), F.floor(F.col("event_id") / 3 % 64).cast("int").alias("x"), (F.floor("value") % 256).cast("int").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    files = p.select("image_id").distinct().select("image_id", F.concat(F.lit("in/p"), F.col("image_id").cast("string"), F.when(F.col("image_id") == 1, ".JPeG").otherwise(".png")).alias("path"))
    return pixels.looks_compressed(p, files)


def _bundle_files(s, d):
    """Four documents a folder: a recording, a transcript that may be blank, a profile that may be broken, and another file."""
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.when(F.col("doc_id") % 8 == 0, "Sample.WAV").otherwise("notes.md")).when(k == 1, "transcript.txt").when(k == 2, "profile.json").otherwise("another.ogg")
    profile = F.when(F.col("doc_id") % 16 == 2, "{bad").otherwise(F.to_json(F.struct(F.col("lang").alias("language"), F.col("text").alias("transcript"), F.create_map(F.lit("n"), F.col("n_chars").cast("string")).alias("options"))))
    text = F.when(k == 1, F.when(F.col("doc_id") % 12 == 1, " \n").otherwise(F.col("text"))).when(k == 2, profile)
    return _t(s, d, "documents").select(F.concat(F.lit("voices/"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit("/"), name).alias("path"), text.alias("text"))


def assemble_bundles(s, d):
    f = _bundle_files(s, d)
    out = inventory.assemble_bundles(inventory.described(f.select("path")), f.where("text is not null"))
    return out.select("dir", "reference", "transcript", "valid", F.sha2("transcript_text", 256).alias("text_sha256"), "language", F.col("options")["n"].alias("n"))


def place_timecodes(s, d):
    """Placed clips on a drop-frame timeline that starts at an hour."""
    c = _clips(s, d).select("track", F.col("doc_id").alias("pos"), TC.seconds_to_frames(F.col("duration"), F.col("rate"), "floor").alias("length"))
    rate = TC.parse_rate(F.lit(_NTSC))
    return layout.placement_rows(layout.place_sequential(c, 107892, 2), rate).select("track", "pos", "record_frame", "status", "timeline_timecode")


def enrich_source_frames(s, d):
    """Segments whose file is read, whose clip tells its frames (stored, as timecode or text), or neither."""
    x = _signal(s, d)
    facts = signal.signal_levels(x).where("duration > 20").select(F.concat(F.lit("f"), F.col("series_id").cast("string")).alias("path"), "duration")
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    docs, k = _t(s, d, "documents"), F.col("doc_id") % 4
    rate = TC.parse_rate(F.lit("25"))
    n = F.col("n_chars").cast("long")
    clips = docs.select(path.alias("file_path"), F.when(k == 0, n).alias("stored"), F.when(k == 1, TC.frames_to_timecode(n, rate)).alias("code"), F.when(k == 2, n.cast("string")).alias("frames"))
    edges = facts.select("path", F.lit(None).cast("double").alias("leading"), F.lit(None).cast("double").alias("trailing"), F.lit("not analysed").alias("reason"))
    return manifest.enrich_segments(docs.select("doc_id", path.alias("file_path")), facts, edges, clips, rate).select("doc_id", "duration", "source_frames")


def build_manifest_turns(s, d):
    """Conversations as scripts of a segment a turn: every segment beside its run."""
    t = _t(s, d, "conversations")
    turns = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text", F.length("text").alias("char_count"), F.floor(F.col("turn") / 2).alias("paragraph_index"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    docs = t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(said, "\n").alias("text"))
    segments, runs = manifest.build_manifest(turns, docs, 300, True)
    return segments.join(runs, "script_id").select("script_id", "index", "char_count", "paragraph_index", "status", "attempts", "script_sha256", "max_chars", "merge_paragraphs", "segments")


QUERIES = {f.__name__: f for f in (plan_preview, plan_preview_forced, scan_roots, looks_compressed, assemble_bundles, place_timecodes, enrich_source_frames, build_manifest_turns)}


def _preview_sql(edge, forced):
    """Chains tried one and all; sizes and texts put together step by step."""
    model = f"'{forced}'" if forced else "model"
    note = "[]" if forced else f"CASE WHEN content = 'anime' THEN ['{images.ART_NOTE}'] WHEN compressed THEN ['{images.LOSSY_NOTE}'] ELSE [] END"
    label = {3840: "4k", 15360: "16k"}[edge]
    times = "CASE WHEN s LIKE 'fast2x%' THEN 2 ELSE 4 END"
    return f"""WITH c(model, steps, net, cost, n) AS (VALUES {_chain_rows()}),
i AS (SELECT image_id, width, height, content, compressed, {model} AS model, {edge}.0::DOUBLE / greatest(width, height) AS m FROM {_IMAGES}),
b AS (SELECT image_id, arg_min({{'steps': steps, 'net': net, 'n': n}}, {{'a': net < m, 'b': CASE WHEN net < m THEN -net ELSE 0 END, 'c': cost, 'd': n, 'e': net, 'f': string_split(steps, '+')}}) AS b FROM i JOIN c USING (model) WHERE m > 1 GROUP BY image_id),
j AS (SELECT *, greatest(1, round_even(width * m, 0))::BIGINT || 'x' || greatest(1, round_even(height * m, 0))::BIGINT AS goal, string_split(b.steps, '+') AS l, width::DOUBLE * height * b.net * b.net / 1e6 AS peak,
  width * height * m * m > 800000000 AS failed FROM i LEFT JOIN b USING (image_id)),
k AS (SELECT *, list_transform(l, lambda s: {times}) AS z FROM j)
SELECT image_id, CASE WHEN failed THEN 'failed' WHEN m <= 1 THEN 'skipped' ELSE 'planned' END AS status, content, model,
  CASE WHEN failed OR m <= 1 THEN '' ELSE array_to_string([width * z[1] || 'x' || height * z[1], CASE WHEN b.n > 1 THEN width * z[1] * z[2] || 'x' || height * z[1] * z[2] END, CASE WHEN b.n > 2 THEN width * z[1] * z[2] * z[3] || 'x' || height * z[1] * z[2] * z[3] END], '|') END AS pass_sizes,
  CASE WHEN failed THEN NULL WHEN m <= 1 THEN 'resample only -> ' || goal ELSE array_to_string(list_transform(l, lambda s: s || ' x' || {times}), ' -> ') || ' (x' || b.net || ')' || CASE WHEN abs(b.net - m) >= 1e-6 THEN ' -> Lanczos to ' || goal ELSE '' END END AS plan,
  round(CASE WHEN failed OR m <= 1 THEN width::DOUBLE * height / 1e6 ELSE peak END, 1) AS peak_mpix,
  array_to_string(list_concat({note}, CASE WHEN NOT failed AND peak > 400 THEN ['large job: peaks at ' || round(peak, 0)::BIGINT || ' MPix in RAM'] ELSE [] END), '|') AS notes,
  CASE WHEN NOT failed AND m <= 1 THEN 'already ' || width || 'x' || height || ', at or above {label} — nothing to upscale' END AS skipped,
  CASE WHEN failed THEN 'too large' END AS error, round(greatest(1.0::DOUBLE, 3840.0::DOUBLE / greatest(width, height)), 3) AS scale_for_4k FROM k"""


_FRAME_LABEL = f"record_frame + 18 * (record_frame // {_DROP10}) + CASE WHEN record_frame % {_DROP10} >= 2 THEN 2 * ((record_frame % {_DROP10} - 2) // {_DROP1}) ELSE 0 END"

ORACLES = {
    "plan_preview": _preview_sql(3840, None),
    "plan_preview_forced": _preview_sql(15360, "ultrasharp"),
    "scan_roots": f"SELECT path, min(size) AS size, any_value(name) AS name, any_value(ext) AS ext FROM {_INVENTORY} WHERE path IS NOT NULL AND (ext = 'html' OR page_id % 9 = 0) GROUP BY path",
    "looks_compressed": "WITH p AS (SELECT event_id % 3 AS image_id, event_id // 192 AS y, event_id // 3 % 64 AS x, (floor(value)::BIGINT % 256) / 3.0::DOUBLE / 255 AS v FROM events), q AS (SELECT *, abs(lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - v) AS step FROM p), g AS (SELECT image_id, CASE WHEN max(x) >= 63 AND max(y) >= 63 AND avg(step) >= 0.01 THEN avg(step) FILTER (x % 8 = 7) / avg(step) ELSE 0 END AS score FROM q GROUP BY image_id) SELECT image_id, image_id = 1 OR score > 1.5 AS compressed FROM g",
    "assemble_bundles": r"""WITH f AS (SELECT *, 'voices/' || doc_id // 4 AS dir FROM documents), t AS (SELECT dir,
 max(CASE WHEN doc_id % 8 = 0 THEN dir || '/Sample.WAV' END) AS s, max(CASE WHEN doc_id % 4 = 3 THEN dir || '/another.ogg' END) AS o, max(CASE WHEN doc_id % 4 = 1 THEN dir || '/transcript.txt' END) AS transcript,
 max(CASE WHEN doc_id % 4 = 1 AND doc_id % 12 <> 1 THEN nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') END) AS spoken, max(CASE WHEN doc_id % 4 = 2 AND doc_id % 16 <> 2 THEN text END) AS told,
 max(CASE WHEN doc_id % 4 = 2 AND doc_id % 16 <> 2 THEN lang END) AS language, max(CASE WHEN doc_id % 4 = 2 AND doc_id % 16 <> 2 THEN n_chars END)::VARCHAR AS n FROM f GROUP BY dir)
SELECT dir, coalesce(s, o) AS reference, transcript, coalesce(s, o) IS NOT NULL AS valid, sha256(coalesce(spoken, told)) AS text_sha256, language, n FROM t""",
    "place_timecodes": f"SELECT track, pos, record_frame, 'placed' AS status, format('{{:02d}}:{{:02d}}:{{:02d}};{{:02d}}', l // 108000, l // 1800 % 60, l // 30 % 60, l % 30) AS timeline_timecode FROM (SELECT *, {_FRAME_LABEL} AS l FROM (SELECT track, doc_id AS pos, 107892 + coalesce(sum(floor(duration * fps)::BIGINT + 2) OVER (PARTITION BY track ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_frame FROM {_CLIPS}))",
    "enrich_source_frames": f"SELECT doc_id, duration, coalesce(nullif(floor(duration * 25)::BIGINT, 0), CASE WHEN doc_id % 4 < 3 AND n_chars > 0 THEN n_chars END)::BIGINT AS source_frames FROM documents LEFT JOIN (SELECT series_id, count(*)::DOUBLE AS duration FROM {_SIGNAL} GROUP BY series_id HAVING count(*) > 20) ON doc_id = series_id",
    "build_manifest_turns": "SELECT conv_id AS script_id, turn AS index, length(text) AS char_count, turn // 2 AS paragraph_index, 'pending' AS status, 0 AS attempts, sha256(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS script_sha256, 300 AS max_chars, true AS merge_paragraphs, count(*) OVER (PARTITION BY conv_id) AS segments FROM conversations",
}
