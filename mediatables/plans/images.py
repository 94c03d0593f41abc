"""Plans for enlarging images: target sizes, models and the cheapest chain of passes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Long edges of the named targets (fixed values).
PRESETS = {"1080p": 1920, "2k": 2560, "1440p": 2560, "4k": 3840, "5k": 5120, "6k": 6144, "8k": 7680, "12k": 11520, "16k": 15360}
#: Model, scale, kind of content, tier, cost per output pixel (fixed values).
MODELS = (
    ("nomos8k-dat", 4, "photo", "quality", 36.0), ("nomos8k-srformer", 4, "photo", "quality", 41.0), ("nomos-webphoto", 4, "photo", "balanced", 3.0), ("nomos2-realplksr", 4, "photo", "balanced", 3.2),
    ("ultrasharp", 4, "any", "balanced", 7.3), ("realesrgan", 4, "any", "balanced", 7.3), ("anime", 4, "anime", "balanced", 3.4), ("fast2x", 2, "any", "fast", 1.0), ("fast2x-avc", 2, "any", "fast", 1.0),
)
MOST_PIXELS, MOST_PEAK = 800_000_000, 400.0


def parse_target(width: Column, height: Column, target: Column) -> Column:
    """``struct<multiplier, width, height, label, error>`` of ``4k``, ``3840x2160``, ``x2.5`` or a pixel width."""
    t = F.lower(F.trim(target))
    w, h = (F.regexp_extract(t, r"^(\d{2,6})\s*[x×]\s*(\d{2,6})$", k).try_cast("double") for k in (1, 2))
    edge = F.create_map(*[F.lit(x) for kv in PRESETS.items() for x in kv])[t].cast("double")
    number = F.regexp_extract(t, r"^x?(\d+(?:\.\d+)?)x?$", 1).try_cast("double")
    times = t.contains("x") | (number < 100)
    long_side = F.greatest(width, height)
    m = F.when(w.isNotNull(), F.greatest(w / width, h / height)).when(edge.isNotNull(), edge / long_side).when(times, number).otherwise(number / width)
    sizes = [F.greatest(F.lit(1), F.bround(x * m)).cast("long") for x in (width, height)]
    error = F.when(m.isNull() | (m <= 0), "unknown target").when(times & w.isNull() & edge.isNull() & (number > 32), "over 32 times").when(sizes[0] * sizes[1] > MOST_PIXELS, "too large")
    return F.struct(m.alias("multiplier"), sizes[0].alias("width"), sizes[1].alias("height"), t.alias("label"), error.alias("error"))


def choose_model(content: Column, compressed: Column, tier: Column, override: Column | None = None) -> Column:
    """The model asked for, else flat art's, else the tier's for clean or compressed pictures."""
    own = F.when(content == "anime", "anime").when(tier == "fast", F.when(compressed, "fast2x-avc").otherwise("fast2x")).when(tier == "quality", F.when(compressed, "nomos8k-srformer").otherwise("nomos8k-dat")).otherwise(F.when(compressed, "nomos-webphoto").otherwise("nomos2-realplksr"))
    return own if override is None else F.coalesce(override, own)


#: Texts of plans and results (fixed values).
ART_NOTE, LOSSY_NOTE = "detected illustration/anime -> line-art model", "source looks lossy-compressed -> degradation-aware model"
LARGE_NOTE, SKIPPED = "large job: peaks at %.0f MPix in RAM", "already %dx%d, at or above %s \u2014 nothing to upscale"
RESAMPLE, RESIZED = "resample only -> %dx%d", " -> Lanczos to %dx%d"


def model_notes(content: Column, compressed: Column, override: Column | None = None) -> Column:
    """Why :func:`choose_model` took its model; nothing where it was asked for."""
    why = F.when(content == "anime", ART_NOTE).when(compressed, LOSSY_NOTE)
    return F.array_compact(F.array(why if override is None else F.when(override.isNull(), why)))


def scale_for_4k(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1.0), PRESETS["4k"] / F.greatest(width, height))


def chains(passes: int = 3) -> list[tuple[str, list[str], int, float, int]]:
    """Every chain of at most ``passes``: model, steps, net scale, cost, number of steps; the first step is the model itself.

    Later steps are the model or the two-fold one; a step costs its weight times its output's pixels.
    """
    rows = []
    for name, scale, _, _, weight in MODELS:
        options = {(name, scale, weight), (name, scale, weight) if scale == 2 else ("fast2x", 2, 1.0)}
        for n in range(1, passes + 1):
            for rest in product(sorted(options), repeat=n - 1):
                steps, net, cost = [], 1, 0.0
                for m, s, w in ((name, scale, weight), *rest):
                    net *= s
                    steps.append(m)
                    cost += w * net * net
                rows.append((name, steps, net, cost, n))
    return rows


def _planned(images: DataFrame, target: str, tier: str, passes: int, override: Column | None = None) -> DataFrame:
    """The images with ``goal, model, best`` (the chain, null where nothing is to do), ``status`` and ``peak``.

    A chain's rank among all is a whole number: those that reach the goal by cost, passes, scale and steps, after
    them those that fall short, the longest first. So an image looks its model's ranks up in its own row, and an id's best is their least.
    """
    goal = parse_target(F.col("width"), F.col("height"), F.lit(target))
    i = images.withColumn("goal", goal).withColumn("model", choose_model(F.col("content"), F.col("compressed"), F.lit(tier), override))
    reach = sorted(chains(passes), key=lambda c: (c[3], c[4], c[2], c[1]))
    short = sorted(reach, key=lambda c: -c[2])
    ranked = F.array(*[F.struct(F.array(*map(F.lit, c[1])).alias("steps"), F.lit(c[2]).alias("net"), F.lit(c[4]).alias("n")) for c in reach + short])
    ranks = {name: [F.struct(F.lit(c[2]).alias("net"), F.lit(k).alias("full"), F.lit(len(reach) + short.index(c)).alias("short")) for k, c in enumerate(reach) if c[0] == name] for name, *_ in MODELS}
    mine = F.create_map(*[x for name, structs in ranks.items() for x in (F.lit(name), F.array(*structs))])[F.col("model")]
    m = F.col("goal.multiplier")
    rank = F.array_min(F.transform(mine, lambda c: F.when(c["net"] < m, c["short"]).otherwise(c["full"])))
    i = i.withColumn("_rank", F.when(F.col("goal.error").isNull() & (m > 1), rank))
    best = i.where("_rank is not null").groupBy("image_id").agg(F.min("_rank").alias("_best_rank"))
    status = F.when(F.col("goal.error").isNotNull(), "failed").when(F.col("goal.multiplier") <= 1, "skipped").otherwise("planned")
    peak = F.col("width").cast("double") * F.col("height") * F.col("best.net") * F.col("best.net") / 1e6
    return i.join(best, "image_id", "left").withColumn("best", F.get(ranked, F.col("_best_rank"))).drop("_rank", "_best_rank").withColumns({"status": status, "peak": peak})


def plan_images(images: DataFrame, target: str = "4k", tier: str = "balanced", passes: int = 3) -> DataFrame:
    """``image_id, width, height, content, compressed`` with the cheapest chain that reaches the target.

    Nothing to do is ``skipped``; a bad target is ``failed``; where no chain reaches it, the longest of the model is taken.
    """
    peak = F.col("peak")
    return _planned(images, target, tier, passes).select(
        "image_id", "width", "height", F.col("goal.width").alias("target_width"), F.col("goal.height").alias("target_height"), F.round("goal.multiplier", 3).alias("multiplier"), "model", "status",
        F.coalesce(F.array_join("best.steps", "+"), F.lit("")).alias("steps"), F.coalesce("best.n", F.lit(0)).alias("passes"), F.round(F.coalesce(peak, F.lit(0.0)), 1).alias("peak_mpix"),
        F.coalesce(F.abs(F.col("best.net") - F.col("goal.multiplier")) >= 1e-6, F.lit(False)).alias("final_resize"), (F.coalesce(peak, F.lit(0.0)) > MOST_PEAK).alias("heavy"),
    )


def plan_preview(images: DataFrame, target: str = "4k", tier: str = "balanced", override: str | None = None, passes: int = 3) -> DataFrame:
    """What would be done with each image, in words: sizes after each pass, the plan, notes, why it is skipped or failed.

    ``override`` names the model for all images; one that is not known fails. A plan without a pass peaks
    at its source's size. Rows that repeat an ``image_id`` are planned each, on one chain for their id.
    """
    forced = None if override is None else F.lit(override)
    p = _planned(images, target, tier, passes, forced)
    known = F.lit(override is None or override in {m[0] for m in MODELS})
    scales = F.create_map(*[F.lit(x) for name, scale, *_ in MODELS for x in (name, scale)])
    steps, net = F.col("best.steps"), F.col("best.net")
    nets = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.aggregate(F.slice(steps, F.lit(1), k), F.lit(1), lambda a, m: a * scales[m]))
    sizes = F.transform(nets, lambda n: F.concat_ws("x", (F.col("width") * n).cast("string"), (F.col("height") * n).cast("string")))
    chain = F.array_join(F.transform(steps, lambda m: F.concat(m, F.lit(" x"), scales[m].cast("string"))), " -> ")
    goal = [F.col("goal.width"), F.col("goal.height")]
    tail = F.when(F.abs(net - F.col("goal.multiplier")) >= 1e-6, F.format_string(RESIZED, *goal)).otherwise("")
    described = F.when(F.col("status") == "planned", F.concat(chain, F.lit(" (x"), net.cast("string"), F.lit(")"), tail)).when(F.col("status") == "skipped", F.format_string(RESAMPLE, *goal))
    peak = F.coalesce("peak", F.col("width").cast("double") * F.col("height") / 1e6)
    notes = F.concat(model_notes(F.col("content"), F.col("compressed"), forced), F.array_compact(F.array(F.when(F.col("peak") > MOST_PEAK, F.format_string(LARGE_NOTE, F.col("peak"))))))
    skipped = F.when(F.col("status") == "skipped", F.format_string(SKIPPED, F.col("width"), F.col("height"), F.col("goal.label")))
    error = F.when(~known, "unknown model").otherwise(F.col("goal.error"))
    return p.select(
        "image_id", F.when(known, F.col("status")).otherwise("failed").alias("status"), "content", "model", F.coalesce(sizes, F.array().cast("array<string>")).alias("pass_sizes"), F.when(known, described).alias("plan"),
        F.round(peak, 1).alias("peak_mpix"), notes.alias("notes"), skipped.alias("skipped"), error.alias("error"), F.round(scale_for_4k(F.col("width"), F.col("height")), 3).alias("scale_for_4k"),
    )
