"""Pixel statistics over rows ``image_id, y, x, r, g, b``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files: the decoded bytes, row by row."""
    i = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    at = i.select(F.col("origin").alias("image_id"), "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("k"))

    def byte(c: int):
        return F.conv(F.hex(F.substr("data", F.col("k") * F.col("nChannels") + 1 + F.least(F.lit(c), F.col("nChannels") - 1), F.lit(1))), 16, 10).cast("int")

    return at.select("image_id", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def pixel_stats(pixels: DataFrame, most: int = 600) -> DataFrame:
    """``image_id, unique_share, flat_share, content`` on a strided sample.

    Flat art has few colours (< 0.03 of the samples) and mostly equal neighbours (> 0.85).
    """
    size = pixels.groupBy("image_id").agg(F.greatest(F.lit(1), F.floor(F.greatest(F.max("y") + 1, F.max("x") + 1) / most)).alias("step"))
    s = pixels.join(size, "image_id").where((F.col("y") % F.col("step") == 0) & (F.col("x") % F.col("step") == 0))
    s = s.withColumn("sum", F.col("r") + F.col("g") + F.col("b"))
    left = F.lag("sum").over(Window.partitionBy("image_id", "y").orderBy("x"))
    above = F.lag("sum").over(Window.partitionBy("image_id", "x").orderBy("y"))
    s = s.withColumn("same_x", (left == F.col("sum")).cast("double")).withColumn("same_y", (above == F.col("sum")).cast("double"))
    # colours first per image and colour, so that counting them needs no wide set
    colours = s.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"), F.sum("same_x").alias("sx"), F.count("same_x").alias("nx"), F.sum("same_y").alias("sy"), F.count("same_y").alias("ny"))
    a = colours.groupBy("image_id").agg((F.count("*") / F.sum("n")).alias("unique_share"), ((F.sum("sx") / F.sum("nx") + F.sum("sy") / F.sum("ny")) / 2).alias("flat_share"))
    return a.withColumn("content", F.when((F.col("unique_share") < 0.03) & (F.col("flat_share") > 0.85), "anime").otherwise("photo"))


def block_grid_score(pixels: DataFrame) -> DataFrame:
    """``image_id, score, compressed``: how much steeper the luma is across every eighth column."""
    luma = pixels.withColumn("v", (F.col("r") + F.col("g") + F.col("b")) / 3.0 / 255.0)
    step = F.abs(F.lead("v").over(Window.partitionBy("image_id", "y").orderBy("x")) - F.col("v"))
    d = luma.withColumn("step", step)
    a = d.groupBy("image_id").agg(F.avg(F.when(F.col("x") % 8 == 7, F.col("step"))).alias("edge"), F.avg("step").alias("mean"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    usable = (F.col("w") >= 64) & (F.col("h") >= 64) & (F.col("mean") >= 0.01)
    score = F.when(usable, F.col("edge") / F.col("mean")).otherwise(0.0)
    return a.select("image_id", score.alias("score"), (score > 1.5).alias("compressed"))


#: Extensions of lossy formats (fixed values).
LOSSY = ("jpg", "jpeg", "jpe", "jfif", "webp")


def looks_compressed(pixels: DataFrame, files: DataFrame) -> DataFrame:
    """``image_id, compressed`` of ``image_id, path``: by the extension alone where it is a lossy format's, else by the block grid.

    Pixels of files with a lossy extension are dropped before any window; files without pixels are not compressed.
    """
    lossy = F.coalesce(F.lower(F.regexp_extract("path", r".\.([^./]+)$", 1)).isin(*LOSSY), F.lit(False))
    named = files.where("image_id is not null").groupBy("image_id").agg(F.max(lossy).alias("lossy"))
    grid = block_grid_score(pixels.join(named.where("not lossy"), "image_id", "left_semi")).select("image_id", F.col("compressed").alias("grid"))
    return named.join(grid, "image_id", "left").select("image_id", (F.col("lossy") | F.coalesce("grid", F.lit(False))).alias("compressed"))
