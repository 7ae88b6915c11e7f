"""Pixel tables (image, x, y and values): morphology, counts, sampling and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import linear_to_srgb, srgb_to_linear


def _neighbours(mask: DataFrame, radius: int, width: int | None = None) -> DataFrame:
    """Each pixel's value at all places that have it in their square; with ``width``, x wraps around."""
    d = F.array(*map(F.lit, range(-radius, radius + 1)))
    x = F.col("x") + F.col("dx")
    out = mask.withColumn("dx", F.explode(d)).withColumn("x", F.pmod(x, F.lit(width)) if width else x).drop("dx")
    return out.withColumn("dy", F.explode(d)).withColumn("y", F.col("y") + F.col("dy")).drop("dy")


def dilate(mask: DataFrame, radius: int, width: int | None = None) -> DataFrame:
    """image, x, y, flag of the same pixels: true where any pixel of the square is. Outside counts as false.

    Only true pixels are spread; ``width`` makes x periodic, as longitude is.
    """
    hit = _neighbours(mask.where("flag").select("image", "x", "y"), radius, width).distinct().withColumn("hit", F.lit(True))
    return mask.select("image", "x", "y").join(hit, ["image", "x", "y"], "left").select("image", "x", "y", F.coalesce("hit", F.lit(False)).alias("flag"))


def erode(mask: DataFrame, radius: int) -> DataFrame:
    """True where all pixels of the square are there and true."""
    full = (2 * radius + 1) ** 2
    hit = _neighbours(mask.where("flag").select("image", "x", "y"), radius).groupBy("image", "x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == full)
    return mask.select("image", "x", "y").join(hit, ["image", "x", "y"], "left").select("image", "x", "y", F.col("n").isNotNull().alias("flag"))


def all_valid_max(pixels: DataFrame) -> DataFrame:
    """image, x, y, far: the greatest depth of the 3 x 3 pixels, null unless all nine are valid."""
    out = _neighbours(pixels.where("valid").select("image", "x", "y", "depth"), 1).groupBy("image", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("far"))
    return pixels.select("image", "x", "y").join(out, ["image", "x", "y"], "left").select("image", "x", "y", F.when(F.col("n") == 9, F.col("far")).alias("far"))


def integral(mask: DataFrame) -> DataFrame:
    """image, x, y, total: true pixels at or above and left of each one. A row, then a column, is one task's group."""
    rows = Window.partitionBy("image", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    columns = Window.partitionBy("image", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    across = mask.withColumn("_r", F.sum(F.col("flag").cast("long")).over(rows))
    return across.withColumn("total", F.sum("_r").over(columns)).select("image", "x", "y", "total")


def pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """image, level, x, y, near, far: depth extremes of valid pixels in blocks of 2^level."""
    base = pixels.where("valid").select("image", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "x", "y", "depth")
    size = F.pow(F.lit(2.0), F.col("level"))
    return base.groupBy("image", "level", F.floor(F.col("x") / size).cast("long").alias("x"), F.floor(F.col("y") / size).cast("long").alias("y")).agg(F.min("depth").alias("near"), F.max("depth").alias("far"))


def block_means(pixels: DataFrame, factor: int, value: str) -> DataFrame:
    """Means of valid pixels in blocks, null unless all pixels of the block are valid."""
    key = ["image", F.floor(F.col("x") / factor).cast("long").alias("x"), F.floor(F.col("y") / factor).cast("long").alias("y")]
    out = pixels.groupBy(*key).agg(F.avg(F.when(F.col("valid"), F.col(value))).alias("mean"), F.count_if("valid").alias("n"))
    return out.select("image", "x", "y", F.when(F.col("n") == factor * factor, F.col("mean")).alias("mean"))


def composite(over: Column, under: Column, alpha: Column) -> Column:
    """An 8-bit channel over another in linear light, rounded half to even; alpha 0 keeps the lower one as it is."""
    mixed = srgb_to_linear(over / 255) * alpha + srgb_to_linear(under / 255) * (1 - alpha)
    return F.when(alpha == 0, under).otherwise(F.rint(255 * linear_to_srgb(mixed)).cast("int"))


def labelled(scores: DataFrame, dynamic: float, sky: float, ground: float, strict: bool = False) -> DataFrame:
    """policy of each pixel (dynamic, sky, ground scores): dynamic goes before sky and ground.

    Labels count from their limit on; score planes (``strict``) only above it.
    """
    over = (lambda c, t: F.col(c) > t) if strict else (lambda c, t: F.col(c) >= t)
    return scores.withColumn("policy", F.when(over("dynamic", dynamic), "remove").when(over("sky", sky), "sky").when(over("ground", ground), "ground").otherwise("keep"))


def union_masks(instances: DataFrame, threshold: float) -> DataFrame:
    """Pixels of any instance whose score is strictly above the threshold."""
    return instances.where(F.col("score") > threshold).groupBy("image", "x", "y").agg(F.max("score").alias("score"))


def coverage(masks: DataFrame) -> DataFrame:
    """image and the share of pixels that are set."""
    return masks.groupBy("image").agg(F.avg(F.col("flag").cast("int")).alias("share"))


def new_holes(before: DataFrame, after: DataFrame, threshold: float) -> DataFrame:
    """image and the masked pixels whose alpha was at the threshold or above and no longer is."""
    b = after.select("image", "x", "y", F.col("alpha").alias("_after"))
    lost = F.col("flag") & (F.col("alpha") >= threshold) & (F.col("_after") < threshold)
    return before.join(b, ["image", "x", "y"]).groupBy("image").agg(F.count_if(lost).alias("new_holes"))
