"""Distances within masks, consensus of sky colours over stations, tallies and weighted losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import finite


def mask_distance(mask: DataFrame, width: int, height: int, band: int = 64) -> DataFrame:
    """image, x, y, distance: from each pixel to the nearest unset one; all places outside the picture are unset.

    Exact: the nearest unset pixel of each column by windows, then the least over a row's columns as the
    lower envelope of parabolas. A task holds ``band`` rows of one image. All pixels must be there.
    """
    up = Window.partitionBy("image", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("image", "x").orderBy("y").rowsBetween(0, Window.unboundedFollowing)
    hole = F.when(~F.col("flag"), F.col("y"))
    above = F.col("y") - F.coalesce(F.max(hole).over(up), F.lit(-1))
    below = F.coalesce(F.min(hole).over(down), F.lit(height)) - F.col("y")
    columns = mask.select("image", "x", "y", F.least(above, below).cast("double").alias("gap"))

    def across(table):
        import pyarrow as pa

        x, y, gap = (table.column(c).to_numpy() for c in ("x", "y", "gap"))
        rows, at = np.unique(y, return_inverse=True)
        # Columns -1 and width are unset.
        grid = np.zeros((len(rows), width + 2))
        grid[at, x + 1] = gap
        out = np.array([_envelope(r * r) for r in grid])
        return pa.table({"image": table.column("image"), "x": table.column("x"), "y": table.column("y"), "distance": pa.array(np.sqrt(out[at, x + 1]))})

    kinds = {f.name: f.dataType.simpleString() for f in mask.schema}
    schema = f"image {kinds['image']}, x {kinds['x']}, y {kinds['y']}, distance double"
    banded = columns.withColumn("_band", F.floor(F.col("y") / band))
    return banded.groupBy("image", "_band").applyInArrow(lambda t: across(t.drop(["_band"])), schema)


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (p - q)^2 + f[q] for all p."""
    n = len(f)
    tops, starts = [0], [-np.inf]
    for q in range(1, n):
        while True:
            p = tops[-1]
            meet = (f[q] + q * q - f[p] - p * p) / (2 * (q - p))
            if meet > starts[-1]:
                break
            tops.pop()
            starts.pop()
        tops.append(q)
        starts.append(meet)
    owner = np.array(tops)[np.searchsorted(np.array(starts), np.arange(n), side="right") - 1]
    return (np.arange(n) - owner) ** 2 + f[owner]


def depth_evidence(pixels: DataFrame, sky: float = 0.3, edge: float = 0.12) -> DataFrame:
    """image, x, y, valid, relative_edge and accepted (pixels: depth, sky, usable, edited).

    valid: finite depth above 0, sky score below the limit and usable. The edge is the range of depth over 3 x 3 pixels by
    the pixel's depth, with the picture's rim repeated outside.
    """
    d = F.array(*map(F.lit, (-1, 0, 1)))
    # Rows beyond the rim repeat rows of the square, so that the range needs only what is there.
    spread = pixels.where(finite(F.col("depth"))).select("image", "x", "y", "depth").withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d))
    spread = spread.select("image", (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"), "depth")
    extent = spread.groupBy("image", "x", "y").agg((F.max("depth") - F.min("depth")).alias("extent"))
    valid = F.coalesce(finite(F.col("depth")) & (F.col("depth") > 0) & finite(F.col("sky")) & (F.col("sky") < sky) & F.col("usable"), F.lit(False))
    out = pixels.join(extent, ["image", "x", "y"], "left").withColumn("valid", valid).withColumn("relative_edge", F.col("extent") / F.greatest(F.col("depth"), F.lit(1e-8)))
    return out.select("image", "x", "y", "valid", "relative_edge", (F.col("valid") & ~F.col("edited") & F.coalesce(F.col("relative_edge") <= edge, F.lit(False))).alias("accepted"))


def colour_consensus(views: DataFrame, minimum: int, negative: float = 0.0, spread: float = 0.12) -> DataFrame:
    """row_id, support, negatives, red, green, blue, disagreement and accepted.

    ``views``: row_id, station_id, positive, conflict, red, green, blue (0 to 1). A station's colour is the mean over its positive
    views; the row's is the median over stations, and the disagreement is the largest difference of any channel
    from it. A station with any conflicting view is negative, also where it has a colour.
    """
    colours = ("red", "green", "blue")
    per = views.groupBy("row_id", "station_id").agg(F.bool_or("positive").alias("seen"), F.bool_or("conflict").alias("bad"), *(F.avg(F.when(F.col("positive"), F.col(c))).alias(c) for c in colours))
    seen = F.when(F.col("seen"), F.lit(1))
    mid = per.groupBy("row_id").agg(
        F.count(seen).alias("support"), F.count_if("bad").alias("negatives"), F.count_if(F.col("seen") | F.col("bad")).alias("known"),
        *(F.median(F.when(F.col("seen"), F.col(c))).alias(c) for c in colours), *(F.min(c).alias(f"{c}_min") for c in colours), *(F.max(c).alias(f"{c}_max") for c in colours),
    )
    far = F.greatest(*(F.greatest(F.col(f"{c}_max") - F.col(c), F.col(c) - F.col(f"{c}_min")) for c in colours))
    enough = F.col("support") >= minimum
    share = F.col("negatives") / F.greatest(F.col("known"), F.lit(1))
    out = mid.withColumn("disagreement", F.when(enough, far)).withColumn("accepted", F.coalesce(enough & (share <= negative) & (far <= spread), F.lit(False)))
    return out.select("row_id", "support", "negatives", *colours, "disagreement", "accepted")


def source_counts(pixels: DataFrame) -> DataFrame:
    """source_count and how many accepted pixels have it."""
    return pixels.where("accepted").groupBy("source_count").agg(F.count(F.lit(1)).alias("pixels"))


def concept_tallies(instances: DataFrame) -> DataFrame:
    """concept, candidates, accepted and the best score of accepted instances (null if none is)."""
    return instances.groupBy("concept").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("accepted").alias("accepted"), F.max(F.when(F.col("accepted"), F.col("score"))).alias("best"))


def weighted_loss(rows: DataFrame, by: list[str], loss: Column, weight: Column) -> DataFrame:
    """by and the weighted mean of a loss; 0 where all weights are 0."""
    return rows.groupBy(*by).agg((F.coalesce(F.sum(weight * loss), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(1e-12))).alias("loss"))


def class_groups(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """group and ids (sorted) of the classes (id, label) that each group (group, name) names, whatever the case.

    A name that no class has, and a class in two groups, are errors.
    """
    own = labels.select("id", F.lower(F.trim("label")).alias("_l"))
    named = groups.select("group", F.lower(F.trim("name")).alias("_l"))
    hit = named.join(own, "_l", "left")
    twice = hit.where("id is not null").groupBy("id").agg(F.count_distinct("group").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("_most"))
    out = hit.groupBy("group").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count_if(F.col("id").isNull()).alias("_none")).crossJoin(F.broadcast(twice))
    fault = F.when(F.col("_none") > 0, "no class has a configured name").when(F.col("_most") > 1, "a class is in two groups")
    return out.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))).select("group", "ids")
