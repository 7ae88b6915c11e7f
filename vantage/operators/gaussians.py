"""Gaussian scenes: size filter, cylinder crop, clean-up policy, inspection and row subsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import finite, sigmoid
from .stations import scene

SCALES = ("scale_0", "scale_1", "scale_2")


def largest_scale() -> Column:
    return F.greatest(*SCALES)


def marked(gaussians: DataFrame, cameras: DataFrame, up: tuple[float, float, float], size_ratio: float = 0.5, crop_ratio: float = 1.0) -> DataFrame:
    """Each Gaussian with keep_size and keep_crop. ``up`` is declared, or what :func:`stations.world_up` finds.

    Size keeps what is strictly below ln(ratio * radius); the crop keeps what is within ratio * radius
    (inclusive) of the axis through the scene's centre along ``up``. The scene is one row, broadcast.
    """
    if not 1e-4 <= size_ratio <= 10 or not 1e-4 <= crop_ratio <= 100:
        raise ValueError("a ratio is out of its range")
    n = math.sqrt(sum(u * u for u in up))
    u = [x / n for x in up]
    own = gaussians.crossJoin(F.broadcast(scene(cameras)))
    d = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    along = d[0] * u[0] + d[1] * u[1] + d[2] * u[2]
    off = [x - along * y for x, y in zip(d, u)]
    radial = F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    return own.withColumns({"keep_size": largest_scale() < F.log(F.lit(size_ratio) * F.col("radius")), "keep_crop": radial <= F.lit(crop_ratio) * F.col("radius")}).drop("mx", "my", "mz", "stations", "radius")


def cleanup(gaussians: DataFrame, cameras: DataFrame, up: tuple[float, float, float], **options) -> DataFrame:
    """The Gaussians that both filters keep, in their columns."""
    return marked(gaussians, cameras, up, **options).where("keep_size AND keep_crop").select(*gaussians.columns)


def cleanup_counts(gaussians: DataFrame, cameras: DataFrame, up: tuple[float, float, float], **options) -> DataFrame:
    m = marked(gaussians, cameras, up, **options)
    return m.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(~F.col("keep_size")).alias("size_removed"),
        F.count_if(F.col("keep_size") & ~F.col("keep_crop")).alias("crop_additional_removed"),
        F.count_if(~(F.col("keep_size") & F.col("keep_crop"))).alias("removed"),
        F.count_if(F.col("keep_size") & F.col("keep_crop")).alias("remaining"),
    )


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The row selection sidecar: row_ids of ``before`` that ``after`` lacks."""
    return before.select("row_id").join(after.select("row_id"), "row_id", "left_anti")


def policy(votes: DataFrame, radius: float, soft_ratio: float, hard_ratio: float, sky_min: int, sky_over: float, down_min: int) -> DataFrame:
    """The clean-up policy on rows with max_log_scale, sky, non_sky, down (votes) and below (boolean)."""
    semantic = (F.col("sky") >= sky_min) & (F.col("sky") >= sky_over * F.col("non_sky"))
    soft = F.col("max_log_scale") >= math.log(radius * soft_ratio)
    down = soft & (F.col("down") >= down_min)
    hard = F.col("max_log_scale") >= math.log(radius * hard_ratio)
    prev = semantic | (soft & ~down)
    return votes.withColumns({"semantic": semantic, "soft": soft, "down_protected": down, "hard": hard, "remove": (prev & ~F.col("below")) | hard})


def policy_counts(marked: DataFrame) -> DataFrame:
    names = ("semantic", "soft", "down_protected", "hard", "below", "remove")
    return marked.agg(F.count(F.lit(1)).alias("source_rows"), *(F.count_if(n).alias(f"{n}_rows") for n in names))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Finite and other counts and exact quantiles of a column."""
    c = F.col(column)
    ok = F.when(finite(c), c)
    q = F.percentile(ok, F.array(*map(F.lit, (0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0))))
    one = df.agg(F.count(ok).alias("finite"), (F.count(F.lit(1)) - F.count(ok)).alias("other"), q.alias("q"))
    return one.select("finite", "other", *(F.col("q")[i].alias(n) for i, n in enumerate(("q0", "q01", "q10", "q50", "q90", "q99", "q100"))))


def inspection(gaussians: DataFrame, baseline: DataFrame, extent_sigmas: float = 3.0) -> DataFrame:
    """Each Gaussian with sorted sigmas, axis ratio, opacity, extent over the camera baseline, and flags."""
    own = gaussians.crossJoin(F.broadcast(baseline)).withColumn("sigmas", F.array_sort(F.array(*(F.exp(s) for s in SCALES))))
    own = own.withColumns({"sigma_min": F.col("sigmas")[0], "sigma_mid": F.col("sigmas")[1], "sigma_max": F.col("sigmas")[2], "alpha": sigmoid(F.col("opacity"))})
    own = own.withColumn("axis_ratio", F.col("sigma_max") / F.col("sigma_min")).withColumn("extent", 2 * extent_sigmas * F.col("sigma_max") / F.col("baseline"))
    return own.withColumns({"large": F.col("extent") > 4, "long": F.col("axis_ratio") > 100, "opaque": F.col("alpha") > 0.5}).drop("sigmas")


def first_examples(flagged: DataFrame, flags: tuple[str, ...], limit: int = 32) -> DataFrame:
    """flag, row_id: the lowest rows of each flag. Each flag is a partial top-k, not a gathered group."""
    parts = [flagged.where(f).select(F.lit(f).alias("flag"), "row_id").orderBy("row_id").limit(limit) for f in flags]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def geometry(gaussians: DataFrame, radius: DataFrame) -> DataFrame:
    """Bounds, quantiles of the largest sigma, the number above 0.05 radius, and the mean opacity."""
    s = F.exp(largest_scale())
    own = gaussians.crossJoin(F.broadcast(radius.select("radius")))
    aggs = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    q = F.percentile(s, F.array(*map(F.lit, (0.5, 0.95, 0.99, 1.0)))).alias("q")
    out = own.agg(*aggs, q, F.count_if(s > 0.05 * F.col("radius")).alias("large"), F.avg(sigmoid(F.col("opacity"))).alias("mean_opacity"))
    return out.select(*(f"{n}_{c}" for c in "xyz" for n in ("min", "max")), *(F.col("q")[i].alias(n) for i, n in enumerate(("q50", "q95", "q99", "q100"))), "large", "mean_opacity")


def appended(scene_rows: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of ``more`` after those of a scene, matched by column name, with row_ids that go on."""
    offset = scene_rows.agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("_o"))
    shifted = more.crossJoin(F.broadcast(offset)).withColumn("row_id", (F.col("row_id") + F.col("_o")).cast("long")).drop("_o")
    return scene_rows.unionByName(shifted)


def recoloured(scene_rows: DataFrame, columns: DataFrame) -> DataFrame:
    """A scene with the columns of ``columns`` (row_id and others) in place of its own, where it has the row."""
    names = [c for c in columns.columns if c != "row_id"]
    to = columns.select("row_id", F.lit(True).alias("_has"), *(F.col(n).alias(f"_new_{n}") for n in names))
    out = scene_rows.join(to, "row_id", "left")
    return out.withColumns({n: F.when(F.col("_has"), F.col(f"_new_{n}")).otherwise(F.col(n)) for n in names}).select(*scene_rows.columns)
