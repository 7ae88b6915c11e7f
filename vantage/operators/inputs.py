"""Inputs of the sky clean-up: registered cameras with their files and depths, checked as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each camera must bring: the input's name, and the columns of its path and hash.
FIELDS = {
    "source_rgb": ("file_path", "image_sha256"),
    "source_original": ("original_file_path", "original_file_sha256"),
    "source_sky": ("sky_mask_path", "sky_mask_sha256"),
    "source_generic_valid": ("original_valid_mask_path", "original_valid_mask_sha256"),
    "source_edit_alpha": ("edit_alpha_path", "edit_alpha_sha256"),
}
KEY = ("station_id", "face", "file_path")


def confined(path: Column) -> Column:
    """Whether a relative path stays within its folder: not absolute, no drive, and never above where it starts."""
    depth = F.aggregate(
        F.split(F.regexp_replace(path, r"\\\\", "/"), "/"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, p: F.struct(
            (a["now"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("now"),
            F.least(a["low"], a["now"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low"),
        ),
    )
    return F.coalesce((F.length(path) > 0) & ~path.rlike(r"^([/\\\\]|[A-Za-z]:)") & (depth["low"] >= 0), F.lit(False))


def cleanup_inputs(cameras: DataFrame, files: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """One row a registered camera, with its inputs and, if ``depths`` is given, its depth; an error tells which rule fails.

    ``cameras`` hold KEY, the columns of FIELDS and any others; equal repeated rows count once, different rows of one
    key are a conflict. ``files`` (path, sha256) say what there is: each input must be there with its hash, and stay
    in its folder. ``depths`` (KEY, depth_path, depth_sha256) must hold each camera once, and no others.
    """
    once = cameras.distinct()
    checks = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    fault = [(F.lit("no registered camera"), checks.select(F.col("most") == 0)), (F.lit("conflicting rows of one camera"), checks.select(F.col("most") > 1))]
    there = files.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha")).distinct()
    long = once.select(*KEY, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(p).alias("path"), F.col(h).alias("sha")) for n, (p, h) in FIELDS.items()))).alias("_input")).select(*KEY, "_input.*")
    wrong = long.join(there, (F.col("path") == F.col("_path")) & (F.col("sha") == F.col("_sha")), "left").where(F.col("_path").isNull() | ~confined(F.col("path")))
    fault.append((F.lit("an input is missing, changed or outside its folder"), wrong.agg((F.count(F.lit(1)) > 0).alias("x"))))
    out = once
    if depths is not None:
        own = depths.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        both = own.join(once.select(*KEY, F.lit(True).alias("_c")).distinct(), list(KEY), "full_outer")
        fault.append((F.lit("the depths' roster differs from the cameras'"), both.agg(F.coalesce(F.bool_or(F.col("n").isNull() | F.col("_c").isNull() | (F.col("n") > 1)), F.lit(False)).alias("x"))))
        out = out.join(depths.select(*KEY, "depth_path", "depth_sha256"), list(KEY))
    for message, found in fault:
        name = found.columns[0]
        out = out.crossJoin(F.broadcast(found.select(F.col(name).alias("_fault")))).where(F.when(F.col("_fault"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_fault")
    return out
