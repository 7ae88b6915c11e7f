"""View and depth metrics, their summaries, and before/after gates with all reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import finite, psnr


def checked_pixels(pixels: DataFrame) -> Column:
    """What is wrong with a pixel (pr, pg, pb, rr, rg, rb, alpha), null if nothing: all finite, references from 0 to 1, alpha nearly so."""
    values = [F.col(c) for c in ("pr", "pg", "pb", "rr", "rg", "rb", "alpha")]
    whole = reduce(lambda a, b: a & b, (F.coalesce(finite(c), F.lit(False)) for c in values))
    inside = reduce(lambda a, b: a & b, (F.col(c).between(0, 1) for c in ("rr", "rg", "rb"))) & F.col("alpha").between(-1e-5, 1 + 1e-5)
    return F.when(~whole, "a value isn't finite").when(~inside, "colours and alpha are to be from 0 to 1")


def masked_metrics(pixels: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Per view: metrics of predicted colours pr, pg, pb against rr, rg, rb on pixels whose ``mask`` is set.

    Predictions are cut to 0..1 first. Gives static_pixels, static_sse, masked_psnr_db, masked_l1, alpha_mean,
    covered_pixels (alpha from ``threshold`` on) and coverage_fraction; a view without a masked pixel has nulls. A pixel
    that breaks :func:`checked_pixels`, masked or not, is an error. One pass, aggregated before the shuffle.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold isn't from 0 to 1")
    fault = checked_pixels(pixels)
    own = pixels.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True)))
    d = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"p{c}"))) - F.col(f"r{c}") for c in "rgb"]
    m = F.col("mask")
    out = own.groupBy(*by).agg(
        F.count_if(m).alias("static_pixels"), F.coalesce(F.sum(F.when(m, d[0] * d[0] + d[1] * d[1] + d[2] * d[2])), F.lit(0.0)).alias("static_sse"),
        F.avg(F.when(m, (F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2])) / 3)).alias("masked_l1"), F.avg(F.when(m, F.col("alpha"))).alias("alpha_mean"),
        F.count_if(m & (F.col("alpha") >= threshold)).alias("covered_pixels"),
    )
    share = F.when(F.col("static_pixels") > 0, F.col("covered_pixels") / F.col("static_pixels"))
    return out.withColumns({"masked_psnr_db": psnr(F.col("static_sse"), F.col("static_pixels")), "coverage_fraction": share})


def station_mean_psnr(metrics: DataFrame, sse: str = "static_sse") -> DataFrame:
    """One row: the mean over stations of their pooled PSNR, and the stations; stations without pixels don't count in the mean."""
    per = metrics.groupBy("station_id").agg(psnr(F.sum(sse), F.sum("static_pixels")).alias("p"))
    return per.agg(F.avg("p").alias("station_mean_psnr_db"), F.count(F.lit(1)).alias("stations"))


def depth_metrics(pixels: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Per view: weighted sums of the relative depth error and spread of moments m1, m2 and alpha against target_z.

    Pixels count that are ``valid``, with a finite positive target and a positive ``confidence``. A ray of no
    alpha has error 1 and spread 0. Gives target_pixels, confidence_sum, relative_error_sum, relative_variance_sum,
    relative_moment_sum, covered_pixels, and the means where there is a pixel. Nonfinite moments are an error.
    """
    bad = ~(finite(F.col("m1")) & finite(F.col("m2")) & finite(F.col("alpha"))) | (F.col("alpha") < -1e-6) | ~finite(F.col("confidence")) | (F.col("confidence") < 0)
    own = pixels.where(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("invalid depth moments or confidence")).cast("boolean")).otherwise(F.lit(True)))
    use = F.coalesce(F.col("valid") & finite(F.col("target_z")) & (F.col("target_z") > 0) & (F.col("confidence") > 0), F.lit(False))
    over = F.greatest(F.col("alpha"), F.lit(1e-8))
    mean = F.col("m1") / over
    z, seen, w = F.col("target_z"), F.col("alpha") > 1e-6, F.col("confidence")
    own = own.withColumns({"_u": use, "_e": F.when(seen, ((mean - z) / z) * ((mean - z) / z)).otherwise(1.0), "_s": F.when(seen, F.greatest(F.lit(0.0), F.col("m2") / over - mean * mean) / (z * z)).otherwise(0.0)})
    total = lambda x: F.coalesce(F.sum(F.when(F.col("_u"), x)), F.lit(0.0))
    out = own.groupBy(*by).agg(
        F.count_if("_u").alias("target_pixels"), total(w).alias("confidence_sum"), total(w * F.col("_e")).alias("relative_error_sum"),
        total(w * F.col("_s")).alias("relative_variance_sum"), F.count_if(F.col("_u") & (F.col("alpha") >= threshold)).alias("covered_pixels"),
    )
    some = lambda x: F.when(F.col("target_pixels") > 0, x)
    return out.withColumn("relative_moment_sum", F.col("relative_error_sum") + F.col("relative_variance_sum")).withColumns({
        "relative_target_rmse": some(F.sqrt(F.col("relative_error_sum") / F.col("confidence_sum"))),
        "relative_center_depth_variance": some(F.col("relative_variance_sum") / F.col("confidence_sum")),
        "coverage_fraction": some(F.col("covered_pixels") / F.col("target_pixels")),
    })


def view_summary(metrics: DataFrame) -> DataFrame:
    """level (overall, station, category), key, views, pixels and pooled PSNR, in one pass by grouping sets."""
    m = metrics.select(F.col("station_id").cast("string").alias("station"), "category", "static_pixels", "before_sse")
    out = m.groupingSets([["station"], ["category"], []], "station", "category").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("views"), F.sum("static_pixels").alias("pixels"), F.sum("before_sse").alias("sse")
    )
    level = F.when(F.col("g") == 1, "station").when(F.col("g") == 2, "category").otherwise("overall")
    return out.select(level.alias("level"), F.coalesce("station", "category", F.lit("")).alias("key"), "views", "pixels", psnr(F.col("sse"), F.col("pixels")).alias("psnr"))


def worst_view(metrics: DataFrame) -> DataFrame:
    """The view with the lowest PSNR, ties by frame; views without pixels are never the worst."""
    m = metrics.where("static_pixels > 0").withColumn("psnr", psnr(F.col("before_sse"), F.col("static_pixels")))
    return m.agg(F.min(F.struct("psnr", "frame")).alias("w")).select("w.frame", "w.psnr")


def depth_summary(metrics: DataFrame, by: str) -> DataFrame:
    """Confidence-weighted relative error and variance; a group that nothing covers has error 1 and variance 0."""
    out = metrics.groupBy(by).agg(F.sum("confidence_sum").alias("w"), F.sum("relative_error_sum").alias("e"), F.sum("relative_moment_sum").alias("m"))
    mean = F.col("e") / F.col("w")
    return out.select(by, F.when(F.col("w") > 0, mean).otherwise(F.lit(1.0)).alias("relative_error"), F.when(F.col("w") > 0, F.greatest(F.lit(0.0), F.col("m") / F.col("w") - mean * mean)).otherwise(F.lit(0.0)).alias("relative_variance"))


def gate(metrics: DataFrame, overall_drop: float = 0.10, station_drop: float = 0.50, hole_share: float = 0.001, min_stations: int = 2) -> DataFrame:
    """One row: accepted, and all reasons against the after state, sorted and distinct.

    Views without pixels stay in the roster and are never scored.
    """
    scored = metrics.where("static_pixels > 0")
    per = scored.groupBy("station_id").agg(F.sum("static_pixels").alias("n"), F.sum("before_sse").alias("b"), F.sum("after_sse").alias("a"), F.sum("new_hole_pixels").alias("h"))
    per = per.withColumn("drop", psnr(F.col("b"), F.col("n")) - psnr(F.col("a"), F.col("n")))
    one = per.agg(
        F.count(F.lit(1)).alias("stations"), F.coalesce(F.sum("n"), F.lit(0)).alias("pixels"),
        (psnr(F.sum("b"), F.sum("n")) - psnr(F.sum("a"), F.sum("n"))).alias("overall_drop"), F.max("drop").alias("worst_station_drop"),
        (F.sum("h") / F.sum("n")).alias("hole_share"),
    )
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(F.col("stations") < min_stations, "too_few_stations"),
        F.when(F.col("overall_drop") > overall_drop, "overall_psnr_drop"),
        F.when(F.col("worst_station_drop") > station_drop, "station_psnr_drop"),
        F.when(F.col("hole_share") > hole_share, "new_holes"),
    )))
    return one.withColumn("reasons", F.array_join(reasons, ",")).withColumn("accepted", F.col("reasons") == "")


def roster_faults(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys missing on either side and repeated on either side."""
    x, y = (d.groupBy(key).agg(F.count(F.lit(1)).alias("n")) for d in (a, b))
    both = x.withColumnRenamed("n", "x").join(y.withColumnRenamed("n", "y"), key, "full_outer")
    return both.agg(F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second"), F.count_if(F.col("x") > 1).alias("first_repeats"), F.count_if(F.col("y") > 1).alias("second_repeats"))


def compared(before: DataFrame, after: DataFrame, bindings: list[str]) -> DataFrame:
    """frame and the sorted names of bindings that differ between two sides, for frames where any does."""
    b = after.select("frame", *(F.col(c).alias(f"_{c}") for c in bindings))
    differ = F.array_sort(F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in bindings))))
    return before.join(b, "frame").withColumn("differs", F.array_join(differ, ",")).where("differs <> ''").select("frame", "differs")


def cache_prefix(inventory: DataFrame) -> DataFrame:
    """stage_index, files and bytes of each stage and of all up to it (inventory: stage_index, path, bytes)."""
    from pyspark.sql.window import Window

    per = inventory.groupBy("stage_index").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    w = Window.orderBy("stage_index").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("stage_index", "files", "bytes", F.sum("files").over(w).alias("files_to"), F.sum("bytes").over(w).alias("bytes_to"))


def reuse_plan(inventory: DataFrame, present: DataFrame) -> DataFrame:
    """The number of leading stages all of whose files are present with the recorded hash."""
    ok = inventory.join(present.select("path", F.col("sha256").alias("_now")), "path", "left").withColumn("ok", F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False)))
    per = ok.groupBy("stage_index").agg(F.bool_and("ok").alias("ok"))
    return per.agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("stage_index"))), F.max("stage_index") + 1, F.lit(0)).alias("reusable_stages"))
