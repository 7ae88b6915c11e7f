"""Before/after gates on depth and sky: one row with all reasons, sorted and distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import finite

# Names of reasons.
DEPTH_FAULTS = (
    "invalid_trusted_depth_target_roster", "insufficient_or_leaked_physical_station_holdout", "depth_target_roster_mismatch", "trusted_depth_target_roster_mismatch",
    "depth_target_binding_mismatch", "trusted_depth_target_binding_mismatch", "invalid_depth_statistics",
)
DEPTH_FINDINGS = (
    "no_heldout_geometric_consistency_improvement", "heldout_depth_target_error_regression", "heldout_depth_coverage_regression",
    "local_geometric_consistency_regression", "local_depth_target_error_regression", "local_depth_coverage_regression",
)
SKY_REASONS = (
    "foreground_not_proven_byte_identical", "physical_station_holdout_leakage", "insufficient_heldout_stations", "no_measured_sky_rgb_improvement", "no_measured_sky_coverage_benefit",
)

_DEPTH_SUMS = ("relative_error_sum", "relative_variance_sum", "relative_moment_sum", "covered_pixels")


def _verdict(one: DataFrame, faults: list[Column], findings: list[Column], keep: list[str]) -> DataFrame:
    """``findings`` are judged only where no fault is."""
    array = lambda c: F.array_compact(F.array(*c)) if c else F.array().cast("array<string>")
    out = one.withColumn("_faults", array(faults)).withColumn("_found", array(findings))
    reasons = F.array_sort(F.array_distinct(F.when(F.size("_faults") > 0, F.col("_faults")).otherwise(F.col("_found"))))
    return out.withColumn("reasons", F.array_join(reasons, ",")).withColumn("accepted", F.col("reasons") == "").select("accepted", "reasons", *keep)


def _reason(test: Column, name: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(name))


def depth_gate(
    before: DataFrame, after: DataFrame, roster: DataFrame, trained: DataFrame,
    improvement: float = 0.01, station_loss: float = 0.05, coverage_loss: float = 0.001, error_rise: float = 1e-4, stations: int = 2,
) -> DataFrame:
    """accepted, reasons and the relative improvement of held-out depth from ``before`` to ``after``.

    Views: frame, station_id, roster_sha256, target_pixels, confidence_sum and the four sums. ``roster``: the trusted
    frame, station_id, roster_sha256, target_pixels. ``trained``: station_id of stations that were optimised on. Faults of the
    evidence (other rosters, repeated frames, broken bindings, leaked stations, unusable numbers) come before any verdict on it.
    """
    bound = ["station_id", "roster_sha256", "target_pixels"]
    side = lambda d, m: d.select("frame", *(F.col(c).alias(m + c) for c in d.columns if c != "frame"), F.lit(1).alias(f"{m}here"))
    keys = [*bound, "confidence_sum", *_DEPTH_SUMS]
    rows = side(before.select("frame", *keys), "b_").join(side(after.select("frame", *keys), "a_"), "frame", "full_outer").join(side(roster.select("frame", *bound), "t_"), "frame", "full_outer")
    rows = rows.join(trained.select(F.col("station_id").alias("_trained")).distinct(), F.coalesce("b_station_id", "a_station_id") == F.col("_trained"), "left")
    c = lambda m, n: F.col(f"{m}_{n}")
    differs = lambda m, n, names: F.lit(False) if not names else ~(c(m, names[0]).eqNullSafe(c(n, names[0]))) | differs(m, n, names[1:])
    usable = lambda m: F.coalesce((c(m, "target_pixels") > 0) & (c(m, "confidence_sum") > 0), F.lit(False)) & _all(finite(c(m, s).cast("double")) & (c(m, s) >= 0) for s in _DEPTH_SUMS)
    both = c("b", "here").isNotNull() & c("a", "here").isNotNull()
    checks = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("b", "here").isNotNull()).alias("views"), F.count_if(c("t", "here").isNotNull()).alias("trusted"), F.count_distinct("frame").alias("frames"),
        F.bool_or(c("b", "here").isNull() != c("a", "here").isNull()).alias("unpaired"), F.bool_or(~both | c("t", "here").isNull()).alias("untrusted"),
        F.bool_or(both & (differs("b", "a", [*bound, "confidence_sum"]) | c("b", "roster_sha256").isNull())).alias("unbound"), F.bool_or(both & differs("b", "t", bound)).alias("trust_unbound"),
        F.bool_or(both & ~(usable("b") & usable("a"))).alias("unusable"), F.bool_or(F.col("_trained").isNotNull()).alias("leaked"),
        F.count_distinct("b_station_id").alias("groups"), F.count_distinct("a_station_id").alias("after_groups"),
    )
    sums = [F.sum(c(m, s)).cast("double").alias(f"{m}_{s}") for m in "ba" for s in ("target_pixels", "confidence_sum", *_DEPTH_SUMS)]
    rate = lambda m, s: c(m, s) / c(m, "confidence_sum")
    covered = lambda m: c(m, "covered_pixels") / c(m, "target_pixels")
    floor = F.greatest(rate("b", "relative_moment_sum"), F.lit(1e-12))
    worse = rate("a", "relative_error_sum") > rate("b", "relative_error_sum") + error_rise
    thinner = covered("b") - covered("a") > coverage_loss
    local = rows.where(both).groupBy("b_station_id").agg(*sums).agg(
        F.bool_or(rate("a", "relative_moment_sum") > floor * (1 + station_loss)).alias("local_moment"), F.bool_or(worse).alias("local_error"), F.bool_or(thinner).alias("local_coverage")
    )
    total = rows.where(both).agg(*sums).select((1 - rate("a", "relative_moment_sum") / floor).alias("improvement"), worse.alias("error"), thinner.alias("coverage"))
    one = checks.crossJoin(total).crossJoin(local)
    faults = [
        F.col("trusted") == 0,
        (F.least("groups", "after_groups") < stations) | F.col("leaked"),
        (F.col("views") == 0) | F.col("unpaired") | (F.col("frames") < F.col("n")),
        F.col("untrusted"),
        F.col("unbound"),
        F.col("trust_unbound"),
        F.col("unusable"),
    ]
    findings = [F.col("improvement") < improvement, *map(F.col, ("error", "coverage", "local_moment", "local_error", "local_coverage"))]
    return _verdict(one, [*map(_reason, faults, DEPTH_FAULTS)], [*map(_reason, findings, DEPTH_FINDINGS)], ["improvement"])


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out &= F.coalesce(t, F.lit(False))
    return out


def sky_guards(metrics: DataFrame) -> DataFrame:
    """category, pixels, stations, pooled and worst loss in dB, and coverage before and after.

    ``metrics``: frame, station_id, category, pixels (trusted), before_sse, after_sse, before_covered,
    after_covered, new_holes. Views without pixels in a category don't score in it.
    """
    floor = lambda sse, n: F.greatest(sse, n * 1e-12)
    loss = lambda a, b, n: 10 * F.log10(floor(a, n) / floor(b, n))
    scored = metrics.where("pixels > 0").withColumn("_loss", loss(F.col("after_sse"), F.col("before_sse"), F.col("pixels")))
    per = scored.groupBy("category").agg(
        F.sum("pixels").alias("pixels"), F.count_distinct("station_id").alias("stations"), F.sum("before_sse").alias("_b"), F.sum("after_sse").alias("_a"), F.max("_loss").alias("worst_loss"),
        (F.sum("before_covered") / F.sum("pixels")).alias("before_coverage"), (F.sum("after_covered") / F.sum("pixels")).alias("after_coverage"), F.sum("new_holes").alias("new_holes"),
    )
    return per.withColumn("pooled_loss", loss(F.col("_a"), F.col("_b"), F.col("pixels"))).drop("_a", "_b")


def sky_gate(
    metrics: DataFrame, discovery: DataFrame, foreground_same: bool, stations: int, pooled_loss: float, view_loss: float, gain: float, coverage_gain: float, complete: float, need_down: bool = False
) -> DataFrame:
    """accepted, reasons, sky gain in dB and in coverage over the categories all, foreground, down and sky.

    The sky must improve, nothing else may get worse, no category may get holes, and no station of ``discovery`` may be
    among those held out. ``foreground_same``: whether the foreground's rows are byte for byte the same.
    """
    guards = sky_guards(metrics)
    names = ("all", "foreground", "down", "sky")
    fields = ("pixels", "stations", "pooled_loss", "worst_loss", "before_coverage", "after_coverage", "new_holes")
    one = guards.agg(*(F.max(F.when(F.col("category") == n, F.col(f))).alias(f"{n}_{f}") for n in names for f in fields))
    held = metrics.select("station_id").distinct()
    one = one.crossJoin(held.agg(F.count(F.lit(1)).alias("held"))).crossJoin(held.join(discovery.select("station_id").distinct(), "station_id").agg(F.count(F.lit(1)).alias("leaks")))
    c = lambda n, f: F.col(f"{n}_{f}")
    one = one.withColumn("sky_gain", -c("sky", "pooled_loss")).withColumn("sky_coverage_gain", c("sky", "after_coverage") - c("sky", "before_coverage"))
    kept_complete = (c("sky", "before_coverage") >= complete) & (F.col("sky_coverage_gain") >= 0)
    tests = [
        F.lit(not foreground_same),
        F.col("leaks") > 0,
        F.col("held") < stations,
        F.col("sky_gain").isNull() | (F.col("sky_gain") < gain),
        ~F.coalesce((F.col("sky_coverage_gain") >= coverage_gain) | kept_complete, F.lit(False)),
    ]
    found = [*map(_reason, tests, SKY_REASONS)]
    for n in names:
        found.append(_reason(c(n, "new_holes") > 0, f"new_{n}_holes"))
        found.append(_reason((c(n, "pooled_loss") > pooled_loss) | (c(n, "worst_loss") > view_loss), f"{n}_rgb_regression"))
        if n != "down" or need_down:
            found.append(_reason(c(n, "pixels").isNull() | (c(n, "stations") < stations), f"insufficient_{n}_evaluation"))
    return _verdict(one, [], found, ["sky_gain", "sky_coverage_gain"])


def candidate_gate(*verdicts: DataFrame) -> DataFrame:
    """accepted only if all are, and all their reasons."""
    rows = verdicts[0].select("accepted", "reasons")
    for v in verdicts[1:]:
        rows = rows.unionAll(v.select("accepted", "reasons"))
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("reasons") != "", F.split("reasons", ","))))))
    return rows.agg(F.bool_and("accepted").alias("accepted"), F.array_join(reasons, ",").alias("reasons"))


def split_faults(frames: DataFrame) -> DataFrame:
    """One row: stations in more than one split, repeated frames, and unknown splits (frames: frame, station_id, split)."""
    stations = frames.groupBy("station_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("leaked_stations"))
    names = frames.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_frames"))
    known = frames.agg(F.count_if(~F.coalesce(F.col("split").isin("train", "heldout"), F.lit(False))).alias("unknown_splits"))
    return stations.crossJoin(names).crossJoin(known)
