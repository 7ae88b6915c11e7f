"""Selecting captures: places, times, sets, facets, order, pages and the graph of links."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.capture import ID, capture_parts, clock_between, policy
from ..functions.geo import box, haversine, valid_place


def within(captures: DataFrame, lat: float, lng: float, radius_m: float, tolerance_m: float = 0.0) -> DataFrame:
    """Captures within a radius (inclusive), with ``distance_m``; unusable places are left out.

    The box lets the scan skip what is far away before distances are computed.
    """
    reach = radius_m + tolerance_m
    near = captures.where(valid_place(F.col("lat"), F.col("lng")) & box(F.col("lat"), F.col("lng"), lat, lng, reach))
    return near.withColumn("distance_m", haversine(lat, lng, F.col("lat"), F.col("lng"))).where(F.col("distance_m") <= reach)


def dated(captures: DataFrame) -> DataFrame:
    return captures.withColumns(capture_parts(F.col("captured_at")))


def by_policy(captures: DataFrame, mode: str, value: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    return captures.where(policy(mode, value, F.col("month"), F.col("day")) & clock_between(F.col("clock"), start, end))


def date_prefix(captures: DataFrame, prefix: str) -> DataFrame:
    return captures.where(F.coalesce(F.col("capture_date"), F.lit("")).startswith(prefix))


def chosen(captures: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Captures in one id list and not in another."""
    return captures.join(include, "pano_id", "left_semi").join(exclude, "pano_id", "left_anti")


def set_faults(include: DataFrame, exclude: DataFrame) -> DataFrame:
    """One row: repeated ids of either list, ids in both, and whether the first is empty."""
    a = include.agg((F.count("pano_id") - F.count_distinct("pano_id")).alias("include_repeats"), (F.count("pano_id") == 0).alias("include_empty"))
    b = exclude.agg((F.count("pano_id") - F.count_distinct("pano_id")).alias("exclude_repeats"))
    c = include.distinct().join(exclude.distinct(), "pano_id").agg(F.count(F.lit(1)).alias("in_both"))
    return a.crossJoin(b).crossJoin(c)


def usable_ids(captures: DataFrame, column: str = "pano_id") -> DataFrame:
    return captures.where(F.col(column).cast("string").rlike(ID))


def date_facet(captures: DataFrame) -> DataFrame:
    """Captures by date, unknown ones left out; the precision follows from the date's length."""
    out = captures.where(F.col("capture_date").isNotNull()).groupBy("capture_date").agg(F.count(F.lit(1)).alias("captures"))
    return out.withColumn("precision", F.when(F.length("capture_date") == 7, "month").otherwise("day")).orderBy(F.col("capture_date").desc())


def nearest_first(captures: DataFrame, limit: int, after: tuple[float, int] | None = None) -> DataFrame:
    """A page by (distance_m, pano_id), from after a given key on."""
    if after is not None:
        captures = captures.where((F.col("distance_m") > after[0]) | ((F.col("distance_m") == after[0]) & (F.col("pano_id") > after[1])))
    return captures.orderBy("distance_m", "pano_id").limit(limit)


def freeze(captures: DataFrame, lat: float, lng: float, radius_m: float, mode: str = "any", value: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The captures of a frozen selection: within the radius and a metre, and meeting the policy."""
    return by_policy(within(dated(captures), lat, lng, radius_m, 1.0), mode, value, start, end)


def merged_first(pages: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of all pages with each key once, the first by ``order``."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def discover(links: DataFrame, nodes: DataFrame, start: list[int], max_rounds: int | None = None) -> DataFrame:
    """id and depth of every node that links (src, dst) reach from ``start`` through ``nodes`` (id), up to a depth if one is given.

    A round joins only the nodes found in the last one; each round is a checkpoint, so that the plan doesn't
    grow and a lost executor costs one round. Links to ids that are no node are left out.
    """
    spark = links.sparkSession
    keep = links.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct().persist()
    frontier = spark.createDataFrame([(i,) for i in start], "id long").join(nodes, "id", "left_semi").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for depth in count(1) if max_rounds is None else range(1, max_rounds + 1):
        step = keep.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionAll(frontier))
    return seen


def discover_within(links: DataFrame, captures: DataFrame, start: list[int], lat: float, lng: float, radius_m: float, failed: DataFrame | None = None) -> DataFrame:
    """id, depth and status of the captures (pano_id, lat, lng) within a radius that links (src, dst) reach from ``start``.

    Captures outside are neither found nor followed. Those in ``failed`` (id), whose data could not be had, have
    status "failed" and are not followed; the others are "found".
    """
    nodes = within(captures, lat, lng, radius_m).select(F.col("pano_id").alias("id"))
    if failed is None:
        return discover(links, nodes, start).withColumn("status", F.lit("found"))
    follow = links.join(failed.select(F.col("id").alias("src")), "src", "left_anti")
    out = discover(follow, nodes, start)
    bad = failed.select("id", F.lit("failed").alias("_s")).distinct()
    return out.join(bad, "id", "left").select("id", "depth", F.coalesce("_s", F.lit("found")).alias("status"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder that executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or "/tmp/checkpoints")
    return df.checkpoint()
