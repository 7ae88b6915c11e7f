"""Pairs of captures or stations: links, nearest neighbours, recovery, and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .captures import checkpointed
from .neighbours import _pairs, extent, nearest


def _undirected(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link_pairs(links: DataFrame, roster: DataFrame) -> DataFrame:
    """Undirected pairs (a < b) of links (src, dst) both of whose ends are in the roster (id), of different stations
    where it has a station_id."""
    station = ["station_id"] if "station_id" in roster.columns else []
    ends = [roster.select(F.col("id").alias(c), *(F.col(s).alias(f"_{c}") for s in station)) for c in ("src", "dst")]
    out = links.where("src <> dst").join(ends[0], "src").join(ends[1], "dst")
    return (out.where("_src <> _dst") if station else out).select(*_undirected("src", "dst")).distinct()


def knn_pairs(points: DataFrame, k: int, cell: float) -> DataFrame:
    """Undirected pairs of each point with its k nearest others, ties by id."""
    return nearest(points, points, k, cell, apart=True).select(*_undirected("id", "other")).distinct()


def capture_pairs(captures: DataFrame, k: int = 8, cell: float = 16.0) -> DataFrame:
    """Undirected pairs (a < b) of each capture (id, station_id, east, north) with the k nearest ones of other stations.

    Distances are horizontal, ties go by id. Captures meet in grid cells. A capture is complete once the k-th of
    its neighbours at other stations is within a cell; the others go on with cells four times as wide.
    """
    own = captures.select("id", F.col("east").alias("x"), F.lit(0.0).alias("y"), F.col("north").alias("z"))
    at = captures.select("id", "station_id")
    other = at.select(F.col("id").alias("other"), F.col("station_id").alias("_o"))
    w = Window.partitionBy("id").orderBy("distance", F.col("other").cast("string"))
    whole, _ = extent(own)
    out, rest = None, own
    while True:
        met = _pairs(rest, own, cell, True).join(at, "id").join(other, "other").where("station_id <> _o")
        found = checkpointed(met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "other", "distance"))
        full = found.groupBy("id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n")).where((F.col("n") == k) & (F.col("far") <= cell)).select("id")
        done = found if cell >= whole else found.join(full, "id", "left_semi")
        out = done if out is None else out.unionAll(done)
        if cell >= whole:
            break
        rest = checkpointed(rest.join(full, "id", "left_anti"))
        if rest.isEmpty():
            break
        cell *= 4
    return out.select(*_undirected("id", "other")).distinct()


def ball_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (a < b) of points within a radius, by grid cells."""
    return _pairs(points, points, radius, True).where((F.col("distance") <= radius) & (F.col("id") < F.col("other"))).select(F.col("id").alias("a"), F.col("other").alias("b"))


def recovery_pairs(pairs: DataFrame, registered: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs exactly one side of which is registered (id, registered), without those already done."""
    a, b = (registered.select(F.col("id").alias(c), F.col("registered").alias(f"_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where("_a <> _b").select("a", "b").join(done, ["a", "b"], "left_anti")


def face_pairs(pairs: DataFrame, cameras: DataFrame) -> DataFrame:
    """All pairs of frames of paired stations; six faces each make 36."""
    a, b = (cameras.select(F.col("station_id").alias(c), F.col("frame_name").alias(n)) for c, n in (("a", "first_frame"), ("b", "second_frame")))
    return pairs.join(a, "a").join(b, "b").select("first_frame", "second_frame")


def unregistered(captures: DataFrame, registered: DataFrame) -> DataFrame:
    """The captures (pano_id) that are not registered (pano_id), whatever repeats there are."""
    return captures.join(registered.select("pano_id"), "pano_id", "left_anti")
