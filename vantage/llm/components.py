"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dropped, joined, skew_join, stored


def _watched(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``edges`` stored, and what changes with them, which the writing observes."""
    seen = Observation()
    mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    out = stored(edges.observe(seen, *mark), name)
    return out, (seen.get["n"], seen.get["s"])


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``links`` (a, b: long).

    Loops and repeated links do no harm; rows with a null end are ignored; an empty table gives an empty one.
    Every round joins the links with the smallest neighbour of each id, which is aggregated before the
    shuffle; no id's neighbours are gathered in one row. The links of each round are a table in the shared
    folder, and rounds end when they no longer change.
    """
    edges, mark = _watched(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = skew_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Here u is the larger end, which few stars share; centres of stars are on the other side.
        small = joined(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after, now = _watched(small.where("u <> v").distinct(), "links")
        dropped(edges)
        dropped(large)
        edges, before, mark = after, mark, now
        if mark == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
