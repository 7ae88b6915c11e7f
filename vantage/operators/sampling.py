"""Deterministic splits, samples and picks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def point_split(point: Column, seed: int, fraction: float) -> Column:
    """Whether a point belongs to the fit side: the first 8 bytes of BLAKE2b of ``seed:point`` against the fraction."""
    limit = int(fraction * 2**64)

    @F.pandas_udf("boolean")
    def fits(ids: pd.Series) -> pd.Series:
        digest = lambda i: int.from_bytes(hashlib.blake2b(f"{seed}:{int(i)}".encode(), digest_size=8).digest(), "big") < limit
        return ids.map(lambda i: None if i is None or i != i else digest(i)).astype("object")

    return fits(point)


def point_split_sha(point: Column, seed: int, fraction: float) -> Column:
    """The same kind of split by SHA-256 in SQL functions; it picks other points than :func:`point_split`."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), point.cast("string")), 256), 1, 13), 16, 10).cast("long")
    return head < F.lit(int(fraction * 2**52))


def subsample(rows: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    """``limit`` rows, the first by a seeded hash of their key; the same rows on every run."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.withColumn("_h", h).orderBy("_h", key).limit(limit).drop("_h")


def station_uniform(frames: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw, station_id, frame: for each draw a station with equal chance, then one of its frames with equal chance."""
    numbered = frames.select("station_id", "frame", (F.row_number().over(Window.partitionBy("station_id").orderBy("frame")) - 1).alias("_f"))
    sizes = numbered.groupBy("station_id").agg(F.count(F.lit(1)).alias("_n"))
    # The roster has a row a station; its numbers need one order over them.
    sizes = sizes.withColumn("_s", F.row_number().over(Window.orderBy("station_id")) - 1)
    total = sizes.agg(F.count(F.lit(1)).alias("_stations"))
    spark = frames.sparkSession
    drawn = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total))
    drawn = drawn.withColumn("_s", F.pmod(F.xxhash64(F.lit(seed), "draw", F.lit(0)), F.col("_stations")))
    own = drawn.join(sizes, "_s").withColumn("_f", F.pmod(F.xxhash64(F.lit(seed), "draw", F.lit(1)), F.col("_n")))
    return own.join(numbered, ["station_id", "_f"]).select("draw", "station_id", "frame")


def evenly_spaced(rows: DataFrame, by: str, order: str, picks: int) -> DataFrame:
    """At most ``picks`` rows a group, evenly spaced in its order, first and last included."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    step = F.greatest(F.lit(1), F.least(F.lit(picks), F.col("_n")) - 1)
    slots = F.transform(F.sequence(F.lit(0), F.least(F.lit(picks), F.col("_n")) - 1), lambda i: F.floor(i * (F.col("_n") - 1) / step))
    return rows.withColumn("_at", at).withColumn("_n", n).where(F.array_contains(slots, F.col("_at").cast("long"))).drop("_at", "_n")
