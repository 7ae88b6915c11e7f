"""Manifests, reports, recipes and job states as tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a job's state may turn into.
STEPS = {"queued": ("running", "cancelled"), "running": ("completed", "failed", "cancelled", "interrupted"), "interrupted": ("queued",)}


def canonical(value, ascii_only: bool = True) -> str:
    """JSON with sorted keys and no spaces; numbers that aren't finite are an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def digest(value, ascii_only: bool = True) -> str:
    return hashlib.sha256(canonical(value, ascii_only).encode()).hexdigest()


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of all files under a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_faults(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path and reason (missing, extra, size, hash) of each file that differs from its manifest."""
    f = found.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    both = manifest.join(f, "path", "full_outer")
    why = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha"), "hash")
    return both.select("path", why.alias("reason")).where("reason IS NOT NULL")


def replayed(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows that only a stored or only a recomputed report has, with the side."""
    return stored.exceptAll(computed).withColumn("side", F.lit("stored")).unionAll(computed.exceptAll(stored).withColumn("side", F.lit("computed")))


def merged_recipe(defaults: DataFrame, *overrides: DataFrame) -> DataFrame:
    """key and value: the last non-null one; keys that the defaults lack are an error."""
    out = defaults.select("key", "value")
    for o in overrides:
        unknown = o.join(defaults, "key", "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"unknown key: {unknown[0].key}")
        out = out.join(o.select("key", F.col("value").alias("_v")), "key", "left").select("key", F.coalesce("_v", "value").alias("value"))
    return out


def job_states(events: DataFrame) -> DataFrame:
    """job_id, status and faults of jobs' status events (job_id, sequence, status): the last status, and bad steps."""
    w = Window.partitionBy("job_id").orderBy("sequence")
    before = F.lag("status").over(w)
    steps = F.array(*(F.lit(f"{a}>{b}") for a, to in STEPS.items() for b in to))
    bad = F.when(before.isNull(), F.col("status") != "queued").otherwise(~F.array_contains(steps, F.concat(before, F.lit(">"), F.col("status"))))
    return events.withColumn("_bad", bad).groupBy("job_id").agg(F.max_by("status", "sequence").alias("status"), F.count_if("_bad").alias("faults"))


def newest_first(rows: DataFrame, created: str, key: str) -> DataFrame:
    return rows.orderBy(F.col(created).desc(), key)
