"""Command line: ``python -m vantage COMMAND``; each command prints JSON or writes a file."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .functions.geo import covariance
from .operators import captures, evidence, gaussians, quality, stations
from .session import session
from .sources.cameras import declarations, read_cameras, to_opencv
from .sources.ply import read_ply, scene_up, write_ply


def _cameras(spark, path: str):
    """The cameras with their centres as cx, cy, cz; one that isn't valid is an error, since it would change the scene's radius."""
    fine = F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid camera: "), F.coalesce("file_path", F.lit("?")))).cast("boolean"))
    return read_cameras(spark, path).where(fine).drop("cx", "cy").withColumnsRenamed({f"t{c}": f"c{c}" for c in "xyz"})


def _discover(spark, a) -> dict:
    found = captures.within(spark.read.parquet(a.captures), a.lat, a.lng, a.radius)
    found = captures.date_prefix(found, a.date) if a.date else found
    return {"captures": [r.asDict() for r in captures.nearest_first(found, a.limit).collect()]}


def _cleanup(spark, a) -> dict:
    scene, cameras = read_ply(spark, a.scene), _cameras(spark, a.cameras)
    declared, convention = declarations(spark, a.cameras)
    up = stations.world_up(cameras, declared + scene_up(spark, a.scene), convention)
    stations.checked_scene(cameras).collect()  # an error where the stations aren't what they should be
    kept = gaussians.cleanup(scene, cameras, up, size_ratio=a.size, crop_ratio=a.crop)
    rows = write_ply(kept.select(*scene.columns), a.out)
    return {"rows": rows, "out": a.out}


def _prune(spark, a) -> dict:
    """Drop the Gaussians that lie in free space by sparse depths of the given size."""
    scene, (_, convention) = read_ply(spark, a.scene), declarations(spark, a.cameras)
    cameras = _cameras(spark, a.cameras)
    cameras = to_opencv(cameras) if convention == "OpenGL_c2w" else cameras
    across, down = F.lit(a.width) / F.col("w"), F.lit(a.height) / F.col("h")
    principal = read_cameras(spark, a.cameras).select("file_path", F.col("cx").alias("pp_x"), F.col("cy").alias("pp_y"))
    views = cameras.join(principal, "file_path").withColumn("frame_name", F.col("file_path")).withColumns({
        "fl_x": F.col("fl_x") * across, "fl_y": F.col("fl_y") * down, "pp_x": F.col("pp_x") * across, "pp_y": F.col("pp_y") * down, "w": F.lit(a.width), "h": F.lit(a.height)
    })
    terms = covariance([F.col(f"rot_{i}").cast("double") for i in range(4)], [F.col(f"scale_{i}").cast("double") for i in range(3)])
    own = scene.select("row_id", *(F.col(c).cast("double").alias(c) for c in "xyz"), *(t.alias(n) for n, t in terms.items()))
    free = evidence.free_space(own, views, spark.read.parquet(a.depths)).select("row_id")
    rows = write_ply(scene.join(free, "row_id", "left_anti").select(*scene.columns), a.out)
    return {"rows": rows, "removed": scene.count() - rows, "out": a.out}


def _inspect(spark, a) -> dict:
    scene, cameras = read_ply(spark, a.scene, "inspect"), _cameras(spark, a.cameras)
    flags = ("large", "long", "opaque")
    seen = gaussians.inspection(scene, stations.baseline(cameras.withColumn("capture", F.coalesce("pano_id", "file_path")), capture="capture").select("baseline"))
    return seen.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(f).alias(f) for f in flags)).first().asDict()


def _reuse(spark, a) -> dict:
    recorded = spark.read.parquet(a.inventory)
    plan = quality.reuse_plan(recorded, spark.read.parquet(a.present)).first()
    done = recorded.where(F.col("stage_index") < plan.reusable_stages).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).first()
    return {"reusable_stages": plan.reusable_stages, "files": done.files, "bytes": done.bytes}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vantage", description=__doc__)
    top.add_argument("--master", help="Spark master; the cluster's own by default")
    commands = top.add_subparsers(required=True, metavar="COMMAND")

    def command(run, text, *options):
        p = commands.add_parser(run.__name__.strip("_"), help=text)
        for name, settings in options:
            p.add_argument(name, **settings)
        p.set_defaults(run=run)

    path = {"required": True}
    command(_discover, "captures around a place, nearest first", ("--captures", path), ("--lat", path | {"type": float}), ("--lng", path | {"type": float}), ("--radius", {"type": float, "default": 50.0}), ("--date", {}), ("--limit", {"type": int, "default": 200}))
    command(_cleanup, "filter a scene by size and cylinder", ("--scene", path), ("--cameras", path), ("--out", path), ("--size", {"type": float, "default": 0.5}), ("--crop", {"type": float, "default": 1.0}))
    command(_prune, "drop what lies in free space by sparse depths", ("--scene", path), ("--cameras", path), ("--depths", path), ("--width", path | {"type": int}), ("--height", path | {"type": int}), ("--out", path))
    command(_inspect, "counts of invalid, large, long and thin Gaussians", ("--scene", path), ("--cameras", path))
    command(_reuse, "leading stages whose files can be used again", ("--inventory", path), ("--present", path))
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    print(json.dumps(a.run(session(a.master), a), default=str))


if __name__ == "__main__":
    main()
