"""Depth fields in NPZ files: one a view, with the projection that made it."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("m", "metre", "metres")
POSE = tuple(f"p{i}{j}" for i in range(3) for j in range(4))
_HEAD = "path string, station string, w int, h int, fl_x double, fl_y double, pp_x double, pp_y double, " + ", ".join(f"{p} double" for p in POSE)


def _field(raw: bytes, where: str) -> dict:
    """A file's arrays, with what must hold of any depth field; ValueError if it doesn't."""
    with np.load(io.BytesIO(raw), allow_pickle=False) as data:
        d = {k: data[k] for k in data.files}
    z, valid = d["depth_z"], d["valid"]
    h, w = z.shape
    if valid.dtype != np.bool_ or valid.shape != z.shape or (int(d["h"]), int(d["w"])) != (h, w):
        raise ValueError(f"the arrays of {where} have other shapes than it says")
    if str(d["world_frame"]) != "ENU" or str(d["depth_convention"]) != "camera_z" or str(d["unit"]) not in UNITS or float(d["pixel_center_offset"]) != 0.5:
        raise ValueError(f"{where} has another frame, convention or unit")
    if d["K"].shape != (3, 3) or d["camera_from_world"].shape != (3, 4) or np.any(valid & (d["source_type"] != 1)):
        raise ValueError(f"{where} has no projection, or depths that weren't observed")
    return d


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: path, station, size, focal lengths, principal point and the pose (camera from world, by rows)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for where, raw in zip(b["path"], b["content"]):
                d = _field(raw, where)
                k, h, w = d["K"].astype(float), *d["depth_z"].shape
                rows.append((where, str(d["station"]), w, h, k[0, 0], k[1, 1], k[0, 2], k[1, 2], *d["camera_from_world"].astype(float).ravel()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _HEAD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _HEAD)


def read_depths(spark: SparkSession, path: str, least_sources: int = 1) -> DataFrame:
    """path, ix, iy, depth and confidence of each observed pixel: valid, finite, positive and seen by enough other stations."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for where, raw in zip(b["path"], b["content"]):
                d = _field(raw, where)
                z, c = d["depth_z"].astype(float), d["confidence"].astype(float)
                iy, ix = np.nonzero(d["valid"] & np.isfinite(z) & (z > 0) & np.isfinite(c) & (c > 0) & (d["source_count"] >= least_sources))
                yield pd.DataFrame({"path": where, "ix": ix.astype("int64"), "iy": iy.astype("int64"), "depth": z[iy, ix], "confidence": c[iy, ix]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ix long, iy long, depth double, confidence double")


def bound_fields(fields: DataFrame, manifest: DataFrame, cameras: DataFrame) -> DataFrame:
    """The fields with the ``image`` that a manifest (path, image) binds them to; an error if they aren't its camera's.

    ``cameras`` hold file_path, station_id, centre cx, cy, cz, OpenCV rotation r00 to r22, intrinsics fl_x, fl_y, pp_x, pp_y and
    size w, h; intrinsics scale with the field's size. K must agree within 1e-5 and the pose within 1e-6.
    """
    cam = cameras.select(F.col("file_path").alias("image"), F.col("station_id").cast("string").alias("_st"), "cx", "cy", "cz", *(f"r{i}{j}" for i in range(3) for j in range(3)), *(F.col(c).alias(f"_{c}") for c in ("fl_x", "fl_y", "pp_x", "pp_y", "w", "h")))
    both = fields.join(manifest.select("path", "image"), "path", "left").join(cam, "image", "left")
    across, down = F.col("w") / F.col("_w"), F.col("h") / F.col("_h")
    off = [F.abs(F.col(c) - F.col(f"_{c}") * by) for c, by in (("fl_x", across), ("pp_x", across), ("fl_y", down), ("pp_y", down))]
    turn = [F.abs(F.col(f"p{j}{i}") - F.col(f"r{i}{j}")) for i in range(3) for j in range(3)]
    move = [F.abs(F.col(f"p{j}3") + sum((F.col(f"r{i}{j}") * F.col(c) for i, c in ((1, "cy"), (2, "cz"))), F.col(f"r0{j}") * F.col("cx"))) for j in range(3)]
    fault = (
        F.when(F.col("_st").isNull(), "a field has no camera").when(F.col("_st") != F.col("station"), "a field is of another station")
        .when(~F.coalesce(F.greatest(*off) <= 1e-5, F.lit(False)), "a field's calibration differs").when(~F.coalesce(F.greatest(*turn, *move) <= 1e-6, F.lit(False)), "a field's pose differs")
    )
    return both.where(F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": "), F.col("path"))).cast("boolean")).otherwise(F.lit(True))).select(*fields.columns, "image")
