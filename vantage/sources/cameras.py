"""Camera documents: frames with document-wide defaults, as rows with checked poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import rigid

FRAME = "file_path string, station_id string, pano_id string, face string, w int, h int, fl_x double, fl_y double, cx double, cy double, transform_matrix array<array<double>>"
DOCUMENT = f"coordinate_frame string, units string, camera_convention string, world_up array<double>, w int, h int, fl_x double, fl_y double, cx double, cy double, frames array<struct<{FRAME.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>"
UNITS = ("m", "meters", "metres")


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """A row a frame: ids, intrinsics (the frame's or else the document's), rotation r00-r22, centre tx, ty, tz, and ``valid``.

    Poses are camera to world. ``valid`` says that the units are metres, the size and focal lengths positive
    and the rotation rigid; null matrices are not valid.
    """
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    names = ("w", "h", "fl_x", "fl_y", "cx", "cy")
    out = docs.select("units", *(F.col(n).alias(f"_{n}") for n in names), F.explode("frames").alias("f"))
    m = F.col("f.transform_matrix")
    cell = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    out = out.select(
        *(F.col(f"f.{n}").alias(n) for n in ("file_path", "station_id", "pano_id", "face")), *(F.coalesce(F.col(f"f.{n}"), F.col(f"_{n}")).alias(n) for n in names),
        *(cell(i, j).alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(cell(i, 3).alias(f"t{c}") for i, c in enumerate("xyz")), F.coalesce("units", F.lit("m")).alias("units"),
    )
    ok = F.col("units").isin(*UNITS) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("fl_x") > 0) & (F.col("fl_y") > 0) & rigid([F.col(f"r{i}{j}") for i in range(3) for j in range(3)], 1e-5)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def declarations(spark: SparkSession, path: str) -> tuple[list[tuple[float, ...]], str]:
    """The directions that the documents declare as up, and their camera convention (OpenCV_c2w if none says)."""
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True).select("world_up", "camera_convention").distinct().collect()
    conventions = {d.camera_convention or "OpenCV_c2w" for d in docs}
    if len(conventions) > 1:
        raise ValueError("the documents' camera conventions differ")
    return [tuple(d.world_up) for d in docs if d.world_up is not None], next(iter(conventions), "OpenCV_c2w")


def to_opencv(cameras: DataFrame) -> DataFrame:
    """Turn OpenGL rotations into OpenCV ones: the second and third columns change sign."""
    return cameras.withColumns({f"r{i}{j}": -F.col(f"r{i}{j}") for i in range(3) for j in (1, 2)})
