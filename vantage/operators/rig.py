"""Cube faces, the rig of tilted views around them, and how views cover all directions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each face of a cube looks at, and what is on its right, in the front camera's axes (right, down, ahead).
FACES = {"F": ("z", "x"), "R": ("x", "-z"), "B": ("-z", "-x"), "L": ("-x", "z"), "U": ("-y", "x"), "D": ("y", "x")}


def _axis(name: str) -> tuple[int, ...]:
    return tuple((-1 if name[0] == "-" else 1) * int(c == name[-1]) for c in "xyz")


def _cross(a, b) -> tuple[float, ...]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def face_rotation(face: str) -> list[list[float]]:
    """Camera-to-station rotation by rows; its columns are right, down and ahead."""
    ahead, right = (_axis(n) for n in FACES[face])
    return [list(row) for row in zip(right, _cross(ahead, right), ahead)]


def views(spark: SparkSession, fov: float = 70.0, size: int = 1024, offset: float = 22.5) -> DataFrame:
    """24 views: four a face, turned towards its corners by ``offset`` degrees either way.

    name, anchor_face, w, h, fl_x, fl_y, pp_x, pp_y and the rotation r00 to r22. A table of 24 rows whatever the data.
    """
    if not 0 < fov < 179 or not 0 < offset < 45 or size <= 0:
        raise ValueError("settings of the rig are out of their ranges")
    a, focal, rows = math.tan(math.radians(offset)), size / 2 / math.tan(math.radians(fov / 2)), []
    for face in FACES:
        turn = face_rotation(face)
        for sy, up in ((-1, "up"), (1, "down")):
            for sx, side in ((-1, "left"), (1, "right")):
                n = math.sqrt(2 * a * a + 1)
                ahead = (sx * a / n, sy * a / n, 1 / n)
                right = _cross((0.0, 1.0, 0.0), ahead)
                length = math.sqrt(sum(x * x for x in right))
                right = tuple(x / length for x in right)
                own = list(zip(right, _cross(ahead, right), ahead))
                whole = [[sum(turn[i][k] * own[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
                rows.append((f"{face}_{side}_{up}", face, size, size, focal, focal, size / 2, size / 2, *(float(x) for r in whole for x in r)))
    names = ["name", "anchor_face", "w", "h", "fl_x", "fl_y", "pp_x", "pp_y", *(f"r{i}{j}" for i in range(3) for j in range(3))]
    return spark.createDataFrame(rows, names)


def sphere_rays(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Directions x, y, z of an equirectangular image's pixel centres, and of a cube's faces, edges and corners."""
    if width != 2 * height or height <= 0:
        raise ValueError("the image is to be twice as wide as high")
    i = F.col("id")
    u, v = (i % width + 0.5) / width * (2 * math.pi) - math.pi, (F.floor(i / width) + 0.5) / height * math.pi - math.pi / 2
    grid = spark.range(width * height).select((F.cos(v) * F.sin(u)).alias("x"), F.sin(v).alias("y"), (F.cos(v) * F.cos(u)).alias("z"))
    cube = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if x or y or z]
    return grid.unionAll(spark.createDataFrame([tuple(c / math.sqrt(x * x + y * y + z * z) for c in (x, y, z)) for x, y, z in cube], "x double, y double, z double"))


def coverage(rays: DataFrame, rig: DataFrame) -> DataFrame:
    """One row: rays, uncovered, the least, greatest and mean number of views that see a ray, and the worst ray's part
    of the half field of view that its best view needs. The rig is a few rows, broadcast."""
    q = [sum((F.col(f"r{i}{j}") * F.col(c) for i, c in ((1, "y"), (2, "z"))), F.col(f"r0{j}") * F.col("x")) for j in range(3)]
    need = F.greatest(F.abs(q[0]) * 2 * F.col("fl_x") / F.col("w"), F.abs(q[1]) * 2 * F.col("fl_y") / F.col("h"))
    part = F.when(q[2] > 0, need / F.greatest(q[2], F.lit(1e-30)))
    own = rays.withColumn("_ray", F.monotonically_increasing_id()).crossJoin(F.broadcast(rig)).select("_ray", part.alias("p"))
    per = own.groupBy("_ray").agg(F.count_if(F.col("p") <= 1).alias("n"), F.min("p").alias("best"))
    return per.agg(
        F.count(F.lit(1)).alias("rays"), F.count_if(F.col("n") == 0).alias("uncovered"), F.min("n").alias("least"), F.max("n").alias("greatest"),
        F.avg("n").alias("mean"), F.max("best").alias("worst_part"),
    )
