"""Pixel tables between cube faces, panoramas and views: bilinear taps, masks, and agreement of depths.

Pixel centres lie at i + 0.5. Cameras hold w, h, fl_x, fl_y, px, py (principal point), the rotation r00..r22
from camera to station or world, and where needed the centre tx, ty, tz.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import erp_to_ray, inside, ray_to_erp

_TERMS = [f"r{i}{j}" for i in range(3) for j in range(3)]
_CAMERA = ["w", "h", "fl_x", "fl_y", "px", "py", *_TERMS]


def turned(v: list[Column], r: list[Column], back: bool = False) -> list[Column]:
    """R v, or R' v with ``back``; r holds the nine terms by rows."""
    at = (lambda i, k: r[3 * k + i]) if back else (lambda i, k: r[3 * i + k])
    return [at(i, 0) * v[0] + at(i, 1) * v[1] + at(i, 2) * v[2] for i in range(3)]


def taps(points: DataFrame) -> DataFrame:
    """Each point (mx, my: continuous pixel indices) once for every pixel x, y that a bilinear sample there uses.

    ``weight`` may round to 0; a neighbour is left out only if its coordinate is whole.
    """
    f = {c: F.col(f"m{c}") - F.floor(f"m{c}") for c in "xy"}
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    i, j = F.col("_tap.i"), F.col("_tap.j")
    out = points.withColumn("_tap", corners).where(((i == 0) | (f["x"] > 0)) & ((j == 0) | (f["y"] > 0)))
    weight = F.when(i == 1, f["x"]).otherwise(1 - f["x"]) * F.when(j == 1, f["y"]).otherwise(1 - f["y"])
    return out.withColumn("weight", weight).withColumn("x", (F.floor("mx") + i).cast("long")).withColumn("y", (F.floor("my") + j).cast("long")).drop("_tap")


def _keyed(points: DataFrame, key: list[str]) -> DataFrame:
    """Only what sampling needs; the key may itself hold an x and y, so it takes other names meanwhile."""
    return points.select("image", "mx", "my", *(F.col(k).alias(f"_key_{k}") for k in key))


def _names(key: list[str]) -> list[Column]:
    return [F.col(f"_key_{k}").alias(k) for k in key]


def bilinear_support(points: DataFrame, mask: DataFrame, key: list[str], size: tuple[int, int] | None = None) -> DataFrame:
    """key and supported: whether all pixels that a bilinear sample of image at (mx, my) uses are set.

    Pixels outside aren't set; with ``size`` (width, height) the edge's pixels go on outside.
    """
    used = taps(_keyed(points, key))
    if size:
        for c, n in zip("xy", size):
            used = used.withColumn(c, F.greatest(F.lit(0), F.least(F.col(c), F.lit(n - 1))).cast("long"))
    hit = used.join(mask.where("flag").select("image", "x", "y", "flag"), ["image", "x", "y"], "left")
    return hit.groupBy(*_names(key)).agg(F.bool_and(F.coalesce("flag", F.lit(False))).alias("supported"))


def bilinear(points: DataFrame, pixels: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """key and the bilinear samples of values at (mx, my); outside is 0."""
    hit = taps(_keyed(points, key)).join(pixels.select("image", "x", "y", *values), ["image", "x", "y"], "left")
    return hit.groupBy(*_names(key)).agg(*(F.sum(F.col("weight") * F.coalesce(F.col(v), F.lit(0.0))).alias(v) for v in values))


def _grid(rows: DataFrame, width: Column, height: Column) -> DataFrame:
    """Every row once for each pixel x, y."""
    out = rows.withColumn("y", F.explode(F.sequence(F.lit(0), height - 1)))
    return out.withColumn("x", F.explode(F.sequence(F.lit(0), width - 1)))


def erp_owners(cameras: DataFrame, width: int) -> DataFrame:
    """station_id, x, y of each panorama pixel and the face that sees it, with that face's pixel (face_x, face_y).

    Of several faces the one with the ray nearest its axis owns the pixel, ties by face_index; face is null
    where none sees it. A station's cameras stay in one row, so no panorama is shuffled.
    """
    face = F.struct("face", "face_index", *_CAMERA)
    per = cameras.groupBy("station_id").agg(F.sort_array(F.collect_list(face)).alias("faces"))
    ray = erp_to_ray((F.col("x") + 0.5) / width, (F.col("y") + 0.5) / (width // 2))
    grid = _grid(per, F.lit(width), F.lit(width // 2)).withColumn("ray", F.array(*ray))

    def seen(c):
        x, y, z = turned([F.col("ray")[i] for i in range(3)], [c[t] for t in _TERMS], back=True)
        u, v = c["fl_x"] * x / z + c["px"], c["fl_y"] * y / z + c["py"]
        ok = (z > 0) & inside(u, v, c["w"], c["h"])
        return F.when(ok, F.struct(z.alias("z"), (-c["face_index"]).alias("order"), c["face"].alias("face"), F.floor(u).alias("face_x"), F.floor(v).alias("face_y")))

    best = F.array_max(F.array_compact(F.transform("faces", seen)))
    return grid.withColumn("_best", best).select("station_id", "x", "y", *(F.col(f"_best.{c}").alias(c) for c in ("face", "face_x", "face_y")))


def faces_to_erp(pixels: DataFrame, cameras: DataFrame, width: int, values: list[str]) -> DataFrame:
    """station_id, x, y and the nearest face pixel's values (pixels: station_id, face, x, y and values)."""
    p = pixels.select("station_id", "face", F.col("x").alias("face_x"), F.col("y").alias("face_y"), *values)
    return erp_owners(cameras, width).join(p, ["station_id", "face", "face_x", "face_y"], "left").select("station_id", "x", "y", "face", *values)


def uncovered(owners: DataFrame) -> DataFrame:
    """station_id, pixels that no face sees, and faces that own pixels."""
    return owners.groupBy("station_id").agg(F.count_if(F.col("face").isNull()).alias("uncovered"), F.count_distinct("face").alias("faces"))


def erp_to_faces(mask: DataFrame, cameras: DataFrame, width: int, nearest: bool = False) -> DataFrame:
    """station_id, face, x, y and flag of a panorama mask (station_id, x, y, flag) on each face's pixels.

    A face pixel is set if any pixel of its bilinear sample is (longitude wraps, the poles go on), or with
    ``nearest`` if the pixel that holds its centre is.
    """
    height = width // 2
    key = ["station_id", "face", "face_x", "face_y"]
    own = _grid(cameras, F.col("w"), F.col("h"))
    ray = [(F.col("x") + 0.5 - F.col("px")) / F.col("fl_x"), (F.col("y") + 0.5 - F.col("py")) / F.col("fl_y"), F.lit(1.0)]
    u, v = ray_to_erp(*turned(ray, [F.col(t) for t in _TERMS]))
    at = own.select("station_id", "face", F.col("x").alias("face_x"), F.col("y").alias("face_y"), (u * width).alias("mx"), (v * height).alias("my"))
    if nearest:
        used = at.withColumn("x", F.floor("mx")).withColumn("y", F.floor("my"))
    else:
        used = taps(at.withColumn("mx", F.col("mx") - 0.5).withColumn("my", F.col("my") - 0.5)).where("weight > 0")
    used = used.withColumn("x", F.pmod("x", F.lit(width)).cast("long")).withColumn("y", F.greatest(F.lit(0), F.least("y", F.lit(height - 1))).cast("long"))
    hit = used.join(mask.where("flag").select("station_id", "x", "y", "flag"), ["station_id", "x", "y"], "left")
    out = hit.groupBy(*key).agg(F.bool_or(F.coalesce("flag", F.lit(False))).alias("flag"))
    return out.select("station_id", "face", F.col("face_x").alias("x"), F.col("face_y").alias("y"), "flag")


def _posed(cameras: DataFrame, mark: str) -> DataFrame:
    return cameras.select(*(F.col(c).alias(f"{mark}{c}") for c in ("frame", "station_id", *_CAMERA, "tx", "ty", "tz")))


def _world(mark: str, u: Column, v: Column, z: Column) -> list[Column]:
    c = lambda n: F.col(mark + n)
    ray = [(u - c("px")) / c("fl_x") * z, (v - c("py")) / c("fl_y") * z, z]
    return [a + c(t) for a, t in zip(turned(ray, [c(t) for t in _TERMS]), ("tx", "ty", "tz"))]


def _view(mark: str, p: list[Column]) -> tuple[Column, Column, Column]:
    """u, v (null behind the camera) and z of a point of the world."""
    c = lambda n: F.col(mark + n)
    x, y, z = turned([a - c(t) for a, t in zip(p, ("tx", "ty", "tz"))], [c(t) for t in _TERMS], back=True)
    return F.when(z > 0, c("fl_x") * x / z + c("px")), F.when(z > 0, c("fl_y") * y / z + c("py")), z


def view_agreement(pixels: DataFrame, cameras: DataFrame, pairs: DataFrame, depth_error: float = 0.05, roundtrip: float = 2.0, photo: float = 0.1, parallax: float = 0.5, minimum: int = 2) -> DataFrame:
    """frame, x, y, support (other stations that confirm the pixel's depth) and accepted, for valid pixels.

    ``pixels``: frame, x, y, depth_z, valid, confidence, red, green, blue (0 to 1); ``pairs``: frame, source. A source confirms a
    pixel that falls within its picture, less one pixel at the edge, if its depth there agrees, its own point comes back near the
    pixel, colours agree on average over 3 x 3 pixels, and the rays meet at an angle. Stations count once,
    however many of their faces confirm; a source of the pixel's own station doesn't count.
    """
    key = ["frame", "source", "x", "y"]
    t, s = _posed(cameras, "t_"), _posed(cameras, "s_")
    placed = pairs.join(t, F.col("frame") == F.col("t_frame")).join(s, F.col("source") == F.col("s_frame")).where("t_station_id <> s_station_id")
    far = pixels.join(placed, "frame")
    for c, a in zip("XYZ", _world("t_", F.col("x") + 0.5, F.col("y") + 0.5, F.col("depth_z"))):
        far = far.withColumn(f"world{c}", a)
    u, v, z = _view("s_", [F.col(f"world{c}") for c in "XYZ"])
    far = far.withColumn("u", u).withColumn("v", v).withColumn("source_z", z)
    colours = ["red", "green", "blue"]
    seen = far.select(F.col("source").alias("image"), *key, (F.coalesce("u", F.lit(-2.0)) - 0.5).alias("mx"), (F.coalesce("v", F.lit(-2.0)) - 0.5).alias("my"))
    sampled = bilinear(seen, pixels.withColumnRenamed("frame", "image"), key, colours)
    there = sampled.select(*key, *(F.col(c).alias(f"s_{c}") for c in colours)).join(pixels.select("frame", "x", "y", *colours), ["frame", "x", "y"])
    error = there.select(*key, (sum((F.abs(F.col(c) - F.col(f"s_{c}")) for c in colours), F.lit(0.0)) / 3).alias("error"))
    d = F.array(*map(F.lit, (-1, 0, 1)))
    spread = error.withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d)).withColumn("x", F.col("x") + F.col("_dx")).withColumn("y", F.col("y") + F.col("_dy"))
    patch = spread.groupBy(*key).agg((F.sum("error") / 9).alias("patch"))
    edge = (F.col("u") >= 1) & (F.col("u") < F.col("s_w") - 1) & (F.col("v") >= 1) & (F.col("v") < F.col("s_h") - 1)
    near = far.where(F.col("valid") & edge).withColumn("at_x", F.floor("u")).withColumn("at_y", F.floor("v"))
    found = pixels.where("valid").select(F.col("frame").alias("source"), F.col("x").alias("at_x"), F.col("y").alias("at_y"), F.col("depth_z").alias("found_z"))
    met = near.join(found, ["source", "at_x", "at_y"])
    bu, bv, bz = _view("t_", _world("s_", F.col("at_x") + 0.5, F.col("at_y") + 0.5, F.col("found_z")))
    back = F.sqrt(F.pow(bu - (F.col("x") + 0.5), 2) + F.pow(bv - (F.col("y") + 0.5), 2))
    rays = [[F.col(f"world{c}") - F.col(f"{m}t{c.lower()}") for c in "XYZ"] for m in ("t_", "s_")]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cosine = dot(*rays) / F.greatest(F.sqrt(dot(rays[0], rays[0])) * F.sqrt(dot(rays[1], rays[1])), F.lit(1e-15))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    geometric = (F.abs(F.col("found_z") - F.col("source_z")) <= depth_error * F.col("source_z")) & (bz > 0) & (back <= roundtrip) & (angle >= parallax)
    good = met.where(geometric).select(*key, "s_station_id").join(patch.where(F.col("patch") <= photo), key)
    support = good.groupBy("frame", "x", "y").agg(F.count_distinct("s_station_id").alias("support"))
    out = pixels.where("valid").select("frame", "x", "y", "confidence").join(support, ["frame", "x", "y"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return out.select("frame", "x", "y", "support", ((F.col("support") >= minimum) & (F.col("confidence") > 0)).alias("accepted"))
