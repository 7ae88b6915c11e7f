"""Scalar functions on places, poses, colours and Gaussians, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
SH_DC = 0.28209479177387814


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """Metres between two places in degrees."""
    a, b, c, d = (F.radians(F.lit(x) if isinstance(x, float) else x) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def box(lat: Column, lng: Column, lat0: float, lng0: float, radius_m: float) -> Column:
    """A necessary condition for being within a radius that scans can push down."""
    d_lat = math.degrees(radius_m / EARTH_RADIUS_M) * 1.001 + 1e-9
    cos = math.cos(math.radians(min(90.0, abs(lat0) + d_lat)))
    if cos * 180 <= d_lat:
        return lat.between(lat0 - d_lat, lat0 + d_lat)
    d_lng = d_lat / cos
    west, east = lng0 - d_lng, lng0 + d_lng
    inside = lng.between(west, east)
    if west < -180:
        inside |= lng >= west + 360
    if east > 180:
        inside |= lng <= east - 360
    return lat.between(lat0 - d_lat, lat0 + d_lat) & inside


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid_place(lat: Column, lng: Column) -> Column:
    return finite(lat) & finite(lng) & lat.between(-90, 90) & lng.between(-180, 180)


def heading_degrees(radians: Column) -> Column:
    return F.pmod(F.degrees(radians), F.lit(360.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def psnr(sse: Column, pixels: Column) -> Column:
    """Decibels of a squared error over three channels; null without pixels."""
    return F.when(pixels > 0, -10 * F.log10(F.greatest(sse / (3 * pixels), F.lit(1e-12))))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def dc_to_rgb(dc: Column) -> Column:
    return 0.5 + SH_DC * dc


def rgb_to_dc(rgb: Column) -> Column:
    return (rgb - 0.5) / SH_DC


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The nine terms of a quaternion's matrix, by rows; a zero quaternion gives the identity."""
    n = w * w + x * x + y * y + z * z
    s = F.when(n > 0, 2 / n).otherwise(F.lit(0.0))
    return [
        1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y),
        s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x),
        s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y),
    ]


def covariance(quaternion: list[Column], log_scale: list[Column]) -> dict[str, Column]:
    """The six terms of R diag(exp(2 scale)) R'."""
    r = rotation(*quaternion)
    v = [F.exp(2 * s) for s in log_scale]
    term = lambda i, j: sum((r[3 * i + k] * r[3 * j + k] * v[k] for k in range(1, 3)), r[3 * i] * r[3 * j] * v[0])
    return {f"c{'xyz'[i]}{'xyz'[j]}": term(i, j) for i in range(3) for j in range(i, 3)}


def pixel(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pinhole image coordinates; null behind the camera."""
    ahead = z > 0
    return F.when(ahead, fx * x / z + cx), F.when(ahead, fy * y / z + cy)


def inside(u: Column, v: Column, width: int, height: int) -> Column:
    """Half-open image bounds; null coordinates are outside."""
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def ray_to_erp(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(u, v) in [0, 1) x [0, 1] of a direction (x right, y down, z ahead); u wraps."""
    n = F.sqrt(x * x + y * y + z * z)
    return F.pmod(F.atan2(x, z) / (2 * math.pi) + 0.5, F.lit(1.0)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / n))) / math.pi + 0.5


def erp_to_ray(u: Column, v: Column) -> tuple[Column, Column, Column]:
    lng, lat = (u - 0.5) * (2 * math.pi), (v - 0.5) * math.pi
    return F.cos(lat) * F.sin(lng), F.sin(lat), F.cos(lat) * F.cos(lng)


def radial_to_z(radial: Column, x: Column, y: Column, z: Column) -> Column:
    """Depth along the axis from distance along the ray."""
    return radial * z / F.sqrt(x * x + y * y + z * z)


def interval_class(depth: Column, near: Column, tolerance: Column) -> dict[str, Column]:
    """How a point at ``depth`` stands to a surface at ``near``: free (before it), support (at it), behind."""
    known = finite(depth) & finite(near)
    return {
        "free": known & (depth < near - tolerance),
        "support": known & (F.abs(depth - near) <= tolerance),
        "behind": known & (depth > near + tolerance),
    }


def rigid(r: list[Column], tolerance: float = 1e-6) -> Column:
    """Whether nine terms by rows are a rotation."""
    ok = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            dot = sum((r[3 * i + k] * r[3 * j + k] for k in range(1, 3)), r[3 * i] * r[3 * j])
            ok &= F.abs(dot - (1.0 if i == j else 0.0)) <= tolerance
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    return ok & (F.abs(det - 1) <= tolerance)
