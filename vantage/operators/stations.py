"""Camera stations: centres, radii, baselines, splits and grouping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distance(a: list, b: list) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def centres(cameras: DataFrame, dedup: bool = True) -> DataFrame:
    """One centre a station: the mean of its distinct camera centres (of all, without ``dedup``)."""
    c = cameras.select("station_id", "cx", "cy", "cz")
    return (c.distinct() if dedup else c).groupBy("station_id").agg(*(F.avg(x).alias(x) for x in ("cx", "cy", "cz")))


def scene(cameras: DataFrame, dedup: bool = True, factor: float = 1.0) -> DataFrame:
    """One row: the unweighted mean of station centres, and the largest distance from it times ``factor``.

    Cleaning takes distinct centres and factor 1, normalising for training all centres and 1.1, and refining
    distinct ones and 1.1; they stay apart, since they differ.
    """
    own = centres(cameras, dedup)
    mid = own.agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"), F.avg("cz").alias("mz"), F.count(F.lit(1)).alias("stations"))
    far = own.crossJoin(F.broadcast(mid)).groupBy("mx", "my", "mz", "stations")
    return far.agg((factor * F.max(distance([F.col("cx"), F.col("cy"), F.col("cz")], [F.col("mx"), F.col("my"), F.col("mz")]))).alias("radius"))


def checked_scene(cameras: DataFrame) -> DataFrame:
    """:func:`scene` of distinct centres, where stations are what they should be; an error tells which rule fails.

    There must be two stations or more, the radius positive, all centres of a station within 1e-6 of the radius of its
    mean, and no two stations within that of each other. Near stations meet in cells of a grid.
    """
    from .neighbours import nearest_distance

    own, whole = centres(cameras), scene(cameras)
    at = [F.col(c) for c in ("cx", "cy", "cz")]
    far = cameras.select("station_id", *(F.col(c).alias(f"o{c}") for c in ("cx", "cy", "cz"))).join(own, "station_id")
    off = far.agg(F.max(distance(at, [F.col(f"o{c}") for c in ("cx", "cy", "cz")])).alias("off"))
    near = nearest_distance(own.select(F.col("station_id").alias("id"), *(F.col(f"c{c}").alias(c) for c in "xyz"))).agg(F.min("distance").alias("near"))
    out = whole.crossJoin(F.broadcast(off)).crossJoin(F.broadcast(near))
    fault = (
        F.when(F.col("stations") < 2, "fewer than two stations").when(~F.coalesce((F.col("radius") > 0) & (F.col("radius") < float("inf")), F.lit(False)), "the radius isn't positive")
        .when(F.col("off") > 1e-6 * F.col("radius"), "a station has different centres").when(F.col("near") <= 1e-6 * F.col("radius"), "two stations have one centre")
    )
    return out.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))).select(*whole.columns)


def baseline(cameras: DataFrame, limit: int = 1024, capture: str = "pano_id") -> DataFrame:
    """One row: the median positive distance between stations, of at most ``limit`` in the order of their ids' hashes.

    Faces are averaged within a capture, and captures within a station. Also stations (all), sampled and pairs
    (positive); the baseline is null where there is no such pair.
    """
    xyz = ("cx", "cy", "cz")
    per = cameras.groupBy("station_id", capture).agg(*(F.avg(c).alias(c) for c in xyz)).groupBy("station_id").agg(*(F.avg(c).alias(c) for c in xyz))
    own = per.withColumn("h", F.sha2(F.col("station_id").cast("string"), 256)).orderBy("h").limit(limit)
    a, b = own.alias("a"), F.broadcast(own).alias("b")
    d = a.join(b, F.col("a.h") < F.col("b.h")).select(distance([F.col(f"a.{x}") for x in xyz], [F.col(f"b.{x}") for x in xyz]).alias("d"))
    found = d.where("d > 0").agg(F.median("d").alias("baseline"), F.count(F.lit(1)).alias("pairs"))
    return found.crossJoin(F.broadcast(per.agg(F.count(F.lit(1)).alias("stations")))).withColumn("sampled", F.least("stations", F.lit(limit)))


def characteristic_length(cameras: DataFrame, cell: float = 4.0) -> DataFrame:
    """The median distance to the nearest other centre, of distinct centres.

    Centres meet in a grid; those without another one in their neighbourhood meet all centres.
    """
    from .neighbours import nearest

    own = cameras.select("cx", "cy", "cz").distinct().withColumn("id", F.xxhash64("cx", "cy", "cz"))
    named = own.select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return nearest(named, named, 1, cell, apart=True).agg(F.median("distance").alias("length"))


def unit_vector(v: tuple[float, float, float]) -> tuple[float, float, float]:
    n = math.sqrt(sum(x * x for x in v))
    if len(v) != 3 or not math.isfinite(n) or n <= 1e-10:
        raise ValueError("not a direction")
    return tuple(x / n for x in v)


def world_up(frames: DataFrame, declared: list[tuple[float, float, float]] = (), convention: str = "OpenCV_c2w") -> tuple[float, float, float]:
    """The upward direction of a scene; no axis is ever assumed.

    Declared directions go first, and must agree within one degree. Else the frames (station_id, face, r02, r12, r22:
    the third column of their rotation) that look up or down tell: the mean of each station's distinct directions,
    and the mean over stations, which all of them must meet within 5 degrees. ValueError where nothing tells or they
    don't agree. One row of sums comes to the driver.
    """
    if declared:
        units = [unit_vector(v) for v in declared]
        if any(sum(a * b for a, b in zip(u, units[0])) < math.cos(math.radians(1)) for u in units):
            raise ValueError("the declared directions differ")
        return units[0]
    ahead = 1 if convention == "OpenCV_c2w" else -1
    face = F.lower("face")
    sign = F.when(face.isin("u", "up"), F.lit(1.0)).when(face.isin("d", "down"), F.lit(-1.0)) * ahead
    names = ("ux", "uy", "uz")
    rows = frames.where(face.isin("u", "up", "d", "down")).select("station_id", *((sign * F.col(f"r{i}2")).alias(n) for i, n in enumerate(names))).distinct()
    per = rows.groupBy("station_id").agg(*(F.avg(n).alias(n) for n in names))
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])))
    per = per.withColumn("_n", length).select(*((F.col(n) / F.col("_n")).alias(n) for n in names), (F.col("_n") <= 1e-10).alias("none"))
    mean = per.agg(*(F.avg(n).alias(n) for n in names), F.count(F.lit(1)).alias("n"), F.bool_or("none").alias("none")).first()
    if not mean.n:
        raise ValueError("the upward direction needs a declaration, or cameras that look up or down")
    if mean.none:
        raise ValueError("the cameras that look up and down have no common axis")
    up = unit_vector((mean.ux, mean.uy, mean.uz))
    dot = sum((F.col(n) * u for n, u in zip(names[1:], up[1:])), F.col(names[0]) * up[0])
    if not per.where(dot < math.cos(math.radians(5))).isEmpty():
        raise ValueError("the cameras that look up and down have no common axis")
    return up


def holdout(stations: DataFrame, seed: str, fraction: float) -> DataFrame:
    """station_id and split: the first stations in the order of sha256(seed, 0, id) are held out.

    Their number is ceil(n * fraction), 1 at least and n - 2 at most. Ranking gathers a row a station.
    """
    own = stations.select("station_id").distinct()
    n = own.agg(F.count(F.lit(1)).alias("n"))
    key = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col("station_id").cast("string")), 256)
    ranked = own.withColumn("rank", F.row_number().over(Window.orderBy(key, "station_id")))
    count = F.least(F.col("n") - 2, F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(fraction))))
    return ranked.crossJoin(F.broadcast(n)).select("station_id", F.when(F.col("rank") <= count, "heldout").otherwise("train").alias("split"))


def complete_link(places: DataFrame, tolerance_m: float = 0.25) -> DataFrame:
    """Group places (id, lat, lng): in the order of ids, each joins the first group all of whose members are near.

    Groups never chain. Occupied cells of a grid are connected where they adjoin, which needs no pairs of places;
    whatever such a patch holds is grouped on its own, so a task holds one patch. Within it a place meets the groups
    whose first member is in a cell beside it.
    """
    from ..functions.geo import EARTH_RADIUS_M
    from .graph import connected

    # Cells of a latitude band have one width in degrees, chosen where the band is nearest to a pole; a point meets the
    # cells around it in its own band and, by their width, in the bands beside it. Longitude wraps.
    step = tolerance_m / EARTH_RADIUS_M * 57.29577951308232 * 1.01
    width = lambda gy: step / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(gy * step), F.abs((gy + 1) * step)) + step))))
    around = lambda gy: F.greatest(F.lit(1), F.floor(360.0 / width(gy))).cast("long")
    row = F.floor(F.col("lat") / step)
    own = places.withColumn("gy", row)
    own = own.withColumn("gx", F.pmod(F.floor(F.col("lng") / width(F.col("gy"))), around(F.col("gy"))))
    known = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng")
    own = own.withColumn("cell", F.when(known, F.xxhash64("gy", "gx")).otherwise(F.xxhash64("id")))
    # The cells that a place may have neighbours in; two cells are joined if either's places reach the other.
    near = own.select("cell", "lng", F.explode(F.array(row - 1, row, row + 1)).alias("gy"))
    near = near.select("cell", "gy", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(F.floor(F.col("lng") / width(F.col("gy"))) + d, around(F.col("gy")))))).alias("gx"))
    reach = near.distinct().select("cell", F.xxhash64("gy", "gx").alias("other"))
    parts = connected(reach.join(own.select(F.col("cell").alias("other")).distinct(), "other").select(F.col("cell").alias("a"), F.col("other").alias("b")))
    joined = own.join(parts.withColumnRenamed("id", "cell"), "cell", "left").select("id", "lat", "lng", F.coalesce("component", "cell").alias("component"))

    def greedy(pdf):
        import numpy as np

        pdf = pdf.sort_values("id").reset_index(drop=True)
        la, lo = np.radians(pdf["lat"].to_numpy(float)), np.radians(pdf["lng"].to_numpy(float))
        xyz = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
        # Chords tell near from far but for a sliver about the tolerance, where the haversine decides.
        chord = 2 * math.sin(min(math.pi / 2, tolerance_m / (2 * EARTH_RADIUS_M)))
        slack = 1e-6 + 1e-14 / max(chord, 1e-300)
        low, high, side = chord * chord * (1 - slack), chord * chord * (1 + slack), max(chord * (1 + slack), 1e-12)
        cells = np.floor(xyz / side).astype(np.int64).tolist()

        def apart(i, j):
            h = np.sin((la[j] - la[i]) / 2) ** 2 + np.cos(la[j]) * np.cos(la[i]) * np.sin((lo[j] - lo[i]) / 2) ** 2
            return not 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1))) <= tolerance_m

        steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
        beside: dict[tuple, list[int]] = {}  # of a cell: the groups whose first member is in it or next to it, as they came
        groups: list[list[tuple]] = []
        first = []
        for i, ((cx, cy, cz), (x, y, z)) in enumerate(zip(cells, xyz.tolist())):
            for k in beside.get((cx, cy, cz), ()):
                g = groups[k]
                for n, (px, py, pz, j) in enumerate(g):
                    d = (px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z)
                    if not d < low and (d > high or apart(i, j)):
                        # A member that turned one away may turn the next away, so it is asked sooner.
                        if n > 1:
                            g[n], g[n - 1] = g[n - 1], g[n]
                        break
                else:
                    g.append((x, y, z, i))
                    first.append(g[0][3])
                    break
            else:
                for a, b, c in steps:
                    beside.setdefault((cx + a, cy + b, cz + c), []).append(len(groups))
                groups.append([(x, y, z, i)])
                first.append(i)
        out = pdf[["id"]].copy()
        out["group_id"] = pdf["id"].to_numpy()[first]
        return out

    return joined.groupBy("component").applyInPandas(greedy, "id long, group_id long")


def preferred_view(frames: DataFrame) -> DataFrame:
    """The frame (station_id, face, r12, frame_index, cx, cy, cz) to start from: of the station nearest to the mean of
    stations, a front face before others, then the least tilted, then the first."""
    xyz = ("cx", "cy", "cz")
    own = centres(frames, dedup=False)
    mid = own.agg(*(F.avg(c).alias(f"m{c}") for c in xyz))
    d = distance([F.col(c) for c in xyz], [F.col(f"m{c}") for c in xyz])
    first = own.crossJoin(F.broadcast(mid)).agg(F.min(F.struct(d.alias("d"), F.col("station_id").cast("string").alias("s"), "station_id")).alias("b")).select("b.station_id")
    rank = F.struct((~F.col("face").isin("F", "front")).alias("other"), F.abs("r12").alias("tilt"), F.col("frame_index"))
    return frames.join(F.broadcast(first), "station_id", "left_semi").withColumn("_k", rank).orderBy("_k").limit(1).drop("_k")


def best_first(rows: DataFrame, keys: list[str], ascending: bool = False) -> DataFrame:
    """The row with the greatest (or least) keys, compared in their order; a partial top-1, not a sort."""
    return rows.orderBy(*(F.col(k).asc() if ascending else F.col(k).desc() for k in keys)).limit(1)
