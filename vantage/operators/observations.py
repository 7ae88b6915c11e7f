"""Track observations: support, duplicates, collisions, calibration and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seed_support(support: Column, angle: Column, error: Column, min_support: int = 2, min_angle: float = 2.0, max_error: float = 2.0) -> Column:
    ok = (support >= min_support) & (angle >= min_angle) & (error >= 0) & (error <= max_error)
    return F.coalesce(ok, F.lit(False))


def reason(x: Column, y: Column, depth: Column, support: Column, angle: Column, error: Column, width: int, height: int) -> Column:
    """The first test that an observation fails, null if none."""
    return (
        F.when(~F.coalesce((x >= 1) & (x < width - 1) & (y >= 1) & (y < height - 1), F.lit(False)), "outside")
        .when(~F.coalesce(depth > 0, F.lit(False)), "depth")
        .when(~F.coalesce(support >= 2, F.lit(False)), "support")
        .when(~F.coalesce(angle >= 2, F.lit(False)), "angle")
        .when(~F.coalesce(error.between(0, 2), F.lit(False)), "error")
    )


def tally(observations: DataFrame, reason: Column) -> DataFrame:
    return observations.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


ORDER = ("reprojection_error_px", "px", "py", "source_row", "depth_z", "support_station_count", "angle_deg")


def _groups(observations: DataFrame, frame: list[str], rtol_depth: float, rtol_angle: float) -> DataFrame:
    """Of each (frame, point): its best row ``b``, its rows ``n``, and ``ok``: whether all agree with the first one.

    Rows agree in station, split and support, and in depth and angle within a part of the first row's.
    """
    near = lambda c, rtol: F.coalesce(F.greatest(F.max(c) - F.min_by(c, "source_row"), F.min_by(c, "source_row") - F.min(c)) <= rtol * F.abs(F.min_by(c, "source_row")), F.lit(False))
    one = lambda c: F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count(F.lit(1))))
    ok = (F.count(F.lit(1)) == 1) | (one("station_id") & one("split") & one("support_station_count") & near("depth_z", rtol_depth) & near("angle_deg", rtol_angle))
    group = [*frame, "point_id"]
    rest = [c for c in observations.columns if c not in ORDER and c not in group]
    # station_id may be a key of the frame; it is compared all the same.
    return observations.groupBy(*group).agg(F.min(F.struct(*ORDER, *rest)).alias("b"), F.count(F.lit(1)).alias("n"), ok.alias("ok"))


def deduplicated(observations: DataFrame, frame: list[str], rtol_depth: float = 1e-9, rtol_angle: float = 1e-6) -> DataFrame:
    """One row a (frame, point): the one with the least error, then x, y and place.

    Groups whose rows disagree on station, split, support, depth or angle are rejected as a whole; see
    :func:`dedup_report`. Nothing is averaged.
    """
    group = [*frame, "point_id"]
    best = _groups(observations, frame, rtol_depth, rtol_angle).where("ok")
    return best.select(*group, *(F.col(f"b.{c}").alias(c) for c in observations.columns if c not in group))


def dedup_report(observations: DataFrame, frame: list[str], rtol_depth: float = 1e-9, rtol_angle: float = 1e-6) -> DataFrame:
    """One row: input_rows, groups, output_rows, duplicate_groups, removed_rows and rejected_groups of :func:`deduplicated`."""
    g = _groups(observations, frame, rtol_depth, rtol_angle)
    out = g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("input_rows"), F.count(F.lit(1)).alias("groups"), F.count_if("ok").alias("output_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.count_if(~F.col("ok")).alias("rejected_groups"),
    )
    return out.withColumn("removed_rows", F.col("input_rows") - F.col("output_rows"))


def confidence(support: Column, angle: Column, error: Column, max_error: float = 2.0) -> Column:
    """How far an observation is to be trusted, from 0 to 1: by its stations (3), angle (10 degrees) and error."""
    return F.least(support / 3.0, F.lit(1.0)) * F.least(angle / 10.0, F.lit(1.0)) * F.exp(-0.5 * (error / max_error) * (error / max_error))


def rasterised(observations: DataFrame, frame: list[str], spread: float = 0.02, max_error: float = 2.0) -> DataFrame:
    """frame, pixel, hits, ambiguous (depths differ by more than ``spread`` of the nearest), and of the nearest row
    depth, point_id and confidence, which are null where the pixel is ambiguous."""
    at = observations.withColumns({"ix": F.floor("px").cast("long"), "iy": F.floor("py").cast("long")})
    one = F.min(F.struct("depth_z", "source_row", "point_id", confidence(F.col("support_station_count"), F.col("angle_deg"), F.col("reprojection_error_px"), max_error).alias("c")))
    out = at.groupBy(*frame, "ix", "iy").agg(one.alias("b"), F.max("depth_z").alias("_far"), F.count(F.lit(1)).alias("hits"))
    near = F.col("b.depth_z")
    out = out.withColumn("ambiguous", (F.col("_far") - near) / near > spread)
    clear = lambda c: F.when(~F.col("ambiguous"), F.col(c))
    return out.select(*frame, "ix", "iy", "hits", "ambiguous", clear("b.depth_z").alias("depth"), clear("b.point_id").alias("point_id"), clear("b.c").alias("confidence"))


SIDE = 14


def _tile(name: str) -> Column:
    return F.floor(F.col(name) / SIDE).cast("long")


def _eroded(words: list[Column]) -> list[Column]:
    """The 3 x 3 erosion of 16 x 16 bits, four rows a word, right but for the outermost rows and columns."""
    h = [w.bitwiseAND(F.shiftleft(w, 1)).bitwiseAND(F.shiftrightunsigned(w, 1)) for w in words]
    none = F.lit(0).cast("long")
    over = [F.shiftleft(w, 16).bitwiseOR(F.shiftrightunsigned(p, 48)) for w, p in zip(h, [none, *h])]
    under = [F.shiftrightunsigned(w, 16).bitwiseOR(F.shiftleft(n, 48)) for w, n in zip(h, [*h[1:], none])]
    return [w.bitwiseAND(o).bitwiseAND(u) for w, o, u in zip(h, over, under)]


def core_clear(observations: DataFrame, mask: DataFrame, frame: list[str]) -> DataFrame:
    """The observations whose pixel and its eight neighbours are all in a mask (frame, ix, iy: the pixels that are set).

    The mask is packed into bits of tiles of 14 x 14 pixels with a rim of one, which tasks put together before the
    shuffle, and eroded by shifts; an observation looks its bit up in one tile.
    """
    m = mask.select(*frame, "ix", "iy")
    for c, t in (("ix", "tx"), ("iy", "ty")):
        # A pixel next to a tile's edge is also in the rim of the tile beyond it.
        at, own = F.pmod(F.col(c), F.lit(SIDE)), _tile(c)
        m = m.withColumn(t, F.explode(F.when(at == 0, F.array(own - 1, own)).when(at == SIDE - 1, F.array(own, own + 1)).otherwise(F.array(own))))
    place = lambda: ((F.col("iy") - F.col("ty") * SIDE + 1) * 16 + F.col("ix") - F.col("tx") * SIDE + 1).cast("int")
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_p") % 64)
    word = lambda k: F.when(F.floor(F.col("_p") / 64) == k, bit()).otherwise(F.lit(0).cast("long"))
    tiles = m.withColumn("_p", place()).groupBy(*frame, "tx", "ty").agg(*(F.bit_or(word(k)).alias(f"_w{k}") for k in range(4)))
    core = tiles.select(*frame, "tx", "ty", *(w.alias(f"_w{k}") for k, w in enumerate(_eroded([F.col(f"_w{k}") for k in range(4)])))).where("_w0 <> 0 OR _w1 <> 0 OR _w2 <> 0 OR _w3 <> 0")
    at = observations.withColumns({"ix": F.floor("px").cast("long"), "iy": F.floor("py").cast("long")}).withColumns({"tx": _tile("ix"), "ty": _tile("iy")})
    at = at.withColumn("_p", place()).drop("ix", "iy")
    k = F.floor(F.col("_p") / 64)
    w = F.when(k == 0, F.col("_w0")).when(k == 1, F.col("_w1")).when(k == 2, F.col("_w2")).otherwise(F.col("_w3"))
    core = core.select(*(F.col(c).alias(f"_k_{c}") for c in [*frame, "tx", "ty"]), *(f"_w{i}" for i in range(4)))
    on = [F.col(c) == F.col(f"_k_{c}") for c in [*frame, "tx", "ty"]]
    return at.join(core, [*on, w.bitwiseAND(bit()) != 0], "left_semi").drop("tx", "ty", "_p")


def balanced(observations: DataFrame, value: str) -> DataFrame:
    """point_id and the median over stations of each station's median, for points of two stations or more; training only."""
    per = observations.where("split = 'train'").groupBy("point_id", "station_id").agg(F.median(value).alias("m"))
    out = per.groupBy("point_id").agg(F.median("m").alias("value"), F.count(F.lit(1)).alias("stations")).where("stations >= 2")
    return out.withColumn("value", F.rint("value").cast("long"))


def calibration(pairs: DataFrame, by: list[str], min_fit: int = 20, min_test: int = 8, max_median: float = 0.2, max_p90: float = 0.5, min_inliers: float = 0.65, inlier: float = 0.25) -> DataFrame:
    """scale = exp(median ln(metric / raw)) of the fitting points of each group, and relative errors on the others.

    ``pairs`` are by, point_id, fit (boolean), metric and raw; values that are not finite and positive are left out.
    ``accepted`` groups reach the median, 90 % and inlier limits; with too few points of either kind there is no
    scale. A point that comes twice in a group is an error.
    """
    once = pairs.groupBy(*by, "point_id").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("fit", "metric", "raw")))
    once = once.where(F.when(F.col("n") > 1, F.raise_error(F.lit("a point comes twice in a calibration group")).cast("boolean")).otherwise(F.lit(True)))
    ok = once.where(" AND ".join(f"{c} > 0 AND {c} < double('inf') AND NOT isnan({c})" for c in ("metric", "raw")))
    fit = ok.where("fit").groupBy(*by).agg(F.exp(F.median(F.log(F.col("metric") / F.col("raw")))).alias("scale"), F.count(F.lit(1)).alias("fit_points"))
    err = F.abs(F.col("scale") * F.col("raw") - F.col("metric")) / F.col("metric")
    test = ok.where("NOT fit").join(fit.select(*by, "scale"), by).groupBy(*by).agg(
        F.median(err).alias("median_error"), F.percentile(err, F.lit(0.9)).alias("p90_error"), F.avg((err < inlier).cast("double")).alias("inliers"), F.count(F.lit(1)).alias("test_points")
    )
    out = fit.join(test, by, "left").withColumn("test_points", F.coalesce("test_points", F.lit(0)))
    enough = (F.col("fit_points") >= min_fit) & (F.col("test_points") >= min_test)
    good = enough & (F.col("median_error") <= max_median) & (F.col("p90_error") <= max_p90) & (F.col("inliers") >= min_inliers)
    only = lambda c: F.when(enough, F.col(c)).alias(c)
    return out.select(*by, only("scale"), "fit_points", "test_points", only("median_error"), only("p90_error"), only("inliers"), F.coalesce(good, F.lit(False)).alias("accepted"))


def ground(observations: DataFrame, frame: list[str], mask: DataFrame | None = None) -> DataFrame:
    """Points that training observations see from two stations or more, each frame counted once by its least error.

    With ``mask`` (frame, ix, iy) only observations whose 3 x 3 neighbourhood is ground count.
    """
    own = observations.where("split = 'train'")
    once = deduplicated(own if mask is None else core_clear(own, mask, frame), frame)
    return once.groupBy("point_id").agg(F.count_distinct("station_id").alias("stations"), F.min("reprojection_error_px").alias("least_error"), F.max("angle_deg").alias("angle")).where("stations >= 2").withColumn("strong", (F.col("stations") >= 3) & (F.col("angle") >= 4) & (F.col("least_error") <= 1))


def merged_depth(actual: DataFrame, learned: DataFrame, key: list[str]) -> DataFrame:
    """Actual depth before learned depth; an ambiguous actual pixel vetoes the learned one. source: 1 or 2."""
    a = actual.select(*key, F.col("depth").alias("_a"), F.col("ambiguous").alias("_amb"))
    b = learned.select(*key, F.col("depth").alias("_b"))
    out = a.join(b, key, "full_outer")
    return out.select(*key, F.when(F.col("_amb"), F.lit(None)).otherwise(F.coalesce("_a", "_b")).alias("depth"), F.when(F.col("_amb"), F.lit(0)).when(F.col("_a").isNotNull(), F.lit(1)).otherwise(F.lit(2)).alias("source"))


def triangulation(rays: DataFrame) -> DataFrame:
    """point_id and the greatest angle (degrees) between its rays (ray_id, x, y, z of length 1); 0 with fewer than two."""
    b = rays.select("point_id", *(F.col(c).alias(f"o_{c}") for c in ("ray_id", "x", "y", "z")))
    dot = F.col("x") * F.col("o_x") + F.col("y") * F.col("o_y") + F.col("z") * F.col("o_z")
    pairs = rays.join(b, "point_id").where("ray_id < o_ray_id").groupBy("point_id").agg(F.min(dot).alias("d"))
    out = rays.select("point_id").distinct().join(pairs, "point_id", "left")
    return out.select("point_id", F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("d"))))), F.lit(0.0)).alias("angle"))


def best_per_group(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """The row with the greatest ``keys`` of each group."""
    return rows.groupBy(group).agg(F.max(F.struct(*keys)).alias("b")).select(group, *(F.col(f"b.{k}").alias(k) for k in keys))


def unique_pixels(rows: DataFrame, group: str, pixel: list[str], order: str) -> DataFrame:
    """The first valid occurrence of each pixel within a row."""
    w = Window.partitionBy(group, *pixel).orderBy(order)
    return rows.where("valid").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def anchors(observations: DataFrame, frame: list[str], mask: DataFrame, width: int, height: int, min_support: int, min_angle: float, max_error: float) -> DataFrame:
    """Observations that may anchor a depth scale: known, well supported, inside the image by a pixel and clear of the mask's edge."""
    ok = F.coalesce((F.col("depth_z") > 0) & (F.col("depth_z") < float("inf")) & (F.col("support_station_count") >= min_support) & (F.col("angle_deg") >= min_angle) & (F.col("reprojection_error_px") <= max_error), F.lit(False))
    ix, iy = F.floor("px"), F.floor("py")
    inner = F.coalesce((ix >= 1) & (ix < width - 1) & (iy >= 1) & (iy < height - 1), F.lit(False))
    return core_clear(observations.where(ok & inner), mask, frame)


def eligible_frames(pixels: DataFrame, frame: str, min_stations: int) -> DataFrame:
    """frame and station_id of the frames with a pixel of sky that isn't foreground; too few stations of them are an error."""
    own = pixels.groupBy(frame, "station_id").agg(F.bool_or(F.col("sky") & ~F.col("foreground")).alias("ok")).where("ok").drop("ok")
    n = own.agg(F.count_distinct("station_id").alias("_n"))
    few = F.when(F.col("_n") < min_stations, F.raise_error(F.lit("too few stations show the sky")).cast("boolean")).otherwise(F.lit(True))
    # The check stands beside the rows, so it is made where there are none, too.
    return n.where(few).crossJoin(own).drop("_n")


def tracks(points: DataFrame, images: DataFrame, sources: DataFrame) -> DataFrame:
    """point_id, image_id, point2d and the source's columns of each element of the points' tracks (array of image_id, point2d).

    Only images with a pose, and names (``name``) that a source is bound to, count.
    """
    flat = points.select("point_id", F.explode("track").alias("t")).select("point_id", F.col("t.image_id").alias("image_id"), F.col("t.point2d").alias("point2d"))
    return flat.join(images.where("has_pose").select("image_id", "name"), "image_id").join(sources, "name")


def bound_by_name(frames: DataFrame, depths: DataFrame) -> DataFrame:
    """Frames (file_path) with the depth (image, depth_path) of the same base name; a frame without one keeps a null."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    own = depths.select(base(F.col("image")).alias("_base"), "depth_path")
    return frames.withColumn("_base", base(F.col("file_path"))).join(own, "_base", "left").drop("_base")


def paired_depths(metric: DataFrame, poses: DataFrame) -> DataFrame:
    """Metric and pose rows of each image; that both come from the same source image is checked, and an error if not."""
    both = metric.join(poses.withColumnRenamed("source_sha256", "_sha"), "image")
    same = F.when(F.coalesce(F.col("source_sha256") != F.col("_sha"), F.lit(True)), F.raise_error(F.concat(F.lit("inferred from another image: "), F.col("image"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(same).drop("_sha")


def face_tallies(frames: DataFrame) -> DataFrame:
    """face, frames, accepted frames and their pixels."""
    return frames.groupBy("face").agg(F.count(F.lit(1)).alias("frames"), F.count_if("accepted").alias("accepted_frames"), F.coalesce(F.sum(F.when(F.col("accepted"), F.col("pixels"))), F.lit(0)).cast("long").alias("pixels"))
