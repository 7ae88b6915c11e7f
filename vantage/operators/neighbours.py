"""Neighbour searches in space by grid cells, with an exact fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .captures import checkpointed
from .stations import distance


def _cells(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumns({f"g{c}": F.floor(F.col(c) / cell) for c in "xyz"})


def _around(points: DataFrame, cell: float) -> DataFrame:
    """Each point once for its own and each adjoining cell."""
    out = _cells(points, cell)
    for c in "xyz":
        out = out.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + d for d in (-1, 0, 1)))))
    return out


def _pairs(queries: DataFrame, points: DataFrame, cell: float, apart: bool) -> DataFrame:
    p = _cells(points, cell).select(F.col("id").alias("other"), *(F.col(c).alias(f"p{c}") for c in "xyz"), "gx", "gy", "gz")
    out = _around(queries.select("id", "x", "y", "z"), cell).join(p, ["gx", "gy", "gz"])
    out = out.withColumn("distance", distance([F.col(c) for c in "xyz"], [F.col(f"p{c}") for c in "xyz"])).select("id", "other", "distance")
    return out.where("id <> other") if apart else out


def ball_count(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """id and count of points (id, x, y, z) within a radius (inclusive) of each query; itself counts where it is a point."""
    found = _pairs(queries, points, radius, False).where(F.col("distance") <= radius).groupBy("id").agg(F.count(F.lit(1)).alias("count"))
    return queries.select("id").join(found, "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("count"))


def extent(points: DataFrame) -> tuple[float, int]:
    """The longest side of the points' bounds, and their number."""
    r = points.agg(*(f(c) for c in "xyz" for f in (F.min, F.max)), F.count(F.lit(1))).first()
    return max((float(r[i + 1] - r[i]) for i in (0, 2, 4) if r[i] is not None), default=0.0), r[6]


def nearest(queries: DataFrame, points: DataFrame, k: int, cell: float, apart: bool = False, ties: float | None = None) -> DataFrame:
    """id, other, distance and rank of the k nearest points of each query, ties by id; with ``ties`` also all others
    within the k-th distance and that part of it.

    A query's result is complete once its k-th distance is no more than a cell, as nothing nearer lies outside
    the adjoining cells. Others go on with cells four times as wide, until a cell is as wide as all bounds. A round
    is a checkpoint, so that none is computed twice.
    """
    slack = 1 + (ties or 0.0)
    w = Window.partitionBy("id").orderBy("distance", "other")

    def ranked(d):
        d = d.withColumn("rank", F.row_number().over(w))
        if ties is None:
            return d.where(F.col("rank") <= k)
        cut = F.max(F.when(F.col("rank") <= k, F.col("distance"))).over(Window.partitionBy("id"))
        return d.withColumn("_cut", cut).where(F.col("distance") <= F.col("_cut") * slack).drop("_cut")

    whole, _ = extent(points.select("x", "y", "z").unionAll(queries.select("x", "y", "z")))
    out, rest = None, queries.select("id", "x", "y", "z")
    while True:
        found = checkpointed(ranked(_pairs(rest, points, cell, apart)))
        if cell >= whole:
            return found if out is None else out.unionAll(found)
        kth = F.max(F.when(F.col("rank") <= k, F.col("distance"))) * slack
        full = found.groupBy("id").agg(kth.alias("far"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= k) & (F.col("far") <= cell)).select("id")
        done = found.join(full, "id", "left_semi")
        out = done if out is None else out.unionAll(done)
        rest = checkpointed(rest.join(full, "id", "left_anti"))
        if rest.isEmpty():
            return out
        cell *= 4


def nearest_distance(points: DataFrame) -> DataFrame:
    """id and distance of each point's nearest other one; the first cells hold about one point each."""
    whole, n = extent(points)
    return nearest(points, points, 1, max(whole, 1e-9) / max(1.0, n ** (1 / 3)), apart=True).select("id", "distance")


def sphere_nearest(queries: DataFrame, cores: DataFrame, degrees: float) -> DataFrame:
    """id, angle (degrees, null beyond ``degrees``) and weight: a smooth step from 1 at a core to 0 at the limit.

    Directions (id, x, y, z) have length 1; angles follow from chords, so longitude needs no wrapping.
    """
    import math

    chord = 2 * math.sin(math.radians(degrees) / 2)
    near = _pairs(queries, cores, chord, False).where(F.col("distance") <= chord * (1 + 1e-12)).groupBy("id").agg(F.min("distance").alias("d"))
    angle = F.when(F.col("d").isNotNull(), F.degrees(2 * F.asin(F.least(F.lit(1.0), F.col("d") / 2))))
    t = F.least(F.lit(1.0), F.col("angle") / degrees)
    return queries.select("id").join(near, "id", "left").withColumn("angle", angle).select("id", "angle", F.coalesce(1 - t * t * (3 - 2 * t), F.lit(0.0)).alias("weight"))


BLOCK = 1024


def _blocks(points: DataFrame, name: str) -> DataFrame:
    """Blocks of up to ``BLOCK`` points (x, z and others) that are near each other: ``name``_block, _n, _x0, _x1, _z0, _z1 and the points as structs.

    Points are cut in the order of a curve through a grid. A block with a coordinate that isn't finite has no bounds.
    """
    r = points.agg(*(f(c) for c in "xz" for f in (F.min, F.max)), F.count(F.lit(1))).first()
    side = max((float(r[i + 1] - r[i]) for i in (0, 2) if r[i] is not None), default=0.0) or 1.0
    at = [F.least(F.lit(65535), F.floor((F.col(c) - F.lit(r[i])) / side * 65536)).cast("long") for c, i in (("x", 0), ("z", 2))]
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1))
    curve = sum((F.shiftleft(bit(c, k), 2 * k + i) for k in range(16) for i, c in enumerate(at)), F.lit(0).cast("long"))
    kind = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in points.schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def packed(t):
            rows = t.combine_chunks().to_batches()[0]
            bounds = [f(np.asarray(rows.column(c))) for c in "xz" for f in (np.min, np.max)]
            if not np.isfinite(bounds).all():
                bounds = [-np.inf, np.inf] * 2
            own = pa.StructArray.from_arrays(rows.columns, names=rows.schema.names)
            own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64()), *(pa.array([float(b)]) for b in bounds), own], [f"{name}_{c}" for c in ("n", "x0", "x1", "z0", "z1")] + [name])

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= BLOCK:
                yield packed(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
        if held is not None and held.num_rows:
            yield packed(held)

    parts = max(1, min(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), r[4] // (16 * BLOCK)))
    rows = points.withColumn("_at", curve).repartitionByRange(parts, "_at").sortWithinPartitions("_at").drop("_at")
    out = rows.mapInArrow(run, f"{name}_n long, {name}_x0 double, {name}_x1 double, {name}_z0 double, {name}_z1 double, {name} array<struct<{kind}>>")
    return checkpointed(out.withColumn(f"{name}_block", F.monotonically_increasing_id()))


def nearest_stations(queries: DataFrame, stations: DataFrame, k: int, epsilon: float = 128 * 2.220446049250313e-16) -> DataFrame:
    """id, far_height and stations: the greatest height of the k nearest stations (x, y, z) by horizontal distance, and how many they are.

    All stations within the k-th distance and a relative epsilon count. y points down, so height is -y. Ids of queries are distinct;
    rows without a place are left out.

    Blocks of queries meet the blocks of stations that can have one of the k nearest: by the bounds of blocks, there are k stations
    within some distance of all its queries, and blocks that begin beyond that aren't looked at. A query keeps its nearest distances
    only, each with a count and the greatest height, while its task goes from block to block; no pair is shuffled.
    """
    q = _blocks(queries.select("id", "x", "z").where("x IS NOT NULL AND z IS NOT NULL"), "q")
    s = _blocks(stations.select("x", "y", "z").where("x IS NOT NULL AND z IS NOT NULL"), "s")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"s_{c}0") - F.col(f"q_{c}1"), F.col(f"q_{c}0") - F.col(f"s_{c}1"))
    reach = lambda c: F.greatest(F.col(f"s_{c}1") - F.col(f"q_{c}0"), F.col(f"q_{c}1") - F.col(f"s_{c}0"))
    apart = lambda f: F.sqrt(f("x") * f("x") + f("z") * f("z"))
    met = q.drop("q").hint("shuffle_replicate_nl").crossJoin(s.drop("s")).withColumns({"near": apart(gap), "far": apart(reach)})
    enough = F.sum("s_n").over(Window.partitionBy("q_block").orderBy("far")) >= k
    cut = F.min(F.when(F.col("_enough"), F.col("far"))).over(Window.partitionBy("q_block"))
    kept = met.withColumn("_enough", enough).withColumn("_cut", cut).where("_cut IS NULL OR near <= _cut * (1 + 1e-9) + 1e-300").select("q_block", "s_block", "near")
    rows = kept.join(s.select("s_block", "s"), "s_block").join(q.select("q_block", "q"), "q_block").repartition("q_block").sortWithinPartitions("q_block", "near")
    slack = 1 + epsilon

    def run(batches):
        import numpy as np
        import pyarrow as pa

        numbers = lambda v, c: v.field(c).to_numpy(zero_copy_only=False).astype(float)

        def meet(own, v):
            """Add one more block of stations to the kept query indices, distances, counts and heights."""
            x, z, cut = own["x"], own["z"], own["cut"]
            height = 0.0 - numbers(v, "y")
            dx, dz = numbers(v, "x")[None, :] - x[:, None], numbers(v, "z")[None, :] - z[:, None]
            d = np.sqrt(dx * dx + dz * dz)
            d[np.isnan(d)] = np.inf
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.inf)
            row, at = np.nonzero(d <= (np.minimum(cut, kth) * slack)[:, None])
            i, far, n, h = (np.concatenate(c) for c in zip(own["held"], (row, d[row, at], np.ones(len(row), np.int64), height[at])))
            order = np.lexsort((far, i))
            i, far, n, h = (c[order] for c in (i, far, n, h))
            first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (far[1:] != far[:-1])][: len(i)])
            if len(first):
                i, far, n, h = i[first], far[first], np.add.reduceat(n, first), np.fmax.reduceat(h, first)
                before = np.cumsum(n) - n
                full = before + n - before[np.searchsorted(i, i)] >= k
                # Of a query's distances that have k stations within them the least is set last.
                cut[i[full][::-1]] = far[full][::-1]
                keep = far <= cut[i] * slack
                own["held"] = i[keep], far[keep], n[keep], h[keep]

        def result(own):
            i, _, n, h = own["held"]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            columns = [own["ids"].take(pa.array(i[first])), pa.array(np.fmax.reduceat(h, first), from_pandas=True), pa.array(np.add.reduceat(n, first))]
            return pa.RecordBatch.from_arrays(columns, ["id", "far_height", "stations"])

        block, own = None, None
        with np.errstate(all="ignore"):
            for b in batches:
                for r in range(b.num_rows):
                    if own is None or b.column("q_block")[r].as_py() != block:
                        if own is not None:
                            yield result(own)
                        block, v = b.column("q_block")[r].as_py(), b.column("q")[r].values
                        none = np.zeros(0, np.int64)
                        own = {"ids": v.field("id"), "x": numbers(v, "x"), "z": numbers(v, "z"), "held": (none, np.zeros(0), none, np.zeros(0)), "cut": np.full(len(v), np.inf)}
                    meet(own, b.column("s")[r].values)
        if own is not None:
            yield result(own)

    return rows.select("q_block", "q", "s").mapInArrow(run, f"id {queries.schema['id'].dataType.simpleString()}, far_height double, stations long")
