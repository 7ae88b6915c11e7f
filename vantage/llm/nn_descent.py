"""Embedding near-duplicates by NN-descent.

A first neighbour graph comes from random hyperplanes: vectors of one code are compared in chunks of bounded
size, under several tables of hyperplanes. Rounds then join each vector's neighbours with their neighbours and
keep the best. Edges at the threshold make components. A vector's list is limited, and in a dense group it is
saturated; so components with saturated lists are compared with one another, in tiles of bounded size whose
centres and radii say which tiles can hold a link, and lists are enlarged to the whole component, in tiles too,
which gives exact counts.
The number of tables follows from the number of vectors and the threshold, and rounds go on until the links of
unsaturated lists stay the same. An audit of a bounded sample against all vectors measures recall vector by
vector, apart for few and many links; the search goes on with more tables while either is too low, and at last
all vectors are compared exactly, block by block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored
from .components import components

#: Vectors compared with one another at once.
CHUNK = 512
#: Points of a block where blocks are compared.
BLOCK = 2048


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column whose lists have one length."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(flat)
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, v (the vector as doubles, -0.0 as 0.0) and key (a fingerprint of 128 bits), null where there is no usable vector."""
    wide = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0)
    v = F.when(F.coalesce(usable, F.lit(False)), F.transform(wide, lambda x: x + 0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("key", F.when(F.col("v").isNotNull(), F.concat_ws("/", *(F.xxhash64(F.lit(seed), "v").cast("string") for seed in (1, 2)))))


def classes(keyed: DataFrame) -> DataFrame:
    """id, key, vec_id (the smallest), n (copies), size and unit (the vector at length 1) of each distinct usable vector.

    Ids are numbers of their own, so the result is to be stored before it is used.
    """
    one = keyed.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    # Length 1 by way of the largest component, lest squares overflow or vanish.
    top = one.withColumn("top", F.array_max(F.transform("v", lambda x: F.abs(x)))).withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("v", lambda x: x / F.col("norm"))
    return top.withColumn("norm", norm).select(F.monotonically_increasing_id().alias("id"), "key", "vec_id", "n", F.size("v").alias("size"), unit.alias("unit"))


def _best(lists: DataFrame, k: int) -> DataFrame:
    """id and near (the k best of all lists, each neighbour once) from rows id, near."""
    every = F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), asc=False)
    return lists.groupBy("id").agg(F.slice(every, 1, k).alias("near"))


_NEAR = "array<struct<sim:int,id:long>>"


def _millionths(sims: np.ndarray, threshold: float) -> np.ndarray:
    """Similarities as whole millionths, on the same side of the threshold as before."""
    out, at = np.rint(sims * 1e6).astype(np.int32), round(threshold * 1e6)
    return np.where(sims >= threshold, np.maximum(out, at), np.minimum(out, at - 1)).astype(np.int32)


def _near(ids: np.ndarray, sims: np.ndarray, k: int, threshold: float):
    """For each row of a similarity matrix its k best as (similarity in millionths, id)."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    sims = _millionths(sims, threshold)
    return [[{"sim": int(sims[i, j]), "id": int(ids[j])} for j in row] for i, row in enumerate(top)]


def _first(units: DataFrame, tables: range, bits: int, k: int, threshold: float, floor: float) -> DataFrame:
    """Neighbour lists (id, near) from hyperplane codes; only neighbours from ``floor`` on."""

    def code(batches):
        import pyarrow as pa

        for b in batches:
            ids, sizes = b.column("id").to_numpy(zero_copy_only=False), b.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _matrix(b.column("unit").take(pa.array(at)))
                for t in tables:
                    planes = np.random.default_rng((t, int(size))).standard_normal((int(size), max(bits, 1)))
                    codes = ((x @ planes > 0) << np.arange(max(bits, 1))).sum(axis=1) if bits else np.zeros(len(x), np.int64)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * n, pa.int32()), pa.array([size] * n, pa.int32()), pa.array(codes, pa.int64()), pa.array(ids[at], pa.int64())], ["t", "size", "code", "id"])

    def compare(table):
        import pyarrow as pa

        ids, x = table.column("id").to_numpy(), _matrix(table.column("unit"))
        out = [] if len(ids) < 2 else _near(ids, x @ x.T, k, threshold)
        rows = [(int(i), near) for i, row in zip(ids, out) if (near := [y for y in row if y["sim"] >= floor * 1e6])]
        kind = pa.list_(pa.struct([("sim", pa.int32()), ("id", pa.int64())]))
        return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "near": pa.array([r[1] for r in rows], kind)})

    coded = stored(units.select("id", "size", "unit").mapInArrow(code, "t int, size int, code long, id long"), "codes")
    counts = coded.groupBy("t", "size", "code").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = coded.join(counts, ["t", "size", "code"]).withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("m") / CHUNK)))
    full = dealt.join(units.select("id", "unit"), "id").select("t", "size", "code", "salt", "id", "unit")
    return full.groupBy("t", "size", "code", "salt").applyInArrow(compare, f"id long, near {_NEAR}")


def _refined(graph: DataFrame, units: DataFrame, k: int, threshold: float) -> DataFrame:
    """One round: neighbours of neighbours are compared, and the k best of old and new kept.

    Neighbours are those of a vector's list and the k best of those whose lists hold it.
    """
    forward = graph.select("id", F.explode("near").alias("x"))
    # A hub is in very many lists; parts of them are ranked first, then the k best of each part.
    part = forward.groupBy(F.col("x.id").alias("to"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col("x.sim").alias("sim"), F.col("id"))), asc=False).alias("own"))
    back = _best(part.select(F.col("to").alias("id"), F.slice("own", 1, k).alias("near")), k)
    both = graph.unionAll(back).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near.id"))).alias("all"))
    both = stored(both, "both")
    edges = both.select("id", F.explode("all").alias("via"))
    hops = edges.join(both.withColumnRenamed("id", "via"), "via").select("id", F.explode("all").alias("to"))
    held = graph.select("id", F.explode("near.id").alias("to"))
    new = hops.where("id <> to").distinct().join(held, ["id", "to"], "left_anti")

    def compare(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                sims = _millionths((_matrix(b.column("a")) * _matrix(b.column("b"))).sum(axis=1), threshold)
                one = pa.StructArray.from_arrays([pa.array(sims), b.column("to").cast(pa.int64())], ["sim", "id"])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1), pa.int32()), one)], ["id", "near"])

    both = new.join(units.select("id", F.col("unit").alias("a")), "id").join(units.select(F.col("id").alias("to"), F.col("unit").alias("b")), "to")
    return _best(graph.unionAll(both.select("id", "to", "a", "b").mapInArrow(compare, f"id long, near {_NEAR}")), k)


def _close(points: DataFrame, threshold: float) -> DataFrame:
    """a and b of the points (id, component, size, unit, radius) of different components that hold a link or may.

    Points of radius 0 are vectors, and compared exactly; others stand for the vectors within that angle. All
    points are compared, block by block.
    """
    blocks = max(1, math.ceil(points.count() / BLOCK))
    own = points.withColumn("own", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(blocks)).cast("int"))
    first = own.select("*", F.lit(0).alias("side"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("j"))
    second = own.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    angle = math.acos(max(-1.0, min(1.0, threshold)))

    def compare(table):
        import pyarrow as pa

        side, ids, group, radius = (table.column(c).to_numpy() for c in ("side", "id", "component", "radius"))
        x = _matrix(table.column("unit"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        both = radius[a][:, None] + radius[b][None, :]
        least = np.where(both == 0, threshold, np.cos(np.minimum(angle + both, np.pi)))
        hit = (x[a] @ x[b].T >= least) & (group[a][:, None] != group[b][None, :])
        if len(a) and table.column("i")[0] == table.column("j")[0]:
            hit &= ids[a][:, None] < ids[b][None, :]
        i, j = np.nonzero(hit)
        return pa.table({"a": pa.array(ids[a[i]], pa.int64()), "b": pa.array(ids[b[j]], pa.int64())})

    return first.unionAll(second).select("size", "i", "j", "side", "id", "component", "radius", "unit").groupBy("size", "i", "j").applyInArrow(compare, "a long, b long")


def _across(graph: DataFrame, members: DataFrame, units: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links (a, b) between the components that hold saturated lists, at least one for two components with a link.

    A list of k neighbours at the threshold may leave out further ones, hence all links to another component.
    """
    full = graph.where((F.size("near") >= k) & (F.element_at("near", k)["sim"] >= round(threshold * 1e6))).select("id")
    own = members.join(members.join(full, "id", "left_semi").select("component").distinct(), "component", "left_semi")
    tiles = own.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("tiles"))
    own = own.join(tiles, "component").withColumn("piece", F.pmod(F.xxhash64("id", F.lit(7)), F.col("tiles")))
    named = own.groupBy("component", "piece").agg(F.min("id").alias("tile"))
    tiled = stored(own.join(named, ["component", "piece"]).join(units.select("id", "size", "unit"), "id").select("tile", "component", "id", "size", "unit"), "tiled")

    def centre(table):
        import pyarrow as pa

        x = _matrix(table.column("unit"))
        mean = x.mean(axis=0)
        norm = np.linalg.norm(mean)
        c = mean / norm if norm > 1e-6 else x[0]
        # The angle by its chord, which is exact for small ones too.
        far = 2 * np.arcsin(np.minimum(np.linalg.norm(x - c, axis=1).max() / 2, 1.0)) + 1e-6
        return pa.table({"id": table.column("tile")[:1], "component": table.column("component")[:1], "size": table.column("size")[:1], "unit": pa.array([c.tolist()], pa.list_(pa.float64())), "radius": pa.array([far])})

    centres = stored(tiled.groupBy("tile").applyInArrow(centre, "id long, component long, size int, unit array<double>, radius double"), "centres")
    pairs = stored(_close(centres, threshold), "pairs")

    def link(table):
        import pyarrow as pa

        side, ids, x = table.column("side").to_numpy(), table.column("id").to_numpy(), _matrix(table.column("unit"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero(x[a] @ x[b].T >= threshold)
        return pa.table({"a": pa.array(ids[a[i[:1]]], pa.int64()), "b": pa.array(ids[b[j[:1]]], pa.int64())})

    sides = [pairs.join(tiled, F.col(c) == F.col("tile")).select("a", "b", F.lit(n).alias("side"), "id", "unit") for n, c in enumerate("ab")]
    return sides[0].unionAll(sides[1]).groupBy("a", "b").applyInArrow(link, "a long, b long")


def _counts(members: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """id, linked (copies of the other classes at the threshold) and links (those classes) within each component, in tiles."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("tiles"))
    own = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    placed = own.select("component", "id", F.lit(0).alias("side"), F.col("own").alias("i"), every.alias("j"))
    placed = placed.unionAll(own.select("component", "id", F.lit(1).alias("side"), every.alias("i"), F.col("own").alias("j")))

    def count(table):
        import pyarrow as pa

        side, ids, n = (table.column(c).to_numpy() for c in ("side", "id", "n"))
        x = _matrix(table.column("unit"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
        return pa.table({"id": pa.array(ids[a], pa.int64()), "linked": pa.array(near @ n[b].astype(np.int64), pa.int64()), "links": pa.array(near.sum(axis=1), pa.int64())})

    full = placed.join(units.select("id", "n", "unit"), "id").select("component", "i", "j", "side", "id", "n", "unit")
    return full.groupBy("component", "i", "j").applyInArrow(count, "id long, linked long, links long").groupBy("id").agg(F.sum("linked").alias("linked"), F.sum("links").alias("links"))


def _audit(units: DataFrame, sample: int, threshold: float) -> list[tuple[int, int]]:
    """Of at most ``sample`` classes, first in hash order: id and the number of classes at the threshold, by brute force."""
    asked = units.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "size", "unit").collect()
    ids = np.array([r.id for r in asked])
    by_size = {s: (np.array([i for i, r in enumerate(asked) if r["size"] == s]), np.array([r.unit for r in asked if r["size"] == s])) for s in {r["size"] for r in asked}}

    def count(batches):
        import pyarrow as pa

        total = np.zeros(len(ids), np.int64)
        for b in batches:
            own, sizes = b.column("id").to_numpy(zero_copy_only=False), b.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                if size in by_size:
                    at = np.flatnonzero(sizes == size)
                    rows, q = by_size[size]
                    total[rows] += ((q @ _matrix(b.column("unit").take(pa.array(at))).T >= threshold + 1e-12) & (ids[rows][:, None] != own[at][None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["id", "links"])

    found = units.select("id", "size", "unit").mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    return [(r.id, r.links) for r in found.collect()] if asked else []


def _tables(bits: int, threshold: float, recall: float, least: int) -> int:
    """Tables in which a pair at the threshold shares a code with probability ``recall``; ``least`` at least."""
    alike = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    if alike >= 1 or recall <= 0:
        return least
    if alike <= 0 or recall >= 1:
        return 1 << 30
    return max(least, min(1 << 30, math.ceil(math.log(1 - recall) / math.log1p(-alike))))


def _mark(graph: DataFrame, k: int, threshold: float) -> tuple:
    """What changes with the links of unsaturated lists; saturated ones are compared in tiles anyway."""
    at = round(threshold * 1e6)
    near = F.filter("near", lambda x: x["sim"] >= at)
    held = graph.select("id", near.alias("near")).where(F.size("near").between(1, k - 1))
    return tuple(held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "near").cast("decimal(38,0)"))).first())


def _recalled(truth: DataFrame, counts: DataFrame, k: int) -> float:
    """The lower of the mean recalls of audited classes with fewer than ``k`` links and of the others; 1 without any."""
    each = truth.where("links > 0").join(counts.select("id", F.col("links").alias("have")), "id", "left")
    mean = each.groupBy((F.col("links") < k).alias("few")).agg(F.avg(F.least(F.lit(1.0), F.coalesce("have", F.lit(0)) / F.col("links"))).alias("mean"))
    return min((r["mean"] for r in mean.collect()), default=1.0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, k: int = 10, tables: int = 16, rounds: int = 2, sample: int = 256, recall: float = 0.999) -> DataFrame:
    """Near-duplicate groups of ``vectors`` (vec_id, embedding) by cosine.

    Returns vec_id, n_links (other rows linked directly), component_id (the smallest vec_id reachable, itself
    included), kept (vec_id = component_id) and recall (what the audit measured, 1 where all vectors were compared) of
    each row. Vectors that are null, empty or zero, or hold null or non-finite components, are linked with nothing;
    vectors of different lengths are not linked. Equal vectors are one class and linked. Rows that share a vec_id are
    judged by their own vector each. A row without a vec_id links like others, gets its group's id (null if no row of
    it has one), and is never kept. Other columns are ignored; an empty table gives an empty one.
    """
    keyed = _keyed(vectors)
    named = stored(classes(keyed), "units")
    units = named.select("id", "n", "size", "unit")
    total = units.count()
    bits = max(0, math.ceil(math.log2(max(total, 1) / 64)))
    # Neighbours that are far from the threshold seldom lead to any at it; the audit measures what that costs.
    floor = threshold - 0.35 if threshold > 0 else -1.0
    step, most = _tables(bits, threshold, recall, tables), 8 * tables
    truth, seen, graph, measured = None, 0, None, 1.0
    # Where codes of any bounded number of tables miss too many pairs, only the exact comparison is left.
    whole = step > most
    step = min(step, most)
    while True:
        lists = _first(units, range(seen, seen + step), bits, k, threshold, floor)
        graph = stored(_best(lists if graph is None else graph.unionAll(lists), k), "graph")
        done, mark = 0, None
        while done < rounds or mark != (mark := _mark(graph, k, threshold)):
            graph = stored(_refined(graph, units, k, threshold), "graph")
            done += 1
        seen, step = seen + step, tables
        edges = graph.select("id", F.explode("near").alias("x")).where(F.col("x.sim") >= round(threshold * 1e6))
        links = edges.select(F.col("id").alias("a"), F.col("x.id").alias("b"))
        members = stored(components(links), "members")
        across = stored(_across(graph, members, units, k, threshold), "across")
        if not across.isEmpty():
            links = links.unionAll(across)
            members = stored(components(links), "members")
        if not whole:
            counts = stored(_counts(members, units, threshold), "counts")
            if truth is None:
                truth = stored(vectors.sparkSession.createDataFrame(_audit(units, sample, threshold), "id long, links long"), "truth")
            measured = _recalled(truth, counts, k)
            if measured >= recall:
                break
            whole = seen >= most
        if whole:
            points = units.join(members, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "size", "unit", F.lit(0.0).alias("radius"))
            members = stored(components(links.unionAll(_close(points, threshold))), "members")
            counts, measured = stored(_counts(members, units, threshold), "counts"), 1.0
            break
    own = named.select("id", "key", "n", "vec_id").join(counts.select("id", "linked"), "id", "left").join(members, "id", "left")
    own = stored(own.select("key", "n", "linked", "vec_id", F.coalesce("component", "id").alias("group")), "own")
    least = own.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    own = skew_join(own, least, "group").select("key", "n", "linked", "component_id")
    out = skew_join(keyed.select("key", "vec_id"), own, "key", "left")
    usable = F.col("n").isNotNull()
    whole = F.when(usable, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.when(usable, F.coalesce("linked", F.lit(0)) + F.col("n") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        whole.alias("component_id"), F.coalesce(F.col("vec_id") == whole, F.lit(False)).alias("kept"), F.lit(float(measured)).alias("recall"),
    )
