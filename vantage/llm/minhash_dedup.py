"""MinHash near-duplicates: banded candidates, pruned by sequential Bayesian tests, verified on full sets.

Copies of one shingle set collapse into a class first. The bands of the classes' signatures make buckets. A
bucket is not paired out: its members are compared with one pivot of it, which joins most groups of copies.
Buckets whose members are not all joined then form clusters. In a cluster, the members outside its largest
joined group are compared with all its members in tiles of bounded size; a tile returns links only, and stops
comparing what it has joined. So every pair of one bucket is either joined or tested.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined, lean, skew_join, stored, text_bytes, trimmed
from .components import components

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Signature positions compared before each Bayesian test.
BATCH = 16
#: Classes on either side of a tile.
TILE = 512


@functools.lru_cache(1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1), rng.integers(0, 2**64, HASHES, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted distinct 64-bit fingerprints; words hash once per batch."""

    def __init__(self, words: int):
        self.words, self.seen = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        words = text.lower().split()
        if len(self.seen) > 1 << 17:
            self.seen.clear()
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        for w in set(words).difference(seen):
            seen[w] = digest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        k = self.words
        if len(h) == 0:
            return h
        n = max(1, len(h) - k + 1)
        out = np.full(n, min(k, len(h)), np.uint64)
        for i in range(min(k, len(h))):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of each hash function over a non-empty set, upper 32 bits."""
    a, b = _family()
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        best = np.minimum(best, (shingles[i : i + 256, None] * a + b).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different between bands."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


@functools.lru_cache(8)
def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch end n, the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while m < n and tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survives(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which pairs of signature rows pass every test; rows that failed one are not compared further."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def row_key() -> Column:
    """A fingerprint of doc_id and text (null: empty) that tells a null id from others."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.coalesce(F.col("text"), F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and row (:func:`row_key`)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row"))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row, n_shingles, digest (of the set) and sig of each row; digest and sig are null for empty sets."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        make = Shingler(words)
        for b in batches:
            sets = [make(t) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("row"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "row", "n_shingles", "digest", "sig"],
            )

    return _rows(docs).mapInArrow(lean(run), "doc_id long, row long, n_shingles long, digest binary, sig binary")


def _banded(signs: DataFrame) -> DataFrame:
    """bucket and id, a row for each band of each class."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            keys = np.concatenate([np.zeros(0, np.int64), *map(band_keys, sig)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column("id").to_numpy(zero_copy_only=False), BANDS))], ["bucket", "id"])

    return signs.select("id", "sig").mapInArrow(lean(run), "bucket long, id long")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and set (sorted fingerprints) of the classes in ``ids`` (id, row, digest), from a row of each."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        make, done = Shingler(words), set()
        for b in batches:
            # Of equal rows a task reads one.
            first = {r: i for i, r in enumerate(b.column("row").to_pylist()) if r not in done}
            done.update(first)
            sets = [make(t).tobytes() for t in text_bytes(b.column("text").take(pa.array(list(first.values()), pa.int64())))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "set"])

    rows = joined(_rows(docs), ids.select("row"), "row", "left_semi")
    return joined(rows.mapInArrow(lean(run), "digest binary, set binary"), ids.select("id", "digest"), "digest").dropDuplicates(["id"]).select("id", "set")


def _with_both(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """The pairs (p, q) as a, b with both ends' ``name``; p may be one end of very many pairs."""
    ends = [of.select(F.col("id").alias(c), F.col(name).alias(f"{name}_{to}")) for c, to in (("p", "a"), ("q", "b"))]
    both = joined(joined(pairs, ends[1], "q"), ends[0], "p")
    return both.select(F.col("p").alias("a"), F.col("q").alias("b"), f"{name}_a", f"{name}_b")


def _tested(pairs: DataFrame, signs: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (p, q) that the Bayesian tests don't prune, as a, b."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(survives(x, y, percent / 100, miss)))

    return _with_both(pairs, signs, "sig").mapInArrow(lean(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, q) whose full sets are similar enough, as a, b."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(c).to_pylist()] for c in ("set_a", "set_b"))
            keep = pa.array([similar(p, q, percent) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(keep)

    return _with_both(pairs, sets, "set").mapInArrow(lean(run), "a long, b long")


def _tile(rows: list[tuple], percent: int, miss: float) -> list[tuple[int, int]]:
    """Links that join what is similar in one tile; rows are (side, id, label, outside, sig, set).

    Side 0 holds classes outside their cluster's largest group, side 1 any classes. Pairs are compared if they
    share a band, are not joined yet, and were not compared with the sides exchanged.
    """
    sides = [sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in (0, 1)]
    if not sides[0] or not sides[1]:
        return []
    sigs = [np.array([np.frombuffer(r[4], np.uint32) for r in side]) for side in sides]
    bands = [np.array([band_keys(x) for x in sig]) for sig in sigs]
    sets = [[np.frombuffer(r[5], np.uint64) for r in side] for side in sides]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    ids = np.array([r[1] for r in sides[1]])
    outside = np.array([r[3] for r in sides[1]])
    for i, (_, x, label, _, _, _) in enumerate(sides[0]):
        near = np.flatnonzero((bands[1] == bands[0][i]).any(axis=1) & (ids != x) & ~(outside & (ids < x)))
        near = near[survives(np.broadcast_to(sigs[0][i], (len(near), HASHES)), sigs[1][near], percent / 100, miss)]
        for j in near:
            p, q = top(label), top(sides[1][j][2])
            if p != q and similar(sets[0][i], sets[1][j], percent):
                above[max(p, q)] = min(p, q)
                out.append((x, int(ids[j])))
    return out


def _tiles(live: DataFrame, signs: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) within the clusters of ``live`` (bucket, id, label)."""
    first = live.groupBy("bucket").agg(F.min("id").alias("b"))
    cluster = components(joined(live, first, "bucket").select(F.col("id").alias("a"), "b").where("a <> b").distinct())
    own = joined(live.select("id", "label").distinct(), cluster, "id")
    groups = own.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.groupBy("component").agg(F.sum("n").alias("n"), F.max(F.struct("n", F.col("label").alias("main"))).alias("largest"))
    groups = groups.select("component", "n", F.col("largest.main").alias("main"), (F.col("n") - F.col("largest.n")).alias("out"))
    own = stored(skew_join(own, groups, "component").select("component", "id", "label", (F.col("label") != F.col("main")).alias("outside"), "n", "out"), "clusters")
    chunk = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col(n) / TILE)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col(n) / TILE) - 1).cast("long")))
    rest = ["component", "id", "label", "outside"]
    placed = own.where("outside").select(*rest, F.lit(0).alias("side"), chunk("out").alias("i"), every("n").alias("j"))
    placed = placed.unionAll(own.select(*rest, F.lit(1).alias("side"), every("out").alias("i"), chunk("n").alias("j")))

    def run(table):
        import pyarrow as pa

        columns = ("side", "id", "label", "outside", "sig", "set")
        links = _tile(list(zip(*(table.column(c).to_pylist() for c in columns))), percent, miss)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    full = joined(placed, joined(signs.select("id", "sig"), sets.select("id", "set"), "id"), "id")
    return full.groupBy("component", "i", "j").applyInArrow(trimmed(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text) by word shingles.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included),
    kept (doc_id = component_id), row (:func:`row_key`) and group (a number of the group, null without a word) of
    each row. Words are runs of anything but space and 0x09-0x0D, with A-Z
    lower-cased; a text with fewer than ``words`` words is one shingle. Two rows are linked from
    100 * intersection >= percent * union on; null, empty and blank texts have no shingle and are linked with
    nothing. ``miss`` bounds each of the six tests' chance, under a uniform prior, that a pair that it prunes is
    similar enough. Equal texts are in one group whatever their number. Repeated rows, and rows that share a doc_id,
    are judged by their own text each; a row without a doc_id links like others, gets its group's id (null if no
    row of it has one) and is never kept. Other columns are ignored; an empty table gives an empty table.
    Shingles are compared as 64-bit fingerprints.
    """
    signed = stored(_signed(docs, words), "signed")
    # A class is a set of shingles; its id is a number of its own, given once and kept in a table.
    first = F.min(F.struct("row", "sig")).alias("first")
    classes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc"), first)
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "doc", "first.row", "first.sig"), "classes")
    signs = classes.select("id", "sig")
    band = _banded(signs)
    shared = band.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = stored(joined(band, shared, "bucket"), "members")
    sets = stored(_sets(docs, joined(classes.select("id", "row", "digest"), members.select("id").distinct(), "id", "left_semi"), words), "sets")

    pivot = members.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", F.lit(7))).alias("p"))
    pairs = skew_join(members, pivot, "bucket").where("id <> p").select("p", F.col("id").alias("q")).distinct()
    pairs = stored(pairs, "pairs")
    tested = stored(_tested(pairs, signs, percent, miss).select(F.col("a").alias("p"), F.col("b").alias("q")), "tested")
    links = stored(_verified(tested, sets, percent), "found")
    labels = stored(components(links), "labels")
    labelled = stored(joined(members, labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label")), "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high and n > 2")
    live = stored(skew_join(labelled, open_.select("bucket"), "bucket"), "live")
    more = stored(_tiles(live, signs, sets, percent, miss), "found")
    if not more.isEmpty():
        # Groups joined by more links: components of the groups, which are far fewer than their members.
        named = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_group"))
        between = joined(joined(more, named("a"), "a", "left"), named("b"), "b", "left").select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
        tops = stored(components(between.distinct()), "joined")
        whole = labels.select("id", F.col("component").alias("g")).unionAll(joined(tops.select("id", F.col("id").alias("g")), labels.select("id"), "id", "left_anti"))
        over = tops.select(F.col("id").alias("g"), F.col("component").alias("top"))
        labels = stored(skew_join(whole, over, "g", "left").select("id", F.coalesce("top", "g").alias("component")), "labels")

    known = stored(joined(classes, labels, "id", "left").select("digest", "doc", F.coalesce("component", "id").alias("group")), "known")
    # Nothing that is returned reads these any more.
    for table in (classes, members, sets, pairs, tested, links, labelled, live, more):
        dropped(table)
    least = known.groupBy("group").agg(F.min("doc").alias("component_id"))
    named = skew_join(known, least, "group").select("digest", "component_id", "group")
    out = skew_join(signed.select("doc_id", "n_shingles", "digest", "row"), named, "digest", "left")
    whole = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(False)).alias("kept"), "row", "group")
