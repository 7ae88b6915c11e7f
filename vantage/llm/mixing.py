"""Mixing sources to target weights: copies of documents by pivotal dependent rounding.

Every document of a source should be taken target / size times. The whole part is taken outright; the
fraction is rounded by the pivotal method: two documents pass probability mass, weighed by their words, between
them at random until one of them is decided, and the other goes on to meet the next. Chunks of documents of one
source do so side by side, each leaving one undecided document; those meet in a tree of further chunks, so that
the words taken stay near the target without gathering a source in one task. The last document of a source is drawn
by what is left of its probability. What that is off the target is passed on once more, as whole documents in random
order: out where there is too much, in where there is too little. As both happen with the chances that cancel the
draw, expectations are kept (tests measure them), and the source comes as near its target as whole documents allow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """key, source_size and target for each key of ``sizes`` (key, size), a row a document.

    Sources in the order of their keys get ``weights`` in turn and share ``share`` times all sizes; a target
    ends at ``cap`` times its source's size, and what is over is shared again by weight. With the sources in
    the order of cap / weight this is a running sum: the first ones end at their caps, and all others get one
    multiple of their weights. Only a row a source is gathered for it.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "key")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("all", share * F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    per = per.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # A source ends at its cap if the level is above it; from the first one that doesn't, the level stays.
    free = F.col("most") >= F.col("level") * F.col("weight")
    level = F.min(F.when(free, F.struct(F.col("most") / F.col("weight"), F.col("key"), F.col("level")))).over(every)
    target = F.least(F.col("most"), F.coalesce(level["level"], F.lit(float("inf"))) * F.col("weight"))
    return per.select("key", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def unit(seed: int, *values: int) -> float:
    """A number in [0, 1) that depends on the values only."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(repr(values).encode(), seed) >> 11) / (1 << 53)


def pivotal(keys: list[int], sizes: list[int], p: list[float], seed: int) -> tuple[list[int], int]:
    """Round probabilities by meeting one after the other: decisions (-1: undecided) and the undecided index.

    Two that meet pass words, not counts: one gains what the other loses, until one is in or out; the way is
    drawn so that each keeps its expectation. So the expected words of all are kept but for the undecided one,
    whose index is -1 where none is left; its probability is in ``p``. Items of no size are drawn on their own.
    """
    out, held = [-1] * len(p), -1
    for i, q in enumerate(p):
        if q <= 1e-9 or q >= 1 - 1e-9:
            out[i] = int(q > 0.5)
        elif not sizes[i]:
            out[i] = int(unit(seed, keys[i]) < q)
        elif held < 0:
            held = i
        else:
            a, b = sizes[held], sizes[i]
            gain, loss = min((1 - p[held]) * a, q * b), min(p[held] * a, (1 - q) * b)
            moved = gain if unit(seed, keys[held], keys[i]) * (gain + loss) < loss else -loss
            p[held] += moved / a
            p[i] -= moved / b
            own = [held, i]
            held = -1
            for j in own:
                if p[j] <= 1e-9 or p[j] >= 1 - 1e-9:
                    out[j] = int(p[j] > 0.5)
                else:
                    held = j
    return out, held


def settle(sizes: list[int], out: list[int], over: float, order: list[int]) -> None:
    """Pass ``over`` words too many (or, below 0, too few) on to decided documents, in the given order, while that brings them nearer."""
    for i in order:
        change = -sizes[i] if out[i] else sizes[i]
        if abs(over + change) < abs(over):
            out[i] = 1 - out[i]
            over += change


_KEPT = "doc_id long, row long, times long, size long, key string, copies long, rest double"


def _meet(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Meetings within each group of ``keys``; ``rest`` is what is undecided, null once it is decided.

    Where a group is all that is left of a source (``whole``), its last document is drawn too, and :func:`settle` follows.
    """

    def run(pdf):
        pdf = pdf.sort_values(["size", "row", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p, ids, sizes = pdf["rest"].tolist(), pdf["row"].tolist(), pdf["size"].tolist()
        fixed = [q <= 1e-9 for q in p]
        out, held = pivotal(ids, sizes, p, seed)
        if held >= 0 and pdf["whole"].iloc[0]:
            out[held] = int(unit(seed, ids[held]) < p[held])
            order = [i for i in sorted(range(len(ids)), key=lambda i: unit(seed, ids[i], 1)) if i != held and not fixed[i]]
            settle(sizes, out, (out[held] - p[held]) * sizes[held], order)
            held = -1
        pdf["copies"] = [c + max(0, o) for c, o in zip(pdf["copies"].tolist(), out)]
        pdf["rest"] = [p[i] if i == held else None for i in range(len(p))]
        pdf["rest"] = pdf["rest"].astype("float64")
        return pdf[["doc_id", "row", "times", "size", "key", "copies", "rest"]]

    # Dealt by all keys, even where a join has dealt the rows by some of them.
    return rows.repartition(*keys).groupBy(*keys).applyInPandas(run, _KEPT).withColumn("rest", F.when(F.isnan("rest"), F.lit(None)).otherwise(F.col("rest")))


def row_key(columns: tuple[str, ...]) -> Column:
    """A fingerprint of the columns that tells nulls from values."""
    return F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, seed: int = 17, chunk: int = 2_000, by: tuple[str, ...] = ("doc_id", "text", "source")) -> DataFrame:
    """How often each document is taken.

    Returns doc_id, row (:func:`row_key` of ``by``), times (rows that are equal in ``by``), size (words; null text: 0), source_size, target and
    copies (of all equal rows together), one row for equal rows. Of ``times`` equal rows, times * target / source_size
    copies are taken, rounded up or down by the pivotal method; no row is taken more than ``cap`` times, rounded up.
    Sources go in code point order, a null one last. Documents of size 0 are rounded like others and take nothing; a
    source of size 0 has target 0. Reruns agree, as all randomness comes from ``seed`` and row hashes. An empty
    table gives an empty table; other columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(by).alias("row"), key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = stored(rows.groupBy("doc_id", "row", "key", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    per = stored(targets(rows.select("key", (F.col("size") * F.col("times")).alias("size")), share, cap, weights), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    open_ = rows.join(per, "key").withColumn("ratio", ratio * F.col("times")).withColumn("copies", F.floor(F.col("ratio") + 1e-9).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("ratio") - F.col("copies")))
    counts = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    for level in range(max(0, math.ceil(math.log(max(most, 1), chunk)))):
        counts = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        salted = open_.join(counts, "key").withColumn("salt", F.pmod(F.xxhash64("row", F.lit(level)), F.ceil(F.col("n") / chunk)))
        met = stored(_meet(salted.select("doc_id", "row", "times", "size", "key", "copies", "rest", "salt", (F.col("n") <= chunk).alias("whole")), ["key", "salt"], seed), f"met{level}")
        done.append(met.where(F.col("rest").isNull()))
        open_ = met.where(F.col("rest").isNotNull())
    done.append(_meet(open_.select("doc_id", "row", "times", "size", "key", "copies", "rest", F.lit(True).alias("whole")), ["key"], seed))
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out.join(per, "key").select("doc_id", "row", "times", "size", "source_size", "target", "copies")


def shared_out(copies: Column, times: Column) -> Column:
    """How often each of ``times`` equal rows is taken, as an array whose sum is ``copies``."""
    low = F.floor(copies / times).cast("long")
    return F.transform(F.sequence(F.lit(1).cast("long"), times), lambda i: low + F.when(i <= copies - low * times, F.lit(1)).otherwise(F.lit(0)))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each row that :func:`mix` was given."""
    each = mixed.select("doc_id", "size", "source_size", "target", F.explode(shared_out(F.col("copies"), F.col("times"))).alias("copies"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
