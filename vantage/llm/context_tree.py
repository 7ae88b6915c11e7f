"""Context-tree weighting of bytes: code lengths that mix Krichevsky-Trofimov estimates over all depths.

A byte is eight binary decisions, each with its own tree over the preceding bytes (up to ``DEPTH``). A node's
block probability weighs its own KT estimate against the product over its children, so that the weights of all
depths follow from the counts alone. The trees are learned from training texts and then fixed: the
probability of a byte depends only on it and its context, and is worked out once for each distinct gram of
context and byte.

Texts are dealt into blocks. A block sends its distinct grams with their training counts to buckets, by the
two bytes before the predicted one; a bucket thus holds whole subtrees. The top of the trees, of bounded size
(256 contexts of 255 nodes), is summed over all buckets; then buckets answer blocks with the probabilities
of their grams. Word counts for the base score travel the same way.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, block_count, blocked, by_bucket, multiplied, pack_array, pack_sorted, pack_words, squeezed, stored, trimmed, unpack_array, unpack_sorted, unpack_words, whole_texts

DEPTH = 5
#: The mark before and after a text; no UTF-8 text holds this byte.
EDGE = 255


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    n = range(1 << 16)
    return np.array([math.lgamma(x + 0.5) for x in n]), np.array([math.lgamma(x + 1.0) for x in n])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """lgamma(n + 1/2) or lgamma(n + 1) of whole numbers."""
    table = _tables()[not half]
    out = table[np.minimum(n, len(table) - 1)]
    big = n >= len(table)
    if big.any():
        x = n[big] + (0.5 if half else 1.0)
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of the KT block probability of so many zeros and ones."""
    return _log_gamma(zeros, True) + _log_gamma(ones, True) - _log_gamma(zeros + ones, False) - math.log(math.pi)


def weighted(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of a node's block probability from its estimate and its children's sum, and the weight of the estimate in it."""
    less = np.exp(-np.abs(kt - children))
    part = 1 / (1 + less)
    return math.log(0.5) + np.maximum(kt, children) + np.log(1 + less), np.where(kt >= children, part, less * part)


def _estimates(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Each node's probability of a zero, then of a one."""
    return (np.stack([zeros, ones], axis=1) + 0.5).ravel() / np.repeat(zeros + ones + 1, 2)


class Trees:
    """Nodes of depths 2 to DEPTH over grams (sorted distinct keys) with training counts.

    A key holds the context's bytes, the nearest one first, and then the byte. For each depth and bit there are
    each gram's node, the nodes' counts, and the weight of the node's own estimate.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.to, self.node, self.zeros, self.ones, self.log_p, self.weight = {}, {}, {}, {}, {}, {}
        first = {}
        grams = keys
        for d in range(DEPTH, 1, -1):
            if d < DEPTH:
                short = (grams >> np.uint64(16)) << np.uint64(8) | grams & np.uint64(255)
                grams, self.to[d] = np.unique(short, return_inverse=True)
                counts = np.bincount(self.to[d], counts, len(grams)).astype(np.int64)
            for j in range(8):
                at = grams >> np.uint64(8 - j)
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                node = np.cumsum(new) - 1
                bit = (grams >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64)
                n = int(new.sum())
                ones = np.bincount(node, counts * bit, n).astype(np.int64)
                zeros = np.bincount(node, counts * (1 - bit), n).astype(np.int64)
                kt = log_kt(zeros, ones)
                if d < DEPTH:
                    up = node[self.to[d][first[j]]]
                    log_p, self.weight[d, j] = weighted(kt, np.bincount(up, self.log_p[d + 1, j], n))
                else:
                    log_p = kt
                self.node[d, j], self.zeros[d, j], self.ones[d, j], self.log_p[d, j] = node, zeros, ones, log_p
                first[j] = np.flatnonzero(new)
        self.keys, self.grams, self.first = keys, grams, first

    def summary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """node (nearest byte * 256 + bits so far with a leading 1), zeros, ones and the children's sum at depth 1."""
        out = []
        for j in range(8):
            g = self.grams[self.first[j]]
            node = (g >> np.uint64(16) & np.uint64(255)) * np.uint64(256) + (np.uint64(1 << j) | (g & np.uint64(255)) >> np.uint64(8 - j))
            out.append((node.astype(np.int64), self.zeros[2, j], self.ones[2, j], self.log_p[2, j]))
        node, zeros, ones, log_p = (np.concatenate(x) for x in zip(*out))
        own, to = np.unique(node, return_inverse=True)
        return own, *(np.bincount(to, x, len(own)) for x in (zeros, ones, log_p))

    def log10(self, top: tuple) -> np.ndarray:
        """log10 of the probability of each gram's byte after its context.

        A node's probability weighs its own estimate against its child's by the posterior of being a leaf; a node
        that training texts don't hold says 1/2.
        """
        # The product over a byte's bits stays far above the least double: each is at least half of one over its node's count.
        out = np.ones(len(self.keys))
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        near = (self.keys >> np.uint64(8 * DEPTH)).astype(np.int64)
        for j in range(8):
            bit = byte >> (7 - j) & 1
            at = np.arange(len(self.keys))
            p = np.full(len(at), 0.5)
            for d in range(DEPTH, 1, -1):
                if d < DEPTH:
                    at = self.to[d][at]
                node = self.node[d, j][at]
                own = _estimates(self.zeros[d, j], self.ones[d, j])[2 * node + bit]
                if d < DEPTH:
                    w = self.weight[d, j][node]
                    own = w * own + (1 - w) * p
                p = own
            prefix = 1 << j | byte >> (8 - j)
            for zeros_, ones_, weight, index in ((*top[1], near * 256 + prefix), (*top[0], prefix)):
                own = _estimates(zeros_, ones_)[2 * index + bit]
                w = weight[index]
                p = w * own + (1 - w) * p
            out *= p
        return np.log10(out)


def top_of(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple:
    """Zeros, ones and weights of the nodes of depths 0 and 1, from the sums at depth 1."""
    size = 1 << 16
    z, o, c = np.zeros(size), np.zeros(size), np.zeros(size)
    z[nodes], o[nodes], c[nodes] = zeros, ones, children

    def level(z, o, c):
        kt = log_kt(z.astype(np.int64), o.astype(np.int64))
        log_p, weight = weighted(kt, c)
        return log_p, (z, o, weight)

    log_p, one = level(z, o, c)
    log_p[z + o == 0] = 0.0
    _, zero = level(*(x.reshape(256, 256).sum(axis=0) for x in (z, o, log_p)))
    return zero, one


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all bytes and ends of lower-cased texts in order, and where each text's begin, with the end."""
    joined = b"".join(bytes([EDGE]) * DEPTH + t.lower() + bytes([EDGE]) for t in texts)
    raw = np.frombuffer(joined, np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 + DEPTH for t in texts)])
    # Eight bytes from anywhere in the reversed texts, the first one highest, are the bytes before a place, the nearest one first.
    before = np.ndarray(len(raw), ">u8", joined[::-1] + bytes(8), strides=(1,))
    key = np.zeros(len(raw), np.uint64)
    key[1:] = before[:0:-1]
    key >>= np.uint64(8 * (7 - DEPTH))
    key &= ~np.uint64(255)
    key |= raw
    keep = np.ones(len(raw), bool)
    keep[(starts[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return key[keep], starts - np.arange(len(starts)) * DEPTH


def _slots(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, by its two nearest context bytes."""
    near = keys >> np.uint64(8 * (DEPTH - 1))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def _by_slot(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that have keys, and which ones, in order."""
    slot = _slots(keys, buckets)
    order = np.argsort(slot, kind="stable")
    cut = np.flatnonzero(np.diff(slot[order], prepend=-1))
    return list(zip(slot[order[cut]].tolist(), np.split(order, cut[1:]))) if len(keys) else []


class Finder:
    """Indices in sorted distinct keys of keys that are all among them."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(8, int(8 * len(keys)).bit_length())
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[self._spot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        out = self.table[self._spot(wanted)]
        off = np.flatnonzero(self.keys[out] != wanted)
        out[off] = np.searchsorted(self.keys, wanted[off])
        return out


_SENT = "block int, bucket int, words binary, word_counts binary, grams binary, gram_counts binary"


def _block(table, buckets: int):
    """Of a block: texts, words by bucket, and how often texts train."""
    texts, words = whole_texts(table), set()
    for t in texts:
        words.update(t.lower().split())
    train = [n * t for n, t in zip(table.column("times").to_pylist(), table.column("train").to_pylist())]
    return texts, by_bucket(words, buckets), train


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, block_bytes: int = BLOCK_BYTES * 3 // 4) -> DataFrame:
    """Score ``docs`` (doc_id, text), learning from rows whose crc32(doc_id as text) mod ``folds`` isn't ``held_out``.

    Returns doc_id, held_out, n_tokens and n_known (words and the end; of those, known from training),
    train_tokens, base_score (log10 of add-one word probabilities), score (log10 of the text's probability under
    the trees, its end included) and bits_per_byte. Texts are taken with A-Z in lower case. A null text counts
    as empty: its end alone is scored. Rows without a doc_id are neither held out nor learned from. Repeated
    rows are learned from each. Other columns are ignored; an empty table gives an empty table; without any
    training row all bits have probability 1/2.
    """
    blocks = block_count(docs, block_bytes)
    buckets = blocks
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = squeezed(blocked(docs, blocks, F.coalesce(rest != held_out, F.lit(False)).alias("train"), F.coalesce(rest == held_out, F.lit(False)).alias("held_out")))

    def send(table):
        import pyarrow as pa

        texts, by, train = _block(table, buckets)
        counts: Counter = Counter()
        for t, n in zip(texts, train):
            if n == 1:
                counts.update(t.lower().split())
            elif n:
                counts.update({w: n * k for w, k in Counter(t.lower().split()).items()})
        keys, starts = grams_of(texts)
        keys <<= np.uint64(1)
        keys |= np.repeat(np.array(train) > 0, np.diff(starts))
        more = [(keys[starts[i] : starts[i + 1]] >> np.uint64(1), n - 1) for i, n in enumerate(train) if n > 1]
        keys.sort()
        both = keys
        new = np.ones(len(both), bool)
        new[1:] = both[1:] >> np.uint64(1) != both[:-1] >> np.uint64(1)
        first = np.flatnonzero(new)
        own = both[first] >> np.uint64(1)
        learned = np.add.reduceat((both & np.uint64(1)).astype(np.int64), first) if len(first) else first
        for k, n in more:
            np.add.at(learned, np.searchsorted(own, k), n)
        grams, nothing = dict(_by_slot(own, buckets)), np.zeros(0, np.int64)
        rows = []
        for k in sorted(by.keys() | grams.keys()):
            w, mine = by.get(k, []), grams.get(k, nothing)
            rows.append((k, pack_words(w), pack_array(np.array([counts[x] for x in w], np.uint32)), pack_sorted(own[mine]), pack_array(learned[mine].astype(np.uint32))))
        block = table.column("block")[0].as_py()
        ends = sum(train)
        # The number of texts that train stands in a row of its own, without words or grams.
        rows.append((buckets, b"", pack_array(np.array([ends], np.uint32)), b"", b""))
        names = ("bucket", "words", "word_counts", "grams", "gram_counts")
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.table({"block": pa.array([block] * len(rows), pa.int32())} | {n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(names, kinds))})

    sent = stored(rows.groupBy("block").applyInArrow(trimmed(send), _SENT), "grams")

    def merged_words(table):
        lists = [unpack_words(x) for x in table.column("words").to_pylist()]
        counts = [unpack_array(x, np.uint32).tolist() for x in table.column("word_counts").to_pylist()]
        total: dict = {}
        for w, c in zip(lists, counts):
            for x, n in zip(w, c):
                total[x] = total.get(x, 0) + n
        return lists, total

    def merged_grams(table):
        lists = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
        counts = np.concatenate([unpack_array(x, np.uint32) for x in table.column("gram_counts").to_pylist()]).astype(np.int64)
        keys, to = np.unique(np.concatenate(lists), return_inverse=True)
        return lists, to, keys, np.bincount(to, counts, len(keys)).astype(np.int64)

    def sums(table):
        import pyarrow as pa

        if table.column("bucket")[0].as_py() == buckets:
            ends = sum(int(unpack_array(x, np.uint32)[0]) for x in table.column("word_counts").to_pylist())
            nodes, zeros, ones, children = [-2], [ends], [0], [0.0]
        else:
            _, total = merged_words(table)
            _, _, keys, counts = merged_grams(table)
            used = counts > 0
            node, z, o, c = Trees(keys[used], counts[used]).summary()
            nodes, zeros, ones, children = [-1, *node.tolist()], [sum(total.values()), *z.tolist()], [sum(n > 0 for n in total.values()), *o.tolist()], [0.0, *c.tolist()]
        return pa.table({"node": pa.array(nodes, pa.int32()), "zeros": pa.array(map(int, zeros), pa.int64()), "ones": pa.array(map(int, ones), pa.int64()), "children": pa.array(children, pa.float64())})

    # At most 256 * 255 nodes and two rows of totals come to the driver.
    partial = sent.groupBy("bucket").applyInArrow(trimmed(sums), "node int, zeros long, ones long, children double")
    found = {r.node: (r.zeros, r.ones, r.children) for r in partial.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("children").alias("children")).collect()}
    ends = found.pop(-2, (0, 0, 0))[0]
    tokens, kinds = found.pop(-1, (0, 0, 0))[:2]
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    nodes = sorted(found)
    top = top_of(np.array(nodes, np.int64), *(np.array([found[n][i] for n in nodes], float) for i in range(3)))

    def answer(table):
        import pyarrow as pa

        lists, total = merged_words(table)
        words = [pack_array(np.array([total[w] for w in x], np.uint32)) for x in lists]
        lists, to, keys, counts = merged_grams(table)
        log10 = Trees(keys, counts).log10(top).astype(np.float32)[to]
        cuts = np.cumsum([0, *map(len, lists)])
        grams = [pack_array(log10[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "words": pa.array(words, pa.binary()), "grams": pa.array(grams, pa.binary())})

    answers = sent.where(F.col("bucket") < buckets).groupBy("bucket").applyInArrow(trimmed(answer), "block int, bucket int, words binary, grams binary")
    bottom = math.log10(tokens + kinds + 1)

    def finish(left, right):
        import pyarrow as pa

        texts, by, _ = _block(left, buckets)
        got = {k: (w, g) for k, w, g in zip(right.column("bucket").to_pylist(), right.column("words").to_pylist(), right.column("grams").to_pylist())}
        at, known = {}, [np.zeros(0, np.uint32)]
        for k, own in by.items():
            at.update(zip(own, range(len(at), len(at) + len(own))))
            known.append(unpack_array(got[k][0], np.uint32))
        known = np.concatenate(known).astype(np.float64)
        value = np.log10(known + 1) - bottom
        end = math.log10(ends + 1) - bottom
        keys, starts = grams_of(texts)
        own = np.sort(keys)
        own = own[np.append(True, own[1:] != own[:-1])]
        find = Finder(own)
        log10 = np.zeros(len(own), np.float32)
        for k, mine in _by_slot(own, buckets):
            log10[mine] = unpack_array(got[k][1], np.float32)
        scores = []
        for a in range(0, len(starts) - 1, 256):
            cut = starts[a : a + 257]
            part = log10[find(keys[cut[0] : cut[-1]])].astype(np.float64)
            scores.append(np.add.reduceat(part, cut[:-1] - cut[0]))
        scores = np.concatenate(scores)
        n, n_known, base = [], [], []
        for t in texts:
            w = t.lower().split()
            i = np.fromiter(map(at.__getitem__, w), np.int64, len(w))
            n.append(len(w) + 1)
            n_known.append(int((known[i] > 0).sum()) + (ends > 0))
            base.append(float(value[i].sum()) + end)
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": left.column("held_out"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([tokens] * len(n), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(scores, pa.float64()),
                "bits_per_byte": pa.array(-scores / np.diff(starts) / math.log10(2), pa.float64()),
                "times": left.column("times"),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double, times long"
    return multiplied(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(trimmed(finish), schema))
