"""Substring de-duplication by recompression: locally consistent symbols, then windows around shared ones.

Words are symbols. A first step names runs of two equal words, further steps name pairs: a symbol is left- or
right-handed by its name and the step, and a left-handed one merges with a right-handed neighbour on its right
unless both are too long together. A name is a fingerprint of what it stands for, so tasks agree on names
without exchanging them. Whether two neighbours merge depends on them alone; so equal passages get equal
symbols but for a margin at either end, and the limits on symbols' lengths keep both margins together shorter
than a window: every window that occurs twice has interior symbols, all of which occur twice.

Two Spark rounds use that. The first counts symbols over all blocks of documents and tells each block which of
its symbols occur once; that rules out nearly all windows without repeats. The second compares the windows
that are left, in full, by 96-bit fingerprints. Texts are dealt to blocks once; a block sends distinct symbols and
windows only, so no passage is hot however often it occurs.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, block_count, blocked, multiplied, pack, pack_sorted, squeezed, trimmed, unpack, unpack_sorted, whole_texts

# Arrays of one, whose products wrap without a warning.
_M1, _M2, _M3 = (np.array([x], np.uint64) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def limits(window: int) -> list[int]:
    """The longest merged symbol after each pair step; the first entry is for the run step, 0 without one.

    A step moves either margin by the longest symbol before it (the run step: by a run of two). Steps end
    before the margins on one side could come to half a window.
    """
    room = (window - 1) // 2 - 2
    if room < 0:
        return [0]
    out, longest = [2], 2
    while room >= longest:
        room -= longest
        longest += longest // 2
        out.append(longest)
    return out


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit fingerprint of each word of all texts, and the texts' first positions with the end."""
    import xxhash

    index: dict = {}
    parts = [np.zeros(0, np.int32)]
    for t in texts:
        words = t.split()
        for w in set(words).difference(index):
            index[w] = len(index)
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    prints = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    return prints[np.concatenate(parts)], np.cumsum([0, *map(len, parts[1:])])


class Parse:
    """The symbols of a block's texts, and each window's range of interior symbols.

    ``names`` are the last step's symbols and ``text`` their texts; the window that starts at word ``starts[i]`` has the interior
    symbols ``left[i]`` to ``right[i]`` (excluded), at least one.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, window: int):
        n = len(words)
        lens = np.diff(ends)
        count = np.maximum(lens - window + 1, 0)
        self.starts = np.repeat(ends[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        left, right = self.starts.copy(), self.starts + window
        text = np.repeat(np.arange(len(lens)), lens)
        names, length = words, np.ones(n, np.int64)
        caps = limits(window)
        if caps[0] and n:
            same = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
            run = np.cumsum(np.concatenate([[0], ~same]))
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            last = np.append(first[1:], n)
            left = np.where(last[run[left]] - left > 2, left, last[run[left]])
            right = np.where(right - first[run[right - 1]] > 2, right, first[run[right - 1]])
            pair = (last - first == 2)[run]
            head = pair & (np.arange(n) == first[run])
            keep = ~pair | head
            names = np.where(head, mixed(words * _M1 + np.uint64(2)), words)[keep]
            length = np.where(head, 2, 1)[keep]
            text = text[keep]
            index = np.append(np.cumsum(keep) - 1, keep.sum())
            left, right = index[left], index[right]
        for step, cap in enumerate(caps[1:]):
            handed = (mixed(names ^ mixed(np.uint64(step + 1) * _M1)) >> np.uint64(63)).astype(bool)  # True: right
            join = np.zeros(len(names), bool)
            join[:-1] = ~handed[:-1] & handed[1:] & (text[1:] == text[:-1]) & (length[1:] + length[:-1] <= cap)
            left = np.where(handed[np.minimum(left, len(names) - 1)], left + 1, left) if len(names) else left
            right = np.where(handed[right - 1], right, right - 1) if len(names) else right
            keep = np.ones(len(names), bool)
            keep[1:] = ~join[:-1]
            merged = names.copy()
            merged[:-1] = np.where(join[:-1], mixed(names[:-1] * _M1 + mixed(names[1:])), names[:-1])
            total = length.copy()
            total[:-1] += np.where(join[:-1], length[1:], 0)
            index = np.append(np.cumsum(keep) - 1, keep.sum())
            names, length, text = merged[keep], total[keep], text[keep]
            left, right = index[left], index[right]
        self.names, self.left, self.right, self.text = names, left, right, text


def window_keys(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (64 and 32 bits) of the windows that start at ``at``, by doubling."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    out = []
    for base, seed in ((_M1, np.uint64(1)), (_M2, np.uint64(2))):
        part, size, factor = mixed(words ^ seed * _M3), 1, base
        key, have = None, 0
        todo = window
        while todo:
            if todo & 1:
                if key is None:
                    key = part[at]
                else:
                    key = key * factor + part[at + have]
                have += size
            todo >>= 1
            if todo:
                grown = part.copy()
                grown[: len(part) - size] = part[: len(part) - size] * factor + part[size:]
                part, size, factor = grown, size * 2, factor * factor
        out.append(mixed(key))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def _canonical(table) -> tuple[list, list[bytes], np.ndarray]:
    """doc_ids, texts and times of a block's rows, in an order that is the same whenever the block is read."""
    rows = zip(table.column("doc_id").to_pylist(), whole_texts(table), table.column("times").to_pylist())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


def _distinct(keys: np.ndarray, checks: np.ndarray | None = None):
    """Sorted distinct keys, their checks, the index of each input's key among them, and which occur twice."""
    order = np.argsort(keys)
    k = keys[order]
    if checks is not None and ((k[1:] == k[:-1]) & (checks[order][1:] != checks[order][:-1])).any():
        order = np.lexsort((checks, keys))
        k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if checks is not None:
        c = checks[order]
        new[1:] |= c[1:] != c[:-1]
    group = np.cumsum(new) - 1
    inverse = np.empty(len(k), np.int64)
    inverse[order] = group
    twice = np.bincount(group, minlength=int(new.sum())) > 1
    return k[new], None if checks is None else c[new], inverse, twice


def _step(buckets: int) -> int:
    """How many values of a key's upper 32 bits a bucket has."""
    return (1 << 32) // buckets + 1


def _sent(block: int, keys: np.ndarray, checks: np.ndarray | None, twice: np.ndarray, buckets: int) -> list[tuple]:
    """Rows (block, bucket, keys, checks, twice) of distinct sorted keys; a bucket is a range of keys."""
    own = (keys >> np.uint64(32)) // np.uint64(_step(buckets))
    cut = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        out.append((block, int(own[a]), pack_sorted(keys[a:b]), b"" if checks is None else checks[a:b].tobytes(), pack(np.packbits(twice[a:b]).tobytes())))
    return out


_ROWS = "block int, bucket int, keys binary, checks binary, twice binary"


def _table(rows: list[tuple]):
    import pyarrow as pa

    names = ("block", "bucket", "keys", "checks", "twice")
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(names, kinds))})


def _merge(rows: DataFrame, buckets: int, width: int) -> DataFrame:
    """Answer each block which of its keys occur twice over all blocks; rows of other buckets pass as they are."""

    def run(table):
        if table.column("bucket")[0].as_py() >= buckets:
            return table
        blocks, bucket, keys, checks, twice = (table.column(c).to_pylist() for c in ("block", "bucket", "keys", "checks", "twice"))
        keys = [unpack_sorted(k) << np.uint64(64 - width) for k in keys]
        sizes = [len(k) for k in keys]
        checks = np.frombuffer(b"".join(checks), np.uint32) if checks[0] else None
        own = np.concatenate([np.unpackbits(np.frombuffer(unpack(t), np.uint8), count=n).astype(bool) for t, n in zip(twice, sizes)])
        _, _, inverse, more = _distinct(np.concatenate(keys), checks)
        more[inverse[own]] = True
        found = more[inverse]
        cuts = np.cumsum([0, *sizes])
        return _table([(b, k, b"", b"", pack(np.packbits(found[x:y]).tobytes())) for b, k, x, y in zip(blocks, bucket, cuts[:-1], cuts[1:])])

    return rows.groupBy("bucket").applyInArrow(trimmed(run), _ROWS)


def _flags(table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of :func:`_merge` in the order of a block's distinct keys."""
    out, high = np.zeros(len(keys), bool), keys >> np.uint64(32)
    for k, t in zip(table.column("bucket").to_pylist(), table.column("twice").to_pylist()):
        if k < buckets:
            a, b = np.searchsorted(high, np.array([k, k + 1], np.uint64) * np.uint64(_step(buckets)))
            out[a:b] = np.unpackbits(np.frombuffer(unpack(t), np.uint8), count=b - a).astype(bool)
    return out


def remove_repeats(docs: DataFrame, window: int = 35, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove each word that a repeated window covers.

    A window is ``window`` consecutive words of one text (words: runs of anything but space and 0x09-0x0D,
    compared unchanged); it is repeated if its word sequence starts anywhere else too, in the same text
    included. Windows are judged on the input, so all occurrences go. Returns doc_id, n_words, n_removed and
    kept (the words left, joined by one space) of each row. Null, empty and blank texts have no word and an
    empty ``kept``; texts shorter than a window stay; equal rows repeat each other; null doc_ids are kept;
    other columns are ignored; an empty table gives an empty table.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    blocks = block_count(docs, block_bytes)
    buckets = blocks
    # Symbols are compared by so many bits; a chance match only lets a window through to the full comparison.
    width = min(64, max(34, (blocks * block_bytes).bit_length() + 10))
    drop = np.uint64(64 - width)
    rows = squeezed(blocked(docs, blocks))

    def symbols_of(words, ends, times):
        parse = Parse(words, ends, window)
        keys, checks, inverse, twice = _distinct(parse.names >> drop << drop)
        twice[inverse[times[parse.text] > 1]] = True
        return parse, (keys, checks, inverse, twice)

    def first(table):
        _, texts, times = _canonical(table)
        words, ends = fingerprints(texts)
        _, (keys, _, _, twice) = symbols_of(words, ends, times)
        found = _sent(table.column("block")[0].as_py(), keys, None, twice, buckets)
        return _table([(b, k, pack_sorted(unpack_sorted(x) >> drop), c, t) for b, k, x, c, t in found])

    def second(left, right):
        _, texts, times = _canonical(left)
        words, ends = fingerprints(texts)
        parse, (keys, _, inverse, _) = symbols_of(words, ends, times)
        once = ~_flags(right, keys, buckets)[inverse] if len(keys) else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(once)])
        maybe = before[parse.right] == before[parse.left]
        at = parse.starts[maybe]
        block = left.column("block")[0].as_py()
        keys, checks, inverse, twice = _distinct(*window_keys(words, at, window))
        twice[inverse[times[np.searchsorted(ends, at, "right") - 1] > 1]] = True
        mask = np.zeros(len(words), bool)
        mask[at] = True
        return _table([*_sent(block, keys, checks, twice, buckets), (block, buckets + block, b"", b"", pack(np.packbits(mask).tobytes()))])

    def third(left, right):
        import pyarrow as pa

        ids, texts, times = _canonical(left)
        words, ends = fingerprints(texts)
        mask = next(t for k, t in zip(right.column("bucket").to_pylist(), right.column("twice").to_pylist()) if k >= buckets)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(unpack(mask), np.uint8), count=len(words)))
        keys, _, inverse, _ = _distinct(*window_keys(words, at, window))
        hit = at[_flags(right, keys, buckets)[inverse]] if len(at) else at
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + window, -1)
        keep = np.cumsum(change)[:-1] == 0
        kept = [b" ".join(compress(t.split(), keep[a:b].tolist())) for t, a, b in zip(texts, ends[:-1], ends[1:])]
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(np.diff(ends), pa.int64()),
                "n_removed": pa.array(gone[ends[1:]] - gone[ends[:-1]], pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "times": pa.array(times, pa.int64()),
            }
        )

    shared = _merge(rows.groupBy("block").applyInArrow(trimmed(first), _ROWS), buckets, width)
    windows = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(trimmed(second), _ROWS)
    answers = _merge(windows, buckets, 64)
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(trimmed(third), "doc_id long, n_words long, n_removed long, kept string, times long")
    return multiplied(out)
