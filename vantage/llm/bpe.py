"""BPE by a table of distinct words: each is encoded once, and ids are joined back by position.

Texts are dealt into blocks of bounded bytes. A block sends its distinct words, packed by bucket, to the
buckets; a bucket encodes each distinct word once whatever the number of blocks that hold it, and answers
each block with the ids in the order of the block's words. The answers meet the block's texts again, and
every position takes its word's ids. So only texts and distinct words of blocks are shuffled, and no key is
hot: a frequent word is one entry a block.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, block_count, blocked, by_bucket, multiplied, pack_array, pack_words, squeezed, trimmed, unpack_array, unpack_words, whole_texts


@functools.lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def checked(path: str) -> None:
    """ValueError unless the file encodes each word on its own and decodes by joining pieces with spaces.

    White space must be dropped between words, nothing may look across it, and there must be no decoder.
    """
    import json

    import regex

    file = json.loads(_tokenizer(path).to_str())
    steps = lambda part, many: (part or {}).get(many) or ([part] if part else [])
    normal = all(
        x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ")
        for x in steps(file.get("normalizer"), "normalizers")
    )
    first = next(iter(steps(file.get("pre_tokenizer"), "pretokenizers")), {})
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and not regex.search(first["pattern"].get("Regex", " "), " \t\n\r\v\f")
    later = all(x["type"] == "ByteLevel" and not x.get("add_prefix_space") for x in steps(file.get("pre_tokenizer"), "pretokenizers")[1:])
    added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and not any(c.isspace() for c in x["content"]) for x in file.get("added_tokens") or ())
    if file.get("decoder") or file.get("post_processor") or not (normal and dropped and later and added):
        raise ValueError("this vocabulary looks across white space or has a decoder of its own")


@functools.lru_cache(2)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table, at most as long as the vocabulary; ids without a piece are empty."""
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece.encode()
    return out


def encode_words(words: list[bytes], path: str) -> list[list[int]]:
    """Ids of each word; :func:`checked` tells whether a vocabulary can be used so."""
    found = _tokenizer(path).encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
    return [e.ids for e in found]


def _distinct(table, buckets: int) -> tuple[list[bytes], dict[int, list[bytes]]]:
    """The texts, and their distinct words by bucket; no list of all words is held."""
    texts, words = whole_texts(table), set()
    for t in texts:
        words.update(t.split())
    return texts, by_bucket(words, buckets)


def word_ids(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """For blocked rows: block, bucket, lens and ids of the block's words of that bucket, in byte order."""

    def words_of(table):
        import pyarrow as pa

        block = table.column("block")[0]
        found = _distinct(table, buckets)[1]
        return pa.table(
            {"block": pa.array([block.as_py()] * len(found), pa.int32()), "bucket": pa.array(list(found), pa.int32()), "words": pa.array(map(pack_words, found.values()), pa.binary())}
        )

    def encode(table):
        import pyarrow as pa

        lists = [unpack_words(x) for x in table.column("words").to_pylist()]
        every = list(set().union(*lists))
        at = {w: i for i, w in enumerate(every)}
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for k in range(0, len(every), 1 << 12):
            found = encode_words(every[k : k + (1 << 12)], path)
            lens.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        ids, starts = np.concatenate(ids), np.cumsum(np.concatenate(lens))
        out = []
        for words in lists:
            entry, own = _gather(words, at, starts, ids)
            out.append((pack_array((starts[entry + 1] - starts[entry]).astype(np.uint32)), pack_array(own)))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "lens": pa.array([x[0] for x in out], pa.binary()), "ids": pa.array([x[1] for x in out], pa.binary())})

    packed = rows.groupBy("block").applyInArrow(trimmed(words_of), "block int, bucket int, words binary")
    return packed.groupBy("bucket").applyInArrow(trimmed(encode), "block int, bucket int, lens binary, ids binary")


def _joined(docs: DataFrame, path: str, block_bytes: int, finish, schema: str) -> DataFrame:
    """What ``finish`` makes of each block: its ids by text, called with a function from a text to its ids."""
    checked(path)
    blocks = block_count(docs, block_bytes)
    rows = squeezed(blocked(docs, blocks))
    answers = word_ids(rows, path, blocks)

    def meet(left, right):
        import pyarrow as pa

        by_key = {k: (unpack_array(a, np.uint32), unpack_array(b, np.uint32)) for k, a, b in zip(right.column("bucket").to_pylist(), right.column("lens").to_pylist(), right.column("ids").to_pylist())}
        texts, words = _distinct(left, blocks)
        at, lens, ids, n = {}, [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], 0
        for k, own in words.items():
            at.update(zip(own, range(n, n + len(own))))
            lens.append(by_key[k][0])
            ids.append(by_key[k][1])
            n += len(own)
        starts, ids = np.concatenate([[0], np.cumsum(np.concatenate(lens).astype(np.int64))]), np.concatenate(ids)
        columns = finish(texts, lambda t: _gather(t.split(), at, starts, ids)[1])
        return pa.table({"doc_id": left.column("doc_id"), **columns, "times": left.column("times")})

    return multiplied(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(trimmed(meet), f"doc_id long, {schema}, times long"))


def _gather(words: list[bytes], at: dict, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one text: each word's entry, and the ids joined by position."""
    entry = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
    begin = starts[entry]
    lens = starts[entry + 1] - begin
    ends = np.cumsum(lens)
    flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - lens), lens)
    return entry, ids[flat]


def encode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of each row of ``docs`` (doc_id, text); with ``decoded`` the decoded text too.

    A null text counts as empty and has no ids; null doc_ids and repeated rows are kept as they are; other
    columns are ignored; an empty table gives an empty table.
    """

    def finish(texts, ids_of):
        import pyarrow as pa

        table = np.array(pieces(path), object) if decoded else None
        ids, whole = [], []
        for t in texts:
            own = ids_of(t)
            ids.append(pa.array(own.astype(np.int32)))
            if decoded:
                whole.append(b" ".join(table[own].tolist()))
        lens = np.cumsum([0, *map(len, ids)])
        flat = pa.concat_arrays([pa.array([], pa.int32()), *ids])
        out = {"ids": pa.ListArray.from_arrays(pa.array(lens, pa.int32()), flat)}
        return out | ({"decoded": pa.array(whole, pa.binary()).cast(pa.string())} if decoded else {})

    return _joined(docs, path, block_bytes, finish, "ids array<int>" + (", decoded string" if decoded else ""))


def vocabulary(spark, path: str) -> DataFrame:
    """The id-to-piece table as rows (id, piece); its size is bound by the vocabulary file."""
    return spark.createDataFrame([(i, p.decode()) for i, p in enumerate(pieces(path))], "id int, piece string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Decode rows (doc_id, ids) through a join with the id-to-piece table: doc_id, text.

    Pieces are joined by one space, as the library does for a file without a decoder; null or empty ids
    decode to an empty text; unknown ids are skipped.
    """
    # The row's own digest tells repeated doc_ids apart; equal rows decode alike and are multiplied back.
    rows = encoded.groupBy("doc_id", "ids").agg(F.count(F.lit(1)).alias("copies")).withColumn("row", F.sha2(F.to_json(F.struct("doc_id", "ids")), 256))
    long = rows.select("row", F.posexplode("ids").alias("position", "id"))
    found = long.join(F.broadcast(vocabulary(encoded.sparkSession, path)), "id").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("found"))
    text = F.coalesce(F.array_join(F.col("found.piece"), " "), F.lit(""))
    return rows.join(found, "row", "left").select("doc_id", text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).drop("one")


def round_trip(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids (little-endian uint32) and of the decoded text, of each row.

    Ids are decoded where they are joined back: the id-to-piece table, whose size the vocabulary bounds, is looked
    up in the block's task (a map-side join), since a row for each position would be many times the text.
    :func:`decode` is the same as a join of tables. Cases as in :func:`encode`; an empty text has 0 tokens and
    decodes to an empty text.
    """

    def finish(texts, ids_of):
        import pyarrow as pa

        table = np.array(pieces(path), object)
        n, first, second = [], [], []
        for t in texts:
            own = ids_of(t)
            n.append(len(own))
            first.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            second.append(hashlib.sha256(b" ".join(table[own].tolist())).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}

    return _joined(docs, path, block_bytes, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
