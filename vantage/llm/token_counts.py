"""Token counts: batches balanced by bytes, encoded in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_bytes

#: A single space between two characters that are neither a space nor the library's mark for one.
#: No piece of a word-initial vocabulary crosses it, and the next part gets the same mark as its prefix.
SAFE = r"(?<=[^ ▁]) (?=[^ ▁])"


@functools.lru_cache(2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(2)
def boundaries(path: str) -> re.Pattern:
    """Where a text may be cut: at safe spaces, and before characters that no piece joins with others.

    ValueError if the vocabulary has pieces that cross a space. Where the library changes texts before it encodes
    them, only spaces are safe.
    """
    sp = _processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("this vocabulary has pieces that cross a space")
    probe = "ﬁ  ①é\tＡ"
    if sp.normalize(probe) != "▁" + probe.replace(" ", "▁"):
        return re.compile(SAFE)
    joined = "".join(sorted({" ", "▁"}.union(*(p for p in pieces if len(p) > 1))))
    return re.compile(f"{SAFE}|(?=[^{re.escape(joined)}])")


def safe_parts(text: str, size: int, cuts: re.Pattern) -> list[tuple[str, int]]:
    """Cut a text into parts of about ``size`` characters, each with the tokens that its prefix adds; without a boundary it stays whole."""
    out, start, extra = [], 0, 0
    while len(text) - start > size:
        cut = cuts.search(text, start + size)
        if not cut or cut.end() == len(text):
            break
        out.append((text[start : cut.start()], extra))
        # A part that follows a space has the mark that the space had; any other gets one too many.
        start, extra = cut.end(), int(cut.start() == cut.end())
    return [*out, (text[start:], extra)]


def lengths(texts: list[str], encode, part: int, batch_bytes: int, cuts: re.Pattern) -> list[int]:
    """Tokens of each text; batches hold about ``batch_bytes`` of UTF-8 whatever the lengths of the texts."""
    out = [0] * len(texts)
    held, owner, size = [], [], 0

    def flush() -> None:
        for i, ids in zip(owner, encode(held)):
            out[i] += len(ids)
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for p, extra in safe_parts(text, part, cuts):
            held.append(p)
            owner.append(i)
            out[i] -= extra
            size += len(p.encode())
            if size >= batch_bytes:
                flush()
                size = 0
    if held:
        flush()
    return out


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, part: int = 1 << 14, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text).

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows are counted
    each; other columns are ignored; an empty table gives an empty table. The vocabulary must have no piece
    with a space mark after another character (:func:`boundaries` checks), else cuts would not be safe.
    Nothing is shuffled: a task encodes its own rows in batches of ``batch_bytes``.
    """

    def run(batches):
        import pyarrow as pa

        sp, cuts = _processor(model), boundaries(model)
        for b in batches:
            raw = text_bytes(b.column("text"))
            n = lengths([x.decode("utf-8", "replace") for x in raw], lambda t: sp.encode(t, num_threads=1), part, batch_bytes, cuts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
