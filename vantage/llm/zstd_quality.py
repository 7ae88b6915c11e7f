"""Compression classifier: a text's compressed sizes under dictionaries of good and bad text, calibrated."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lean, text_bytes


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration score = sigmoid(slope * difference + offset)."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    level: int = 3


def _compressors(model_good: bytes, model_bad: bytes, level: int):
    import zstandard

    out = []
    for raw in (model_good, model_bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def differences(texts: list[bytes], good: bytes, bad: bytes, level: int, part: int = 1024) -> np.ndarray:
    """(size under the bad dictionary - size under the good one) / text bytes; 0 for an empty text.

    Every ``part`` bytes are compressed afresh, since a long text would soon serve as its own dictionary.
    """
    g, b = _compressors(good, bad, level)
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        if t:
            parts = [t[i : i + part] for i in range(0, len(t), part)]
            out[k] = sum(len(b.compress(p)) - len(g.compress(p)) for p in parts) / len(t)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, share: float = 0.5, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps on balanced classes, moved to ``share`` of label 1.

    Where a class is missing, the score is the share.
    """
    prior = float(np.log(share / (1 - share)))
    if len(x) == 0 or y.min() == y.max():
        return 0.0, prior
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    # Platt's targets, which stop short of 0 and 1: few rows don't make a steep slope.
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    scale = max(float(np.abs(x).max()), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1]) + prior


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard

    joined = sum(map(len, texts))
    size = max(256, min(size, joined // 4))
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves as a raw dictionary
        return b"".join(texts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, sample: int = 2000, sample_bytes: int = 1 << 16, dictionary: int = 400_000, level: int = 3) -> Model:
    """Fit on a bounded sample of labelled rows: of each class the ``sample`` rows first in hash order.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_out`` are not used, nor, in fitting, are texts
    over ``sample_bytes``. Two thirds build the dictionaries, one third the calibration. Rows without a doc_id,
    text or label are not used; of several labels of a document the lowest counts. Without labels of both classes
    the score is the share of label 1, smoothed by one row of each.
    """
    key = F.col("doc_id").cast("string")
    known = labels.where(F.col("quality").isin(0, 1) & (F.crc32(key) % folds != held_out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    fitting, tuning = [], []
    for quality in (0, 1):
        # Twice the number, as some texts are too long; at most 4 * sample ids are broadcast.
        ids = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).select("doc_id")
        texts = docs.where(F.octet_length("text").between(1, sample_bytes)).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
        rows = [r.text.encode() for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()]
        fitting.append([t for i, t in enumerate(rows) if i % 3 != 2])
        tuning.append([t for i, t in enumerate(rows) if i % 3 == 2])
    bad, good = fitting
    if not good or not bad:
        return Model(b"", b"", *calibrate(np.zeros(0), np.zeros(0), share), level)
    dicts = _dictionary(good, dictionary), _dictionary(bad, dictionary)
    d = differences(tuning[0] + tuning[1], *dicts, level)
    y = np.array([0.0] * len(tuning[0]) + [1.0] * len(tuning[1]))
    return Model(*dicts, *calibrate(d, y, share), level)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """score (0 to 1) and predicted (1 from ``threshold``) for every whole text.

    Returns doc_id, score, predicted; with ``keep`` all columns of ``docs`` instead of doc_id, and where they hold a
    column of these names, the results' names begin with further underscores (:func:`free_name`). A null or
    empty text has difference 0, hence the calibration's offset as score. Rows are scored one by one, so
    repeated rows and null ids need no rule.
    """
    schema = docs.schema
    columns = docs.columns if keep else ["doc_id"]
    names = free_name(columns, "score", "predicted")
    (text,) = free_name(columns, "_scored_text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = text_bytes(b.column(b.num_columns - 1))
            if model.good and model.bad:
                z = model.slope * differences(texts, model.good, model.bad, model.level) + model.offset
            else:
                z = np.full(len(texts), model.offset)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                [*columns, *names],
            )

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    out = StructType([*(schema[c] for c in columns), StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    return docs.select(*columns, F.coalesce("text", F.lit("")).alias(text)).mapInArrow(lean(run), out)
