"""The corpus pipeline: stages that each take and return documents.

Each stage takes the columns of documents and further ones of any name; all but the last return the same columns. Empty
tables give empty tables. Rows without a doc_id pass each stage by its rule; none is lost for lack of an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import bpe, minhash_dedup, mixing, pii, zstd_quality
from vantage.llm.common import WORD, free_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score of 0.7 or more).

    Equal texts are judged alike, a null text as an empty one. Without labels of both classes all have the share of
    label 1 as score.
    """
    model = zstd_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = free_name(docs.columns, "score", "predicted")[1]
    return zstd_quality.score(docs, model, keep=True).where(F.col(predicted) == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id.

    Words and similarity are the operator's defaults: shingles of five words, 0.8. Of rows of a group that share that
    doc_id one stays. Texts without a word are in no group and stay, and so do rows without a doc_id.
    """
    row, times = free_name(docs.columns, "_row", "_times")
    found = minhash_dedup.near_duplicates(docs).where("kept and group is not null")
    per_row = found.groupBy("group", "row").agg(F.count(F.lit(1)).alias("n"))
    chosen = per_row.groupBy("group").agg(F.min(F.struct("row", "n")).alias("one")).select(F.col("one.row").alias(row), F.col("one.n").alias(times))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    out = docs.where(~alone).withColumn(row, minhash_dedup.row_key()).join(chosen, row)
    once = out.where(F.col(times) == 1).select(*docs.columns)
    again = out.where(F.col(times) > 1).dropDuplicates([row]).select(*docs.columns)
    return once.unionByName(again).unionByName(docs.where(alone))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by surrogates; n_chars follows the text. A null text stays null."""
    out = pii.replace(docs, pii.session_key(spark), keep=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows that are equal in all columns share the copies of their text; which of them a copy comes from makes no
    difference. A null source comes last.
    """
    row, copies, times, one = free_name(docs.columns, "_row", "_copies", "_times", "_one")
    mixed = mixing.mix(docs, by=tuple(docs.columns)).where("copies > 0")
    mixed = mixed.select(F.col("row").alias(row), F.col("copies").alias(copies), F.col("times").alias(times))
    rows = docs.withColumn(row, mixing.row_key(tuple(docs.columns))).join(mixed, row)
    rows = rows.where(F.col(times) == 1).unionByName(rows.where(F.col(times) > 1).dropDuplicates([row]))
    return rows.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the text that the ids give) of each row; a null text has no ids."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", private), ("mix", mix), ("bpe", encode)]

#: No stage's models can be stated in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
