"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, context_tree, minhash_dedup, mixing, mpeg_media, nn_descent, pii, substring_dedup, token_counts, zstd_quality
from .common import documents


def _held_out(folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 2, F.lit(False)).alias("held_out")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_media.digest_media(mpeg_media.stored_media(documents(spark, sf_dir)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = zstd_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return zstd_quality.score(docs, model).select("doc_id", _held_out(4), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(mixing.mix(documents(spark, sf_dir)))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir), pii.session_key(spark))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of op 2's columns that SQL can state: what was stored and read back."""
    return op2_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of op 4's columns that SQL can state: the word counts' side of it."""
    return op4_context_tree(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of op 6's columns that SQL can state: sizes and targets."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_dedup, op2_media_columns, op3_token_counts, op4_context_tree, op5_quality_classifier, op6_mixing, op7_nn_descent, op8_bpe, op9_pii_surrogates, op10_substring_dedup, media_payloads, base_scores, mixing_targets)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

_BYTES = "list_transform(regexp_extract_all(hex({}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
_CRC32 = "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], " + _BYTES + "), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (sh) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id""",
    "media_payloads": f"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
padded AS (SELECT doc_id, octet_length(b) AS n, b || repeat('\\x00'::BLOB, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END) AS p FROM raw),
tail AS (SELECT *, unhex(right(hex(p), 128)) AS last FROM padded)
SELECT doc_id, n AS n_bytes, octet_length(p) AS payload_bytes, sha256(p) AS payload_sha256, CAST({_CRC32.format('last')} AS BIGINT) AS tail_crc32 FROM tail""",
    "base_scores": f"""
WITH d AS (SELECT doc_id, coalesce({_CRC32.format("encode(CAST(doc_id AS VARCHAR))")} % 7, -1) AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
c AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM d WHERE r NOT IN (2, -1)) GROUP BY word),
e AS (SELECT count(*) AS ends FROM d WHERE r NOT IN (2, -1)),
t AS (SELECT CAST(coalesce((SELECT sum(c) FROM c), 0) + ends AS BIGINT) AS n, (SELECT count(*) FROM c) + CAST(ends > 0 AS BIGINT) AS v, ends FROM e),
s AS (SELECT doc_id, count(*) AS words, count(c.c) AS known, sum(log10((coalesce(c.c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) AS score FROM (SELECT doc_id, unnest(w) AS word FROM d) k LEFT JOIN c USING (word), t GROUP BY doc_id)
SELECT d.doc_id, d.r = 2 AS held_out, coalesce(words, 0) + 1 AS n_tokens, coalesce(known, 0) + CAST(ends > 0 AS BIGINT) AS n_known, n AS train_tokens, round(coalesce(score, 0) + log10((ends + 1) / CAST(n + v + 1 AS DOUBLE)), 6) AS base_score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id, t""",
    "mixing_targets": f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
o AS (SELECT *, (1.5 * sum(ss) OVER () - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s),
l AS (SELECT arg_min(level, 2 * ss / w) AS level FROM o WHERE 2 * ss >= level * w)
SELECT doc_id, size, ss AS source_size, round(least(2.0 * ss, l.level * w), 6) AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, l""",
    # All pairs are compared, so the recall is 1.
    "op7_nn_descent": """
WITH RECURSIVE u AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings
), n AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM u WHERE v IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT k.vec_id, coalesce(c.n, 0) AS n_links, k.component_id, k.vec_id = k.component_id AS kept, CAST(1 AS DOUBLE) AS recall
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) k LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = k.vec_id""",
    "op10_substring_dedup": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), hits AS (
  SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), marked AS (
  SELECT k.doc_id, k.i, k.word, coalesce(max(h.i) OVER (PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS gone
  FROM words k LEFT JOIN hits h ON h.doc_id = k.doc_id AND h.i = k.i
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id) g ON g.doc_id = d.doc_id""",
}
