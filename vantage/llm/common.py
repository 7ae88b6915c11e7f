"""Shared plumbing of the training-data operators: scratch tables and document blocks."""

from __future__ import annotations

import ctypes
import uuid
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes that are neither space nor 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one block of documents aims at. A block's answers come from as many buckets as there are blocks, so
#: that neither grows with the input; a block and a bucket exchange a row only if they share a word, gram or window.
BLOCK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only a local session may leave it unset; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    path = f"{scratch(df.sparkSession)}/vantage/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table behind a result of :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def joined(rows: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` on ``key`` by shuffles of both.

    Spark would broadcast a table whose file or shuffle is small, which passes the driver's memory as rows many times that size.
    """
    return rows.join(other.hint("merge"), key, how)


def skew_join(rows: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other``, which has a row a key and is stored first, on ``key``.

    A key may have a third of ``rows``. Both sides of the join are then plain shuffles, and Spark (AQE) splits a
    partition that is much larger than others; it could not if ``other`` were aggregated within the join's stage.
    """
    return joined(rows, stored(other, "keyed"), key, how)


def free_name(columns: list[str], *wanted: str) -> list[str]:
    """Column names that ``columns`` (whatever their case) do not hold, made from the wanted ones."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def trim() -> None:
    """Give freed memory of this Python worker, which serves later tasks too, back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function on an iterator of record batches that gets at most 512 rows at once and trims its memory at the end."""

    def wrapped(batches):
        try:
            yield from run(b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512))
        finally:
            trim()

    return wrapped


def trimmed(run):
    """A function on the tables of a group that trims its worker's memory after each."""

    def one(table):
        try:
            return run(table)
        finally:
            trim()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            trim()

    return two if run.__code__.co_argcount == 2 else one


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks hold the texts at about ``block_bytes`` each."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return int(max(1, -(-total // block_bytes)))


def blocked(docs: DataFrame, blocks: int, *columns) -> DataFrame:
    """block, doc_id, text (null: empty) and more columns, which depend on doc_id only.

    The block comes from the row's content, so a task that runs again deals the same rows to the
    same blocks.
    """
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *columns,
    )


def squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with each text compressed on its own (binary), for shuffles, and ``times``; see :func:`whole_texts`.

    Of equal rows of a batch one is left, with their number as ``times``, so that a row that repeats without
    end does not fill its block.
    """
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    at, key = rows.columns.index("text"), rows.columns.index("doc_id")

    def run(batches):
        import pyarrow as pa

        for b in (x.slice(i, 2048) for x in batches for i in range(0, x.num_rows, 2048)):
            texts, times = text_bytes(b.column(at)), {}
            for i, row in enumerate(zip(b.column(key).to_pylist(), texts)):
                first, n = times.get(row, (i, 0))
                times[row] = first, n + 1
            c = zstandard.ZstdCompressor(level=3, write_checksum=False)
            firsts = pa.array([i for i, _ in times.values()], pa.int64())
            columns = [b.column(i).take(firsts) for i in range(b.num_columns)]
            columns[at] = pa.array([c.compress(t) for _, t in times], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in times.values()], pa.int64())], [*b.schema.names, "times"])
        trim()

    kinds = [StructField("text", BinaryType()) if f.name == "text" else f for f in rows.schema]
    return rows.mapInArrow(run, StructType([*kinds, StructField("times", LongType())]))


def multiplied(rows: DataFrame) -> DataFrame:
    """``rows`` without their ``times`` column, each as often as that says."""
    once = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_one")
    return rows.select(*[c for c in rows.columns if c != "times"], once).drop("_one")


def whole_texts(table) -> list[bytes]:
    """The texts of an Arrow table of :func:`squeezed` rows."""
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in table.column("text").to_pylist()]


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def by_bucket(words, buckets: int) -> dict[int, list[bytes]]:
    """Distinct words by bucket, buckets in order and the words of each in byte order; buckets without words are left out."""
    out: dict[int, list[bytes]] = {}
    crc = zlib.crc32
    for w in words:
        out.setdefault(crc(w) % buckets, []).append(w)
    for x in out.values():
        x.sort()
    return dict(sorted(out.items()))


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no line feed, which therefore separates them."""
    return pack(b"\n".join(words))


def unpack_words(raw: bytes) -> list[bytes]:
    text = unpack(raw)
    return text.split(b"\n") if text else []


def pack_array(values: np.ndarray) -> bytes:
    """Compress an integer array byte plane by byte plane."""
    return pack(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack_array(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(unpack(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Compress a sorted uint64 array by its differences."""
    return pack_array(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(raw, np.uint64), dtype=np.uint64)
