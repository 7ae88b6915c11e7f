"""Array bundles, point clouds, tiles and metric histories as DataFrames."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bundle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of NPZ files of equal-length arrays; ``schema`` names the arrays and their types.

    Files without one of the arrays, or with arrays of other lengths, are errors, as are pickled ones. Each file is
    read whole by one task; ``path`` is set by the reader and may be among the columns of the schema.
    """
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(schema)

    def run(batches):
        import pandas as pd

        for b in batches:
            for where, raw in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(raw), allow_pickle=False) as data:
                    arrays = {f.name: data[f.name] for f in kinds if f.name != "path"}
                sizes = {len(a) for a in arrays.values()}
                if len(sizes) != 1:
                    raise ValueError(f"arrays of {where} differ in length")
                out = {n: list(a) if a.ndim > 1 else (a.astype(str).astype(object) if a.dtype.kind in "US" else a) for n, a in arrays.items()}
                if "path" in kinds.names:
                    out["path"] = [where] * sizes.pop()
                yield pd.DataFrame(out)[kinds.names]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kinds)


def read_history(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """A JSON-lines history of steps; with ``stream``, as lines arrive in new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def tile_faults(tiles: DataFrame, side: int = 512) -> DataFrame:
    """pano_id, face, tiles and usable: exactly the four tiles of a 2 x 2 grid, each of the right size."""
    at = F.when(F.col("tile_x").isin(0, 1) & F.col("tile_y").isin(0, 1) & (F.col("width") == side) & (F.col("height") == side), F.struct("tile_x", "tile_y"))
    out = tiles.groupBy("pano_id", "face").agg(F.count(F.lit(1)).alias("tiles"), F.count_distinct(at).alias("_places"))
    return out.select("pano_id", "face", "tiles", ((F.col("tiles") == 4) & (F.col("_places") == 4)).alias("usable"))


def stitched(pixels: DataFrame, side: int = 512) -> DataFrame:
    """Pixels of tiles (tile_x, tile_y, x, y) in the face's own x and y, without resampling."""
    return pixels.withColumn("x", F.col("tile_x") * side + F.col("x")).withColumn("y", F.col("tile_y") * side + F.col("y")).drop("tile_x", "tile_y")


def write_points(points: DataFrame, path: str) -> int:
    """Write x, y, z (float) and red, green, blue (bytes) in the order of point_id as a binary point cloud; the number of points.

    Tasks pack their rows; the driver passes one packed batch at a time on to the file.
    """
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = np.zeros(b.num_rows, kind)
            for n in kind.names:
                rows[n] = np.asarray(b.column(n))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([rows.tobytes()], pa.binary())], ["n", "data"])

    spark = points.sparkSession
    total = points.count()
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {total}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header", ""]
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray("\n".join(head).encode("ascii")))
    for r in points.select("point_id", *kind.names).orderBy("point_id").mapInArrow(run, "n long, data binary").toLocalIterator():
        out.write(bytearray(r.data))
    out.close()
    return total
