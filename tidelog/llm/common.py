"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Doc ids that are null take this place inside keys, never in results.
NULL_ID = -(2**63)


#: Rows of an Arrow batch at most: ten thousand whole texts, the usual number, take much memory on both sides.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(name: str = "text") -> Column:
    """A string column as its UTF-8 bytes: Python then needs no decoding."""
    return F.col(name).cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where none is set, a session inside one
    process makes its own; on a cluster there is an error, as a local folder there would be lost to the other machines."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidelog-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder, and read from there: smaller than a checkpoint. Deleted when the
    driver ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/tidelog-{uuid.uuid4()}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of checkpointed tables that nothing reads any more."""
    for df in tables:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            deleted(df.sparkSession, file.get())


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: its cleaner waits for the driver's garbage collection, which
    a driver that does little may not come to for hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few, so that neither a worker nor the JVM holds many results at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins in the values of all lists (one place more than rows), and the values."""
    x = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), x.flatten()


def numbers(batch: pa.RecordBatch, name: str, kind=np.int64) -> np.ndarray:
    """A column without nulls as an array."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def heads(rows: list[tuple[int, ...]], kind: np.dtype) -> bytes:
    """Rows of numbers as bytes of a structured type."""
    out = np.zeros(len(rows), kind)
    for name, values in zip(kind.names, zip(*rows, strict=True), strict=False):
        out[name] = values
    return out.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


#: An odd multiplier of polynomial hashes modulo 2**64, and its inverse there.
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = inverse(BASE)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the place of its leftmost minimum, from running minima of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid, places = padded.reshape(blocks, w), np.arange(blocks * w).reshape(blocks, w)
    prefix = np.minimum.accumulate(grid, axis=1)
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    # Leftmost in a suffix of a block: the nearest place to the right that holds its own suffix minimum.
    in_suffix = np.minimum.accumulate(np.where(suffix == grid, places, blocks * w)[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    # Leftmost in a prefix: the last place where the running minimum fell.
    fell = np.ones((blocks, w), bool)
    fell[:, 1:] = prefix[:, 1:] < prefix[:, :-1]
    in_prefix = np.maximum.accumulate(np.where(fell, places, -1), axis=1).ravel()[w - 1 : w - 1 + n]
    return np.where(suffix.ravel()[:n] <= prefix.ravel()[w - 1 : w - 1 + n], in_suffix, in_prefix)
