"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds a worker's memory whatever the batch size.
SLICE_BYTES = 4 << 20


#: Bytes of an Arrow batch between Spark and Python, unless the session says otherwise; by rows alone a batch of long
#: texts takes hundreds of MB on both sides.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bound unless it has one; the queries and the pipeline call this, reading does not."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the checkpoint folder, else one in the warehouse.

    A warehouse on a machine's own disk will do where driver and executors are one process only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
            if not sc.master.startswith("local") and path.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


#: Folders that the operator at work has made: of each thread and task its own.
_open: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("_open", default=None)
#: Result tables that outlive their operators, and their sessions.
_results: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the operator at work ends."""
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    own = _open.get()
    if own is not None:
        own.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut inside are deleted at the end, but for those written by the function given, which outlive it: they go
    with the operator around this one, else by `drop_results`."""
    own: list[tuple[SparkSession, str]] = []
    kept: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        out = cut(df)
        kept.append((out.sparkSession, out._cut_path))
        return out

    before = _open.get()
    token = _open.set(own)
    try:
        yield keep
    finally:
        _open.reset(token)
        paths = {path for _, path in kept}
        for spark, path in own:
            if path not in paths:
                delete(spark, path)
        if before is not None:
            before.extend(kept)
        else:
            _results.update((path, spark) for spark, path in kept)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark reaches."""
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        delete(df.sparkSession, path)
        _results.pop(path, None)


def drop_results() -> None:
    """Delete the result tables of all operators that ended; whoever has read or written the results elsewhere calls this.
    What is left goes when the driver ends."""
    while _results:
        path, spark = _results.popitem()
        delete(spark, path)


atexit.register(drop_results)


def held_out(doc_id: str = "doc_id"):
    """Whether a row belongs to the fifth that no model learns from."""
    return (F.crc32(F.col(doc_id).cast("string")) % 5 == 0) & F.col(doc_id).isNotNull()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about max_bytes of the column at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0)).to_numpy(zero_copy_only=False)
        start = 0
        while start < n:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(size.searchsorted(base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()  # workers live on after the partition


def give_back() -> None:
    """Hand memory that is free back to the system: Arrow's, and where the C library can, the heap's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with null as the empty string, its offsets from 0."""
    return pa.concat_arrays([pc.fill_null(pc.cast(batch.column(column), pa.string()), "")])


#: A key is hot from this part of all rows on, so that this many keys are hot at most.
HOT_PART = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows to one row a key, where `count` of right is the key's number of rows in left.

    Keys of at least a HOT_PART-th of the rows number HOT_PART at most and go by broadcast, so that no key left for the
    shuffle has more than that share. right should be cheap to read several times."""
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.sparkSession.createDataFrame(right.where(F.col(count) * HOT_PART >= total).collect(), right.schema)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(count) * HOT_PART < total), keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)
