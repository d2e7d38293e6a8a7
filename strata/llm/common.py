"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.storage import folders_made, keep, release, scratch_dir, ship

__all__ = ["apart", "bounded_batches", "chunks", "fold", "folders_made", "keep", "lean_worker", "release", "scratch_dir", "table", "text_buffers", "text_hashes"]

#: Bytes of text that one vectorised step works on (a longer text is a step of its own).
CHUNK_BYTES = 1 << 18
#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """For operators with Python workers: ship this package to the executors, once for each
    application, and bound Arrow batches by bytes, so that long texts don't pile up in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def lean_worker() -> None:
    """In a Python worker: give freed memory back, since workers stay between stages; at the first batch of
    a task, also the tables of powers that the tasks before it have left (16 bytes for each byte hashed at once)."""
    from strata.llm import hashing

    if not _lean:
        import ctypes

        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: fixed, so that large arrays are mapped on their own
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        _lean["task"] = None
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if task != _lean["task"]:
        _lean["task"] = task
        hashing.forget()


_lean: dict = {}


def apart(results: list[str], *parameters: str, fixed: tuple[str, ...] = ()) -> Callable:
    """For an operator that returns all columns of its first argument and ``results``: within it, the caller's
    columns have names of ours, so that whatever they are called they clash with nothing the operator uses.
    ``parameters``: those that name columns; ``fixed``: columns that the operator reads by their own name.
    A caller's column that is called like a result is replaced by it."""

    def wrap(operator: Callable) -> Callable:
        @wraps(operator)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            call = inspect.signature(operator).bind(docs, *args, **more)
            call.apply_defaults()
            names = {c: c if c in fixed else f"strata_column_{i}" for i, c in enumerate(docs.columns)}
            call.arguments[next(iter(call.arguments))] = docs.toDF(*names.values())
            call.arguments.update({p: names.get(call.arguments[p], call.arguments[p]) for p in parameters})
            found = operator(*call.args, **call.kwargs)
            own = {new: old for old, new in names.items()}
            return found.select(*(F.col(f"`{c}`").alias(own.get(c, c)) for c in found.columns if own.get(c) not in results or c in results))

        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out. Null ids are in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % 3, F.lit(0))


def text_hashes(text: Column) -> list[Column]:
    """Two hashes that tell texts apart together."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def text_buffers(column: pa.Array):
    """(uint8 data, int64 offsets) of a string column; nulls are empty texts."""
    import numpy as np

    lean_worker()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64) if len(off) else np.zeros(1, dtype=np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets, limit: int = CHUNK_BYTES):
    """Ranges (i, j) of documents with about ``limit`` bytes together; at least one document each."""
    import numpy as np

    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
