"""Shared plumbing: tables, written intermediate results, and shipping this package to executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of every operator here: runs of anything but these six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


#: Arrow batches between Spark and its Python workers: a task holds one on either side, beside its share of the heap.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
USUAL_BATCH, SMALL_BATCH = "67108864b", "8388608b"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per Spark application; and batches of text small, unless the session says otherwise."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH, None) == USUAL_BATCH:
        spark.conf.set(BATCH, SMALL_BATCH)
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    fd, path = tempfile.mkstemp(prefix="quillmark-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(os.path.join(root, "quillmark")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


_kept: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task. A worker that turns to another operator forgets the first one's and gives its memory back."""
    if owner not in _kept:
        if TaskContext.get() is not None and _kept:
            _kept.clear()
            give_back()
        _kept[owner] = {}
    return _kept[owner]


def give_back() -> None:
    """Freed memory goes back to the system, as idle workers share an executor's memory with what comes next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir. Unset, a temporary one, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillmark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: computed once, lineage cut, safe when executors go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Into how many parts the rows of one join key are dealt where that key may be very frequent.
SALTS = 64


def join_hot(rows: DataFrame, one: DataFrame, on: str, by: Column, how: str = "inner") -> DataFrame:
    """rows with the columns of `one`, which has each value of `on` at most once, where one value may have a large share of all rows.

    Rows are dealt by (on, hash of `by` modulo SALTS); only the pairs that occur, at most SALTS a value, meet `one` by the value alone.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    dealt = salted.select(on, "__salt").distinct().join(one, on)
    return salted.join(dealt, [on, "__salt"], how).drop("__salt")


def least_of(rows: DataFrame, on: str, value: str, name: str, by: Column) -> DataFrame:
    """rows and, as `name`, the least value of those with the same `on`; one value of `on` may have a large share of all rows. Sums go up in two steps."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(on, "__salt").agg(F.min(value).alias("__least"))
    least = parts.groupBy(on).agg(F.min("__least").alias(name))
    return salted.join(parts.select(on, "__salt").join(least, on), [on, "__salt"]).drop("__salt")


def let(value: Column, body) -> Column:
    """Bind value once for use inside body: the optimiser can't inline it into lambdas that run once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """Slices of an Arrow batch whose text column holds about `most` bytes each (one row at least)."""
    col = batch.column(column)
    n = len(col)
    if not n:
        return
    _, offsets = text_bytes(col)
    first = 0
    while first < n:
        last = first + 1
        limit = int(offsets[first]) + most
        while last < n and int(offsets[last + 1]) <= limit:
            last += 1
        yield batch.slice(first, last - first)
        first = last


def text_bytes(col: pa.Array):
    """(bytes as uint8, offsets) of a string or binary array; nulls are empty. Offsets start at the array's own first byte."""
    import numpy as np
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binary_array(data, offsets) -> pa.Array:
    """A binary Arrow array over one buffer."""
    import numpy as np

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
