"""What several operators share: words, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of other characters than ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def shingle_hashes(words: Column, k: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of all ``k``-word shingles, in text order; none for shorter texts."""
    return F.when(
        F.size(words) >= k,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - F.lit(k)),
            lambda i: F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``docs`` in the struct ``rest``, beside ``columns``, so that names can't clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rest"), *[c.alias(n) for n, c in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's own setting, or a new one in local mode, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kohorta-")
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found:
        found = "file://" + found
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kohorta/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile gives the disk of its shuffles back at once, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Stored tables of one computation; ``release`` removes those that its result doesn't read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[str, str]] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *keep: str) -> None:
        remove(self.spark, [path for name, path in self.paths if name not in keep])
        self.paths = [x for x in self.paths if x[0] in keep]


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)


def file_system(uri: str):
    """The Arrow file system of ``uri`` and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Bytes of an Arrow batch on its way to Python, about; the default knows no bound but a number of rows.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so that wide rows don't add up to large ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not (now or "").isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def frugal(made: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Gives memory that a task has freed back to the system at its end: workers outlive their tasks."""

    @wraps(made)
    def run(*args, **options):
        try:
            yield from made(*args, **options)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not the GNU library
                pass

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` bytes of ``column`` at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    count = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return pc.fill_null(count(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and the rows' bounds; null counts as empty."""
    bounds = np.r_[0, np.cumsum(lengths(column))].astype(np.int64)
    data = b"".join(x for x in column.cast(pa.binary()).to_pylist() if x)
    return np.frombuffer(data, dtype=np.uint8), bounds
