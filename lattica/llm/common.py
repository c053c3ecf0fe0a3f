"""Shared plumbing of the text operators: Arrow blocks, hashing rules, shared folders."""

from __future__ import annotations

import ctypes
import uuid
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of this many text bytes or rows are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 128
ARROW_ROWS, ARROW_BYTES = "512", "8m"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch brings to a Python worker, for the rest of the session, as Spark reads these settings when a plan runs. Smaller ones of the caller stay."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > int(ARROW_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under the warehouse, with a warning, as that is a local folder by default."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warnings.warn("spark.checkpoint.dir is unset: intermediate tables go to the warehouse, which executors must share", stacklevel=3)
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop's for a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, reread: cuts the lineage and outlives executors. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    leave_no_folder(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def leave_no_folder(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver's JVM ends."""
    store, place = hadoop_path(spark, path)
    store.deleteOnExit(place)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() gave and nothing will read again; others are left alone."""
    for t in tables:
        if getattr(t, "_written", None):
            store, place = hadoop_path(t.sparkSession, t._written)
            store.delete(place, True)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


_held: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks, for one operator at a time: another operator's cache goes first, so that stages run one after the other don't add up."""
    if name not in _held:
        forget(name)
        _held[name] = make()
    return _held[name]


def forget(but: str) -> None:
    """Drops what the worker holds for other operators than the one whose caches begin so."""
    if any(not but or not k.startswith(but) for k in _held):
        _held.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that waits for its next task is small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: list[int], most_bytes: int = BLOCK_BYTES, most_rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes and rows, or one row."""
    start, held, end = 0, 0, 0
    for end, n in enumerate(sizes):
        if end > start and (held + n > most_bytes or end - start >= most_rows):
            yield start, end
            start, held = end, 0
        held += n
    if sizes:
        yield start, end + 1


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, cache: str = "") -> DataFrame:
    """mapInArrow whose work gets a batch and yields dicts of columns; cache names what its worker may keep."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(cache)
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_pydict(columns)
        give_back()

    return df.mapInArrow(run, schema)


def gram_counts(texts: list[bytes], dims: int, n: int = 3) -> np.ndarray:
    """Counts of hashed byte n-grams, one row a text; dims is a power of two."""
    out = np.zeros((len(texts), dims), np.float32)
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return out
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    if len(data) < n:
        return out
    h = np.zeros(len(data) - n + 1, np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193) + data[i : len(data) - n + 1 + i]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - dims.bit_length() + 1)
    first, last = row[: len(h)], row[n - 1 :]
    inside = first == last
    flat = np.bincount(first[inside] * dims + h[inside], minlength=len(texts) * dims)
    return flat.reshape(len(texts), dims).astype(np.float32)
