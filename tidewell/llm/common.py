"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import run_dir, shared_dir, shuffles_freed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on whole texts read; whatever else the table has stays unread."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def folded(docs: DataFrame) -> DataFrame:
    """doc, a struct of all columns but the text, and text: whatever names the columns have, an operator's own ones never meet them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("doc"), F.col("text").cast("string").alias("text"))


def unfolded(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, from the doc and text of a frame that ``folded`` began."""
    kind = docs.schema["text"].dataType
    return df.select(*(F.col("text").cast(kind).alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared checkpoint folder, for several readers; losing an executor loses nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with shuffles_freed(spark):
        # The setting counts for frames made under it.
        return df.select("*").checkpoint()


BatchFunction = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _freed(batches: Iterator[pa.RecordBatch], work: BatchFunction) -> Iterator[pa.RecordBatch]:
    try:
        yield from work(batches)
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
        if trim:
            trim(0)


def freed(work: BatchFunction) -> BatchFunction:
    """A batch function that gives unused memory back to the system at the end of its task.

    Workers live on for later tasks; without this, an idle one holds the most that any of its tasks took.
    """
    return partial(_freed, work=work)


TIGHT_ROWS = 200_000


def tight(df: DataFrame) -> DataFrame:
    """A stored frame of narrow rows in as few partitions as its rows need, so that small joins stay small jobs."""
    return df.coalesce(max(1, -(-df.count() // TIGHT_ROWS)))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as its UTF-8 bytes and row offsets (int64, one more than rows); a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most_bytes: int):
    """Consecutive row ranges of about most_bytes each; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] values, then the same for the next range."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BROADCAST_BYTES = 64_000_000


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored frame with rows of a known width as a join side: broadcast if it is counted to be small, else shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a large intermediate table compressed to the shared folder; the frame that reads it and its place."""
    place = run_dir(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.select("*").write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place


def discard(spark: SparkSession, place: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
