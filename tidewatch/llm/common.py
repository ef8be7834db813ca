"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.session import truncate_lineage

WORD_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


BATCH_BYTES = 8 << 20  # of an Arrow batch between the JVM and Python, whatever the number of rows


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return truncate_lineage(df, name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of anything but blank, tab, line feed, vertical tab, form feed and return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def row_bytes(batch) -> np.ndarray:
    """Bytes of each row of an Arrow batch: exact for texts and binaries, an average for other columns."""
    size = np.full(batch.num_rows, 8, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif batch.num_rows:
            size += column.nbytes // batch.num_rows
    return size


def pieces(batches: Iterator, rows: int, most_bytes: int = 4 << 20) -> Iterator:
    """Arrow batches cut to at most `rows` rows and `most_bytes` each; a single longer row is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(row_bytes(batch))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + most_bytes, "right"))
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def compact(df: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """A staged table read by as many tasks as its rows need, not one a file: few pairs of a large corpus lie in many small files."""
    return df.coalesce(df.count() // rows_per_task + 1)


def small(df: DataFrame, most_rows: int = 2_000_000) -> DataFrame:
    """Mark a narrow side of a join for broadcast if it has at most `most_rows` rows; otherwise leave the join to the planner."""
    df = stage(df, "side")
    return F.broadcast(df) if df.count() <= most_rows else df
