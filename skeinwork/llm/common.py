"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.storage import forget, in_buckets  # noqa: F401  (for the operators)
from skeinwork.storage import settle as materialize  # noqa: F401
from skeinwork.storage import shared_path as work_dir  # noqa: F401

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


#: Rows and bytes of the batches that Python workers get, where the session has Spark's own defaults: texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}
#: For Python workers of long jobs: what they free goes back to the machine at once (which takes a fifth to a half more CPU time).
WORKERS = {"MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_batches(spark: SparkSession) -> None:
    """Bound what a batch of texts takes in executors and their Python workers; a session's own settings stay."""
    for key, (default, own) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


def give_memory_back(spark: SparkSession) -> None:
    """Python workers that start from now on don't keep what they free."""
    for key, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 marks held-out rows (a null id: null)."""
    return F.crc32(doc_id.cast("string")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null has no bytes."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` with about ``most_bytes`` of ``column`` each (one row at least): bounds working memory."""
    if batch.num_rows == 0:
        return
    off, _ = string_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of the given ranges, one after another."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def row_of_byte(off: np.ndarray) -> np.ndarray:
    """For each byte, the row it belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i + 1]]; 0 for empty ranges."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[off[1:]] - total[off[:-1]]


#: Shares that the rows of one key are spread over when they are joined back to what was computed for the key.
SALTS = 64


def salt(*spread: str) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")


def with_group(df: DataFrame, key: str, spread: list[str], *aggregates: Column) -> DataFrame:
    """``df`` with aggregates of each row's group, none null; rows with a null key are lost.

    Aggregates combine before the shuffle.  The rows of a key are spread over SALTS
    shares by the columns ``spread``, and a group's aggregates go only to the shares
    that have a row of it, so a very large group isn't gathered in one task.
    """
    rows = df.withColumn("__salt", salt(*spread))
    groups = rows.groupBy(key).agg(*aggregates, F.collect_set("__salt").alias("__salts"))
    groups = groups.withColumn("__salt", F.explode("__salts")).drop("__salts")
    return rows.join(groups, [key, "__salt"]).drop("__salt")
