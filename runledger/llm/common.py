"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import cut, shared_dir

__all__ = ["BROADCAST_ROWS", "SPACE", "arrow_slices", "cut", "lean", "packed", "shared_dir", "table", "text_buffer", "with_ids"]

#: Words of the documents contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows up to which a side of one or two long columns may be broadcast (16 bytes a row: 16 MB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ids(big: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Joins big with a cut table of keys: by broadcast up to BROADCAST_ROWS rows, by shuffle beyond."""
    small = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return big.join(small, key, how)


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """row, a struct of all columns, beside keys: a join on the keys can't meet columns of the same name."""
    return df.select(F.struct(F.col("*")).alias("row"), *(k.alias(n) for n, k in keys.items()))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, after which a task gives freed memory back to the system: Spark keeps its Python workers for later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped


def arrow_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold max_bytes at most, or one text."""
    offsets = text_buffer(batch.column(column))[1]
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; nulls become empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    elif pa.types.is_string(column.type):
        wide = np.int32
    else:
        return text_buffer(column.cast(pa.large_string()))
    _, offsets, data = column.buffers()
    rows = len(column)
    if not rows:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + rows + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at

