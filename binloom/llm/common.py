"""Helpers that the text operators share: tables, Arrow batches, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from one row in so many on; there are fewer hot keys than this.
HOT_SHARE = 1000
#: Text bytes that one vectorised step works on.
STEP_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filled(column: str = "text"):
    """The text column, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def attach(rows: DataFrame, lookup: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``lookup``, which has one row per key; ``size`` holds the key's rows.

    Keys of more than ``total / HOT_SHARE`` rows are joined by broadcast. Their sizes add up
    to ``total``, so there are fewer than ``HOT_SHARE`` of them; all others are shuffled.
    """
    hot = lookup.where(F.col(size) * HOT_SHARE > F.lit(total))
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup, key, how)
    )


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            floor = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, floor + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the offsets of the texts; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit values."""
    values = values.astype(np.uint64)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values
