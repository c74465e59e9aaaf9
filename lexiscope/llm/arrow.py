"""Helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20


def keyed_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the text alone, a null text as the empty one: other columns can't clash."""
    return docs.select(
        F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores behind it as make it none of the table's columns."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of an Arrow array, and where each begins and ends in them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, ends, values = column.buffers()
    count = len(column)
    if count == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(ends, width)[column.offset : column.offset + count + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def small_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator:
    """Cut a batch into runs of whole rows of about ``limit`` bytes of text each."""
    _, bounds = utf8_of(batch.column(column))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield batch.slice(first, last - first)
        first = last


def split_words(
    data: np.ndarray, bounds: np.ndarray, cuts: np.ndarray | None = None
) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, between ASCII white space, and the number of the first of each text.

    ``data`` and ``bounds`` are as ``utf8_of`` gives them; the numbers end with that of all words.
    ``cuts`` marks bytes at which a word begins besides.
    """
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[begins] = inside[begins]
    if cuts is not None:
        starts |= cuts & inside
    at = np.flatnonzero(starts)
    packed = data[inside]
    offsets = np.append((np.cumsum(inside) - 1)[at], len(packed)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(
        len(at), pa.py_buffer(offsets), pa.py_buffer(packed)
    )
    return words, np.searchsorted(at, bounds)
