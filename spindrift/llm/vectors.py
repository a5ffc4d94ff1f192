"""What the vector operators share: which vectors take part, and lists of floats as one matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """True where the list is there and every component is a finite number; an empty list passes."""
    infinite = [F.lit(float("inf")), F.lit(float("-inf"))]
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(infinite))
    return F.coalesce(good, F.lit(False))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles from a list array without nulls, filled up with zeros to ``width``, or if that is negative to the longest."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = np.asarray(lists.values, dtype=np.float64)[offsets[0] : offsets[-1]] if len(lists) else np.empty(0)
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0)) if width < 0 else width
    if len(lists) and (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


#: Values of vectors that are looked at together.
BLOCK_VALUES = 4 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold ``BLOCK_VALUES`` values in a list column at most once the lists are filled up to the longest of them, or one row."""
    sizes = np.diff(np.asarray(batch.column(column).offsets, dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        filled = np.maximum.accumulate(sizes[at:]) * np.arange(1, batch.num_rows - at + 1)
        n = max(1, int(np.searchsorted(filled, BLOCK_VALUES, side="right")))
        yield batch.slice(at, n)
        at += n
