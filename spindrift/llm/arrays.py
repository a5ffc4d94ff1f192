"""Small helpers for operators whose work runs over Arrow batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows turned into Python objects at once, so that memory follows a few texts and not a whole batch.
ROWS_AT_ONCE = 128


def values(column: pa.Array) -> Iterator:
    """The column's values as Python objects, a few at a time."""
    for at in range(0, len(column), ROWS_AT_ONCE):
        yield from column.slice(at, ROWS_AT_ONCE).to_pylist()


def cut_by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in a column hold ``most`` bytes together, or are one row."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at, before = 0, 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables cut between groups, from batches sorted by ``keys``: no group spans two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = starts_of([batch.column(k) for k in keys])[-1]
        if held and _last(held[-1], keys) != _row(batch, keys, 0):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def starts_of(columns: list[pa.Array]) -> np.ndarray:
    """Where each group of equal neighbours starts; the columns hold integers without nulls."""
    arrays = [np.asarray(c) for c in columns]
    new = np.zeros(len(arrays[0]), dtype=bool)
    new[:1] = True
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _row(batch: pa.RecordBatch, keys: list[str], at: int) -> tuple:
    return tuple(batch.column(k)[at].as_py() for k in keys)


def _last(batch: pa.RecordBatch, keys: list[str]) -> tuple:
    return _row(batch, keys, batch.num_rows - 1)


def made_on_a_worker(rows: DataFrame, make: Callable[[list[dict]], object]) -> object:
    """What ``make`` builds from all of a bounded number of rows, in one task of its own."""
    return made_on_workers(rows, lambda all_, _: make(all_), 1)[0]


def made_on_workers(rows: DataFrame, make: Callable[[list[dict], int], object], times: int) -> list:
    """What ``make`` builds from all of a bounded number of rows and each number below ``times``, in as many tasks; nothing from no rows.

    Numeric libraries start as many threads as the machine has cores in the driver, but one in a Spark worker, where
    the cores are shared out. The results come back pickled, and must be small.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row.pop("__time"), []).append(row)
        for time in sorted(held):
            made = make(held.pop(time), time)
            yield pa.RecordBatch.from_arrays([pa.array([time], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())], names=["time", "made"])

    rows.sparkSession.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    each = rows.withColumn("__time", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).repartitionByRange(times, "__time")
    return [pickle.loads(r["made"]) for r in sorted(each.mapInArrow(of, "time int, made binary").collect())]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the pairs reach from it."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], dtype=np.int64)
