"""The vector cache: how many held vectors lie within a cosine of each asked one.

Held and asked vectors are dealt into tiles, one of a part of the held and a block of the asked ones, which are compared as one matrix product in
single precision. Its error is bounded; pairs nearer to the threshold than the bound are decided in double precision, summed in order
as SQL sums them. Every pair is compared, so the work grows with the product of both tables, and only counts leave a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of the asked vectors that a task holds, about.
ASKED_VALUES = 4 << 20
#: Pairs that are worth a tile of their own, and held vectors of a part once there are ``PARTS``, so that asked vectors are not copied more often.
PAIRS, HELD, PARTS = 1 << 24, 1 << 16, 48
#: Asked and held vectors multiplied at once, and components of the held ones.
ROWS, COLUMNS, VALUES = 512, 4096, 1 << 20


def _units(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, their squared lengths, and unit vectors in single precision: zero where there is no direction."""
    v = np.array(vectors.flatten(), dtype=np.float64).reshape(len(vectors), width)
    largest = np.abs(v).max(axis=1)
    sound = np.isfinite(largest) & (largest > 0)
    v[~sound] = 0
    v = np.ldexp(v, -np.frexp(np.where(sound, largest, 1))[1][:, None])
    squares = _dots(v, v)
    return v, squares, (v / np.sqrt(np.where(sound, squares, 1))[:, None]).astype(np.float32)


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray | slice = slice(None), j: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Inner products of rows ``i`` and ``j``, summed from the first component to the last."""
    out = 0.0
    for k in range(a.shape[1]):
        out = out + a[i, k] * b[j, k]
    return out


class _Block:
    """Asked vectors of one width in the order of their ids, and what has been counted for them."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, width: int, above: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.width, self.above = ids[order], width, above
        self.vectors, self.squares, self.units = _units(vectors.take(pa.array(order)), width)
        self.hits = np.zeros(len(ids), dtype=np.int64)
        # The roundings of the unit vectors' components and of a product's sums in any order.
        self.slack = np.float32(1.01 * (width + 8) * 2.0**-24)

    def count(self, ids: np.ndarray, vectors: pa.Array) -> None:
        held, squares, units = _units(vectors, self.width)
        for at in range(0, len(self.ids), ROWS):
            rows = slice(at, at + ROWS)
            near = self.units[rows] @ units.T
            # A cosine without a direction is not a number, which SQL sorts above every number.
            near[self.squares[rows] == 0] = near[:, squares == 0] = 2
            first, end = np.searchsorted(self.ids[rows], ids, "left"), np.searchsorted(self.ids[rows], ids, "right")
            own = np.repeat(np.arange(len(ids)), end - first)
            near[np.arange(len(own)) - np.repeat(np.cumsum(end - first) - end, end - first), own] = -2
            sure, perhaps = near > self.above + self.slack, near > self.above - self.slack
            self.hits[rows] += [np.count_nonzero(x) for x in sure]
            i, j = np.divmod(np.flatnonzero(sure != perhaps), len(ids))
            if len(i):
                hit = _dots(self.vectors, held, at + i, j) / np.sqrt(self.squares[at + i] * squares[j]) > self.above
                np.add.at(self.hits, at + i[hit], 1)


def _counted(above: float):
    """From rows of (tile, held, id, vec), a tile's asked ones first: an asked id and its hits among the tile's held rows."""

    def of_width(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
        sizes, ids = np.asarray(vectors.value_lengths()), np.asarray(ids)
        for width in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == width)
            yield width, ids[some], vectors if len(some) == len(ids) else vectors.take(pa.array(some))

    def done(blocks: dict[int, _Block]) -> Iterator[pa.RecordBatch]:
        for block in blocks.values():
            some = block.hits > 0
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[some]), pa.array(block.hits[some])], names=["id", "hits"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked, blocks = None, [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            turn = np.asarray(batch.column("tile")) * 2 + np.asarray(batch.column("held"))
            starts = np.flatnonzero(np.diff(turn, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], len(turn)], strict=True):
                some = batch.slice(start, end - start)
                if turn[start] // 2 != tile:
                    yield from done(blocks)
                    tile, asked, blocks = turn[start] // 2, [], {}
                if turn[start] % 2 == 0:
                    asked.append(some)
                    continue
                if asked:
                    whole = pa.Table.from_batches(asked).combine_chunks()
                    ids, vectors = (whole.column(c).combine_chunks() for c in ("id", "vec"))
                    blocks, asked = {w: _Block(i, v, w, above) for w, i, v in of_width(ids, vectors)}, []
                for width, ids, vectors in of_width(some.column("id"), some.column("vec")):
                    step = max(1, min(COLUMNS, VALUES // width))
                    for at in range(0, len(ids) if width in blocks else 0, step):
                        blocks[width].count(ids[at : at + step], vectors.slice(at, step))
        yield from done(blocks)

    return of


def cache_hits(rows: DataFrame, asked: str, above: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The id and ``hits`` of each row that the condition ``asked`` selects: how many rows of another id have a cosine above ``above``; those without are left out.

    Vectors are compared with vectors of their own length. A zero vector, or one with a component that is not finite, has no cosine, and SQL takes
    that as above any number. Rows take no part if the id, the vector or a component is null or the vector is empty.
    """
    held = rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull()))
    some = held.where(asked)
    n = held.count()
    few, values = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(vec_col)), F.lit(0))).first()
    blocks = max(1, -(-values // ASKED_VALUES))
    parts = max(1, min(-(-n * few // (blocks * PAIRS)), max(PARTS, -(-n // HELD))))

    def dealt(df: DataFrame, kind: int, own: int, others: int, tile) -> DataFrame:
        # Dealt round by position, so that neither many rows of one id nor many equal vectors meet in one tile.
        df = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), (F.monotonically_increasing_id() % own).alias("own"))
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select("id", "vec", "own", other.alias("other")).select(tile.cast("int").alias("tile"), F.lit(kind).alias("held"), "id", "vec")

    both = dealt(some, 0, blocks, parts, F.col("own") * parts + F.col("other")).unionByName(dealt(held, 1, parts, blocks, F.col("other") * parts + F.col("own")))
    tiles = both.repartitionById(blocks * parts, F.col("tile")).sortWithinPartitions("tile", "held")
    counted = tiles.mapInArrow(_counted(above), f"id {rows.schema[id_col].dataType.simpleString()}, hits long")
    return counted.groupBy(F.col("id").alias(id_col)).agg(F.sum("hits").alias("hits"))
