"""Exact top-k search by integer inner product, with candidates eliminated through a table of pivots.

Every vector's distance to each of many pivots is computed once. For a query q and a candidate x the largest difference of
their pivot distances is a lower bound of their distance, and since twice their inner product is |q|^2 + |x|^2 less the
squared distance, an upper bound of their score. Candidates lie in cells around their nearest pivot, and the smallest and largest distance of a cell's members
to all pivots bound a whole cell. A query first meets one block of its own cell, whose k-th best score it takes along; then it goes to the blocks of
only those cells whose bound reaches that score, and in each block the candidates are evaluated in the order of their bound until it falls
below the k-th best exact score. A block's candidates are shuffled once and held by one task, which the queries pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.arrays import starts_of
from spindrift.llm.vectors import BLOCK_VALUES, finite, matrix, slices
from spindrift.staging import staged

#: Pivots, and the vectors among which they are chosen, those whose ids hash lowest.
PIVOTS, CHOSEN_FROM = 64, 1024
#: Rows of a block of candidates at most; its values are bounded as well.
BLOCK_ROWS = 16384
#: Pivots that bound a candidate, those nearest to the query, and candidates evaluated at first; then as many as before, all together.
NEAREST, STEP = 8, 512
#: Whole numbers up to this are exact in doubles, and so are sums of products that stay below it.
EXACT = 2.0**53
SEED = 5
#: Share by which bounds are widened, as distances are kept as floats.
SLACK = 1e-6


class Vectors(NamedTuple):
    """Ids, whole numbers as doubles, lengths and distances to the pivots."""

    ids: np.ndarray
    rows: np.ndarray
    norms: np.ndarray
    away: np.ndarray


def scaled(lists: pa.Array, scale: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * matrix(lists, width))


def spread(rows: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the rows, each as far as can be from all before it; equal rows are one."""
    rows = np.unique(rows, axis=0)
    if not len(rows):
        return rows
    chosen, apart = [0], np.linalg.norm(rows - rows[0], axis=1)
    while len(chosen) < n and apart.max() > 0:
        chosen.append(int(np.argmax(apart)))
        np.minimum(apart, np.linalg.norm(rows - rows[chosen[-1]], axis=1), out=apart)
    return rows[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's distances to the pivots; both are filled up with zeros to the same width."""
    wide = max(rows.shape[1], pivots.shape[1])
    rows, pivots = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (rows, pivots))
    out = np.empty((len(rows), len(pivots)), dtype=np.float32)
    for p, pivot in enumerate(pivots):
        with np.errstate(over="ignore"):
            out[:, p] = np.linalg.norm(rows - pivot, axis=1)
    out[~np.isfinite(out)] = np.nan  # beyond a float: nothing is known
    return out


def bounds(q2, x2, apart):
    """Upper bounds of scores from squared lengths and a lower bound of the distance; infinite where doubles can't tell."""
    with np.errstate(over="ignore", invalid="ignore"):
        both = q2 + x2
        low = np.maximum(apart - SLACK * np.sqrt(both), 0)
        return np.nan_to_num((both - low * low) / 2 + SLACK * both + 1, nan=np.inf)


def best_of_block(queries: Vectors, least: np.ndarray, block: Vectors, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query its position, the ids and scores of its best candidates of the block, ties to smaller ids, and how many were evaluated.

    A query has at most k and only those that reach ``least``. Scores are exact: sums that doubles can't hold are added as whole numbers of any size.
    """
    if not len(block.ids):
        return
    with np.errstate(over="ignore"):
        q2, x2, away = queries.norms**2, block.norms**2, np.ascontiguousarray(block.away.T)
    for i in range(len(queries.ids)):
        # The pivots about a query tell most: what lies far from them lies far from it.
        near = np.argsort(queries.away[i])[:NEAREST]
        with np.errstate(invalid="ignore"):
            apart = np.fmax.reduce(np.abs(away[near] - queries.away[i, near, None]), axis=0)
        ub = bounds(q2[i], x2, np.nan_to_num(apart, nan=0.0).astype(np.float64))
        rest = np.flatnonzero((ub >= least[i]) & (block.ids != queries.ids[i]))
        if len(rest) > STEP:
            rest = rest[np.argsort(-ub[rest], kind="stable")]
        ids, scores, seen, limit = np.empty(0, dtype=block.ids.dtype), np.empty(0), 0, least[i]
        while seen < len(rest) and ub[rest[seen]] >= limit:
            now = rest[seen : seen + max(STEP, seen)]
            seen += len(now)
            told = _scores(queries.rows[i], queries.norms[i], block.rows[now], block.norms[now])
            ids, scores = _kept(np.append(ids, block.ids[now]), np.append(scores, told), k)
            if len(scores) == k:
                limit = max(limit, _below(scores[-1]))
        reach = np.array([s >= least[i] for s in scores], dtype=bool)
        yield i, ids[reach], scores[reach], seen


def _scores(q: np.ndarray, q_norm: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        large = ~(q_norm * norms < EXACT)
    if not large.any():
        return rows @ q
    whole = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(row.tolist(), whole, strict=True)) for row in rows] + [None], dtype=object)[:-1]


def _below(score) -> float:
    """A double that is no more than a score."""
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return float(np.finfo(float).max) if score > 0 else float("-inf")


def _kept(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda x: (-scores[x], ids[x]))[:k], dtype=int)
        return ids[order], scores[order]
    if len(ids) > 4 * k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


#: A score as a long, or, beyond longs, its sign and a text that sorts as the number does.
FOUND = ("tier", "large", "score")


def _columns(scores: list[int]) -> list[pa.Array]:
    fits = [-(1 << 63) <= s < 1 << 63 for s in scores]
    tier = pa.array([0 if f else 1 if s > 0 else -1 for s, f in zip(scores, fits, strict=True)], pa.int32())
    large = pa.array(["" if f else _sortable(s) for s, f in zip(scores, fits, strict=True)], pa.string())
    return [tier, large, pa.array([s if f else None for s, f in zip(scores, fits, strict=True)], pa.int64())]


def _sortable(n: int) -> str:
    digits = str(abs(n))
    text = f"{len(digits):06d}{digits}"
    return text if n > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))


def _prepared(pivots: np.ndarray, scale: int):
    """From rows of id and vector: whole numbers, distances to the pivots, the cell and the length; vectors that no double can hold are gone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                rows = scaled(some.column(1), scale, -1)
                good = np.isfinite(rows).all(axis=1)
                rows, ids = rows[good], some.column(0).filter(pa.array(good))
                away = distances(rows, pivots)
                with np.errstate(over="ignore"):
                    norms = np.linalg.norm(rows, axis=1)
                cell = np.argmin(np.nan_to_num(away, nan=np.inf), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, _lists(rows), pa.array(norms), pa.array(cell), _lists(away)], names=["id", "vec", "norm", "cell", "away"])

    return of


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell in a partition the rows, the longest vector and list, and the smallest and largest distance to each pivot."""
    seen: dict[int, list] = {}
    for batch in batches:
        cell, norm = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        away, size = matrix(batch.column(2), -1).astype(np.float32), np.asarray(batch.column(3))
        for c in np.unique(cell).tolist():
            mine = cell == c
            now = [int(mine.sum()), norm[mine].max(), int(size[mine].max()), np.fmin.reduce(away[mine]), np.maximum.reduce(away[mine])]
            old = seen.get(c)
            seen[c] = now if old is None else [old[0] + now[0], max(old[1], now[1]), max(old[2], now[2]), np.fmin(old[3], now[3]), np.maximum(old[4], now[4])]
    if seen:
        columns = [pa.array(list(seen), pa.int32()), *[pa.array([x[i] for x in seen.values()], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int32()))], *[_lists(np.stack([x[i] for x in seen.values()])) for i in (3, 4)]]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", "norm", "size", "low", "high"])


class Cells:
    """What bounds each cell; as many rows as there are pivots."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.cell)
        self.cells, self.norms = np.array([r.cell for r in rows], dtype=np.int32), np.array([r.norm for r in rows])
        self.low, self.high = (np.array([r[c] for r in rows], dtype=np.float32) for c in ("low", "high"))
        # A block holds so many rows that its values stay bounded.
        self.blocks = [max(1, -(-r.n // max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, r.size))))) for r in rows]

    def reached(self, norms: np.ndarray, away: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query and cell whether some member may reach the query's least score."""
        out = np.empty((len(norms), len(self.cells)), dtype=bool)
        for i in range(len(norms)):
            with np.errstate(invalid="ignore", over="ignore"):
                gap = np.nan_to_num(np.fmax(away[i] - self.high, self.low - away[i]), nan=0.0)
                out[i] = bounds(norms[i] ** 2, self.norms**2, np.maximum(gap.max(axis=1), 0).astype(np.float64)) >= least[i]
        return out


def _told(cells: Cells):
    """From queries, with the least score that counts, a copy for each block of each cell that they may find something in."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = cells.reached(np.asarray(batch.column(2)), matrix(batch.column(3), -1).astype(np.float32), np.asarray(batch.column(4)))
            for at in range(len(cells.cells)):
                rows = pa.array(np.flatnonzero(some[:, at]))
                if len(rows):
                    taken = batch.take(rows)
                    for b in range(cells.blocks[at]):
                        where = [pa.array(np.full(len(rows), x, dtype=np.int32)) for x in (cells.cells[at], b)]
                        yield pa.RecordBatch.from_arrays([*where, *taken.columns], names=["cell", "block", *batch.schema.names])

    return of


def _searched(k: int):
    """From rows sorted by (cell, block, asked), candidates before queries: the best of each block for each query."""

    def vectors(batch) -> Vectors:
        return Vectors(np.asarray(batch.column("id")), matrix(batch.column("vec"), -1), np.asarray(batch.column("norm")), matrix(batch.column("away"), -1).astype(np.float32))

    def widened(a: np.ndarray, wide: int) -> np.ndarray:
        return a if a.shape[1] == wide else np.pad(a, ((0, 0), (0, wide - a.shape[1])))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("cell", "block", "asked")]
            starts = starts_of([keys[0], keys[1], keys[2].cast(pa.int8())])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                run, where = batch.slice(s, e - s), (keys[0][s].as_py(), keys[1][s].as_py())
                if where != here:
                    here, parts, block = where, [], None
                if not keys[2][s].as_py():
                    parts.append(run)
                    continue
                if block is None:
                    block = vectors(pa.Table.from_batches(parts).combine_chunks()) if parts else False
                    parts = []
                if block is False:
                    continue
                for some in slices(run, run.schema.get_field_index("vec")):
                    asked = vectors(some)
                    wide = max(asked.rows.shape[1], block.rows.shape[1])
                    left, right = (v._replace(rows=widened(v.rows, wide)) for v in (asked, block))
                    out = [(np.full(len(ids), left.ids[i]), ids, scores) for i, ids, scores, _ in best_of_block(left, np.asarray(some.column("least")), right, k)]
                    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *_columns([int(x) for x in c.tolist()])], names=["query_id", "id", *FOUND])

    return of


def exact_top_k(df: DataFrame, queries, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id_col, score)``: the k best rows for each row that the column ``queries`` selects.

    A component x counts as floor(scale * x); the score is the integer inner product, ties go to the smaller id. Scores are exact however large: those
    that a long can't hold are ranked rightly, and ``score`` is null for them. A query's candidates are all rows but those with its own id. Vectors that are null or hold null or
    non-finite components, or a component whose multiple is beyond a double, and rows with a null id, take no part. Vectors of different length are compared as if zeros followed the
    shorter one. Rows that repeat an id and a vector are one query, and as candidates each counts. Columns beside the two named play no
    part. An empty table gives an empty result.

    The pivots are chosen, far from each other, among ``CHOSEN_FROM`` vectors; any choice gives the same result. A task holds one block of bounded size, or one vector.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), queries.alias("asked"))
    valid = rows.where(F.col("id").isNotNull() & finite("vec"))
    # Vectors among which pivots are chosen have a bounded length, so that the driver holds a bounded number of values.
    sample = valid.where(F.size("vec") <= BLOCK_VALUES // CHOSEN_FROM).select("vec").orderBy(F.xxhash64("id"), "id").limit(CHOSEN_FROM).collect()
    pivots = scaled(pa.array([r.vec for r in sample], pa.list_(pa.float64())), scale, -1)
    pivots = spread(pivots[np.isfinite(pivots).all(axis=1)], PIVOTS)
    pivots = pivots if len(pivots) else np.zeros((1, 1))
    kind = "id long, vec array<double>, norm double, cell int, away array<float>"
    table = staged(valid.select("id", "vec").mapInArrow(_prepared(pivots, scale), kind), "pivot-table")
    told = table.select("cell", "norm", "away", F.size("vec").alias("size")).mapInArrow(_extremes, "cell int, n long, norm double, size int, low array<float>, high array<float>")
    # Combined by cell before it comes to the driver: as many rows as there are pivots, however many partitions.
    told = told.select("cell", "n", "norm", "size", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    told = told.groupBy("cell", "at").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), F.max("size").alias("size"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    told = told.groupBy("cell").agg(F.max("n").alias("n"), F.max("norm").alias("norm"), F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("x"))
    found = told.select("cell", "n", "norm", "size", F.col("x.low").alias("low"), F.col("x.high").alias("high")).collect()
    if not found:
        return df.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    cells = Cells(found)

    nothing = F.lit(float("-inf")).cast("double")
    blocks = dict(zip(cells.cells.tolist(), cells.blocks, strict=True))
    blocks = F.get(F.array(*[F.lit(blocks.get(c, 1)) for c in range(len(pivots))]), F.col("cell"))
    # Candidates are dealt at random, so that equal ones fill no block however many there are.
    held = table.select("cell", F.floor(F.rand(SEED) * blocks).cast("int").alias("block"), "id", "vec", "norm", "away", nothing.alias("least"), F.lit(False).alias("asked"))
    asked = table.join(valid.where("asked").select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "vec"])

    def searched(copies: DataFrame) -> DataFrame:
        """The best of each block that a copy of a query was sent to, ranked by query."""
        both = held.unionByName(copies.withColumn("asked", F.lit(True)))
        dealt = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "asked")
        best = Window.partitionBy("query_id").orderBy(F.desc("tier"), F.desc("large"), F.desc("score"), "id")
        return dealt.mapInArrow(_searched(k), "query_id long, id long, tier int, large string, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = searched(asked.select("cell", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id", "vec", "norm", "away", nothing.alias("least")))
    # A double no larger than the k-th score; one beyond longs is no bound.
    near = F.col("score").cast("double")
    least = first.where((F.col("rank") == k) & (F.col("tier") == 0)).select(F.col("query_id").alias("id"), (near - 1e-12 * F.abs(near) - 1).alias("least"))
    known = asked.join(least, "id", "left").select("id", "vec", "norm", "away", F.coalesce("least", nothing).alias("least"))
    whole = searched(known.mapInArrow(_told(cells), "cell int, block int, id long, vec array<double>, norm double, away array<float>, least double"))
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
