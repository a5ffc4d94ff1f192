"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

A table's key is the side of each of its hyperplanes that a vector lies on. Vectors that share a key in some table are compared
exactly. Equal vectors are one vector with a count throughout. Within a key all comparisons are matrix products that
leave behind a count for each vector and links that span each group, never the pairs; a key with many
vectors is cut into blocks, each pair of blocks being a task's work of its own. The work within a dense key of different vectors grows with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.arrays import starts_of, whole_groups
from spindrift.llm.components import connected_components
from spindrift.llm.vectors import finite, matrix, slices
from spindrift.staging import discard, staged

THRESHOLD = 0.95
#: Share of the pairs exactly at the threshold that the tables should find; nearer pairs are found more often.
RECALL = 0.997
#: Vectors that a key should hold if they lay about at random.
PER_KEY = 16
#: Vectors of a block of a key, and rows compared at once.
BLOCK, ROWS = 4096, 512
SEED = 7
#: Components of a chunk of the hyperplanes.
WIDE = 4096


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` distinct vectors."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 1) / PER_KEY)) if n > PER_KEY else 6))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _planes(chunk: int, width: int, count: int) -> np.ndarray:
    """The hyperplanes' components from ``chunk * WIDE`` on; those of a chunk depend on nothing else."""
    return np.random.default_rng([SEED, chunk]).standard_normal((WIDE, count))[:width]


def _signed(bits: int, tables: int):
    weights = 1 << np.arange(bits, dtype=np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _planes(0, WIDE, tables * bits)
        for batch in batches:
            for some in slices(batch, 1):
                m = matrix(some.column(1), -1)
                sums = np.zeros((len(m), tables * bits))
                for at in range(0, m.shape[1], WIDE):
                    part = m[:, at : at + WIDE]
                    sums += part @ (first[: part.shape[1]] if not at else _planes(at // WIDE, part.shape[1], tables * bits))
                keys = ((sums > 0).reshape(len(m), tables, bits) @ weights).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=["rep", "vec", "copies", "keys"])

    return of


def _compared(threshold: float):
    """From groups of (table, key, low, high): each vector's links, and links that span the groups' components."""

    def group(rep, unit, copies, keys, block, table, low, high, out):
        n = len(rep)
        links = np.zeros(n, dtype=np.int64)
        label = np.arange(n)
        found: list[tuple[int, int]] = []
        for at in range(0, n, ROWS):
            near = unit[at : at + ROWS] @ unit.T >= threshold
            rows = np.arange(at, min(at + ROWS, n))
            near[np.arange(len(rows)), rows] = False
            if low != high:
                near &= block[rows][:, None] != block[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            # A pair counts in the first table that holds both.
            for some in range(0, len(a), 1 << 18):
                i, j = a[some : some + (1 << 18)], b[some : some + (1 << 18)]
                first = ~(keys[rows[i], :table] == keys[j, :table]).any(axis=1)
                np.add.at(links, rows[i[first]], copies[j[first]])
            for row in np.unique(a).tolist():
                reached = np.unique(label[near[row]])
                own = label[at + row]
                if len(reached) == 1 and reached[0] == own:
                    continue
                root = min(own, int(reached[0]))
                for other in {own, *reached.tolist()} - {root}:
                    found.append((int(rep[other]), int(rep[root])))
                label[np.isin(label, np.append(reached, own))] = root
        some = np.flatnonzero(links)
        out.append((rep[some], np.full(len(some), -1), links[some]))
        if found:
            a, b = np.array(found).T
            out.append((a, b, np.zeros(len(a), dtype=np.int64)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["table", "key", "low", "high"]
        for whole in whole_groups(batches, names):
            whole = whole.combine_chunks()
            table, key, low, high, block, rep, copies = (np.asarray(whole.column(c)) for c in [*names, "block", "rep", "copies"])
            starts = starts_of([table, key, low, high])
            ends = np.append(starts[1:], len(rep))
            out: list = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                m = matrix(whole.column("vec").slice(s, e - s), -1)
                unit = m / np.linalg.norm(m, axis=1, keepdims=True)
                keys = matrix(whole.column("keys").slice(s, e - s), -1).astype(np.int32)
                group(rep[s:e], unit, copies[s:e], keys, block[s:e], int(table[s]), int(low[s]), int(high[s]), out)
            if out:
                a, b, links = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], names=["a", "b", "links"])

    return of


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``df``: its id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other rows found at the threshold or above, ``component_id`` is the smallest id that links reach.
    Vectors that are null, zero or hold null or non-finite components link with nothing and are their own component.
    Vectors of different length are compared as if zeros followed the shorter one. Rows that repeat an id count each on its
    own and come back each. A row with a null id takes no part: no links, null component, not kept. Columns beside the
    two named play no part. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    valid = rows.where(F.col("id").isNotNull() & finite("vec") & F.exists("vec", lambda x: x != 0))
    # 0.0 and -0.0 are one number; adding zero makes them one list as well.
    valid = valid.select("id", F.transform("vec", lambda x: x + F.lit(0).cast("float")).alias("vec"))
    reps = staged(valid.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "vec", "copies"), "vectors")
    n = reps.count()
    bits, tables = plan(n, threshold, recall)
    signed = staged(reps.mapInArrow(_signed(bits, tables), f"rep {rows.schema['id'].dataType.simpleString()}, {_kind(reps)}, copies long, keys array<int>"), "signed")

    # Keys and ids alone are counted and joined; a vector is fetched for each of its keys that another vector holds.
    keyed = signed.select("rep", F.posexplode("keys").alias("table", "key"))
    shared = staged(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shared-keys")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "table"), "blocks").cast("int")
    cut = keyed.join(shared, ["table", "key"]).withColumn("blocks", blocks).withColumn("block", own)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    where = ["table", "key", "low", "high"]
    dealt = cut.join(signed, "rep").select(*where, "block", "rep", "copies", "vec", "keys").repartition(*where).sortWithinPartitions(*where)
    found = staged(dealt.mapInArrow(_compared(threshold), "a long, b long, links long"), "found")

    discard(signed)
    discard(shared)
    counts = found.where("b = -1 and links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    reached = connected_components(found.where("links = 0").select("a", "b")).withColumnRenamed("node", "rep")
    named = reps.join(counts, "rep", "left").join(reached, "rep", "left")
    named = named.select("vec", "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = valid.join(named, "vec").select("id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where(~(F.col("id").isNotNull() & finite("vec") & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))))
    alone = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.withColumnRenamed("id", id_col)


def _kind(reps: DataFrame) -> str:
    return f"vec {reps.schema['vec'].dataType.simpleString()}"
