"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of cells; virtual nodes stand at cells, and a key belongs to the next virtual node clockwise. The
counts of keys by cell, a table of fixed size, decide where each shard fills up: walking the ring once, keys fill their node's
shard up to its bound and overflow to the next node whose shard has room. That yields spans of ranks within
cells, and a key's place follows from its cell and its rank there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.staging import staged

#: Cells of the ring as a power of two, and virtual nodes of a shard. The spans are at most the cells and the shards that fill up.
CELL_BITS = 16
NODES = 128


def nodes(shards: int, per_shard: int = NODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """``(cell, shard)`` of every virtual node in ring order. A shard's nodes depend on its number alone."""
    named = ((f"{shard}/{i}", shard) for shard in range(shards) for i in range(per_shard))
    return sorted((int.from_bytes(hashlib.md5(name.encode()).digest()[:8]) >> 64 - cell_bits, shard) for name, shard in named)


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most keys of each shard: their mean and ``slack`` of it more; without slack no two differ by more than one."""
    if slack > 0:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (shard < total % shards) for shard in range(shards)]


def spans(counts: dict[int, int], ring: list[tuple[int, int]], most: list[int]) -> list[tuple[int, int, int, int, int]]:
    """``(cell, first, end, shard, slot)``: the ranks from first to end within a cell go to a shard's slots from ``slot``."""
    cells = [cell for cell, _ in ring]
    room, held = list(most), [0] * len(most)
    beyond = list(range(len(ring)))  # to the next node clockwise whose shard may have room

    def open_node(at: int) -> int:
        walked = []
        at %= len(ring)
        while room[ring[at][1]] == 0:
            walked.append(at)
            at = beyond[at] if beyond[at] != at else (at + 1) % len(ring)
        for x in walked:
            beyond[x] = at
        return at

    out = []
    for cell in sorted(counts):
        rank, at = 0, bisect_left(cells, cell)
        while rank < counts[cell]:
            at = open_node(at)
            shard = ring[at][1]
            n = min(room[shard], counts[cell] - rank)
            out.append((cell, rank, rank + n, shard, held[shard]))
            room[shard] -= n
            held[shard] += n
            rank += n
    return out


def shard(docs: DataFrame, shards: int = 40, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text", per_shard: int = NODES, cell_bits: int = CELL_BITS) -> DataFrame:
    """``(id_col, size, text_crc32, shard, slot)`` of every row; a shard's slots run from 0 without gaps.

    A key is a row's id and its text's checksum and size. With ``slack`` 0 the shards' row counts differ by one at most; with
    more, fewer keys move when a shard is added. Size is the text's UTF-8 bytes and 16; a null text has none and the checksum 0,
    as an empty one. Null and repeated ids take part, and rows alike in all three are interchangeable. Columns beside the two
    named play no part. An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.coalesce(text_col, F.lit(""))).alias("text_crc32"))
    rows = staged(rows.withColumn("key", F.xxhash64("id", "text_crc32", "size")), "keys").withColumn("cell", _cell("key", cell_bits))
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most one row a cell
    found = spans(counts, nodes(shards, per_shard, cell_bits), bounds(sum(counts.values()), shards, slack))
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("cell", "first", "end", "shard", "from")])
    table = rows.sparkSession.createDataFrame(found, kind)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "id", "size")) - 1
    told = rows.withColumn("rank", rank).alias("r").join(F.broadcast(table).alias("s"), (F.col("r.cell") == F.col("s.cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return told.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("from") + F.col("rank") - F.col("first")).alias("slot"))


def _cell(key: str, cell_bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - cell_bits)
