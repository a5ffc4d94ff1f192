"""SimHash near-duplicates, with candidates found by pigeonring filtering.

The 64 bits of a fingerprint form a ring of three segments. If two fingerprints differ in at most two bits, some
segment agrees whole and, with the one that follows it, differs in at most one bit: otherwise every start on the ring would
run over its share of the budget. That chain of two segments is the join key. For each bit of the second segment
there is a key that leaves out this bit and the third segment, 64 keys in all, and every linked pair shares one of them. Only
what shares a key, 42 or 43 bits long, comes to the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.arrays import forest, starts_of, values, whole_groups
from spindrift.llm.components import connected_components
from spindrift.staging import staged

SEED = 42
MOST_BITS = 2
#: First bit and width of each segment of the ring.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Groups up to this size are compared pair by pair, larger ones by looking up flipped bits.
PAIRWISE = 256
#: Hashes whose bits are counted at once.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        some = hashes[at : at + HASHES_AT_ONCE]
        counts += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id_col, fp)`` of every row, fp being the fingerprint's bits as a signed long; a null text counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in values(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def chain_masks() -> list[int]:
    """For each bit b, as signed longs: the bits that stay in the key which leaves out b and the segment after b's own."""
    out = []
    for k, (first, width) in enumerate(SEGMENTS):
        start, length = SEGMENTS[(k + 1) % len(SEGMENTS)]
        rest = ((1 << length) - 1) << start
        for bit in range(first, first + width):
            kept = ~(rest | 1 << bit) & ((1 << 64) - 1)
            out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


def links_within(fps: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose distinct fingerprints differ in at most ``MOST_BITS`` bits, all differences being in ``free``.

    In a large group each fingerprint is looked up with every choice of one or two free bits flipped, so the
    work follows the group's size and not its square. ``free`` has at most 23 bits, which bounds the group too.
    """
    n = len(fps)
    if n <= PAIRWISE:
        left, right = np.triu_indices(n, 1)
        near = np.bitwise_count(fps[left] ^ fps[right]) <= MOST_BITS
        return left[near], right[near]
    order = np.argsort(fps)
    ranked = fps[order]
    bits = [1 << b for b in range(64) if free >> b & 1]
    lefts, rights = [], []
    for i, one in enumerate(bits):
        for flip in [one, *(one | two for two in bits[i + 1 :])]:
            wanted = ranked ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(ranked, wanted), n - 1)
            hit = np.flatnonzero((ranked[at] == wanted) & (at > np.arange(n)))
            lefts.append(order[hit])
            rights.append(order[at[hit]])
    return np.concatenate(lefts), np.concatenate(rights)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each group of fingerprints that share a key, from batches sorted by (bit, key, fp)."""
    masks = np.array(chain_masks(), dtype=np.int64).view(np.uint64)
    for table in whole_groups(batches, ["bit", "key"]):
        table = table.combine_chunks()
        bit, key, fps = (np.asarray(table.column(c)) for c in ("bit", "key", "fp"))
        starts = starts_of([bit, key])
        ends = np.append(starts[1:], len(fps))
        several = ends - starts > 1
        found: list[np.ndarray] = []
        two = starts[several & (ends - starts == 2)]
        near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= MOST_BITS
        found.append(np.stack([fps[two][near], fps[two + 1][near]], axis=1))
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            group = fps[s:e]
            left, right = links_within(group.view(np.uint64), int(~masks[bit[s]]))
            root = forest(e - s, left, right)
            moved = np.flatnonzero(root != np.arange(e - s))
            found.append(np.stack([group[moved], group[root[moved]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that span every component of the distinct longs in ``fps(fp)`` under the Hamming bound."""
    masks = F.array(*[F.lit(m) for m in chain_masks()])
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    keyed = keyed.select("bit", F.col("fp").bitwiseAND(F.element_at(masks, F.col("bit") + 1)).alias("key"), "fp")
    dealt = keyed.repartition("bit", "key").sortWithinPartitions("bit", "key")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp`` and ``component_id``, the smallest id reachable by links.

    Equal fingerprints, so all exact copies, are one node of the graph, however many rows hold them. A null or empty
    text has fingerprint 0 and links like any other. Rows with a null id take part; a component whose ids are all
    null has a null ``component_id``. Repeated rows each come back. Columns beside the two named play no part. An
    empty table gives an empty result.
    """
    marked = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    reached = connected_components(staged(links(nodes.select("fp")), "near")).withColumnRenamed("node", "fp")
    grouped = nodes.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each of ``simhash_groups``, with all their columns.

    Rows that share an id share their fate. Rows with a null id are never dropped.
    """
    groups = simhash_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def hex16(fp):
    """A signed long's bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
