"""Token ids as Parquet files that allow selective reads.

A file holds documents in ascending order of their id, each with its ids as a list column. Ids are dictionary encoded,
row groups and pages have a stated size, and Parquet's page indexes let a reader skip to some documents, or read the lengths and
places of all documents without touching their ids.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.arrays import cut_by_bytes
from spindrift.staging import new_path

#: Bytes of a row group and of a page, and rows of a page, in the files.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Bytes of text that a partition should hold before it is encoded.
PARTITION_BYTES = 32 << 20
SEED = 3
#: Distinct pieces that a task remembers, and their ids.
PIECES_KEPT, IDS_KEPT = 400_000, 8_000_000
#: Bytes of text that are split at once, and pieces whose ids are laid out at once.
TEXT_BYTES, PIECES_AT_ONCE = 4 << 20, 1 << 18

#: Letters whose lower case is one letter and its normal form, so that a run of them is one word to the tokenizer, and the marks that may follow one.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?"
PLAIN = f"^[{LETTERS}]+[{MARKS}]*$"


class WordEncoder:
    """The tokenizer of a file, and the ids of the pieces of text that it has met.

    The tokenizer drops white space and nothing it does reaches across white space, so a text's ids are those of its
    pieces between the white space of ASCII. Special tokens that a text spells out are read as the library does by default: as their ids. Arrow splits
    a batch of texts, numbers its distinct pieces and parts plain words from the marks behind them; only what is new goes to the tokenizer, a plain word to the
    library's model at once and all else through the whole tokenizer. The ids of all texts are then gathered as arrays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spelt = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: spelt.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))})
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])  # of each number the ids, and where they end

    def plain(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def numbers(self, pieces: pa.Array, ids_of: Callable[[str], list[int]]) -> np.ndarray:
        """The pieces' numbers; each that was not met before is encoded."""
        told = pieces.dictionary_encode()
        names, known = told.dictionary.to_pylist(), self.number
        for name in names:
            if name not in known:
                known[name] = len(known)
                self.ids.extend(ids_of(name))
                self.ends.append(len(self.ids))
        return np.fromiter(map(known.__getitem__, names), dtype=np.int64, count=len(names))[np.asarray(told.indices)]

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other with ``end_id`` at the end of each, and how many each has; a null text counts as empty."""
        if len(self.number) > PIECES_KEPT or len(self.ids) > IDS_KEPT:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        told = split.flatten().dictionary_encode()
        # Of each distinct piece the numbers of its word, or of all of it, and of the marks behind the word.
        plain = pc.match_substring_regex(told.dictionary, PLAIN)
        lower, at = pc.utf8_lower(told.dictionary.filter(plain)), np.asarray(plain)
        both = np.empty((len(at), 2), dtype=np.int64)
        both[at, 0] = self.numbers(pc.utf8_rtrim(lower, characters=MARKS), self.plain)
        both[at, 1] = self.numbers(pc.replace_substring_regex(lower, f"^[{LETTERS}]+", ""), self.whole)
        both[~at, 0] = self.numbers(told.dictionary.filter(pc.invert(plain)), self.whole)
        both[~at, 1] = self.numbers(pa.array([""], pa.large_string()), self.whole)[0]
        ids, ends = np.frombuffer(self.ids, dtype=np.int32), np.frombuffer(self.ends, dtype=np.int64)
        each = (ends[1:] - ends[:-1])[both]
        flat, sizes = gathered(ids, ends[both].ravel(), each.ravel()), each.sum(axis=1)
        # And of the texts.
        of = np.asarray(told.indices)
        flat = gathered(flat, (np.cumsum(sizes) - sizes)[of], sizes[of])
        bounds = np.asarray(split.offsets, dtype=np.int64)
        after = np.append(0, np.cumsum(sizes[of]))[bounds[1:] - bounds[0]]
        counts = np.diff(after, prepend=0)
        return (flat, counts) if end_id is None else (np.insert(flat, after, end_id), counts + 1)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, one after the other."""
    out = [values[:0]]
    for at in range(0, len(starts), PIECES_AT_ONCE):
        some = sizes[at : at + PIECES_AT_ONCE]
        out.append(values[np.repeat(starts[at : at + PIECES_AT_ONCE] - np.cumsum(some) + some, some) + np.arange(some.sum())])
    return np.concatenate(out)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the files of ``read_tokens`` to ``path``.

    Rows are dealt by ranges of their id. Rows with equal ids are told apart by their text's hash, and equal rows, which are interchangeable, by
    a random number, so that no id and no row fills a partition however often it comes. Null ids come first. A null text counts as empty and
    has only the end id.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, round(size / PARTITION_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.rand(SEED).asc()]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, encoder = 0, word_encoder(tokenizer_path)
        for batch in batches:
            for some in cut_by_bytes(batch, 1, TEXT_BYTES):
                flat, counts = encoder.encode(some.column(1), end_id)
                ends = np.cumsum(counts)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(start + ends - counts), pa.array(counts), ids], names=["id", "part", "offset", "n_tokens", "ids"])
                start += int(ends[-1])

    kind = rows.schema["id"].dataType.simpleString()
    (
        dealt.mapInArrow(of, f"id {kind}, part int, offset long, n_tokens long, ids array<int>")
        .withColumnRenamed("id", id_col)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: the id, its ``ids`` and ``n_tokens``, its ``part`` and ``offset``, the number of ids before it in its part."""
    return spark.read.parquet(path)


def placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows``, which have ``part`` and ``offset``, with ``start`` instead: the number of ids of all documents before each.

    The parts' places are a running sum over one row a part, read from the length columns of ``files`` alone. The rows are
    joined to them, so columns that aren't needed, as the ids, should be gone.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    return rows.join(places, "part").withColumn("start", F.col("first") + F.col("offset")).drop("part", "offset", "first")


def token_digests(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start, n_tokens, ids_crc32)`` from the rows of ``read_tokens``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat = np.asarray(lists.values).astype("<i4", copy=False)
            bounds = np.asarray(lists.offsets)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["id", "part", "offset", "n_tokens", "ids_crc32"])

    rows = files.select(F.col(id_col).alias("id"), "part", "offset", "n_tokens", "ids")
    kind = rows.schema["id"].dataType.simpleString()
    sums = rows.mapInArrow(of, f"id {kind}, part int, offset long, n_tokens long, ids_crc32 long")
    return placed(sums, files).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")


def token_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return ``token_digests`` of what they hold.

    Columns beside the two named play no part. Rows with repeated ids follow each other in the order of their text's hash. An
    empty table gives an empty result.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_col, text_col)
    return token_digests(read_tokens(docs.sparkSession, path), id_col)
