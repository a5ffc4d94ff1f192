"""Byte-level BPE by replaying the merges over a corpus of distinct words.

A block of words is encoded together. An inverted index leads from each pair of neighbouring tokens that some rank
joins to the positions where the pair stands. The ranks are replayed in ascending order: all positions of the
lowest rank merge, left to right, and only the two neighbours that a merge touches get new entries. Each word thus goes
through exactly the merges that a word-by-word encoder would apply.

A task reads its documents as numbers of distinct words and puts off encoding until ``BLOCK_AT_LEAST`` words are new to it, or ``HELD``
occurrences wait, or its rows are over. So a block spans many documents, and is smaller only where so many documents hold no more new words. What waits is bounded,
nothing is shuffled, and a lost executor costs the rerun of its tasks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a task remembers, and their characters.
WORDS_KEPT, CHARACTERS_KEPT = 600_000, 16_000_000
#: Words encoded as one block: the most, and the new ones that are waited for.
WORDS_IN_BLOCK, BLOCK_AT_LEAST = 50_000, 20_000
#: Occurrences of words that may wait, four bytes each, and rows given on at once.
HELD, ROWS = 8_000_000, 64


class Numbers(dict):
    """A number for each word, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return len(self) - 1


class Vocabulary:
    """Ranks of a tiktoken file and the pattern that splits a text into words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.forget()
        # A pair of ranks is one number, in a base whose last digit no rank uses: so a pair with -1 on its right is never a key.
        self.base = max(self.tokens, default=0) + 2
        self.single = {byte: self.ranks[bytes([byte])] for byte in range(256)} | {None: -1}
        self.joined = {self.ranks[t[:i]] * self.base + self.ranks[t[i:]]: rank for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}

    def encode_block(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word, by replaying the merges over all of them at once."""
        base, joined, single = self.base, self.joined, self.single
        token = [single[byte] for word in words for byte in (*word, None)]  # by position; -1 between words and where a token has gone into the one before it
        left = list(range(-1, len(token) - 1))
        right = list(range(1, len(token) + 1))
        where: dict[int, list[int]] = {}  # from the rank that a pair would merge into to the pair's positions
        for at, pair in enumerate(map(lambda a, b: a * base + b, token, token[1:])):
            rank = joined.get(pair)
            if rank is not None:
                if rank in where:
                    where[rank].append(at)
                else:
                    where[rank] = [at]
        queue = list(where)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            for at in sorted(where.pop(rank)):
                after = right[at]
                if joined.get(token[at] * base + token[after]) != rank:
                    continue  # a merge has changed this pair since it was entered
                token[at] = rank
                token[after] = -1
                beyond = right[at] = right[after]
                left[beyond] = at
                before = left[at]
                for start, pair in ((at, rank * base + token[beyond]), (before, token[before] * base + rank)):
                    new = joined.get(pair)
                    if new is not None:
                        if new in where:
                            where[new].append(start)
                        else:
                            where[new] = [start]
                            heapq.heappush(queue, new)
        out, at = [], 0
        for word in words:
            end = at + len(word)
            out.append(tuple([t for t in token[at:end] if t >= 0]))
            at = end + 1
        return out

    def forget(self) -> None:
        self.number = Numbers()
        self.ids: list[tuple[int, ...]] = []  # by a word's number
        self.spelt: list[str] = []  # the same as decimal numbers joined by commas

    def numbers(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words; a null text has none."""
        words = self.split(text or "")
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words))

    def learn(self) -> None:
        """Encode the words that have a number and no ids yet."""
        fresh = list(islice(self.number, len(self.ids), None))
        for at in range(0, len(fresh), WORDS_IN_BLOCK):
            block = self.encode_block([w.encode() for w in fresh[at : at + WORDS_IN_BLOCK]])
            self.ids += block
            self.spelt += [",".join(map(str, ids)) for ids in block]

    def ids_of(self, numbers: np.ndarray) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, numbers.tolist())))

    def spelt_of(self, numbers: np.ndarray) -> str:
        return ",".join(map(self.spelt.__getitem__, numbers.tolist()))

    def encode_all(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text, all texts being one corpus; a null text has none."""
        waiting = [self.numbers(t) for t in texts]
        self.learn()
        return [self.ids_of(n) for n in waiting]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for all tasks of a Python worker."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, decoded)`` of every row: the token ids of its whole text and the bytes that they decode to.

    No special tokens; what looks like one is ordinary text. A null or empty text has no ids and decodes to no bytes. Rows
    with null or repeated ids come back like any other, columns beside the two named play no part, and an
    empty table gives an empty result.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for ids, waiting in encoded(batches, words):
            rows = [words.ids_of(n) for n in waiting]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.int32())), pa.array(map(words.decode, rows), pa.binary())], names=["id", "ids", "decoded"])

    return _over(docs, of, "ids array<int>, decoded binary", id_col, text_col)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with digests in place of the ids and bytes, so that neither crosses over from Python.

    Returns ``(id_col, n_tokens, ids_sha256, decoded_sha256)``; the first digest is of the decimal ids joined by commas.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for ids, waiting in encoded(batches, words):
            counts, of_ids, of_bytes = [], [], []
            for numbers in waiting:
                row = words.ids_of(numbers)
                counts.append(len(row))
                of_ids.append(hashlib.sha256(words.spelt_of(numbers).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(words.decode(row)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over(docs, of, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def encoded(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Some rows' ids with the numbers of their texts' words, which are all encoded by then."""
    waiting: list[tuple[pa.Array, list[np.ndarray]]] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            numbers = [words.numbers(t) for t in some.column(1).to_pylist()]
            waiting.append((some.column(0), numbers))
            held += sum(map(len, numbers))
            if held >= HELD or len(words.number) - len(words.ids) >= BLOCK_AT_LEAST:
                yield from _given(words, waiting)
                held = 0
    yield from _given(words, waiting)


def _given(words: Vocabulary, waiting: list[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    words.learn()
    while waiting:
        yield waiting.pop(0)
    if len(words.number) > WORDS_KEPT or sum(map(len, words.number)) > CHARACTERS_KEPT:
        words.forget()


def _over(docs: DataFrame, of, columns: str, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)
