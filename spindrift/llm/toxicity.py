"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nystrom landmarks.

The kernel of two words is the cosine of their counts of three-letter subsequences, each occurrence weighted by
``DECAY`` to the power of the letters that it spans, so that gaps and inserted characters lower it a little and never to nothing. Landmarks
are words of the training texts; Nystrom features of a word are its kernel with them times the inverse root of theirs with each
other, and a linear machine over those features is, written out, one weight for each subsequence of the landmarks. So a word's
margin is a sum over its own subsequences, and a worker remembers the margins of the words it has met.

Only whole texts are labelled, so training is by witnesses: words that occur in toxic texts far more than in clean ones start as
positives, all words of clean texts are negatives, and then each toxic text's word with the best margin stands for it. A text's
score is a logistic function of the margins of its several best words, as one near miss is no insult and several are. It is fitted on texts of the training rows that the
machine has not seen: three machines each leave out a third, and the model is their mean.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import nlargest
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spindrift.llm.arrays import ROWS_AT_ONCE, made_on_workers

DECAY = 0.75
#: Letters that a subsequence of three may span at most, and letters of a word that are looked at in one piece.
SPAN, PIECE = 5, 32
#: Toxic and clean labelled texts that training uses at most; those whose ids hash lowest.
MOST_TOXIC, MOST_CLEAN = 2000, 4000
#: Bytes of either that training uses at most.
MOST_BYTES = 32 << 20
#: Parts of the texts, each judged by a machine of the others, and best margins of a text that its score follows.
FOLDS, TOP = 3, 4
LANDMARKS = 200
#: Evidence beyond which a word stays a witness in every round.
PLAIN = 30
#: Witnesses whose variant spellings are positives too, and how much one of those counts.
VARIED, SPELT = 60, 0.02
#: Words of clean texts taken at first and added each round, those with the highest margins.
NEGATIVES, HARDER, ROUNDS = 5000, 2000, 7
THRESHOLD = 0.7
#: Words whose subsequences are laid out at once.
WORDS_AT_ONCE = 4096
#: Distinct words whose margins a worker remembers.
WORDS_KEPT = 500_000
SEED = 11


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, codes and weights of the words' three-letter subsequences within ``SPAN``, a word's squared weights summing to one.

    A mark stands before and behind each word. A subsequence's code holds its three code points; rows ascend.
    """
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        by_length[len(word)].append(i)
    out = []
    for n, at in by_length.items():
        spots = [(i, j, k) for i in range(n) for k in range(i + 2, min(n + 2, i + SPAN)) for j in range(i + 1, k)]
        if not spots:
            continue
        i, j, k = np.array(spots).T
        weight = DECAY ** (k - i - 2.0)
        for some in range(0, len(at), 2048):
            rows = np.array(at[some : some + 2048])
            text = "".join(f"^{words[r]}$" for r in rows)
            points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").reshape(len(rows), n + 2).astype(np.int64)
            codes = points[:, i] << 42 | points[:, j] << 21 | points[:, k]
            order = np.argsort(codes, axis=1)
            codes = np.take_along_axis(codes, order, axis=1)
            first = np.ones(codes.shape, dtype=bool)
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]
            starts = np.flatnonzero(first)
            sums = np.add.reduceat(weight[order].ravel(), starts)
            of = starts // codes.shape[1]
            norms = np.sqrt(np.bincount(of, sums * sums))
            out.append((rows[of], codes.ravel()[starts], sums / norms[of]))
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pieces_of(text: str | None) -> set[str]:
    """A text's lower-cased words, and what runs of three or more single characters spell, as in a word spelt with spaces."""
    pieces = (text or "").lower().split()
    found = set(pieces)
    single = [i for i, p in enumerate(pieces) if len(p) == 1]
    for _, run in groupby(enumerate(single), key=lambda x: x[1] - x[0]):
        if len(run := [pieces[i] for _, i in run]) > 2:
            found.add("".join(run))
    return found


def words_of(piece: str) -> list[str]:
    """What a word is judged by: itself without outer punctuation, its letters alone, and overlapping pieces of long ones."""
    if piece.isalpha():
        found = [piece]
    else:
        found = [w for w in {piece.strip(".,;:!?\"'()[]"), "".join(filter(str.isalpha, piece))} if w]
    return [w[i : i + PIECE] for w in found for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]


class Model:
    """Weights of subsequences by code, and the logistic function over a text's ``TOP`` best margins, best first."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float, slopes: list[float] | None = None, shift: float = 0.0):
        self.codes, self.weights, self.bias, self.slopes, self.shift = codes, weights, bias, slopes or [0.0] * TOP, shift
        self.known: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        out = [np.empty(0)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            rows, codes, weights = subsequences(some)
            place = np.searchsorted(self.codes, codes)
            place[place == len(self.codes)] = 0
            hit = self.codes[place] == codes if len(self.codes) else np.zeros(len(codes), dtype=bool)
            out.append(np.bincount(rows[hit], weights[hit] * self.weights[place[hit]], minlength=len(some)) + self.bias)
        return np.concatenate(out)

    def meet(self, pieces: set[str]) -> None:
        """Remember the margins of words not met before."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = list(pieces)
        words = [words_of(p) for p in new]
        margins = self.margins([w for ws in words for w in ws]).tolist()
        at = 0
        for piece, ws in zip(new, words, strict=True):
            self.known[piece] = max(margins[at : at + len(ws)], default=self.bias)
            at += len(ws)

    def best(self, texts: list[str | None]) -> list[list[float]]:
        """Each text's highest margins of different words; where it has fewer words the bias alone."""
        bags = [pieces_of(t) for t in texts]
        out, get = [], self.known.__getitem__
        for at in range(0, len(bags), 32):
            self.meet(set().union(*bags[at : at + 32]))
            out += [filled(nlargest(TOP, map(get, bag)), self.bias) for bag in bags[at : at + 32]]
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        sums = (sum(a * b for a, b in zip(self.slopes, best, strict=True)) + self.shift for best in self.best(texts))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in sums]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def filled(margins: list[float], bias: float) -> list[float]:
    return margins + [min([bias, *margins])] * (TOP - len(margins))


def mean_of(models: list[Model]) -> Model:
    """The machine whose margins are the mean of the machines'."""
    codes = np.unique(np.concatenate([m.codes for m in models]))
    weights = np.zeros(len(codes))
    for m in models:
        weights[np.searchsorted(codes, m.codes)] += m.weights / len(models)
    return Model(codes, weights, sum(m.bias for m in models) / len(models))


class Part(NamedTuple):
    """A machine of all texts but one part, the best margins that it gives that part's texts, and their labels."""

    model: Model
    best: list[list[float]]
    labels: list[int]


def part(texts: list[str], toxic: list[int], k: int) -> Part | None:
    """Part ``k`` of a model's training; None if the other texts have one label alone. Part 0 stands in where that is so of all parts."""
    labels = np.array(toxic, dtype=int)
    fold = np.array([zlib.crc32(t.encode()) % FOLDS for t in texts], dtype=int)
    fits = [0 < labels[fold != j].sum() < (fold != j).sum() for j in range(FOLDS)]
    if not any(fits) and k == 0:
        if not len(labels) or not labels.any() or labels.all():
            rate = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.01
            return Part(Model(np.empty(0, dtype=np.int64), np.empty(0), 0.0, None, math.log(rate / (1 - rate))), [], [])
        inside = outside = np.arange(len(texts))
    elif not fits[k]:
        return None
    else:
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
    # Words are numbered in their own order, so that nothing depends on that of a set.
    of_text = [sorted({w for p in pieces_of(t) for w in words_of(p)}) for t in texts]
    words = sorted(set().union(*of_text))
    number = {w: i for i, w in enumerate(words)}
    bags = [np.array([number[w] for w in ws], dtype=np.int32) for ws in of_text]
    model = machine_of(words, [bags[i] for i in inside], labels[inside])
    each = model.margins(words)
    return Part(model, [filled(np.sort(each[bags[i]])[::-1][:TOP].tolist(), model.bias) for i in outside], labels[outside].tolist())


def whole(parts: list[Part | None]) -> Model:
    """The mean of the parts' machines, with a logistic function fitted on what each makes of the texts that it has not seen."""
    parts = [p for p in parts if p is not None] or [part([], [], 0)]
    model = mean_of([p.model for p in parts])
    best, of = [b for p in parts for b in p.best], [y for p in parts for y in p.labels]
    if not 0 < sum(of) < len(of):
        model.shift = parts[0].model.shift if not of else math.log((sum(of) + 1) / (len(of) - sum(of) + 1))
        return model
    model.slopes, model.shift = logistic(np.array(best), np.array(of))
    return model


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts."""
    return whole([part(texts, toxic, k) for k in range(FOLDS)])


def machine_of(words: list[str], bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """The machine of labelled bags of numbers of words, by witnesses and ever harder negatives."""
    bad, good = ([bag for bag, y in zip(bags, labels, strict=True) if y == of] for of in (1, 0))
    in_bad, in_good = (np.bincount(np.concatenate([np.empty(0, dtype=np.int32), *b]), minlength=len(words)) for b in (bad, good))
    evidence = np.zeros(len(words))
    for w in np.flatnonzero(in_bad).tolist():
        evidence[w] = _evidence(int(in_bad[w]), int(in_good[w]), len(bad), len(good))
    ranked = np.argsort(-evidence, kind="stable")
    witnesses = [w for w in ranked[:1000].tolist() if evidence[w] > 8]
    witnesses = witnesses if len(witnesses) > 5 else [w for w in ranked[:20].tolist() if in_bad[w]]
    plain = {w: int(in_bad[w]) for w in np.flatnonzero(evidence > PLAIN).tolist()}
    random = np.random.default_rng(SEED)
    others = np.flatnonzero(in_good)
    some = random.permutation(others)
    nystrom = Nystrom([words[w] for w in dict.fromkeys([*witnesses[: LANDMARKS // 2], *some[: LANDMARKS // 2].tolist()])])
    common = others[np.argsort(-in_good[others], kind="stable")][: NEGATIVES // 2]
    negatives = {*common.tolist(), *some[: NEGATIVES // 2].tolist()}
    positives = dict.fromkeys(witnesses, 1)
    spelt = [v for w in witnesses[:VARIED] for v in variants(words[w], random)]
    for turn in range(ROUNDS):
        plus = [*(words[w] for w in positives), *spelt]
        model = nystrom.machine(plus, [*positives.values(), *[SPELT] * len(spelt)], [words[w] for w in sorted(negatives)])
        margin = model.margins(words)
        harder = others[np.argsort(-margin[others], kind="stable")[:HARDER]]
        if turn == ROUNDS - 1 or turn > 2 and negatives.issuperset(harder[margin[harder] > -0.5].tolist()):
            return model
        negatives.update(harder.tolist())
        stand = Counter(int(bag[np.argmax(margin[bag])]) for bag in bad if len(bag))
        stand = {w: n for w, n in stand.items() if not in_good[w] and margin[w] > 0}
        positives = (stand | plain) or dict.fromkeys(witnesses, 1)
    return model


def variants(word: str, random: np.random.Generator) -> list[str]:
    """The word with a character inserted and with one doubled, as its writers may spell it."""
    if len(word) < 4:
        return []
    i, j = random.integers(1, len(word) - 1, size=2)
    odd = "*-_.x1"[random.integers(6)]
    return [word[:i] + odd + word[i:], word[:j] + word[j - 1] + word[j:]]


def _evidence(a: int, b: int, n: int, m: int) -> float:
    """Log likelihood ratio that a of n is a higher share than b of m; 0 if it is lower."""
    if a * m <= b * n:
        return 0.0

    def likelihood(k: int, t: int, q: float) -> float:
        return (k * math.log(q) if k else 0.0) + ((t - k) * math.log(1 - q) if t > k else 0.0)

    p = (a + b) / (n + m)
    return likelihood(a, n, a / n) + likelihood(b, m, b / m) - likelihood(a, n, p) - likelihood(b, m, p)


class Nystrom:
    """Features of words by their kernel with landmarks, and machines over them."""

    def __init__(self, landmarks: list[str]):
        of, codes, weights = subsequences(landmarks)
        self.codes, at = np.unique(codes, return_inverse=True)
        self.rows = np.zeros((len(self.codes), len(landmarks)))
        self.rows[at, of] = weights
        value, vector = np.linalg.eigh(self.rows.T @ self.rows)
        self.root = vector / np.sqrt(np.where(value > 1e-6, value, np.inf)) @ vector.T

    def features(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.rows.shape[1]))
        for at in range(0, len(words), 512):
            of, codes, weights = subsequences(words[at : at + 512])
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = self.codes[place] == codes
            of, place, weights = of[hit], place[hit], weights[hit]
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.diff(of[order], prepend=-1))
            if len(starts):
                out[at + of[order][starts]] = np.add.reduceat(weights[order, None] * self.rows[place[order]], starts, axis=0)
        return out @ self.root

    def machine(self, plus: list[str], counts: list[int], minus: list[str]) -> Model:
        """The model that lowers the squared hinge loss, both labels weighing the same, by accelerated gradients."""
        # The last row is a word that shares nothing with any landmark: it counts as clean, as much as a fifth of all clean words.
        x = np.vstack([self.features(plus), self.features(minus), np.zeros(self.rows.shape[1])])
        y = np.append(np.ones(len(plus)), -np.ones(len(minus) + 1))
        shares = np.sqrt(np.array(counts, dtype=float))
        each = np.concatenate([shares / shares.sum(), np.full(len(minus), 0.8 / max(1, len(minus))), [0.2]]) / 2
        x = np.hstack([x, np.ones((len(x), 1))])
        penalty = np.append(np.full(x.shape[1] - 1, 2e-4), 1e-6)
        step = 1 / (2 * np.linalg.eigvalsh((x * each[:, None]).T @ x)[-1] + penalty.max())
        v = u = np.zeros(x.shape[1])
        for turn in range(300):
            slack = np.maximum(0, 1 - y * (x @ u))
            after = u - step * (penalty * u - 2 * x.T @ (each * y * slack))
            u, v = after + turn / (turn + 3) * (after - v), after
        return Model(self.codes, self.rows @ (self.root @ v[:-1]), float(v[-1]))


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[list[float], float]:
    """Slopes, none below 0, and shift of the probability of label 1 given a text's best margins, by damped Newton steps with smoothed labels."""
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    used = list(range(margins.shape[1]))
    while True:
        w = _newton(np.hstack([margins[:, used], np.ones((len(margins), 1))]), goal)
        # A better margin never speaks against a text.
        below = [i for i, x in zip(used, w, strict=False) if x < 0]
        if not below or len(used) == 1:
            slopes = np.zeros(margins.shape[1])
            slopes[used] = np.maximum(w[:-1], 1e-3 if len(used) == 1 else 0)
            return slopes.tolist(), float(w[-1])
        used = [i for i in used if i not in below] or [0]


def _newton(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - goal * z).sum() + 5e-4 * (w * w).sum())

    w = np.zeros(x.shape[1])
    w[0] = 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (p - goal) + 1e-3 * w)
        step = next((s for s in 0.5 ** np.arange(30) if loss(w - s * change) < loss(w)), 0.0)
        if not step:
            break
        w = w - step * change
    return w


def learnable(id_col: str):
    """Rows that training may use: the crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the texts of ``sampled``, each part of its training in a task of its own."""

    def made(rows: list[dict], k: int) -> Part | None:
        rows = sorted(rows, key=lambda r: (r["id"], r["text"]))
        return part([r["text"] for r in rows], [int(r["y"]) for r in rows], k)

    return whole(made_on_workers(sampled(docs, labels, id_col, text_col, label_col), made, FOLDS))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id, y, text)`` of at most ``MOST_TOXIC`` toxic and ``MOST_CLEAN`` clean texts among the rows that training may use, and ``MOST_BYTES`` of either.

    They come in the order of their ids' hashes, whatever their length, but for texts that alone are a sixteenth of ``MOST_BYTES``. Rows with a null id, text
    or label are left out, and so are labels without a document; all before the numbers are bounded. An id labelled both ways counts as toxic.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learnable("id") & (F.octet_length("text") <= MOST_BYTES // 16))
    known = labels.where(F.col(label_col).isin(0, 1) & learnable(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    sizes = texts.select("id", F.octet_length("text").alias("size")).join(known, "id").groupBy("id", "y").agg(F.max("size").alias("size"))
    both = [sizes.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((0, MOST_CLEAN), (1, MOST_TOXIC))]
    so_far = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    marked = both[0].unionByName(both[1]).withColumn("held", F.sum("size").over(so_far)).where(F.col("held") <= MOST_BYTES).select("id", "y")
    return texts.join(F.broadcast(marked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def with_score(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """All rows and columns of ``docs`` and the score of its text as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(start, ROWS_AT_ONCE)
                scores = pa.array(own.scores(some.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*some.columns, scores], names=[*some.schema.names, name])

    return docs.mapInArrow(of, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row, from its whole text alone.

    A null text counts as empty and gets the score of a text without words. Null and repeated ids come back like any other;
    a null id is not held out. Columns beside the two named play no part. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = F.coalesce(~learnable("id"), F.lit(False))
    scored = with_score(rows, model, "text", "score")
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score lies below ``THRESHOLD``, with all their columns."""
    return with_score(docs, model, text_col, "__score").where(F.col("__score") < THRESHOLD).drop("__score")
