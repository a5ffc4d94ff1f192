"""SimHash, vector near-dedup, top-k search, components and line dedup against brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm.components import connected_components
from spindrift.llm import exact_topk
from spindrift.llm.exact_topk import Cells, Vectors, best_of_block, distances, exact_top_k, spread
from spindrift.llm.line_dedup import SHORTEST, dedup_lines
from spindrift.llm.near_vectors import near_vectors, plan
from spindrift.llm.simhash import chain_masks, fingerprint, hex16, links, links_within, one_of_each, simhash_groups


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(300)] + [(5, 5), (3000, 3000)]
    df = spark.createDataFrame([*pairs, (None, 7), (7, None)], "a long, b long")
    got = {x.node: x.component for x in connected_components(df).collect()}
    assert got == components({n for p in pairs for n in p}, pairs)
    assert connected_components(df.limit(0)).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark):
    texts = ["", None, "One", "one  TWO", "a b c", "É é  x y\x1cz\tq", "x " * 500, " \n\t "]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    # Spark's own XXH64 of one shingle is what a text of three words has.
    df = spark.createDataFrame([("a b c",)], "t string")
    assert df.select(hex16(F.xxhash64("t"))).first()[0] == f"{fingerprint('a b c'):016x}"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_near_pair_shares_a_key():
    r, masks = random.Random(2), chain_masks()
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.choice((0, 1, 2))):
            b ^= 1 << bit
        assert any((a ^ b) & m & ((1 << 64) - 1) == 0 for m in masks)


@pytest.mark.parametrize("n", [2, 40, 600])
def test_links_within_a_group(n):
    r = random.Random(n)
    free = 0x3FFFFF | 1 << 30
    fps = np.unique(np.array([sum(1 << b for b in r.sample([*range(12), 30], r.randrange(5))) | 5 << 40 for _ in range(n)], dtype=np.uint64))
    left, right = links_within(fps, free)
    want = {(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2}
    assert {tuple(sorted(p, reverse=True)) for p in zip(left.tolist(), right.tolist(), strict=True)} == want


def test_links_span_all_components(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(150)]
    fps += [f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for f in fps[:80]] + [f ^ 1 << r.randrange(64) for f in fps[:40]]
    hub = r.getrandbits(64)
    fps = sorted({signed(f) for f in fps + [hub ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]})
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2]
    got = [(x.a, x.b) for x in links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 for a, b in got if len(got) < 200)
    assert components(fps, got) == components(fps, near)


def test_simhash_groups(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base)] + [(200 + i, t + " " + word()) for i, t in enumerate(base)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, base[0]), (5, base[5]), (400, "x y " * 30_000)]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, component_id string")
    got = simhash_groups(docs).select("doc_id", hex16("fp").alias("f"), "component_id").collect()
    fps = {f"{plain_fingerprint(t):016x}" for _, t in rows}
    root = components(fps, [(a, b) for a in fps for b in fps if a < b and bin(int(a, 16) ^ int(b, 16)).count("1") <= 2])
    least = {}
    for i, t in rows:
        if i is not None:
            k = root[f"{plain_fingerprint(t):016x}"]
            least[k] = min(i, least.get(k, i))
    want = sorted((-1 if i is None else i, f"{plain_fingerprint(t):016x}", least[root[f"{plain_fingerprint(t):016x}"]]) for i, t in rows)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.f, x.component_id) for x in got) == want
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted({-1 if x.doc_id is None else x.doc_id for x in kept.collect()}) == sorted({-1, *least.values()})
    assert simhash_groups(docs.limit(0)).count() == 0


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 10, dim))
    rows = np.repeat(centres, 10, axis=0) + r.standard_normal((n, dim)) * r.choice([0.02, 0.15, 0.25, 3.0], size=(n, 1))
    rows[n // 2 : n // 2 + 40] = rows[n // 2]
    return rows.astype(np.float32)


def test_near_vectors(spark):
    m = clustered(800, 32, 5)
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [1.0, None]), (2003, [1.0, float("nan")]), (2004, [float("inf")]), (2005, []), (None, [1.0, 2.0])]
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + odd
    df = spark.createDataFrame([(*x, "q") for x in rows], "vec_id long, embedding array<float>, n_links string")
    got = {x.vec_id: x for x in near_vectors(df, recall=0.9999).collect()}
    root = components(range(800), [(int(a), int(b)) for a, b in np.argwhere(near)])
    assert sum(got[i].n_links for i in range(800)) >= 0.99 * near.sum()
    right = sum(got[i].n_links == near[i].sum() and got[i].component_id == root[i] for i in range(800))
    assert right >= 780
    assert all(got[i].n_links <= near[i].sum() for i in range(800))
    assert all(got[i].kept == (got[i].component_id == i) for i in range(800))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd[:-1])
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert near_vectors(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, -0.0]), (2, [2.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in near_vectors(twice).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_blocks_of_a_key(spark, monkeypatch):
    from spindrift.llm import near_vectors as module

    monkeypatch.setattr(module, "BLOCK", 32)
    m = np.random.default_rng(6).standard_normal((1, 16)) + np.random.default_rng(7).standard_normal((300, 16)) * 0.05
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {x.vec_id: x for x in near_vectors(df).collect()}
    assert [got[i].n_links for i in range(300)] == near.tolist() and {x.component_id for x in got.values()} == {0}


def test_recall_at_the_registered_setting(spark):
    """Of pairs planted just above the threshold at least 0.98 are found, and none below it is linked."""
    r = np.random.default_rng(21)
    base = r.standard_normal((1500, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = r.standard_normal((1500, 48))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = np.where(np.arange(1500) < 1000, 0.951, 0.949)[:, None]
    rows = np.vstack([base, cos * base + np.sqrt(1 - cos**2) * off])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in near_vectors(df).collect()}
    assert sum(got[i].n_links == 1 and got[i + 1500].component_id == i for i in range(1000)) >= 980
    assert all(got[i].n_links == 0 for i in range(1000, 1500))


def test_one_very_long_vector(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [1.0] * 100_000), (3, [1.0, 2.0, 0.0])], "vec_id long, embedding array<double>")
    assert {x.vec_id: (x.n_links, x.component_id) for x in near_vectors(df).collect()} == {0: (2, 0), 1: (2, 0), 2: (0, 2), 3: (2, 0)}


def test_plan_reaches_its_recall():
    for n in (10, 1000, 10**6, 10**9):
        bits, tables = plan(n)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.997 and bits <= 30


def test_exact_top_k(spark):
    r = np.random.default_rng(8)
    m = np.round(r.standard_normal((700, 12)), 1).astype(np.float32)
    m[100:160] = m[100]
    odd = [(1000, None), (1020, [float("nan")] * 12), (1040, [None] * 12), (None, [1.0] * 12), (1060, [5.0]), (1080, [])]
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + odd
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int")
    got = exact_top_k(df, F.col("vec_id") % 20 == 0, k=20)
    ints = {i: np.floor(64 * np.pad(np.array(x, dtype=np.float32).astype(float), (0, 12 - len(x)))).astype(int) for i, x in rows if i is not None and x is not None and i not in (1020, 1040)}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:20]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == sorted(want)
    few = df.where("vec_id < 3")
    assert sorted((x.query_id, x["rank"], x.vec_id) for x in exact_top_k(few, F.col("vec_id") == 0).select("query_id", "rank", "vec_id").collect())[0][:2] == (0, 1) and exact_top_k(few, F.col("vec_id") == 0).count() == 2
    assert exact_top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def as_vectors(rows, pivots):
    rows = np.asarray(rows, dtype=float)
    return Vectors(np.arange(len(rows)), rows, np.linalg.norm(rows, axis=1), distances(rows, pivots))


def some_of(v, at):
    return Vectors(*[x[at] for x in v])


def test_bounds_eliminate_nothing_that_counts():
    r = np.random.default_rng(9)
    c = r.integers(-200, 200, (6000, 8))
    all_ = as_vectors(c, c[10:14].astype(float))
    for i, found, scores, _ in best_of_block(some_of(all_, slice(0, 5)), np.full(5, -np.inf), all_, 20):
        best = sorted((-int(c[i] @ x), j) for j, x in enumerate(c) if j != i)[:20]
        assert [(-int(s), int(j)) for j, s in zip(found, scores, strict=True)] == best
    big = np.full((40, 2), 2**40)
    big[:, 0] += np.arange(40)
    large = as_vectors(big, big[:2].astype(float))
    (_, found, scores, _), = best_of_block(some_of(large, slice(0, 1)), np.full(1, -np.inf), large, 3)
    assert found.tolist() == [39, 38, 37] and int(scores[0]) == 2**40 * (2**40 + 39) + 2**80


def test_pivots_eliminate_most_of_clustered_vectors():
    """Of 40 clusters of 500 vectors a query's bounds leave about its own cluster, and whole cells beyond it are never met."""
    r = np.random.default_rng(12)
    centres = r.standard_normal((40, 32)) * 64
    rows = np.floor(np.repeat(centres, 500, axis=0) + r.standard_normal((20_000, 32)) * 4)
    all_ = as_vectors(rows, spread(rows[r.permutation(20_000)[:1024]], 64))
    asked = some_of(all_, slice(0, 20_000, 50))
    least = np.sort(asked.rows @ rows.T, axis=1)[:, -21]
    seen = [n for *_, n in best_of_block(asked, np.full(400, -np.inf), all_, 20)]
    assert np.mean(seen) < 0.1 * 20_000
    cell = np.argmin(all_.away, axis=1)
    stats = [SimpleNamespace(cell=int(c), n=int((cell == c).sum()), norm=all_.norms[cell == c].max(), size=32, low=all_.away[cell == c].min(axis=0), high=all_.away[cell == c].max(axis=0)) for c in np.unique(cell)]
    cells = Cells([type("Row", (), {"__getitem__": lambda self, k: getattr(self, k), **vars(x)})() for x in stats])
    met = cells.reached(asked.norms, asked.away, least)
    size = np.array([x.n for x in stats])
    assert (met @ size).mean() < 0.2 * 20_000
    # and no cell goes that holds one of the best
    best = np.argsort(-(asked.rows @ rows.T), axis=1, kind="stable")[:, :20]
    place = {c: i for i, c in enumerate(cells.cells.tolist())}
    assert all(met[i, place[int(cell[j])]] for i in range(400) for j in best[i])


def test_top_k_of_large_numbers(spark):
    """Scores beyond longs are ranked exactly and shown as null; what no double holds takes no part."""
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [-1e9, 0.0]), (3, [1e18, 1.0]), (4, [1e18, -1e18]), (5, [-1e18, 3.0]), (6, [1.0, 1.0]), (7, [1e308, 0.0]), (8, [1e200, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(64 * a) for a in x] for i, x in rows if i != 7}
    want = []
    for q in (0, 3, 6, 8):
        best = sorted((-sum(a * b for a, b in zip(ints[q], x, strict=True)), i) for i, x in ints.items() if i != q)
        want += [(q, rank, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for rank, (s, i) in enumerate(best, 1)]
    got = exact_top_k(df, F.col("vec_id").isin(0, 3, 6, 7, 8))
    assert sorted(((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()), key=str) == sorted(want, key=str)


def test_top_k_over_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(13)
    m = np.repeat(np.round(r.standard_normal((60, 6)), 2), 12, axis=0).astype(np.float32)  # each vector a dozen times
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(3, m[3].tolist())] * 90, "vec_id long, embedding array<float>")
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 16)
    ints = np.floor(64 * m.astype(float)).astype(int)
    ids, ints = np.append(np.arange(len(m)), [3] * 90), np.vstack([ints, np.repeat(ints[3:4], 90, axis=0)])
    want = []
    for q in range(0, len(m), 20):
        best = sorted((-int(ints[q] @ x), int(i)) for i, x in zip(ids, ints, strict=True) if i != q)[:7]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    got = exact_top_k(df, F.col("vec_id") % 20 == 0, k=7)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == want


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_line_dedup(rows):
    spots = sorted(((i is not None, i or 0), p, line) for i, t in rows if t is not None for p, line in enumerate(t.split("\n")) if line.strip(" \t\n\x0b\x0c\r"))
    gone = {(at, p) for n, (at, p, line) in enumerate(spots) if any(line == x or min(len(line), len(x)) >= SHORTEST and one_edit(line, x) for _, _, x in spots[:n])}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if ((i is not None, i or 0), p) not in gone) for i, t in rows}


def test_line_dedup(spark):
    r = random.Random(10)
    line = lambda n: "".join(r.choice("abcdé ñ中") for _ in range(n - 2)) + "xy"
    pool = [line(r.choice((5, 19, 20, 21, 22, 30, 41))) for _ in range(60)]

    def edited(x):
        i = r.randrange(len(x))
        return r.choice((x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x[:i] + "q" + x[i + 1 :], x, x))

    rows = [(i, "\n".join(edited(r.choice(pool)) if r.random() < 0.6 else r.choice(("", "  ", line(25)))  for _ in range(6))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, pool[3]), (102, "\n\n"), (103, "a" * 30_000), (104, "a" * 29_999), (105, "b" * 30_000 + "\n" + "b" * 30_002)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, h1 int, line int")
    got = dedup_lines(docs)
    assert got.columns == docs.columns
    assert {x.doc_id: x.text for x in got.collect()} == plain_line_dedup(rows)
    twins = spark.createDataFrame([(1, pool[0] + "\n" + pool[0])] * 2, "doc_id long, text string")
    assert [x.text for x in dedup_lines(twins).collect()] == [pool[0]] * 2
    assert dedup_lines(docs.limit(0)).count() == 0


def near_words(a, b, most):
    a, b = a.split(), b.split()
    short, long = sorted((a, b), key=len)
    if len(short) < 6:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= min(most, len(a) // 6)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("most", [1, 2, 3])
def test_line_dedup_by_words(spark, most):
    r = random.Random(most)
    word = lambda: "".join(r.choice("abcdéñ中") for _ in range(r.randint(2, 9)))
    pool = [[word() for _ in range(r.choice((4, 5, 6, 7, 11, 12, 13, 18, 40, 90)))] for _ in range(40)]

    def edited(words):
        words = list(words)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = word()
        at = r.randrange(len(words))
        return r.choice((" ", " ", "  ", "\t")).join(r.choice((words, words, words, words[:at] + words[at + 1 :], words[:at] + [word()] + words[at:])))

    rows = [(i, "\n".join(edited(r.choice(pool)) if r.random() < 0.8 else edited([word() for _ in range(12)]) for _ in range(5))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, " ".join(pool[3])), (102, "a " * 3000 + "b"), (103, "a " * 1500 + "c " + "a " * 1499 + "b"), (104, "a " * 2999 + "b")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, w int, of_words int")
    spots = sorted(((i is not None, i or 0), p, line) for i, t in rows if t is not None for p, line in enumerate(t.split("\n")) if line.strip())
    near = lambda a, b: a == b or min(len(a), len(b)) >= SHORTEST and one_edit(a, b) or near_words(a, b, most)
    gone = {(at, p) for n, (at, p, line) in enumerate(spots) if any(near(line, x) for _, _, x in spots[:n])}
    want = {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if ((i is not None, i or 0), p) not in gone) for i, t in rows}
    got = dedup_lines(docs, words=most)
    assert got.columns == docs.columns and {x.doc_id: x.text for x in got.collect()} == want
    assert want != plain_line_dedup(rows)
    assert dedup_lines(docs.limit(0), words=most).count() == 0
