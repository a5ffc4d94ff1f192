"""BPE, token files, mixing, sharding, toxicity and page text against libraries, brute force and held-out cases."""

import hashlib
import os
import random
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import bpe, mixing, page_text, ring, token_files, toxicity
from spindrift.llm.arrays import cut_by_bytes
from spindrift.llm.page_blocks import blocks

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a" * 40_000, "ab " * 20_000, "<|endoftext|> x", "\n\n\n  a\t\tb ", "l'été n'est pas I'll", "日本語の文 🎉👩‍👩‍👧", "é   x", "\x00\x1c\x85", "ΣΑΣ ǅ İstanbul"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_bpe_like_the_library(text):
    v = bpe.vocabulary(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    (ids, none) = v.encode_all([text, None])
    assert none == []
    assert ids == library.encode_ordinary(text) and v.decode(ids) == text.encode()


def test_bpe_over_a_table(spark, reference):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "null id", "x", 1), (0, "again", "x", 1)], "doc_id long, text string, ids string, id int")
    want = sorted((str(d.doc_id), len(i := reference.encode_ordinary(d.text or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()) for d in docs.collect())
    got = bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got.collect()) == want
    full = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(x.decoded) == (t or "").encode() for x, t in zip(sorted(full[:12], key=lambda x: x.doc_id or 0), ODD, strict=True) if x.doc_id)
    assert bpe.encode_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_forgets_words(reference, monkeypatch):
    vocabulary = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    monkeypatch.setattr(bpe, "BLOCK_AT_LEAST", 3)
    monkeypatch.setattr(bpe, "ROWS", 1)
    texts = ["one two three four", "five six seven one", "", None, "x" * 100 + " two"]
    batch = pa.record_batch([pa.array(range(5)), pa.array(texts)], names=["id", "text"])
    got = {i: vocabulary.ids_of(n) for ids, rows in bpe.encoded(iter([batch]), vocabulary) for i, n in zip(ids.to_pylist(), rows, strict=True)}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_bpe_blocks_span_documents(monkeypatch):
    """Wherever the rows have so many new words, a block has at least ten thousand, over many documents."""
    vocabulary, sizes = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN), []
    whole = vocabulary.encode_block
    monkeypatch.setattr(vocabulary, "encode_block", lambda words: sizes.append(len(words)) or whole(words))
    spelt = lambda n: "w" + "".join(chr(97 + n // 26**k % 26) for k in range(4))
    texts = [" ".join(spelt((i * 13 + j) % 70_000) for j in range(30)) for i in range(6_000)]
    batches = [pa.record_batch([pa.array(range(1000)), pa.array(texts[at : at + 1000])], names=["id", "text"]) for at in range(0, len(texts), 1000)]
    assert sum(len(rows) for _, rows in bpe.encoded(iter(batches), vocabulary)) == 6_000
    assert len(sizes) > 2 and min(sizes[:-1]) >= 10_000 and max(sizes) <= bpe.WORDS_IN_BLOCK and sum(sizes) == len(vocabulary.number)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=60) | st.text("aAéÉ.,!' \tz0ßµ", max_size=40) | st.sampled_from(["<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|>"]), max_size=4))
def test_words_like_the_library(texts):
    library = Tokenizer.from_file(WORDS)
    ids, counts = token_files.word_encoder(WORDS).encode(pa.array([*texts, None], pa.string()), 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [[*library.encode(t, add_special_tokens=False).ids, 7] for t in [*texts, ""]]


def test_words_forgotten_and_cut(monkeypatch):
    library, encoder = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    monkeypatch.setattr(token_files, "PIECES_KEPT", 3)
    monkeypatch.setattr(token_files, "PIECES_AT_ONCE", 2)
    for text in ("one two three four five", "six one", "", "x" * 500 + " two, two"):
        ids, _ = encoder.encode(pa.array([text]), None)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["aaaa", None, "bbbbbbbb", "c"])], names=["a", "b"])
    assert [x.column(0).to_pylist() for x in cut_by_bytes(batch, 1, 5)] == [[1, 2], [3], [4]]


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    rows = [(i, t) for i, t in enumerate(ODD)][::-1]
    docs = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, start string")
    start, want = 0, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.token_file_digests(docs, WORDS)
    assert sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in got.collect()) == want
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, WORDS)
    files = token_files.read_tokens(spark, path)
    assert sum(len(x.ids) for x in files.collect()) == start
    import glob

    meta = [pq.ParquetFile(f).metadata for f in glob.glob(path + "/part-*")]
    lists = [m.row_group(0).column(4) for m in meta if m.num_rows]
    assert any("DICTIONARY" in str(c.encodings) for c in lists) and all(c.has_column_index and c.has_offset_index for c in lists)
    same = spark.createDataFrame([(None, "b"), (None, None), (3, "a"), (3, "a"), (3, "c")], "doc_id long, text string")
    told = token_files.token_file_digests(same, WORDS).collect()
    assert len(told) == 5 and sorted(x.start for x in told) == sorted(np.cumsum([0] + [x.n_tokens for x in sorted(told, key=lambda x: x.start)])[:-1].tolist())
    assert token_files.token_file_digests(docs.limit(0), WORDS).count() == 0


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped |= more


def test_mixing(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.choice((0, 1, 5, 40)))), r.choice(["a", "b", "b", "b", "b", "c", "Z", "é", None, "zz"])) for i in range(3000)]
    rows += [(None, "x y", "tiny"), (5000, None, "a"), (5001, "w " * 30_000, "b"), (0, rows[0][1], rows[0][2]), (6000, "", "void")]
    docs = spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id long, text string, source string, size string, key int")
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    taken, longest = Counter(), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source])
        assert 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size
        taken[x.source] += x.taken
        longest[x.source] = max(longest[x.source], x.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    repeated = mixing.mixed(docs)
    assert repeated.columns == docs.columns
    assert Counter(len((x.text or "").split()) for x in repeated.collect()) == sum((Counter({x.size: x.copies}) for x in got), Counter())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[7], [None], [7, 8], list(range(3))])
def test_mixing_of_repeated_rows(spark, ids):
    """The budget of a source that is one row, or a few, again and again is met to the document."""
    ids = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = ids.crossJoin(spark.range(10_000 // ids.count(), numPartitions=5)).select("doc_id", F.lit("two words").alias("text"), F.lit("a").alias("source"), "id")
    docs = rows.unionByName(spark.range(2500, numPartitions=2).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("b").alias("source"), "id"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max(F.expr("taken / size")).alias("times")).collect()
    assert len(got) == 2 and all(abs(x.taken - x.target) <= x.size / 2 and x.times <= 3 for x in got) and sum(x.n for x in got) == docs.count()
    copies = mixing.mixed(docs).groupBy("source").count().collect()
    assert {x.source: x["count"] for x in copies} == {x.source: x.taken // x.size for x in got}


def plain_ring(keys, nodes, most):
    """One key after the other in ring order, each walking clockwise from its own node to a shard with room."""
    held, out = Counter(), []
    for cell in keys:
        at = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        while held[nodes[at % len(nodes)][1]] >= most[nodes[at % len(nodes)][1]]:
            at += 1
        shard = nodes[at % len(nodes)][1]
        out.append((cell, shard, held[shard]))
        held[shard] += 1
    return out


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_ring_by_hand(slack):
    r = random.Random(2)
    keys = sorted(r.randrange(64) for _ in range(501))
    nodes = ring.nodes(7, 5, 6)
    most = ring.bounds(501, 7, slack)
    told = [(cell, shard, slot + i) for cell, first, end, shard, slot in ring.spans(Counter(keys), nodes, most) for i in range(end - first)]
    assert told == plain_ring(keys, nodes, most)


def test_sharding(spark):
    rows = [(i, f"text {i % 50}") for i in range(1003)] + [(None, None), (1, "text 1"), (2, ""), (3, "long " * 20_000)]
    docs = spark.createDataFrame([(*x, "q", 9) for x in rows], "doc_id long, text string, shard string, cell int")
    got = ring.shard(docs, 40).collect()
    held = Counter(x.shard for x in got)
    assert len(got) == len(rows) and len(held) == 40 and max(held.values()) - min(held.values()) <= 1
    assert all(sorted(x.slot for x in got if x.shard == s) == list(range(held[s])) for s in held)
    assert {(x.doc_id, x.size, x.text_crc32) for x in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    unique = docs.where("doc_id between 10 and 900")
    before, after = ({x.doc_id: x.shard for x in ring.shard(unique, n, slack=0.25).collect()} for n in (40, 41))
    assert sum(before[i] != after[i] for i in before) < 0.2 * len(before)
    assert {x.shard for x in ring.shard(docs.limit(3), 40).collect()} <= set(range(40)) and ring.shard(docs.limit(0), 40).count() == 0


def labelled(n, seed, bad=("idiot", "moron", "worthless", "scumbag")):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "do", "ri", "ne", "la", "mu", "ti", "or", "st", "un")) for _ in range(r.randint(1, 3)))
    out = []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randint(5, 60))], int(r.random() < 0.25)
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
        out.append((i, " ".join(words) + ".", toxic))
    return out


def test_toxicity(spark):
    rows = labelled(900, 3)
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in rows] + [(None, "x", "q"), (5000, None, "q"), (5001, "", "q"), (5002, "un " * 50_000, "q"), (5002, "again", "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7000, None), (7001, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    got = {x.doc_id: x for x in toxicity.score(docs, model).where("doc_id < 5000").collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    assert 250 < len(held) < 350 and sum(x.predicted == y for x, y in held) > 0.97 * len(held)
    told = toxicity.score(docs, model).collect()
    assert len(told) == 905 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in told)
    clean, gapped = model.scores(["ba do ri.", "ba do i.d.i.o.t ri", "you m o r o n un", "idi-ot", ""])[0], model.scores(["ba do i.d.i.o.t ri", "you m o r o n un", "idi-ot", "idioot"])
    assert clean < 0.2 and min(gapped[:3]) > 0.7 and gapped[3] > clean
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not x.predicted for x in told)
    assert toxicity.score(docs.limit(0), model).count() == 0
    one_sided = toxicity.fitted(docs, labels.where("toxic = 0"))
    assert 0 < one_sided.scores(["x"])[0] < 0.5 and toxicity.train([], []).scores([None])[0] < 0.7


def test_kernel_is_a_cosine():
    words = ["idiot", "i-d-i-o-t", "banana", "aa", "a"]
    rows, codes, weights = toxicity.subsequences(words)
    maps = [dict(zip(codes[rows == i].tolist(), weights[rows == i].tolist(), strict=True)) for i in range(5)]
    for word, got in zip(words, maps, strict=True):
        marked, want = f"^{word}$", Counter()
        for i in range(len(marked)):
            for k in range(i + 2, min(len(marked), i + toxicity.SPAN)):
                for j in range(i + 1, k):
                    want[ord(marked[i]) << 42 | ord(marked[j]) << 21 | ord(marked[k])] += toxicity.DECAY ** (k - i - 2)
        norm = sum(w * w for w in want.values()) ** 0.5
        assert got == pytest.approx({c: w / norm for c, w in want.items()})


def test_blocks():
    html = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=x>One</a><li>Two</ul></nav><p class='big x'>a&amp;b <b>bold</b><br>c\n d<p>e<!-- no --><div id=y>f</div></body>"
    told = [(b.text, [n.name for n in b.node.path()], b.linked) for b in blocks(html)]
    assert told == [("T", ["html", "head", "title"], 0), ("One", ["html", "body", "nav", "ul", "li"], 3), ("Two", ["html", "body", "nav", "ul", "li"], 0), ("a&b bold c d", ["html", "body", "p"], 0), ("e", ["html", "body", "p"], 0), ("f", ["html", "body", "div"], 0)]
    for odd in (None, "", "<", "<p", "<!--", "</p></p>", "<a><a>", "text only", "<script>", "<p>" * 3000 + "x", "&#xZZ; &bogus;"):
        assert isinstance(blocks(odd), list)


def test_tags_are_read_as_browsers_read_them():
    text = lambda html: [b.text for b in blocks(html)]
    assert text("<p title=it's>One two</p><p>three isn't</p><p>four</p>") == ["One two", "three isn't", "four"]
    assert text("<p>a</p><script>x</script foo><p>b</p><style>c</style\n><p>d</p>") == ["a", "b", "d"]
    assert text("<p>1 < 2 <3 & </ b> c<>d</p><!-->e<!-- f --><p>g<!x>h<?y>i") == ["1 < 2 <3 & c<>d", "e", "ghi"]
    assert text('<p a="1>2" b=\'<p>\' c = d>x<br/>y</p><p/>z') == ["x y", "z"]
    assert text("<p>a<p>b <a href=/x/>c</a> d") == ["a", "b c d"]
    (block,) = blocks('<div class="A-b c" id=d role=\'e\'>x')
    assert block.node.named == ("a", "b", "c", "d", "e")


@pytest.mark.parametrize("unit", ['<a title="x ', "<b>t<div>x</div>", "<b><div>", "<p><i>x", "</b>", "<!--", "<", "<a x=y ", "<script>", "&#", "<td><b>x", "<b><p>x</b>"])
def test_reading_takes_time_by_the_length_of_a_page(unit):
    field = page_text.Field({"in b": 1.0}, np.zeros((2, 2)), 0.0)
    begun = time.process_time()
    page = blocks("<b>" * 2000 + "<div>" * 2000 + unit * (1_000_000 // len(unit)) + "</b>" * 2000)
    field.decode(page)
    assert time.process_time() - begun < 60


#: Pages labelled by hand, whose layouts are none of those that pages are made of for training: (html, blocks of main text).
BY_HAND = [
    (
        """<html><body><div class="zz-shell"><div class="glob-hd"><a href="/"><span>The Daily</span></a><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></div>
        <div class="zz-prose"><h1>River towns prepare for spring floods</h1><p>Residents along the river have begun stacking sandbags, and the council opened two shelters on Monday.</p>
        <p>The last flood of this size came in 1997, when the bridge was closed for a week.</p><blockquote><p>We have learned from it, said the mayor.</p></blockquote><h2>What to expect</h2><ul><li>High water from Thursday on.</li><li>Closed roads in the old town.</li></ul></div>
        <div class="zz-foot"><p>© 2024 The Daily. All rights reserved.</p><a href="/t">Terms</a></div></div></body></html>""",
        ["River towns prepare for spring floods", "Residents along the river have begun stacking sandbags, and the council opened two shelters on Monday.", "The last flood of this size came in 1997, when the bridge was closed for a week.", "We have learned from it, said the mayor.", "What to expect", "High water from Thursday on.", "Closed roads in the old town."],
    ),
    (
        """<html><body><nav><a href=1>Start</a> | <a href=2>Archiv</a></nav><main><h1>Brot backen ohne Hefe</h1><p>Sauerteig braucht Geduld, aber sonst nur Mehl, Wasser und Salz.<p>Am ersten Tag rührt man alles an und lässt es stehen.
        <table><tr><td>Mehl<td>500 g<tr><td>Wasser<td>350 ml</table></main><aside><h3>Mehr Rezepte</h3><ul><li><a href=3>Pizza</a><li><a href=4>Kuchen</a></ul></aside><footer>Impressum</footer></body></html>""",
        ["Brot backen ohne Hefe", "Sauerteig braucht Geduld, aber sonst nur Mehl, Wasser und Salz.", "Am ersten Tag rührt man alles an und lässt es stehen.", "Mehl", "500 g", "Wasser", "350 ml"],
    ),
    (
        """<html><body><header><h2>Notes of a gardener</h2></header><article><h1>Pruning roses</h1><p>Cut above a bud that faces outward, at a slant, so that rain runs off.</p><aside><p>Buy our new shears today.</p></aside>
        <p>Old wood goes out entirely.</p><p>Done.</p></article><section id="disqus-thread"><h3>3 responses</h3><article><p>Great advice, thank you so much for it.</p></article><article><p>I always do it in autumn instead.</p></article></section></body></html>""",
        ["Pruning roses", "Cut above a bud that faces outward, at a slant, so that rain runs off.", "Old wood goes out entirely.", "Done."],
    ),
    (
        """<html><body><form><label>Search</label><input type=text><button>Go</button></form><div class="ck-banner-x9" role="dialog"><p>We use small files to make this site better. By going on you agree.</p><button>Fine</button></div>
        <article><h1>A short history of tea</h1><p>Tea came to Europe by ship in the seventeenth century, and was a luxury at first.</p><pre>1610 first cargo
        1657 first shop</pre><p>By 1800 it was in every house.</p></article></body></html>""",
        ["A short history of tea", "Tea came to Europe by ship in the seventeenth century, and was a luxury at first.", "1610 first cargo 1657 first shop", "By 1800 it was in every house."],
    ),
    (
        """<html><body><table><tr><td><a href=a>Home</a><br><a href=b>Links</a><br><a href=c>Guestbook</a></td><td><article><h1>My telescope</h1><p>I built it in the winter of 1998 from a kit, and it still works well.<p>The mirror is eight inches wide.</article></td></tr></table><footer><p>Last changed on a Tuesday.</p></footer></body></html>""",
        ["My telescope", "I built it in the winter of 1998 from a kit, and it still works well.", "The mirror is eight inches wide."],
    ),
    (
        """<html><body><div><ul><li><a href=/>Inicio</a></li><li><a href=/c>Contacto</a></li></ul></div><div class="nota-larga"><h1>El mercado abre de nuevo</h1><p>Tras dos años de obras, el mercado central abre el sábado con cuarenta puestos.</p><div class="prm0-box"><a href="/oferta">Oferta: suscríbase ya</a></div><p>Los vecinos lo esperan con ganas.</p></div><div><h4>También en portada</h4><ul><li><a href=/1>Lluvias en el norte</a></li><li><a href=/2>Nuevo tren</a></li></ul></div></body></html>""",
        ["El mercado abre de nuevo", "Tras dos años de obras, el mercado central abre el sábado con cuarenta puestos.", "Los vecinos lo esperan con ganas."],
    ),
]


def test_page_text_on_pages_labelled_by_hand():
    field = page_text.trained()
    right = found = wanted = 0
    for html, main in BY_HAND:
        page = blocks(html)
        told = Counter(b.text for b, y in zip(page, field.decode(page), strict=True) if y)
        assert not Counter(main) - Counter(b.text for b in page)
        right, found, wanted = right + (told & Counter(main)).total(), found + told.total(), wanted + len(main)
    assert 2 * right / (found + wanted) >= 0.85


def test_page_text_on_unseen_layouts():
    field = page_text.trained()
    unseen = [page_text.labelled(*p) for p in page_text.labelled_pages(120, seed=77)]
    wrong = sum(a != b for page, y in unseen for a, b in zip(field.decode(page), y, strict=True))
    assert wrong < 0.01 * sum(len(y) for _, y in unseen)


def test_viterbi_finds_the_best_labels():
    from itertools import product

    field = page_text.trained()
    page, _ = page_text.labelled(*page_text.labelled_pages(1, seed=5)[0])
    page = page[:9]
    own = [sum(field.weights.get(f, 0.0) for f in page_text.path_features(b.node)) + sum(field.weights.get(f, 0.0) for f in page_text.text_features(b)) for b in page]

    def total(y):
        return sum(o for o, x in zip(own, y, strict=True) if x) + field.start * y[0] + sum(field.steps[a][b] for a, b in zip(y, y[1:], strict=False))

    assert total(field.decode(page)) == pytest.approx(max(map(total, product((0, 1), repeat=len(page)))))


def test_page_table(spark):
    html = "<html><body><nav><a href=a>Home</a> <a href=b>News</a></nav><article><h1>A title &amp; more</h1><p>First paragraph of the text, long enough to read well.</p><p>Second one\n  goes on.</p></article><footer>Imprint</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", html, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", html, "t"), (1, "u", html, "t")], "page_id long, url string, html string, text string")
    got = page_text.extract(pages).collect()
    want = "A title & more First paragraph of the text, long enough to read well. Second one goes on."
    assert Counter((x.page_id, x.text, x.n_chars) for x in got) == Counter({(1, want, len(want)): 2, (None, want, len(want)): 1, (2, "", 0): 1, (3, "", 0): 1})
    assert page_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["math", "object", "svg", "noscript", "template", "iframe"])
def test_blocks_within_embedded_elements(name):
    told = [b.text for b in blocks(f"<p>a</p><{name}><p>x = 1</p></{name}><p>b</p>")]
    assert told == ["a", "x = 1", "b"]
    assert [b.text for b in blocks(f"<p>a</p><{name}><p>b</p><p>c</p>")] == ["a", "b", "c"]
    assert [b.text for b in blocks("<p>a</p><script><p>b</p></script><style>c</style><textarea>d</textarea><p>e</p>")] == ["a", "e"]


def test_places_in_the_sample_go_to_usable_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 5)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 5)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 1600)
    usable = [i for i in range(400) if i % 20 == 0 and zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, "short" if i % 20 == 0 else None if i % 3 == 0 else "x" * 101) for i in range(200)] + [(i, "short") for i in range(200, 400, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i // 20) % 2) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.sampled(docs, labels).collect()
    toxic = sum((i // 20) % 2 for i in usable)
    assert Counter(x.y for x in got) == {1: min(5, toxic), 0: min(5, len(usable) - toxic)} and {x.id for x in got} <= set(usable)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 16)
    assert Counter(x.y for x in toxicity.sampled(docs.withColumn("text", F.lit("a")), labels).collect()) == {1: 5, 0: 5}
    monkeypatch.setattr(toxicity, "MOST_BYTES", 3 * 16)
    assert Counter(x.y for x in toxicity.sampled(docs.withColumn("text", F.lit("abc")), labels).collect()) == {1: 5, 0: 5}
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 100)
    assert Counter(x.y for x in toxicity.sampled(docs.withColumn("text", F.lit("abc")), labels).collect()) == {1: 5, 0: 16}


def test_scores_are_the_same_under_any_hash_seed():
    code = "from test_texts import labelled\nfrom spindrift.llm import toxicity\nr = labelled(150, 5)\nm = toxicity.train([t for _, t, _ in r[:100]], [y for *_, y in r[:100]])\nprint(m.scores([t for _, t, _ in r]))"
    here = os.path.dirname(os.path.abspath(__file__))
    told = {subprocess.run([sys.executable, "-c", code], cwd=here, env=os.environ | {"PYTHONHASHSEED": str(seed)}, capture_output=True, text=True, check=True).stdout for seed in range(3)}
    assert len(told) == 1 and "0." in told.pop()


TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")
def test_toxicity_of_held_out_texts():
    """Of the held-out toxic texts some 9 in 144 hold nothing that any other toxic text holds, so not all can be found."""
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{TABLES}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{TABLES}/labels.parquet").to_pylist() if texts.get(r["doc_id"])}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in labels}
    learnt = sorted(i for i in labels if not held[i])
    model = toxicity.train([texts[i] for i in learnt], [labels[i] for i in learnt])
    asked = sorted(i for i in labels if held[i])
    told = Counter((labels[i], s >= toxicity.THRESHOLD) for i, s in zip(asked, model.scores([texts[i] for i in asked]), strict=True))
    assert told[1, True] >= 0.82 * (told[1, True] + told[1, False]) and told[1, True] >= 0.9 * (told[1, True] + told[0, True])
