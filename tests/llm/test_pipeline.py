"""The pipeline's stages, each over what the one before it kept, against plain Python."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_pairs import SHORTEST, components, near_words, one_edit, plain_fingerprint
from test_texts import RANKS, labelled, plain_targets

from spindrift.llm import bpe, toxicity
from spindrift.staging import staged


def test_pipeline(spark, tmp_path):
    texts = [(i, t.replace(" ", "\n", 1) if i % 7 == 0 else t, y) for i, t, y in labelled(900, 3)]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t, _ in texts]
    rows += [(1000, None, "en", "a", None), (1001, "", "en", "b", 0), (None, "null id text", "en", None, 12)]
    rows += [(2000 + i, rows[i][1], "en", "d", rows[i][4]) for i in range(0, 60, 3)]
    words = texts[1][1].split()
    rows += [(3000, " ".join(["other", *words[1:]]), "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    model = toxicity.fitted(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        after[name] = docs.collect()

    told = dict(zip([r[0] for r in rows], model.scores([r[1] for r in rows]), strict=True))
    assert {x.doc_id for x in after["toxicity"]} == {i for i, s in told.items() if s < toxicity.THRESHOLD}
    dropped = {i for i, _, y in texts} - {x.doc_id for x in after["toxicity"]}
    assert dropped and sum(y for i, _, y in texts if i in dropped) > 0.9 * len(dropped)

    key = lambda i: (i is not None, i or 0)
    spots = sorted((key(x.doc_id), p, line) for x in after["toxicity"] if x.text is not None for p, line in enumerate(x.text.split("\n")) if line.strip())
    near = lambda a, b: a == b or min(len(a), len(b)) >= SHORTEST and one_edit(a, b) or near_words(a, b, 2)
    gone = {(at, p) for n, (at, p, line) in enumerate(spots) if any(near(line, x) for _, _, x in spots[:n])}
    want = {x.doc_id: None if x.text is None else "\n".join(line for p, line in enumerate(x.text.split("\n")) if (key(x.doc_id), p) not in gone) for x in after["toxicity"]}
    assert {x.doc_id: x.text for x in after["line_dedup"]} == want and gone and "" in want.values()
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in after["line_dedup"])

    kept = {x.doc_id: x.text for x in after["simhash"]}
    fps = {plain_fingerprint(t) for i, t in want.items() if i is not None}
    root = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i in sorted(i for i in want if i is not None):
        least.setdefault(root[plain_fingerprint(want[i])], i)
    assert kept == {i: want[i] for i in {*least.values(), None} & want.keys()} and len(kept) < len(want)

    sizes, taken, longest = Counter(), Counter(), Counter()
    for x in after["simhash"]:
        sizes[x.source] += len((x.text or "").split())
        longest[x.source] = max(longest[x.source], len((x.text or "").split()))
    for x in after["mixing"]:
        assert kept[x.doc_id] == x.text
        taken[x.source] += len((x.text or "").split())
    assert all(abs(taken[s] - w) <= longest[s] for s, w in plain_targets(sizes).items())

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(",".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest()
    last = Counter((x.doc_id, digest(x.text)) for x in after["mixing"])
    assert Counter((x.doc_id, x.ids_sha256) for x in after["byte_bpe"]) == last
    assert Counter((x.doc_id, x.ids_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == last
