"""The thin queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.simhash import hex16, simhash_groups

    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spindrift.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spindrift.llm.token_files import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op4_near_vectors"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept
FROM embeddings e JOIN comp ON comp.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.exact_topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op10_exact_topk"] = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT *, ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, size::VARCHAR)), 1, 15))::BIGINT AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS lim,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level FROM s
      WINDOW b AS (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE NOT level > lim::DOUBLE / weight ORDER BY lim::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level > lim::DOUBLE / weight THEN lim::DOUBLE ELSE weight * (SELECT level FROM f) END AS target FROM l),
w AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
r AS (SELECT k.doc_id, k.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM k JOIN w ON k.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN 2 * start + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


@query
def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.ring import shard

    found = shard(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op5_line_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op5_line_dedup``, whose SQL knows one code point alone, and with up to two words replaced or one more or less."""
    from spindrift.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"), words=2)
    return kept.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))


ORACLES["op5_line_dedup"] = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS line FROM s),
y AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' AS blank,
        row_number() OVER (ORDER BY doc_id, place) AS o FROM x),
d AS (SELECT line, min(o) AS o, length(line) AS n FROM y WHERE NOT blank GROUP BY line),
v AS (SELECT line, o, n, i, md5(substr(line, 1, i - 1) || substr(line, i + 1)) AS rest
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 20)),
near AS (
  SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY n, i, rest) AS m FROM v) WHERE m < o
  UNION SELECT greatest(v.o, d.o) FROM v JOIN d ON d.n >= 20 AND v.n = d.n + 1 AND v.rest = md5(d.line)),
gone AS (SELECT y.o FROM y JOIN d USING (line) WHERE NOT y.blank AND (y.o > d.o OR d.o IN (SELECT o FROM near))),
kept AS (SELECT y.doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM y WHERE y.o NOT IN (SELECT o FROM gone) GROUP BY y.doc_id)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  length(CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END)::BIGINT AS n_chars
FROM documents t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.toxicity import fitted, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fitted(docs, table(spark, sf_dir, "labels")))


@query
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.page_text import extract

    return extract(table(spark, sf_dir, "pages"))
