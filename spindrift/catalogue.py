"""Registered queries over the standard tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import scorers
from spindrift.functions.template import Template, python_text
from spindrift.operators import gates, load, reports
from spindrift.operators.evaluate import enough_pass, evaluate
from spindrift.operators.transform import Rules, cache_key, complete_once, parsed, transform
from spindrift.operators.vector_cache import cache_hits
from spindrift.plans.resilience import Backoff, recovery_action, trace
from spindrift.plans.runner import counts
from spindrift.sources import readers
from spindrift.spec import EvaluateSpec, ExtractSpec, Format, Gate, ScorerSpec, TransformSpec
from spindrift.staging import new_path, staged

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.as_records(table(spark, sf_dir, "documents"), "documents.parquet", Format.PARQUET)


SCORERS = (
    ScorerSpec("quality", "column", 0.5, 2.0, "quality"),
    ScorerSpec("safe", "column", 0.5, 1.0, "1 - toxic"),
    ScorerSpec("long", "column", 0.8, 0.5, "least(1.0D, char_length(text) / 1000)"),
)
PROMPT = Template("Classify the document in $lang: $text")
CLASSES = Rules((("n_chars > 2000", "long"), ("n_chars > 500", "medium")), default="short", fails="lang = 'es' AND n_chars < 300")


def gated(spark: SparkSession, sf_dir: str, gate: Gate = Gate.ALL, threshold: float | None = None, provider: Rules = CLASSES) -> DataFrame:
    """Documents with their labels through transform and evaluate."""
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate(transform(docs, PROMPT, TransformSpec("-"), provider), spec_of(gate, threshold))


def spec_of(gate: Gate = Gate.ALL, threshold: float | None = None) -> EvaluateSpec:
    return EvaluateSpec(SCORERS, gate, threshold)


#: The rows of ``gated`` in SQL: scores q, s and n are null where the transform failed.
GATED = """
WITH base AS (
  SELECT d.*, l.quality, l.toxic, (row_number() OVER (ORDER BY d.doc_id) - 1)::VARCHAR AS record_id,
    coalesce(d.lang = 'es' AND d.n_chars < 300, false) AS broke
  FROM documents d LEFT JOIN labels l USING (doc_id)),
t AS (SELECT *, CASE WHEN broke THEN NULL WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'medium' ELSE 'short' END AS reply FROM base),
e AS (SELECT *, CASE WHEN NOT broke THEN quality::DOUBLE END AS q, CASE WHEN NOT broke THEN (1 - toxic)::DOUBLE END AS s,
    CASE WHEN NOT broke THEN least(1.0::DOUBLE, length(text) / 1000) END AS n FROM t),
w AS (SELECT *, coalesce(q * 2, 0) + coalesce(s, 0) + coalesce(n * 0.5::DOUBLE, 0) AS sw,
    CASE WHEN q IS NULL THEN 0 ELSE 2 END + CASE WHEN s IS NULL THEN 0 ELSE 1 END + CASE WHEN n IS NULL THEN 0 ELSE 0.5::DOUBLE END AS ww FROM e),
g AS (SELECT *, coalesce(q >= 0.5, false)::INT + coalesce(s >= 0.5, false)::INT + coalesce(n >= 0.8, false)::INT AS k,
    CASE WHEN broke THEN NULL ELSE coalesce(q >= 0.5, false) AND coalesce(s >= 0.5, false) AND coalesce(n >= 0.8, false) END AS gate FROM w),
long AS (
  SELECT record_id, 'quality' AS evaluator_name, q AS score, 0.5::DOUBLE AS threshold, coalesce(q >= 0.5, false) AS passed FROM g
  UNION ALL SELECT record_id, 'safe', s, 0.5::DOUBLE, coalesce(s >= 0.5, false) FROM g
  UNION ALL SELECT record_id, 'long', n, 0.8::DOUBLE, coalesce(n >= 0.8, false) FROM g)
"""


# Sources


@query("""SELECT (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS record_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index,
  'parquet' AS source_type, 'extracted' AS status, doc_id, lang, source FROM documents""")
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(*[F.col(f"__{c}").alias(c) for c in ("record_id", "row_index", "source_type", "status")], "doc_id", "lang", "source")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents QUALIFY row_index >= 20 AND row_index < 70")
def extract_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.part_of(documents(spark, sf_dir), 20, 50).select("doc_id", F.col("__row_index").alias("row_index"))


@query("SELECT doc_id FROM documents")
def extract_slice_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.part_of(documents(spark, sf_dir), 0, 0).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 15")
def extract_slice_from_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.part_of(documents(spark, sf_dir), -15).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def extract_sql_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return readers.query(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > {{ least }} AND o_orderstatus = '{{ status }}'", {"least": 250000.0, "status": "F"})


@query("""SELECT n_name, count(*) AS orders, sum(o_totalprice) AS revenue FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def extract_sql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return readers.query(spark, "SELECT n_name, count(*) AS orders, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("""SELECT 'record' AS kind, (row_number() OVER () - 1)::VARCHAR AS value FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'document', doc_id::VARCHAR FROM documents JOIN labels USING (doc_id)""")
def extract_sql_join_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of wide rows that come out of a sort-merge join: each has an id of its own, from 0 without gaps."""
    for name in ("documents", "labels"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    found = readers.extract(spark, ExtractSpec("-", query="SELECT /*+ MERGE(l) */ d.*, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id"))
    both = F.array(F.struct(F.lit("record").alias("kind"), F.col("__record_id").alias("value")), F.struct(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("value")))
    return found.select(F.explode(both).alias("x")).select("x.*")


@query("""SELECT c_custkey, c_name, count(*) OVER () AS total, true AS has_more, '60' AS next_cursor FROM customer
  QUALIFY row_number() OVER (ORDER BY c_custkey) BETWEEN 41 AND 60""")
def extract_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, told = readers.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 40, 20)
    return rows.select("*", F.lit(told["total"]).cast("long").alias("total"), F.lit(told["has_more"]).alias("has_more"), F.lit(told["next_cursor"]).alias("next_cursor"))


def _roundtrip(spark: SparkSession, sf_dir: str, kind: Format) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(', "x"')).alias("event_type"), "value", "props")
    path = f"{new_path(spark, 'roundtrip')}.{kind}"
    load.write(rows, path, kind, "overwrite")
    load.write(rows, path, kind, "append")
    back = readers.read(spark, path, kind) if kind != Format.JSON else spark.read.json(path)
    return back.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])


_TWICE = "SELECT event_id, event_type || ', \"x\"' AS event_type, value, props FROM (SELECT * FROM events UNION ALL SELECT * FROM events)"


@query(_TWICE)
def load_append_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, Format.CSV)


@query(_TWICE)
def load_append_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, Format.JSON)


@query(_TWICE)
def load_append_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, Format.JSONL)


@query(_TWICE)
def load_append_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, Format.PARQUET)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN upper(o_orderstatus) || '!' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def load_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), new_path(spark, "upsert")
    load.write(rows, path, Format.PARQUET, "overwrite")
    changed = rows.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.concat(F.upper("o_orderstatus"), F.lit("!")))
    load.write(changed, path, Format.PARQUET, "upsert", key="o_orderkey")
    return spark.read.parquet(path)


# Transform


@query("SELECT doc_id, sha256('Classify the document in ' || lang || ': ' || text) AS prompt_sha FROM documents")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(PROMPT.rendered(docs), 256).alias("prompt_sha"))


@query("""SELECT doc_id, 'q=' || coalesce(quality::VARCHAR, 'None') || ' t=' || coalesce(CASE WHEN toxic = 1 THEN 'True' ELSE CASE WHEN toxic = 0 THEN 'False' END END, 'None') || ' $5' AS prompt
  FROM documents LEFT JOIN labels USING (doc_id)""")
def prompt_null_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("t", F.col("toxic") == 1)
    return rows.select("doc_id", Template("q=${quality} t=$t $$5").rendered(rows).alias("prompt"))


@query("SELECT event_id, value::VARCHAR AS printed FROM events")
def prompt_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", python_text(rows, "value").alias("printed"))


@query("SELECT doc_id, 'Missing template variable' AS error, 'error' AS status FROM documents")
def transform_missing_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = transform(documents(spark, sf_dir), Template("about $nothing"), TransformSpec("-"), CLASSES)
    return told.select("doc_id", F.substring("__error", 1, 25).alias("error"), F.col("__status").alias("status"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buyer' WHEN value > 100 THEN 'big' ELSE 'other' END AS text, 'transformed' AS status FROM events""")
def transform_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = readers.as_records(table(spark, sf_dir, "events"), "events", Format.PARQUET)
    told = transform(events, Template("$event_type"), TransformSpec("-"), Rules((("event_type = 'purchase'", "buyer"), ("value > 100", "big")), "other"))
    return told.select("event_id", F.col("__text").alias("text"), F.col("__status").alias("status"))


@query("""SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'transformed' END AS status, CASE WHEN event_type = 'error' THEN 'rejected by rule' END AS error,
  count(*) AS n FROM events GROUP BY ALL""")
def transform_error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = readers.as_records(table(spark, sf_dir, "events"), "events", Format.PARQUET)
    told = transform(events, Template("$event_type"), TransformSpec("-"), Rules(fails="event_type = 'error'"))
    return told.groupBy(F.col("__status").alias("status"), F.col("__error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


_KEY = "sha256(text || ':gpt-4o-mini:1')"


@query(f"SELECT doc_id, {_KEY} AS key, length(text)::VARCHAR AS text, substr({_KEY}, 1, 1) < '8' AS cached FROM documents")
def transform_call_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the keys are in the cache, some entries of it stale or doubled; every other prompt is completed once."""
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__prompt"))
    keys = prompts.select(cache_key(F.col("__prompt"), "gpt-4o-mini", "1").alias("key"), F.char_length("__prompt").cast("string").alias("text")).distinct()
    day = F.lit("2024-01-02 00:00:00").cast("timestamp")
    fresh = keys.where("substr(key, 1, 1) < '8'").select("key", "text", day.alias("cached_at"), F.lit(86400).alias("ttl_seconds"))
    stale = keys.select("key", F.lit("stale").alias("text"), F.lit("2024-01-01").cast("timestamp").alias("cached_at"), F.lit(60).alias("ttl_seconds"))
    done = complete_once(prompts, fresh.unionByName(stale), lambda wanted: wanted.withColumn("text", F.char_length("__prompt").cast("string")), "gpt-4o-mini", "1", F.lit("2024-01-02 12:00:00").cast("timestamp"))
    return done.select("doc_id", "key", "text", "cached")


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 3 = 0 THEN 'So: ' || props END AS text FROM events""")
def transform_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as columns; every third one isn't JSON and stays as text."""
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("So: "), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", parsed(reply, {"k": "bigint"}).alias("p")).select("event_id", "p.*")


# Scorers

_TURNS = """WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS a,
  list_distinct(list_filter(string_split_regex(lower(before), '\\s+'), lambda x: x <> '')) AS b, before IS NULL OR text IS NULL AS void FROM p)
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    return turns.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))


@query(_TURNS + """SELECT conv_id, turn, CASE WHEN void THEN NULL WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS score FROM t""")
def score_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(scorers.jaccard(F.col("text"), F.col("before")), 9).alias("score"))


@query(_TURNS + "SELECT conv_id, turn, CASE WHEN void OR len(a) = 0 THEN NULL ELSE round(len(list_intersect(a, b)) / len(a), 9) END AS score FROM t")
def score_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(scorers.share_found(F.col("text"), F.col("before")), 9).alias("score"))


@query(_TURNS + "SELECT conv_id, turn, CASE WHEN void OR len(b) = 0 THEN NULL ELSE round(len(list_intersect(a, b)) / len(b), 9) END AS score FROM t")
def score_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(scorers.share_found(F.col("before"), F.col("text")), 9).alias("score"))


@query("""SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], z.embedding::DOUBLE[]), 9) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z""")
def score_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").select(F.col("embedding").alias("first"))
    return rows.join(F.broadcast(first)).select("vec_id", F.round(scorers.cosine(F.col("embedding"), F.col("first")), 9).alias("score"))


@query("""WITH h AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], z.embedding::DOUBLE[]) AS s
  FROM embeddings e JOIN embeddings z ON e.vec_id % 50 = 0 AND z.vec_id <> e.vec_id) SELECT vec_id, count(*) AS hits FROM h WHERE s > 0.3 GROUP BY vec_id""")
def vector_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector whose id 50 divides, how many of all others lie within the cache's cosine."""
    return cache_hits(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 0.3)


@query("SELECT doc_id, ((n_chars > 500)::INT + (lang = 'en')::INT + contains(text, '.')::INT) / 3 AS score FROM documents")
def score_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scorers.share_true(["n_chars > 500", "lang = 'en'", "contains(text, '.')"]).alias("score"))


@query("""SELECT doc_id, CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS preference FROM
  (SELECT doc_id, least(1.0, length(text) / 1000) AS a, ((n_chars > 500)::INT + (lang = 'en')::INT) / 2 AS b FROM documents)""")
def score_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = scorers.fitting_length(F.col("text"), 1000), scorers.share_true(["n_chars > 500", "lang = 'en'"])
    return table(spark, sf_dir, "documents").select("doc_id", F.when(a > b, 1).when(a < b, -1).otherwise(0).alias("preference"))


# Gates


def _decided(spark: SparkSession, sf_dir: str, gate: Gate, threshold: float | None = None) -> DataFrame:
    return gated(spark, sf_dir, gate, threshold).select("doc_id", F.col("__gate").alias("gate"), F.col("__status").alias("status"))


def _decision(gate: str) -> str:
    return f"{GATED} SELECT doc_id, CASE WHEN broke THEN NULL ELSE {gate} END AS gate, CASE WHEN broke THEN 'error' WHEN {gate} THEN 'passed' ELSE 'failed' END AS status FROM g"


@query(_decision("gate"))
def gate_all_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, Gate.ALL)


@query(_decision("(2 * k > 3)"))
def gate_majority_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, Gate.MAJORITY)


@query(_decision("(k > 0)"))
def gate_any_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, Gate.ANY)


@query(_decision("coalesce(sw / nullif(ww, 0) >= 0.75, false)"))
def gate_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, Gate.WEIGHTED, 0.75)


@query(GATED + "SELECT doc_id, NULL::BOOLEAN AS gate, 'error' AS status FROM g")
def gate_weighted_without_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, Gate.WEIGHTED)


@query(GATED + "SELECT doc_id, CASE WHEN broke THEN NULL ELSE sw / nullif(ww, 0) END AS mean FROM g")
def gate_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [F.col(f"__score_{e.name}") for e in SCORERS]
    return gated(spark, sf_dir).select("doc_id", gates.weighted_mean(scores, SCORERS).alias("mean"))


@query("SELECT doc_id, true AS all_pass, false AS any_pass, false AS weighted FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, true, true, true FROM documents WHERE doc_id % 3 <> 0")
def gate_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = (ScorerSpec("x", "column", 0.5),)
    score = F.when(F.col("doc_id") % 3 == 0, float("nan")).otherwise(0.5)
    rows = table(spark, sf_dir, "documents").select("doc_id", score.alias("x"))
    spec = EvaluateSpec(one, Gate.WEIGHTED, 0.5)
    return rows.select("doc_id", *[gates.gate(g, [F.col("x")], one, spec).alias(n) for n, g in (("all_pass", Gate.ALL), ("any_pass", Gate.ANY), ("weighted", Gate.WEIGHTED))])


#: Why a row of ``g`` fails the gate of all scorers.
_REASON = "'below threshold: ' || concat_ws('; ', " + ", ".join(
    f"CASE WHEN NOT coalesce({c} >= {t}, false) THEN '{name} ' || coalesce(format('{{:.3f}}', {c}), 'missing') || ' < {t:.3f}' END" for c, name, t in (("q", "quality", 0.5), ("s", "safe", 0.5), ("n", "long", 0.8))
) + ")"


@query(GATED + f"SELECT doc_id, k AS passing, CASE WHEN NOT gate THEN {_REASON} END AS reason FROM g WHERE NOT broke")
def gate_failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [F.col(f"__score_{e.name}") for e in SCORERS]
    rows = gated(spark, sf_dir).where("__gate is not null")
    return rows.select("doc_id", gates.passing(scores, SCORERS).alias("passing"), gates.failure_reason(Gate.ALL, scores, SCORERS, spec_of()).alias("reason"))


# Batches and reports


@query(GATED + "SELECT record_id, count(*) AS evaluations, sum(passed::INT)::BIGINT AS passes, bool_and(passed) AS all_passed FROM long GROUP BY record_id")
def gate_long_form_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.all_passed(reports.long_form(gated(spark, sf_dir), spec_of()))


@query(GATED + "SELECT record_id, evaluator_name, score, threshold, passed FROM long")
def eval_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.long_form(gated(spark, sf_dir), spec_of())


@query(GATED + """SELECT evaluator_name, round(avg(score), 9) AS mean_score, round(stddev_samp(score), 9) AS std_score, min(score) AS min_score, max(score) AS max_score,
  count(score) AS sample_size, sum(passed::INT)::BIGINT AS passed FROM long GROUP BY evaluator_name""")
def eval_results_by_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reports.by_evaluator(reports.long_form(gated(spark, sf_dir), spec_of()))
    return told.withColumns({c: F.round(c, 9) for c in ("mean_score", "std_score")})


@query(GATED + "SELECT evaluator_name, count(*) AS failure_count, round(avg(score), 9) AS avg_score FROM long WHERE NOT passed GROUP BY evaluator_name")
def failures_by_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failures(reports.long_form(gated(spark, sf_dir), spec_of())).withColumn("avg_score", F.round("avg_score", 9))


@query(GATED + "SELECT source, count(*) AS total, round(avg(CASE WHEN gate THEN 1 ELSE 0 END) * 100, 2) AS pass_rate FROM g GROUP BY source")
def pass_rate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pass_rates(gated(spark, sf_dir), "source")


@query(GATED + """SELECT (SELECT count(*) FROM g) AS total, (SELECT count(*) FROM g WHERE gate) AS passed, (SELECT count(*) FROM g WHERE NOT gate) AS failed,
  (SELECT count(*) FILTER (gate) / count(*) FROM g) AS pass_rate, round(avg(score), 9) AS mean_score, round(stddev_samp(score), 9) AS std_score, min(score) AS min_score, max(score) AS max_score FROM long""")
def batch_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reports.batch_quality(gated(spark, sf_dir), spec_of())
    return told.withColumns({c: F.round(c, 9) for c in ("mean_score", "std_score")})


@query(GATED + "SELECT t AS threshold, coalesce((SELECT count(*) FILTER (gate) / nullif(count(*), 0) FROM g) >= t, true) AS holds FROM (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.9::DOUBLE)) v(t)")
def batch_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = counts(gated(spark, sf_dir)).first()
    return spark.createDataFrame([(t, enough_pass(told.passed_records, told.total_records, t)) for t in (0.1, 0.3, 0.9)], "threshold double, holds boolean")


_COUNTS = """SELECT count(*) AS total_records, count(*) FILTER (length(reply) > 0) AS transformed_records, count(*) FILTER (gate IS NOT NULL) AS evaluated_records,
  count(*) FILTER (gate) AS passed_records, count(*) FILTER (NOT gate) AS failed_records, count(*) FILTER (broke) AS errored FROM g"""


@query(GATED + _COUNTS)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(gated(spark, sf_dir))


@query(GATED + f"SELECT CASE WHEN failed_records > 0 THEN 'partial' ELSE 'completed' END AS status, passed_records FROM ({_COUNTS})")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(gated(spark, sf_dir)).select(F.when(F.col("failed_records") > 0, "partial").otherwise("completed").alias("status"), "passed_records")


@query(GATED + """SELECT doc_id, text, lang, source, n_chars, quality, toxic, record_id AS etl_record_id, reply AS etl_transformed_data, true AS etl_quality_gate_passed,
  q AS etl_score_quality, s AS etl_score_safe, n AS etl_score_long FROM g WHERE 2 * k > 3 AND NOT broke""")
def load_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.projected(gated(spark, sf_dir, Gate.MAJORITY).where(load.loadable()), spec_of())


@query(GATED + f"""SELECT 'r1' AS run_id, record_id, CASE WHEN broke THEN 'transform' ELSE 'evaluate' END AS stage, CASE WHEN broke THEN 'rejected by rule' ELSE {_REASON} END AS reason,
  doc_id, lang, q AS quality, s AS safe, n AS long, false AS resolved FROM g WHERE broke OR NOT gate""")
def quarantine_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gated(spark, sf_dir)
    kept = reports.quarantine(rows, "r1", gates.failure_reason(Gate.ALL, [F.col(f"__score_{e.name}") for e in SCORERS], SCORERS, spec_of()), ["doc_id", "lang"])
    data, scores = F.from_json("data", "doc_id long, lang string").alias("d"), F.from_json("scores", "quality double, safe double, long double").alias("s")
    return kept.select("run_id", "record_id", "stage", "reason", "resolved", data, scores).select("run_id", "record_id", "stage", "reason", "resolved", "d.*", "s.*")


@query(GATED + "SELECT doc_id FROM g WHERE broke")
def quarantine_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gated(spark, sf_dir)
    held = reports.quarantine(rows, "r1", F.lit("below threshold"), ["doc_id"]).where("stage = 'transform'")
    return reports.to_retry(rows, held).select("doc_id")


_POLICIES = ("quarantine", "skip", "abort", "fallback")


@query("SELECT event_id, " + ", ".join(f"""CASE WHEN value < 100 AND event_id % 5 < 3 THEN 'retry' WHEN event_type = 'view' THEN 'abort'
  WHEN event_type = 'click' THEN '{'abort' if p == 'abort' else 'quarantine'}' WHEN event_type = 'purchase' THEN '{'skip' if p == 'skip' else 'quarantine'}' ELSE '{p}' END AS with_{p}""" for p in _POLICIES) + " FROM events")
def recovery_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done about each failed event under each policy."""
    kind = F.col("event_type")
    stage = F.when(kind == "view", "extract").when(kind == "click", "load").when(kind == "purchase", "evaluate").otherwise("transform")
    return table(spark, sf_dir, "events").select("event_id", *[recovery_action(stage, F.col("value") < 100, F.col("event_id") % 5, on_failure=p).alias(f"with_{p}") for p in _POLICIES])


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE value > 10 GROUP BY ALL")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value > 10")
    return rows.groupBy("event_type", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reports.percentiles(table(spark, sf_dir, "events"), "event_type", "value")
    return told.withColumns({p: F.round(p, 6) for p in ("p50", "p95", "p99")})


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS kind, sum(value::DECIMAL(10,6))::DOUBLE AS total_cost, count(*) AS calls FROM events GROUP BY ALL")
def cost_by_day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.costs(table(spark, sf_dir, "events"), "ts", "event_type", F.col("value")).withColumns({"day": F.col("day").cast("timestamp_ntz"), "total_cost": F.col("total_cost").cast("double")})


def _trailing(value: str, factor: float) -> str:
    return f"""WITH d AS (SELECT event_type AS kind, date_trunc('day', ts)::TIMESTAMP AS day, {value} AS value FROM events GROUP BY ALL),
b AS (SELECT *, avg(value) OVER (PARTITION BY kind ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS baseline FROM d)
SELECT kind, day, round(value, 6) AS value, round(baseline, 6) AS baseline FROM b WHERE value > {factor} * baseline"""


def _over(spark: SparkSession, sf_dir: str, value, factor: float) -> DataFrame:
    told = reports.over_trailing(table(spark, sf_dir, "events"), "ts", "event_type", value, 7, factor)
    return told.select("kind", F.col("day").cast("timestamp_ntz").alias("day"), F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"))


@query(_trailing("sum(value)", 1.2))
def cost_spike_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, F.sum("value"), 1.2)


@query(_trailing("avg(value)", 1.1))
def slow_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, F.avg("value"), 1.1)


@query("""SELECT time_bucket(INTERVAL 10 MINUTE, ts)::TIMESTAMP AS window_start, round(avg(value), 6) AS mean_value, count(*) AS total FROM events GROUP BY ALL HAVING avg(value) < 20""")
def low_score_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reports.low_windows(table(spark, sf_dir, "events"), "ts", "value", 10, 20.0)
    return told.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.round("mean_value", 6).alias("mean_value"), "total")


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS window_start, count(*) AS total, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'error') / count(*) AS rate
  FROM events GROUP BY ALL HAVING rate > 0.1""")
def failure_rate_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reports.rate_alerts(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "error", 5, 0.1)
    return told.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT event_type AS operation_type, count(*) AS timeouts, round(avg(value), 6) AS mean_duration FROM events
  WHERE value > 50 AND ts > TIMESTAMP '2024-01-29 00:00:00' GROUP BY event_type""")
def timeouts_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation_type"), F.when(F.col("value") > 50, "timeout").otherwise("other").alias("error_type"), F.col("value").alias("duration"), "ts")
    return reports.timeouts(rows, "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 24).withColumn("mean_duration", F.round("mean_duration", 6))


@query("SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events QUALIFY rank <= 5")
def run_history_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reports.latest(table(spark, sf_dir, "events"), "event_type", [F.desc("ts"), F.asc("event_id")], 5)
    return told.select("event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("rank").cast("long").alias("rank"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 200) AS failed, count(*) FILTER (value > 200) > 10 OR count(*) FILTER (value > 200) / count(*) > 0.1 AS too_many FROM events GROUP BY event_type")
def failure_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 200).alias("failed"))
    return each.withColumn("too_many", (F.col("failed") > 10) | (F.col("failed") / F.col("total") > 0.1))


@query("""WITH a AS (SELECT avg(value) AS m, stddev_samp(value) AS s, min(value) AS l FROM events)
SELECT 'mean' AS assertion, m > 10 AND m < 100 AS holds FROM a UNION ALL SELECT 'spread', s < 1 FROM a UNION ALL SELECT 'least', l >= 0 FROM a""")
def distribution_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.asserted(table(spark, sf_dir, "events"), {"m": "avg(value)", "s": "stddev_samp(value)", "l": "min(value)"}, {"mean": "m > 10 AND m < 100", "spread": "s < 1", "least": "l >= 0"})


@query("SELECT count(*) AS records, sum(ceil(length(text) / 4))::BIGINT AS tokens, sum(ceil(length(text) / 4))::BIGINT * 0.00015::DOUBLE / 1000 AS cost FROM documents")
def token_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tokens_and_cost(table(spark, sf_dir, "documents"), "text", 0.00015)


# Resilience and streaming


@query("SELECT i::INTEGER AS attempt, least(1.0 * 2.0 ** i, 60.0)::DOUBLE AS wait_seconds FROM range(8) r(i)")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = Backoff(attempts=9)
    return spark.createDataFrame([(i, w) for i, w in enumerate(how.waits())], "attempt int, wait_seconds double")


#: The breaker's rule step by step: five failures in a row open it, 60 seconds later calls are probes, of which three in a row close it and one failure opens it.
_BREAKER = """WITH RECURSIVE o AS (
  SELECT i AS step, CASE WHEN i < 5 OR i = 69 THEN 'fail' WHEN i BETWEEN 6 AND 65 THEN 'wait' ELSE 'ok' END AS said FROM range(70) r(i)),
t AS (
  SELECT -1::BIGINT AS step, '' AS outcome, 'closed' AS state, 0 AS streak, 0 AS now, 0 AS until
  UNION ALL
  SELECT step, CASE WHEN shut THEN 'rejected' ELSE said END,
    CASE WHEN said = 'wait' OR shut THEN state WHEN said = 'ok' THEN CASE WHEN a = 'half_open' AND run + 1 >= 3 THEN 'closed' ELSE a END
      WHEN a = 'half_open' OR run + 1 >= 5 THEN 'open' ELSE a END,
    CASE WHEN said = 'wait' OR shut THEN streak WHEN said = 'ok' THEN CASE WHEN a = 'half_open' AND run + 1 < 3 THEN run + 1 ELSE 0 END
      WHEN a = 'half_open' OR run + 1 >= 5 THEN 0 ELSE run + 1 END,
    now, CASE WHEN said = 'fail' AND NOT shut AND (a = 'half_open' OR run + 1 >= 5) THEN now + 60 ELSE until END
  FROM (SELECT *, CASE WHEN state = 'open' AND NOT shut AND said <> 'wait' THEN 'half_open' ELSE state END AS a,
      CASE WHEN state = 'open' THEN 0 ELSE streak END AS run
    FROM (SELECT o.step, o.said, t.state, t.streak, t.until, t.now + (o.said = 'wait')::INT AS now, o.said <> 'wait' AND t.state = 'open' AND t.now < t.until AS shut
      FROM t JOIN o ON o.step = t.step + 1)))
SELECT step::INTEGER AS step, outcome, state FROM t WHERE step >= 0"""


@query(_BREAKER)
def breaker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = trace(["fail"] * 5 + ["ok"] + ["wait"] * 60 + ["ok"] * 3 + ["fail"], failures=5, seconds=60, successes=3)
    return spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], "step int, outcome string, state string")


@query(GATED + "SELECT doc_id, reply AS etl_transformed_data FROM g WHERE gate")
def stream_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over a stream of files, in bounded micro-batches; the same rows as the batch run."""
    from spindrift.streaming.flows import files, run_stream

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    held = staged(docs.repartition(3, "doc_id"), "stream-source")
    target = new_path(spark, "stream-target")
    stream = files(spark, held._staged_path, held.schema)
    run_stream(stream, "doc_id", PROMPT, TransformSpec("-"), spec_of(), CLASSES, target, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(target).select("doc_id", "etl_transformed_data")
