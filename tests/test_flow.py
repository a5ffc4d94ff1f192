"""Sources, templates, stages, sinks and whole runs, with files and rows of the tests' own."""

import asyncio
import json

import pytest
from pyspark.sql import functions as F

from spindrift.errors import ConfigurationError, ConnectorError, ExtractError, LoadError, RunError
from spindrift.functions.template import Template, dotted, load_template
from spindrift.operators import load as out
from spindrift.operators.evaluate import evaluate
from spindrift.operators.transform import Rules, Service, complete_once, parsed, transform, without_prefix
from spindrift.plans.resilience import Backoff
from spindrift.plans.runner import Runner, summary
from spindrift.sources import readers
from spindrift.spec import EvaluateSpec, ExtractSpec, Format, Gate, LoadSpec, RunStatus, ScorerSpec, TransformSpec, from_mapping

ROWS = [("1", "good, very good", "x"), ("2", 'she said "no"', "y"), ("3", "line\nbreak", "x")]


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "a.csv").write_text('id,text,when\n1,"good, very good",2024-01-01\n2,"she said ""no""",2024-01-02\n3,"line\nbreak",2024-01-03\n')
    objects = [{"text": t, "id": i, "kind": k} for i, t, k in ROWS]
    (tmp_path / "a.json").write_text(json.dumps(objects))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, objects)))
    return tmp_path


def test_readers(spark, sources):
    csv = readers.extract(spark, ExtractSpec(str(sources / "a.csv")))
    assert csv.dtypes[:3] == [("id", "bigint"), ("text", "string"), ("when", "string")]
    rows = csv.orderBy("__row_index").collect()
    assert [r.text for r in rows] == [t for _, t, _ in ROWS] and [r["__record_id"] for r in rows] == ["0", "1", "2"]
    assert rows[0]["__status"] == "extracted" and rows[0]["__source_type"] == "csv"
    for kind in ("json", "jsonl"):
        df = readers.extract(spark, ExtractSpec(str(sources / f"a.{kind}")))
        assert df.columns[:3] == ["text", "id", "kind"] and df.dtypes[1] == ("id", "string")
        assert sorted(r.text for r in df.collect()) == sorted(t for _, t, _ in ROWS)
    df.drop(*[c for c in df.columns if c.startswith("__")]).write.parquet(str(sources / "a.parquet"))
    assert readers.extract(spark, ExtractSpec(str(sources / "a.parquet"))).count() == 3
    with pytest.raises(ExtractError, match="Failed to extract from"):
        readers.extract(spark, ExtractSpec(str(sources / "none.csv")))
    with pytest.raises(ConfigurationError):
        readers.extract(spark, ExtractSpec("none"))


def test_numbers_over_many_partitions(spark):
    df = readers.numbered(spark.range(1000, numPartitions=13))
    assert df.where("id <> __row_index").count() == 0
    assert readers.numbered(spark.range(0)).count() == 0
    rows = readers.from_rows(spark, [{"a": i} for i in range(10)])
    assert [r.a for r in readers.part_of(rows, 3, 2).orderBy("a").collect()] == [3, 4]
    assert readers.part_of(rows, 3, 0).count() == 7 and readers.part_of(rows, 20).count() == 0 and readers.part_of(rows, -4, 3).count() == 3


def test_queries_and_connectors(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert readers.query(spark, "SELECT * FROM ten WHERE id > {{ least }}", {"least": 6}).count() == 3
    with pytest.raises(ExtractError):
        readers.query(spark, "SELECT * FROM no_such_table")
    rows, told = readers.page(spark.table("ten"), ["id"], 8, 4)
    assert rows.count() == 2 and told == {"total": 10, "has_more": False, "next_cursor": None}
    assert readers.table_of("select x from Abc where") == "Abc" and readers.table_of("values") == "unknown"
    readers.register_connector("mem", lambda spark, uri: spark.range(4))
    assert readers.extract(spark, ExtractSpec("mem://x")).count() == 4
    assert readers.uri_parts("s3://bucket/a/b") == ("s3", "bucket", "a/b")
    with pytest.raises(ConnectorError):
        readers.connector("none")


def test_templates(spark, tmp_path):
    df = spark.createDataFrame([(None, True, 1e-05, [1.0, 2.5], 7)], "a string, b boolean, c double, d array<double>, e int")
    text = Template("$a ${b} $c $d $e $$5 ${a}x").rendered(df)
    assert df.select(text).first()[0] == f"{None} {True} {1e-05} {[1.0, 2.5]} {7} $5 {None}x"
    assert "Missing template variable 'z'" in Template("$z").error(["a"])
    assert "Invalid placeholder" in Template("a $5").error(["a"])
    assert Template("nothing").error([]) is None
    (tmp_path / "p.txt").write_text("say $e")
    assert df.select(load_template(tmp_path / "p.txt").rendered(df)).first()[0] == "say 7"
    assert df.select(dotted("{{ context.who }} pays $ {{ input.e }}", {"who": "$a"}).rendered(df)).first()[0] == "$a pays $ 7"
    with pytest.raises(ConfigurationError):
        load_template(tmp_path / "none.txt")
    with pytest.raises(ConfigurationError):
        dotted("{{ context.none }}", {})


class Model:
    """A model that fails on some prompts and never answers others."""

    async def __call__(self, prompt, **how):
        if "bad" in prompt:
            raise ValueError("bad prompt")
        if "slow" in prompt:
            await asyncio.sleep(30)
        return prompt.upper()


def test_service_isolates_failures(spark):
    rows = readers.from_rows(spark, [{"t": x} for x in ("one", "bad", "slow", "two")])
    service = Service(Model, run_id="isolates", retries=Backoff(2, initial=0.01))
    told = transform(rows, Template("say $t"), TransformSpec("-", timeout=0.5), service).orderBy("__row_index").collect()
    assert [r["__text"] for r in told] == ["SAY ONE", None, None, "SAY TWO"]
    assert [r["__error"] for r in told] == [None, "bad prompt", "LLM call exceeded timeout (0.5s)", None]
    assert [r["__status"] for r in told] == ["transformed", "error", "error", "transformed"]
    broken = transform(rows.coalesce(1), Template("bad $t"), TransformSpec("-"), Service(Model, run_id="opens", at_once=1, failures=2))
    errors = [r["__error"] for r in broken.orderBy("__row_index").collect()]
    assert errors[:2] == ["bad prompt"] * 2 and all(e.startswith("LLM circuit breaker open") for e in errors[2:])


def test_replies_and_cache(spark):
    df = spark.createDataFrame([('{"s": "x", "n": 2}',), ("plain",)], "r string")
    assert [r.p.asDict() for r in df.select(parsed(F.col("r"), {"s": "string", "n": "int"}).alias("p")).collect()] == [{"s": "x", "n": 2, "text": None}, {"s": None, "n": None, "text": "plain"}]
    prompts = spark.createDataFrame([("a",), ("a",), ("b",)], "__prompt string")
    asked = []

    def finish(wanted):
        asked.append(sorted(r["__prompt"] for r in wanted.collect()))
        return wanted.withColumn("text", F.upper("__prompt"))

    first = complete_once(prompts, None, finish, "m", "1")
    cache = first.select("key", "text").distinct().withColumn("cached_at", F.current_timestamp()).withColumn("ttl_seconds", F.lit(60))
    again = complete_once(prompts.unionByName(spark.createDataFrame([("c",)], "__prompt string")), cache, finish, "m", "1")
    assert sorted((r["__prompt"], r.text, r.cached) for r in again.collect()) == [("a", "A", True), ("a", "A", True), ("b", "B", True), ("c", "C", False)]
    assert asked == [["a", "b"], ["c"]]
    assert without_prefix(cache, "").count() == 0


SCORERS = (ScorerSpec("quality", "column", 0.7, 1.0, "q"), ScorerSpec("extra", "column", 0.5, 1.0, "x"))


def scored(spark, gate=Gate.ANY, threshold=None):
    rows = readers.from_rows(spark, spark.createDataFrame([("a", 0.7, None, "m"), ("b", 0.2, None, "n"), ("", 0.9, None, "o"), ("c", None, None, "p")], "t string, q double, x double, etl_score_quality string"))
    return evaluate(transform(rows, Template("$t"), TransformSpec("-"), Rules(fails="t = 'c'")), EvaluateSpec(SCORERS, gate, threshold))


def test_statuses(spark):
    rows = {r.t: r for r in scored(spark).collect()}
    assert [(rows[t]["__status"], rows[t]["__gate"]) for t in ("a", "b", "", "c")] == [("passed", True), ("failed", False), ("transformed", None), ("error", None)]
    rows = {r.t: r for r in scored(spark, Gate.WEIGHTED).collect()}
    assert [rows[t]["__status"] for t in ("a", "", "c")] == ["error", "transformed", "error"] and rows["c"]["__error"] == "rejected by rule"


def test_projection(spark):
    df = out.projected(scored(spark).where(out.loadable()), EvaluateSpec(SCORERS))
    assert df.columns == ["t", "q", "x", "etl_score_quality", "etl_record_id", "etl_transformed_data", "etl_quality_gate_passed", "etl_score_extra"]
    assert df.first().asDict() == {"t": "a", "q": 0.7, "x": None, "etl_score_quality": 0.7, "etl_record_id": "0", "etl_transformed_data": "a", "etl_quality_gate_passed": True, "etl_score_extra": None}
    assert "etl_score_extra" not in out.projected(scored(spark), EvaluateSpec(SCORERS), compact=True).columns


@pytest.mark.parametrize("kind", list(Format))
@pytest.mark.parametrize("single", [False, True])
def test_writers(spark, tmp_path, kind, single):
    rows, path = spark.createDataFrame([(1, "a,b", None), (2, 'c "d"\ne', 0.5)], "i long, s string, d double"), str(tmp_path / "x" / f"out.{kind}")
    assert out.write(rows, path, kind, "whatever", single) == 2
    with pytest.raises(LoadError, match="Unsupported load mode"):
        out.write(rows, path, kind, "upsert", single)
    assert out.write(rows, path, kind, "append", single) == 2
    back = readers.read(spark, path, kind) if single or kind != Format.JSON else spark.read.json(path)
    assert sorted(map(str, back.select("i", "s", "d").collect())) == sorted(map(str, rows.collect() * 2))
    with pytest.raises(LoadError):
        out.write(rows.select("i"), path, kind, "append", single)
    again = (readers.read(spark, path, kind) if single or kind != Format.JSON else spark.read.json(path)).select("i", "s", "d")
    assert out.write(again.where("i = 1"), path, kind, "overwrite", single) == 2
    assert out.write(rows, path, kind, "overwrite", single) == 2


@pytest.mark.parametrize("kind", [Format.CSV, Format.JSON, Format.JSONL])
@pytest.mark.parametrize("single", [False, True])
def test_append_of_other_types_changes_nothing(spark, tmp_path, kind, single):
    path = tmp_path / f"out.{kind}"
    out.write(spark.createDataFrame([("rec_001", 1.5), ("rec_002", None)], "id string, x double"), str(path), kind, "overwrite", single)
    held = {f.name: f.read_bytes() for f in ([path] if single else sorted(path.iterdir()))}
    other = [spark.createDataFrame([(3, 2.5)], "id long, x double")]
    if kind != Format.CSV:
        other.append(spark.createDataFrame([("rec_003", "2.5")], "id string, x string"))
    for rows in other:
        for mode in ("append", "upsert"):
            with pytest.raises(LoadError):
                out.write(rows, str(path), kind, mode, single, key="id")
        assert {f.name: f.read_bytes() for f in ([path] if single else sorted(path.iterdir()))} == held
    assert out.write(spark.createDataFrame([("rec_003", 2.5)], "id string, x double"), str(path), kind, "append", single) == 1
    back = readers.read(spark, str(path), kind) if single or kind != Format.JSON else spark.read.json(str(path))
    assert {r.id: r.x for r in back.collect()} == {"rec_001": 1.5, "rec_002": None, "rec_003": 2.5}


@pytest.mark.parametrize("size", ["1k", "64k", "64m"])
def test_records_of_a_join(spark, tmp_path, size):
    """Ids are whole and unique however Spark cuts the join's partitions."""
    spark.range(5000).select("id", F.repeat(F.lit("x"), 200).alias("wide")).write.parquet(str(tmp_path / "a"))
    spark.range(3000).select("id", (F.col("id") % 7).alias("k")).write.parquet(str(tmp_path / "b"))
    for name in "ab":
        spark.read.parquet(str(tmp_path / name)).createOrReplaceTempView(f"joined_{name}")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    try:
        found = readers.extract(spark, ExtractSpec("-", query="SELECT /*+ MERGE(b) */ a.*, b.k, NULL AS nothing FROM joined_a a JOIN joined_b b ON a.id = b.id"))
        assert sorted(int(r[0]) for r in found.select("__record_id").collect()) == list(range(3000))
        slim = found.select("__row_index", "k").collect()
        whole = {r["__row_index"]: r["k"] for r in found.collect()}
        assert all(whole[r["__row_index"]] == r["k"] for r in slim)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_order_of_json_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"z": 1, "a": {"q": [1, 2]}, "M": "x"}, {"b": 2}]')
    (tmp_path / "b.jsonl").write_text('{"z": 1, "a": 2}\n{"M": 3}\n')
    (tmp_path / "c.json").write_text("[]")
    assert readers.read(spark, str(tmp_path / "a.json"), Format.JSON).columns == ["z", "a", "M", "b"]
    assert readers.read(spark, str(tmp_path / "b.jsonl"), Format.JSONL).columns == ["z", "a", "M"]
    assert readers.read(spark, str(tmp_path / "c.json"), Format.JSON).count() == 0


def test_nothing_to_load_touches_nothing(spark, tmp_path):
    path = tmp_path / "none.csv"
    assert out.load(scored(spark).where("t = 'b'"), LoadSpec(str(path), mode="overwrite"), EvaluateSpec(SCORERS)) == 0
    assert not path.exists()
    nested = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(LoadError):
        out.write(nested, str(path), Format.CSV)


def pipeline(tmp_path, **evaluate_too):
    (tmp_path / "p.txt").write_text("Say $text")
    return from_mapping({
        "name": "p", "version": "1",
        "extract": {"source": str(tmp_path / "a.csv")},
        "transform": {"prompt": str(tmp_path / "p.txt"), "provider": "echo"},
        "evaluate": {"evaluators": [{"name": "length", "type": "length", "threshold": 0.5, "criteria": 30}], **evaluate_too},
        "load": {"destination": str(tmp_path / "out.csv"), "mode": "overwrite"},
    })


def test_runs(spark, sources):
    run = Runner(pipeline(sources), single_file=True).run(spark)
    assert run.status == RunStatus.PARTIAL
    assert (run.metrics.total_records, run.metrics.passed_records, run.metrics.failed_records, run.metrics.loaded_records) == (3, 2, 1, 2)
    assert (sources / "out.csv").read_text().splitlines()[0] == "id,text,when,etl_record_id,etl_transformed_data,etl_quality_gate_passed,etl_score_length"
    assert "partial" in summary(run) and run.row()["loaded_records"] == 2 and [x["stage"] for x in run.lineage] == ["extract", "transform", "evaluate", "load"]
    (sources / "out.csv").unlink()
    missed = Runner(pipeline(sources, batch_threshold=0.9)).run(spark)
    assert missed.status == RunStatus.FAILED and missed.metrics.loaded_records == 0 and not (sources / "out.csv").exists()
    kept = Runner(pipeline(sources, batch_threshold=0.9), on_batch_fail="load_passed").run(spark)
    assert kept.status == RunStatus.PARTIAL and kept.metrics.loaded_records == 2
    empty = Runner(pipeline(sources)).run(spark, readers.from_rows(spark, spark.createDataFrame([], "text string")))
    assert empty.status == RunStatus.COMPLETED and empty.metrics.total_records == 0
    all_broken = Runner(pipeline(sources), provider=Rules(fails="true")).run(spark)
    assert all_broken.status == RunStatus.COMPLETED and all_broken.metrics.errored == 3 and all_broken.metrics.loaded_records == 0
    (sources / "a.csv").unlink()
    with pytest.raises(RunError):
        Runner(pipeline(sources)).run(spark)


def shouting():
    async def call(prompt, **_):
        return '{"said": "%s", "n": 2}' % prompt.upper().replace("\n", " ").replace('"', "'")

    return call


def test_what_a_run_keeps(spark, sources):
    """A provider by its import path, fields of replies as columns, a gate of one's own, and a history of runs, statuses and failed records."""
    from dataclasses import replace

    from spindrift.operators.gates import register_gate
    from spindrift.plans.history import runs

    register_gate("long_enough", lambda scores, scorers, spec: scores[0] >= 0.9)
    spec = pipeline(sources, quality_gate="long_enough")
    spec = replace(spec, transform=replace(spec.transform, provider="test_flow:shouting"), load=replace(spec.load, schema={"said": "string", "n": "int"}, on_failure="quarantine"))
    folder = str(sources / "kept")
    run = Runner(spec, history=folder, single_file=True).run(spark)
    assert run.metrics.total_records == 3 and run.metrics.loaded_records == run.metrics.passed_records > 0
    told = readers.read(spark, str(sources / "out.csv"), Format.CSV)
    assert told.columns[-2:] == ["said", "n"] and all(r.said.startswith("SAY ") and r.n == 2 for r in told.collect())
    statuses = {r.record_id: r.status for r in spark.read.parquet(f"{folder}/records").collect()}
    assert len(statuses) == 3 and list(statuses.values()).count("loaded") == run.metrics.loaded_records
    assert runs(spark, folder).first()["run_id"] == run.run_id
    assert spark.read.parquet(f"{folder}/quarantine").count() == run.metrics.failed_records
    few = Runner(spec, limit=2, loads=False).run(spark)
    assert few.metrics.total_records == 2 and few.metrics.loaded_records == 0
    with pytest.raises(ConfigurationError):
        Runner(replace(spec, transform=replace(spec.transform, provider="no_such.module:x")))


def test_windowed_stream(spark, tmp_path):
    from spindrift.streaming.flows import files, windowed_rates

    for i, rows in enumerate([[("2024-01-01 00:01:00", "bad"), ("2024-01-01 00:02:00", "ok")], [("2024-01-01 01:00:00", "ok")], [("2024-01-01 00:03:00", "bad")]]):
        spark.createDataFrame(rows, "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    stream = files(spark, str(tmp_path / "in" / "*"), schema)
    told = windowed_rates(stream, "ts", F.col("k") == "bad")
    told.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("rates").count() == 2


def test_history_and_cache(spark, sources):
    from spindrift.plans.history import cached, keep, remember, runs

    folder, path = str(sources / "history"), str(sources / "cache")
    for _ in range(3):
        run = Runner(pipeline(sources)).run(spark)
        remember(spark, run, folder)
    told = runs(spark, folder, 2).collect()
    assert len(told) == 2 and {r.status for r in told} == {"partial"} and spark.read.parquet(f"{folder}/lineage").count() == 12
    prompts = spark.createDataFrame([("a",), ("a",), ("b",)], "__prompt string")
    upper = lambda wanted: wanted.withColumn("text", F.upper("__prompt"))
    assert cached(spark, path) is None
    keep(complete_once(prompts, cached(spark, path), upper, "m", "1"), path, 60)
    assert cached(spark, path).count() == 2
    assert complete_once(prompts, cached(spark, path), upper, "m", "1").where("cached").count() == 3


def test_stage_limits(spark):
    import time

    from spindrift.errors import DeadlineError
    from spindrift.plans.history import within

    assert within(spark, 30, lambda: spark.range(3).count()) == 3
    slow = spark.range(4).select(F.udf(lambda x: time.sleep(8) or x, "long")("id"))
    with pytest.raises(DeadlineError):
        within(spark, 2, lambda: slow.collect())
