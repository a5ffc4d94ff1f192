"""Tables about runs: evaluations in long form, quality, quarantine, costs, latencies, alerts and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.evaluate import score_column
from spindrift.spec import EvaluateSpec


def long_form(records: DataFrame, spec: EvaluateSpec, key: str = "__record_id") -> DataFrame:
    """One row per record and scorer: ``record_id, evaluator_name, score, threshold, passed``; a missing score hasn't passed."""
    rows = F.array(*[F.struct(F.lit(e.name).alias("evaluator_name"), F.col(f"`{score_column(e.name)}`").alias("score"), F.lit(e.threshold).alias("threshold")) for e in spec.evaluators])
    out = records.select(F.col(key).alias("record_id"), F.explode(rows).alias("e")).select("record_id", "e.*")
    return out.withColumn("passed", F.coalesce((F.col("score") >= F.col("threshold")) & ~F.isnan("score"), F.lit(False)))


def all_passed(long: DataFrame) -> DataFrame:
    """Per record whether all its evaluations passed."""
    return long.groupBy("record_id").agg(F.count(F.lit(1)).alias("evaluations"), F.count_if("passed").alias("passes"), F.bool_and("passed").alias("all_passed"))


def by_evaluator(long: DataFrame) -> DataFrame:
    s = F.col("score")
    return long.groupBy("evaluator_name").agg(F.avg(s).alias("mean_score"), F.stddev_samp(s).alias("std_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.count(s).alias("sample_size"), F.count_if("passed").alias("passed"))


def failures(long: DataFrame) -> DataFrame:
    """Failed evaluations by scorer, most first."""
    return long.where(~F.col("passed")).groupBy("evaluator_name").agg(F.count(F.lit(1)).alias("failure_count"), F.avg("score").alias("avg_score")).orderBy(F.desc("failure_count"), "evaluator_name")


def pass_rates(records: DataFrame, by: str) -> DataFrame:
    """Percentage of passing records in each group, undecided ones counting as not passed."""
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(F.when(F.col("__gate"), 1).otherwise(0)) * 100, 2).alias("pass_rate"))


def batch_quality(records: DataFrame, spec: EvaluateSpec) -> DataFrame:
    """One row: the batch's counts, pass rate, and the spread of all its scores, in one pass."""
    scores = F.array(*[F.col(f"`{score_column(e.name)}`") for e in spec.evaluators])
    each = records.select("__gate", F.posexplode(scores).alias("at", "s"))
    s, first = F.col("s"), F.col("at") == 0
    told = each.agg(
        F.count_if(first).alias("total"),
        F.count_if(first & F.col("__gate")).alias("passed"),
        F.count_if(first & ~F.col("__gate")).alias("failed"),
        *[f(s).alias(f"{n}_score") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
    )
    return told.select("total", "passed", "failed", F.try_divide(F.col("passed"), F.col("total")).alias("pass_rate"), "mean_score", "std_score", "min_score", "max_score")


def rejection_rate(records: DataFrame) -> DataFrame:
    """One row: the share of the records that a gate decided about and turned down; null where none was decided."""
    decided = records.agg(F.count_if(~F.col("__gate")).alias("rejected"), F.count("__gate").alias("processed"))
    return decided.withColumn("rejection_rate", F.try_divide(F.col("rejected"), F.col("processed")))


def quarantine(records: DataFrame, run_id: str, reason: Column, columns: Sequence[str]) -> DataFrame:
    """Rows that failed or broke, with their data and scores as JSON, their stage and their reason."""
    scores = [c for c in records.columns if c.startswith("__score_")]
    stage = F.when(F.col("__status") == "failed", "evaluate").when(F.col("__text").isNull(), "transform").otherwise("evaluate")
    return records.where(F.col("__status").isin("failed", "error")).select(
        F.lit(run_id).alias("run_id"),
        F.col("__record_id").alias("record_id"),
        F.to_json(F.struct(*columns)).alias("data"),
        stage.alias("stage"),
        F.coalesce(F.col("__error"), reason).alias("reason"),
        F.to_json(F.struct(*[F.col(f"`{c}`").alias(c.removeprefix("__score_")) for c in scores])).alias("scores"),
        F.lit(False).alias("resolved"),
    )


def to_retry(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """The records whose ids a quarantine holds, for another run."""
    return records.join(chosen.select(F.col("record_id").alias("__record_id")), "__record_id", "left_semi").select(*records.columns)


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Exact 50th, 95th and 99th percentiles of each group, from one buffer of its distinct values."""
    told = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    return told.select(by, "n", *[F.col("p")[i].alias(name) for i, name in enumerate(("p50", "p95", "p99"))])


def costs(df: DataFrame, ts: str, kind: str, amount: Column) -> DataFrame:
    """Money by day and kind as decimals of six places, so that sums are exact."""
    exact = df.select(F.date_trunc("day", ts).alias("day"), F.col(kind).alias("kind"), amount.cast("decimal(10,6)").alias("cost"))
    return exact.groupBy("day", "kind").agg(F.sum("cost").cast("decimal(18,6)").alias("total_cost"), F.count(F.lit(1)).alias("calls"))


def tokens_and_cost(df: DataFrame, text: str, price_per_1k: float) -> DataFrame:
    """Estimated tokens, a quarter of the characters rounded up for each text, and their price."""
    tokens = F.sum(F.ceil(F.char_length(text) / 4))
    return df.agg(F.count(F.lit(1)).alias("records"), tokens.alias("tokens"), (tokens * price_per_1k / 1000).alias("cost"))


def over_trailing(df: DataFrame, ts: str, by: str, value: Column, days: int, factor: float) -> DataFrame:
    """Days of a group whose value exceeds ``factor`` times its mean over the days before, up to ``days`` of them."""
    daily = df.groupBy(F.col(by).alias("kind"), F.date_trunc("day", ts).alias("day")).agg(value.alias("value"))
    before = Window.partitionBy("kind").orderBy(F.unix_date(F.to_date("day"))).rangeBetween(-days, -1)
    return daily.withColumn("baseline", F.avg("value").over(before)).where(F.col("value") > factor * F.col("baseline"))


def rate_alerts(df: DataFrame, ts: str, bad: Column, minutes: int, above: float) -> DataFrame:
    """Windows of some minutes in which the share of bad rows is above a limit."""
    each = df.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad"))
    return each.select(F.col("w.start").alias("window_start"), "total", "bad", (F.col("bad") / F.col("total")).alias("rate")).where(F.col("rate") > above)


def low_windows(df: DataFrame, ts: str, value: str, minutes: int, below: float) -> DataFrame:
    """Windows whose mean value lies below a limit."""
    each = df.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("total"))
    return each.where(F.col("mean_value") < below).select(F.col("w.start").alias("window_start"), "mean_value", "total")


def latest(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def asserted(df: DataFrame, aggregates: dict[str, str], assertions: dict[str, str]) -> DataFrame:
    """One row per named assertion, a SQL predicate over named SQL aggregates: whether it holds."""
    one = df.agg(*[F.expr(sql).alias(name) for name, sql in aggregates.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("assertion"), F.coalesce(F.expr(sql), F.lit(False)).alias("holds")) for name, sql in assertions.items()])
    return one.select(F.explode(rows).alias("a")).select("a.*")


def timeouts(df: DataFrame, ts: str, now: Column, hours: int = 1) -> DataFrame:
    """Timeouts of the last hours by operation, most first."""
    recent = df.where((F.col("error_type") == "timeout") & (F.col(ts) > now - F.make_dt_interval(hours=F.lit(hours))))
    return recent.groupBy("operation_type").agg(F.count(F.lit(1)).alias("timeouts"), F.avg("duration").alias("mean_duration")).orderBy(F.desc("timeouts"), "operation_type")
