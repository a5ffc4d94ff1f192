"""Runs, lineage and cached completions as tables, and limits on how long a stage may take."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.errors import DeadlineError
from spindrift.operators.reports import latest

if TYPE_CHECKING:
    from spindrift.plans.runner import Run

RUNS = """run_id string, pipeline_name string, pipeline_version string, status string, started_at timestamp, completed_at timestamp, error_message string,
total_records long, extracted_records long, transformed_records long, evaluated_records long, passed_records long, failed_records long, loaded_records long,
error_records long, errored long, extract_time double, transform_time double, evaluate_time double, load_time double, total_time double"""
LINEAGE = "run_id string, stage string, records_in long, records_out long"


def remember(spark: SparkSession, run: Run, folder: str) -> None:
    """Append a run and its lineage to the tables ``runs`` and ``lineage`` of a folder."""
    spark.createDataFrame([run.row()], RUNS).write.mode("append").parquet(f"{folder}/runs")
    spark.createDataFrame([{"run_id": run.run_id, **x} for x in run.lineage], LINEAGE).write.mode("append").parquet(f"{folder}/lineage")


def runs(spark: SparkSession, folder: str, most: int = 10) -> DataFrame:
    """The latest runs of each pipeline, newest first, with their rank."""
    return latest(spark.read.schema(RUNS).parquet(f"{folder}/runs"), "pipeline_name", [F.desc("started_at"), F.asc("run_id")], most)


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """A cache of completions, or None, which is a miss of every key, where it can't be read."""
    try:
        return spark.read.schema("key string, text string, cached_at timestamp, ttl_seconds int").parquet(path)
    except PySparkException:
        return None


def keep(completed: DataFrame, path: str, ttl_seconds: int) -> None:
    """Append fresh completions, one row a key, to a cache. A failure to write is no failure of the rows."""
    fresh = completed.where(~F.col("cached") & F.col("text").isNotNull()).select("key", "text").dropDuplicates(["key"])
    try:
        fresh.select("key", "text", F.current_timestamp().alias("cached_at"), F.lit(ttl_seconds).alias("ttl_seconds")).write.mode("append").parquet(path)
    except PySparkException:
        pass


def within(spark: SparkSession, seconds: float, action: Callable[[], Any]) -> Any:
    """What an action gives, its Spark jobs being cancelled once it takes longer than it may."""
    group, late = f"limited-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, f"at most {seconds:g} seconds", True)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise DeadlineError(f"the stage took more than {seconds:g} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
