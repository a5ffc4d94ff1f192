"""Pipelines over streams: the batch stages applied to micro-batches, and alert windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.template import Template
from spindrift.operators.evaluate import evaluate
from spindrift.operators.load import loadable, projected
from spindrift.operators.transform import Rules, Service, transform
from spindrift.spec import EvaluateSpec, TransformSpec


def files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", per_batch: int = 1) -> DataFrame:
    """A stream of a folder's files, a bounded number of them in each micro-batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


def run_stream(stream: DataFrame, key: str, template: Template, of: TransformSpec, by: EvaluateSpec, provider: Rules | Service, target: str, checkpoint: str, prefix: str = "etl_", on_batch: Callable[[DataFrame, int], None] | None = None):
    """Take what there is through all stages, batch by batch; only passing rows reach ``target``. Returns the running query.

    A batch that is run again after a failure replaces its own rows.
    """

    def one(batch: DataFrame, number: int) -> None:
        marks = {"__record_id": F.col(key).cast("string"), "__error": F.lit(None).cast("string"), "__status": F.lit("extracted")}
        told = evaluate(transform(batch.withColumns(marks), template, of, provider), by)
        rows = projected(told.where(loadable()), by, prefix)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch:
            on_batch(told, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(stream: DataFrame, ts: str, bad: Column, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Share of bad rows in each window of some minutes; rows later than ``late`` are left out once their window is closed."""
    each = stream.withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad"))
    return each.select(F.col("w.start").alias("window_start"), "total", "bad", (F.col("bad") / F.col("total")).alias("rate"))
