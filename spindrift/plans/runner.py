"""Running a pipeline: extract, transform, evaluate, load, with metrics and a status.

The whole run is one plan with two barriers: the transformed rows are staged, since their plan must not run twice, and
one aggregate decides the batch threshold before anything is written.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.errors import ConfigurationError, RunError, SpindriftError
from spindrift.functions.template import load_template
from spindrift.operators.evaluate import enough_pass, evaluate, score_column
from spindrift.operators.gates import failure_reason, has_gate
from spindrift.operators.load import load, loadable
from spindrift.operators.reports import quarantine
from spindrift.operators.transform import Rules, Service, need, transform, tuned
from spindrift.plans.history import remember, within
from spindrift.settings import settings
from spindrift.sources.readers import extract, part_of
from spindrift.spec import PipelineSpec, RunStatus, Status, resolve_format
from spindrift.staging import staged

LOG = logging.getLogger(__name__)


@dataclass
class Metrics:
    """Counts and seconds of a run; ``error_records`` stays 0 for compatibility, ``errored`` has the true count."""

    total_records: int = 0
    extracted_records: int = 0
    transformed_records: int = 0
    evaluated_records: int = 0
    passed_records: int = 0
    failed_records: int = 0
    loaded_records: int = 0
    error_records: int = 0
    errored: int = 0
    extract_time: float = 0.0
    transform_time: float = 0.0
    evaluate_time: float = 0.0
    load_time: float = 0.0
    total_time: float = 0.0


@dataclass
class Run:
    pipeline_name: str
    pipeline_version: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    status: RunStatus = RunStatus.PENDING
    started_at: datetime | None = None
    completed_at: datetime | None = None
    metrics: Metrics = field(default_factory=Metrics)
    error_message: str | None = None
    lineage: list[dict] = field(default_factory=list)

    def row(self) -> dict:
        """The run as one flat row for a table of runs."""
        own = {k: v for k, v in asdict(self).items() if k not in ("metrics", "lineage")}
        return own | asdict(self.metrics) | {"status": str(self.status)}


def counts(records: DataFrame) -> DataFrame:
    """One row with what the stages made of the records."""
    return records.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.length("__text") > 0).alias("transformed_records"),
        F.count_if(F.col("__gate").isNotNull()).alias("evaluated_records"),
        F.count_if(F.col("__gate")).alias("passed_records"),
        F.count_if(~F.col("__gate")).alias("failed_records"),
        F.count_if(F.col("__status") == "error").alias("errored"),
    )


def final_status(failed: int) -> RunStatus:
    return RunStatus.PARTIAL if failed else RunStatus.COMPLETED


class Runner:
    """A pipeline ready to run: formats, template and gate are looked at before any run exists.

    ``history`` names a folder that keeps each run, its lineage, its records' statuses and, if the definition's ``on_failure`` is ``quarantine``, the records that failed.
    ``limit`` takes the first records, ``sample`` about a share of them; without ``loads`` nothing is written but the history.
    """

    def __init__(self, spec: PipelineSpec, provider: Rules | Service | None = None, on_batch_fail: str = "stop", prefix: str | None = None, single_file: bool = False, history: str | None = None, limit: int = 0, sample: float = 0.0, loads: bool = True):
        self.spec, self.on_batch_fail, self.single_file = spec, on_batch_fail, single_file
        self.template = load_template(spec.transform.prompt)
        self.given, self.provider = provider is not None, provider or need(spec.transform.provider)
        self.prefix, self.history, self.limit, self.sample, self.loads = prefix, history, limit, sample, loads
        if not spec.extract.query and "://" not in spec.extract.source:
            resolve_format(spec.extract.source_type, spec.extract.source, "source")
        resolve_format(spec.load.destination_type, spec.load.destination, "destination")
        if not has_gate(spec.evaluate.quality_gate):
            raise ConfigurationError(f"there is no quality gate named {spec.evaluate.quality_gate!r}")

    def run(self, spark: SparkSession, records: DataFrame | None = None) -> Run:
        run = Run(self.spec.name, self.spec.version, status=RunStatus.RUNNING, started_at=datetime.now(UTC))
        try:
            return self._stages(spark, run, records)
        except SpindriftError as e:
            run.error_message = str(e)
            self._over(run, RunStatus.FAILED)
            raise RunError(f"pipeline {self.spec.name} failed: {e}") from e
        finally:
            if self.history:
                remember(spark, run, self.history)

    def _stages(self, spark: SparkSession, run: Run, records: DataFrame | None) -> Run:
        m, s = run.metrics, settings(spark)

        def extracted() -> DataFrame:
            found = records if records is not None else extract(spark, self.spec.extract)
            found = part_of(found, 0, self.limit) if self.limit else found
            found = found.sample(self.sample, 1) if self.sample else found
            m.total_records = m.extracted_records = found.count()
            return found

        found = self._timed(spark, run, "extract", s.extract_seconds, extracted)
        if not m.total_records:
            return self._over(run, RunStatus.COMPLETED)
        found = self._timed(spark, run, "transform", s.transform_seconds, lambda: staged(self._transformed(spark, found, run), "transformed"))

        def evaluated() -> DataFrame:
            out = evaluate(found, self.spec.evaluate)
            for name, n in counts(out).first().asDict().items():
                setattr(m, name, n)
            return out

        found = self._timed(spark, run, "evaluate", s.evaluate_seconds, evaluated)
        run.lineage = [
            {"stage": "extract", "records_in": m.total_records, "records_out": m.total_records},
            {"stage": "transform", "records_in": m.total_records, "records_out": m.transformed_records},
            {"stage": "evaluate", "records_in": m.transformed_records, "records_out": m.passed_records},
        ]
        enough = enough_pass(m.passed_records, m.total_records, self.spec.evaluate.batch_threshold)
        if not enough:
            run.error_message = f"{m.passed_records} of {m.total_records} records passed; the batch needs a share of {self.spec.evaluate.batch_threshold:g}"
        loads = enough or self.on_batch_fail == "load_passed"
        if loads and self.loads:
            prefix = self.prefix or s.column_prefix
            m.loaded_records = self._timed(spark, run, "load", s.load_seconds, lambda: load(found, self.spec.load, self.spec.evaluate, prefix, self.single_file))
            run.lineage.append({"stage": "load", "records_in": m.passed_records, "records_out": m.loaded_records})
        if self.history:
            self._kept(found, run, loads and self.loads)
        if not loads:
            return self._over(run, RunStatus.FAILED)
        return self._over(run, RunStatus.PARTIAL if run.error_message else final_status(m.failed_records))

    def _timed(self, spark: SparkSession, run: Run, stage: str, most: float, action: Callable[[], Any]) -> Any:
        """A stage's result, its seconds in the metrics and what it did in the log; its jobs are cancelled after ``most`` seconds."""
        began = time.monotonic()
        out = within(spark, most, action) if most else action()
        took = time.monotonic() - began
        setattr(run.metrics, f"{stage}_time", took)
        LOG.info("run %s: %s took %.1f s: %s", run.run_id, stage, took, {k: v for k, v in asdict(run.metrics).items() if k.endswith("records") and v})
        return out

    def _transformed(self, spark: SparkSession, found: DataFrame, run: Run) -> DataFrame:
        provider = self.provider if self.given else tuned(self.provider, settings(spark), run.run_id)
        return transform(found, self.template, self.spec.transform, provider)

    def _kept(self, found: DataFrame, run: Run, loads: bool) -> None:
        """Append the records' statuses and, where asked for, those that failed to the history."""
        status = F.when(loadable() & F.lit(loads), str(Status.LOADED)).otherwise(F.col("__status"))
        found.select(F.lit(run.run_id).alias("run_id"), F.col("__record_id").alias("record_id"), status.alias("status"), F.col("__error").alias("error")).write.mode("append").parquet(f"{self.history}/records")
        if self.spec.load.on_failure == "quarantine":
            e = self.spec.evaluate
            reason = failure_reason(e.quality_gate, [F.col(f"`{score_column(x.name)}`") for x in e.evaluators], e.evaluators, e)
            quarantine(found, run.run_id, reason, [c for c in found.columns if not c.startswith("__")]).write.mode("append").parquet(f"{self.history}/quarantine")

    @staticmethod
    def _over(run: Run, status: RunStatus) -> Run:
        m = run.metrics
        run.status, run.completed_at = status, datetime.now(UTC)
        m.total_time = m.extract_time + m.transform_time + m.evaluate_time + m.load_time
        return run


def summary(run: Run) -> str:
    """A run in a few lines."""
    m = run.metrics
    lines = [f"{run.pipeline_name} {run.pipeline_version}: {run.status}", f"records {m.total_records}, passed {m.passed_records}, failed {m.failed_records}, errors {m.errored}, loaded {m.loaded_records}"]
    lines.append(f"seconds: extract {m.extract_time:.1f}, transform {m.transform_time:.1f}, evaluate {m.evaluate_time:.1f}, load {m.load_time:.1f}, all {m.total_time:.1f}")
    return "\n".join([*lines, run.error_message] if run.error_message else lines)
