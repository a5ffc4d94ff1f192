"""The evaluate stage: score columns, the gate, statuses and the batch threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.errors import EvaluateError
from spindrift.functions.scorers import scorer
from spindrift.functions.template import python_text
from spindrift.operators.gates import gate
from spindrift.spec import EvaluateSpec, Status


def score_column(name: str) -> str:
    return f"__score_{name}"


def evaluate(records: DataFrame, spec: EvaluateSpec) -> DataFrame:
    """The records with a score column for each scorer and ``__gate``, which is null where nothing was decided.

    An empty output isn't scored: it keeps its status, and an earlier error keeps its reason. A gate that can't be built makes
    an error of every scored row.
    """
    field = spec.reference_field
    reference = python_text(records, field) if field and field in records.columns else None
    output, has_text = F.col("__text"), F.coalesce(F.col("__text") != "", F.lit(False))
    names = list(dict.fromkeys(e.name for e in spec.evaluators))
    first = {e.name: e for e in reversed(spec.evaluators)}
    scores = {n: F.when(has_text, scorer(n, first[n].type)(output, reference, first[n].criteria).cast("double")) for n in names}
    scored = records.withColumns({score_column(n): c for n, c in scores.items()})
    try:
        passes, fault = gate(spec.quality_gate, [F.col(f"`{score_column(e.name)}`") for e in spec.evaluators], spec.evaluators, spec), None
    except EvaluateError as e:
        passes, fault = F.lit(None).cast("boolean"), str(e)
    scored = scored.withColumn("__gate", F.when(has_text, passes))
    status = F.when(F.col("__gate"), str(Status.PASSED)).when(~F.col("__gate"), str(Status.FAILED))
    if fault:
        status, scored = F.when(has_text, str(Status.ERROR)), scored.withColumn("__error", F.when(has_text, fault).otherwise(F.col("__error")))
    return scored.withColumn("__status", F.coalesce(status, F.col("__status")))


def enough_pass(passed: int, total: int, threshold: float | None) -> bool:
    """Whether a batch's pass rate reaches its threshold; all rows count, also those in error."""
    return threshold is None or total == 0 or passed / total >= threshold


def too_many_fail(failed: int, total: int, most: int = 10, rate: float = 0.1) -> bool:
    return total > 0 and (failed > most or failed / total > rate)
