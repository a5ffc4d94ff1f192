"""Quality gates as column expressions over score columns.

Scores are doubles in the order of their scorers; null means that a scorer gave none. NaN compares as in IEEE
arithmetic: it is neither below nor at least a threshold, so it passes ``all_pass`` and nothing else.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.errors import EvaluateError
from spindrift.spec import MORE_GATES, EvaluateSpec, Gate, ScorerSpec

Rule = Callable[[Sequence[Column], Sequence[ScorerSpec], EvaluateSpec], Column]


def reaches(score: Column, threshold: float) -> Column:
    """False for null and NaN."""
    return F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False))


def _all(scores: Sequence[Column], scorers: Sequence[ScorerSpec], spec: EvaluateSpec) -> Column:
    return reduce(operator.and_, (F.coalesce(~(s < e.threshold), F.lit(False)) for s, e in zip(scores, scorers, strict=True)))


def _any(scores: Sequence[Column], scorers: Sequence[ScorerSpec], spec: EvaluateSpec) -> Column:
    return reduce(operator.or_, (reaches(s, e.threshold) for s, e in zip(scores, scorers, strict=True)))


def passing(scores: Sequence[Column], scorers: Sequence[ScorerSpec]) -> Column:
    """How many scorers reach their threshold."""
    return reduce(operator.add, (reaches(s, e.threshold).cast("int") for s, e in zip(scores, scorers, strict=True)))


def _majority(scores: Sequence[Column], scorers: Sequence[ScorerSpec], spec: EvaluateSpec) -> Column:
    return 2 * passing(scores, scorers) > len(scorers)


def weighted_mean(scores: Sequence[Column], scorers: Sequence[ScorerSpec]) -> Column:
    """Mean of the scores that are there; null if there is none."""
    zero = F.lit(0.0)
    top = reduce(operator.add, (F.coalesce(s * F.lit(float(e.weight)), zero) for s, e in zip(scores, scorers, strict=True)), zero)
    weight = reduce(operator.add, (F.when(s.isNotNull(), F.lit(float(e.weight))).otherwise(zero) for s, e in zip(scores, scorers, strict=True)), zero)
    return F.when(weight != 0, top / F.nullif(weight, zero))


def _weighted(scores: Sequence[Column], scorers: Sequence[ScorerSpec], spec: EvaluateSpec) -> Column:
    if spec.quality_gate_threshold is None:
        raise EvaluateError("the weighted gate needs quality_gate_threshold")
    return reaches(weighted_mean(scores, scorers), spec.quality_gate_threshold)


_rules: dict[str, Rule] = {Gate.ALL: _all, Gate.MAJORITY: _majority, Gate.ANY: _any, Gate.WEIGHTED: _weighted}


def register_gate(name: str, rule: Rule) -> None:
    """Make a rule of one's own available under a name, also to pipeline files that are read from then on."""
    _rules[name] = rule
    MORE_GATES.add(name)


def gate(name: str, scores: Sequence[Column], scorers: Sequence[ScorerSpec], spec: EvaluateSpec) -> Column:
    """True where a row passes, never null."""
    if name not in _rules:
        raise EvaluateError(f"there is no quality gate named {name!r}")
    return _rules[name](scores, scorers, spec)


def has_gate(name: str) -> bool:
    return name in _rules


def failure_reason(name: str, scores: Sequence[Column], scorers: Sequence[ScorerSpec], spec: EvaluateSpec) -> Column:
    """Why a row fails its gate, null where it passes. Numbers are shown with three decimals, rounded half to even."""
    shown = [F.concat(F.lit(f"{e.name} "), F.when(s.isNull(), "missing").otherwise(_short(s)), F.lit(f" < {e.threshold:.3f}")) for s, e in zip(scores, scorers, strict=True)]
    low = F.filter(F.array(*[F.when(~reaches(s, e.threshold), text) for s, e, text in zip(scores, scorers, shown, strict=True)]), lambda x: x.isNotNull())
    joined = F.array_join(low, "; ")
    text = {
        Gate.ALL: F.concat(F.lit("below threshold: "), joined),
        Gate.MAJORITY: F.concat(F.lit("only "), passing(scores, scorers).cast("string"), F.lit(f" of {len(scorers)} passed: "), joined),
        Gate.ANY: F.concat(F.lit("none passed: "), joined),
        Gate.WEIGHTED: F.concat(F.lit("weighted mean "), F.coalesce(_short(weighted_mean(scores, scorers)), F.lit("missing")), F.lit(f" < {spec.quality_gate_threshold or 0:.3f}")),
    }.get(name, joined)
    return F.when(~gate(name, scores, scorers, spec), text)


def _short(x: Column) -> Column:
    return F.bround(x, 3).cast("decimal(20,3)").cast("string")
