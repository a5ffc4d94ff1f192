import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.errors import EvaluateError
from spindrift.operators.evaluate import enough_pass, too_many_fail
from spindrift.operators.gates import failure_reason, gate, register_gate
from spindrift.spec import EvaluateSpec, Gate, ScorerSpec

SCORERS = (ScorerSpec("a", "column", 0.8, 2.0), ScorerSpec("b", "column", 0.75, 1.0), ScorerSpec("c", "column", 0.7, 0.5))
SPEC = EvaluateSpec(SCORERS, Gate.WEIGHTED, 0.75)


def expected(row):
    """The four rules in plain Python, whose comparisons with NaN are all false."""
    there = [(s, e) for s, e in zip(row, SCORERS, strict=True) if s is not None]
    weight = sum(e.weight for _, e in there)
    passing = sum(s >= e.threshold for s, e in there)
    return (
        len(there) == 3 and not any(s < e.threshold for s, e in there),
        passing > 1.5,
        passing > 0,
        bool(weight) and sum(s * e.weight for s, e in there) / weight >= 0.75,
    )


def decide(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double")
    columns = [F.col(c) for c in "abc"]
    return [tuple(r)[1:] for r in df.select("i", *[gate(g, columns, SCORERS, SPEC).alias(g) for g in Gate]).orderBy("i").collect()]


def test_boundaries(spark):
    nan = math.nan
    rows = [(0.8, 0.75, 0.7), (0.9, 0.7, 0.6), (0.7, 0.75, None), (None, None, None), (nan, 0.9, 0.9), (nan, nan, nan), (0.79, 0.75, 0.7), (0.95, None, None)]
    assert decide(spark, rows) == [expected(r) for r in rows]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.just(math.nan), st.floats(0, 1), st.sampled_from([0.7, 0.75, 0.8]))] * 3), min_size=1, max_size=30))
def test_random_scores(spark, rows):
    assert decide(spark, rows) == [expected(r) for r in rows]


def test_errors_and_own_gates(spark):
    with pytest.raises(EvaluateError):
        gate("none", [F.lit(1.0)], SCORERS[:1], SPEC)
    with pytest.raises(EvaluateError):
        gate(Gate.WEIGHTED, [F.lit(1.0)], SCORERS[:1], EvaluateSpec(SCORERS[:1], Gate.WEIGHTED))
    register_gate("first", lambda scores, scorers, spec: scores[0] > 0)
    assert spark.range(1).select(gate("first", [F.lit(1.0)], SCORERS[:1], SPEC)).first()[0] is True


def test_reasons(spark):
    df = spark.createDataFrame([(0.5, 0.9, None)], "a double, b double, c double")
    columns = [F.col(c) for c in "abc"]
    said = df.select(*[failure_reason(g, columns, SCORERS, SPEC) for g in Gate]).first()
    assert said[0] == "below threshold: a 0.500 < 0.800; c missing < 0.700"
    assert said[1].startswith("only 1 of 3 passed")
    assert said[2] is None
    assert said[3] == "weighted mean 0.633 < 0.750"


def test_batches():
    assert enough_pass(4, 5, 0.8) and not enough_pass(2, 5, 0.8) and enough_pass(0, 5, None) and enough_pass(0, 0, 0.9)
    assert not too_many_fail(0, 0) and too_many_fail(11, 1000) and too_many_fail(2, 10) and not too_many_fail(1, 10)
