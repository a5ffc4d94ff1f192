"""Scorers as columns: each takes the output, the reference and its criteria, and gives a double or null."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.errors import ConfigurationError

Scorer = Callable[[Column, Column | None, Any], Column]


def tokens(text: Column) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; null if either is, 0 if neither has a word."""
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    share = F.when(union > 0, F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0))).otherwise(0.0)
    return F.when(a.isNotNull() & b.isNotNull(), share)


def share_found(of: Column, within: Column) -> Column:
    """Share of the words of one text that another has; null if either is null or the first has none."""
    x = tokens(of)
    return F.when(of.isNotNull() & within.isNotNull() & (F.size(x) > 0), F.size(F.array_intersect(x, tokens(within))) / F.nullif(F.size(x), F.lit(0)))


def share_true(criteria: list[str]) -> Column:
    """Share of SQL predicates that hold; a predicate that is null doesn't."""
    if not criteria:
        raise ConfigurationError("custom criteria need at least one predicate")
    return reduce(operator.add, (F.coalesce(F.expr(c), F.lit(False)).cast("int") for c in criteria)) / len(criteria)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length in double precision; null if either is null or zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.nullif(norm, F.lit(0.0)))


def fitting_length(text: Column, enough: int) -> Column:
    """Length over what is enough, 1 at most."""
    return F.least(F.lit(1.0), F.char_length(text) / enough)


_scorers: dict[str, Scorer] = {
    "semantic": lambda output, reference, criteria: jaccard(output, reference) if reference is not None else F.lit(None).cast("double"),
    "groundedness": lambda output, reference, criteria: share_found(output, reference) if reference is not None else F.lit(None).cast("double"),
    "relevance": lambda output, reference, criteria: share_found(reference, output) if reference is not None else F.lit(None).cast("double"),
    "custom_criteria": lambda output, reference, criteria: share_true([criteria] if isinstance(criteria, str) else list(criteria or [])),
    "length": lambda output, reference, criteria: fitting_length(output, int(criteria or 1000)),
    "column": lambda output, reference, criteria: F.expr(criteria).cast("double"),
}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Make a scorer of one's own available; it may return any column, also one of a Pandas UDF."""
    _scorers[name] = scorer


def scorer(name: str, kind: str) -> Scorer:
    """The scorer of a name, else of a type."""
    found = _scorers.get(name) or _scorers.get(kind)
    if found is None:
        raise ConfigurationError(f"there is no scorer named {name!r} or of type {kind!r}")
    return found
