"""Pipeline definitions: what a YAML file or a mapping may say, with its bounds and defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import MISSING, dataclass, fields
from enum import StrEnum
from pathlib import Path
from typing import Any

import yaml

from spindrift.errors import ConfigurationError, SpecError


# The literals that pipeline files and outputs hold.
class Stage(StrEnum):
    EXTRACT = "extract"
    TRANSFORM = "transform"
    EVALUATE = "evaluate"
    LOAD = "load"


class Gate(StrEnum):
    ALL = "all_pass"
    MAJORITY = "majority_pass"
    ANY = "any_pass"
    WEIGHTED = "weighted"


class Format(StrEnum):
    CSV = "csv"
    JSON = "json"
    JSONL = "jsonl"
    PARQUET = "parquet"


class RunStatus(StrEnum):
    PENDING = "pending"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"
    PARTIAL = "partial"


class Status(StrEnum):
    PENDING = "pending"
    EXTRACTED = "extracted"
    TRANSFORMED = "transformed"
    EVALUATED = "evaluated"
    PASSED = "passed"
    FAILED = "failed"
    LOADED = "loaded"
    ERROR = "error"


class Recovery(StrEnum):
    RETRY = "retry"
    SKIP = "skip"
    QUARANTINE = "quarantine"
    FALLBACK = "fallback"
    ABORT = "abort"


@dataclass(frozen=True)
class Between:
    """Bounds of a number; ``above`` leaves its value out."""

    low: float | None = None
    high: float | None = None
    above: float | None = None

    def holds(self, x: float) -> bool:
        return (self.low is None or x >= self.low) and (self.high is None or x <= self.high) and (self.above is None or x > self.above)


UNIT, POSITIVE = Between(0, 1), Between(above=0)


@dataclass(frozen=True)
class ScorerSpec:
    name: str
    type: str
    threshold: float
    weight: float = 1.0
    criteria: Any = None

    BOUNDS = {"threshold": UNIT, "weight": POSITIVE}


@dataclass(frozen=True)
class ExtractSpec:
    source: str
    source_type: Format | None = None
    batch_size: int = 100
    timeout: float = 30.0
    query: str | None = None
    params: Any = None

    BOUNDS = {"batch_size": POSITIVE, "timeout": POSITIVE}


@dataclass(frozen=True)
class TransformSpec:
    prompt: str
    model: str = "gpt-4o-mini"
    provider: str = "openai"
    batch_size: int = 50
    temperature: float = 0.7
    max_tokens: int | None = None
    timeout: float = 60.0

    BOUNDS = {"batch_size": POSITIVE, "temperature": Between(0, 2), "max_tokens": POSITIVE, "timeout": POSITIVE}


@dataclass(frozen=True)
class EvaluateSpec:
    evaluators: tuple[ScorerSpec, ...]
    quality_gate: Gate = Gate.ALL
    quality_gate_threshold: float | None = None
    batch_threshold: float | None = None
    reference_field: str | None = None
    timeout: float = 30.0

    BOUNDS = {"quality_gate_threshold": UNIT, "batch_threshold": UNIT, "timeout": POSITIVE}


@dataclass(frozen=True)
class LoadSpec:
    destination: str
    destination_type: Format | None = None
    mode: str = "append"
    batch_size: int = 100
    timeout: float = 30.0
    schema: Any = None
    on_failure: str = "skip"

    BOUNDS = {"batch_size": POSITIVE, "timeout": POSITIVE}


@dataclass(frozen=True)
class PipelineSpec:
    name: str
    version: str
    extract: ExtractSpec
    transform: TransformSpec
    evaluate: EvaluateSpec
    load: LoadSpec
    description: str | None = None

    BOUNDS = {}


#: What the fields that hold more than a plain value are built from.
NESTED = {"extract": ExtractSpec, "transform": TransformSpec, "evaluate": EvaluateSpec, "load": LoadSpec}
CHOICES = {"quality_gate": Gate, "source_type": Format, "destination_type": Format}
NUMBERS = {"threshold", "weight", "timeout", "temperature", "quality_gate_threshold", "batch_threshold"}
WHOLE = {"batch_size", "max_tokens"}
OPEN = {"criteria", "params", "schema"}
#: Names of gates beside the built-in ones, as ``register_gate`` adds them.
MORE_GATES: set[str] = set()


def build(kind: type, given: Any, at: str = "pipeline"):
    """An instance of ``kind`` from a mapping; keys that it doesn't know are left out, everything else must fit."""
    if not isinstance(given, Mapping):
        raise SpecError(f"{at}: a mapping is needed")
    values = {}
    for f in fields(kind):
        where = f"{at}.{f.name}"
        if f.name not in given:
            if f.default is MISSING:
                raise SpecError(f"{where}: missing")
            continue
        values[f.name] = _value(f.name, given[f.name], where, f.default is None)
        bound = kind.BOUNDS.get(f.name)
        if bound and values[f.name] is not None and not bound.holds(values[f.name]):
            raise SpecError(f"{where}: {values[f.name]} is out of bounds")
    return kind(**values)


def _value(name: str, x: Any, where: str, optional: bool) -> Any:
    if x is None and optional or name in OPEN and name != "schema":
        return x
    if name in NESTED:
        return build(NESTED[name], x, where)
    if name == "evaluators":
        if not isinstance(x, (list, tuple)) or not x:
            raise SpecError(f"{where}: at least one is needed")
        return tuple(build(ScorerSpec, y, f"{where}[{i}]") for i, y in enumerate(x))
    if name == "on_failure" and x not in ("skip", "quarantine"):
        raise SpecError(f"{where}: {x!r} is none of skip, quarantine")
    if name == "schema" and not (isinstance(x, Mapping) and all(isinstance(k, str) and isinstance(v, str) for k, v in x.items())):
        raise SpecError(f"{where}: a mapping from names to types is needed")
    if name == "schema":
        return dict(x)
    if name == "quality_gate" and x in MORE_GATES:
        return x
    if name in CHOICES:
        try:
            return CHOICES[name](x)
        except ValueError:
            raise SpecError(f"{where}: {x!r} is none of {', '.join(CHOICES[name])}") from None
    if name in NUMBERS or name in WHOLE:
        try:
            number = float(x)
        except (TypeError, ValueError):
            raise SpecError(f"{where}: a number is needed") from None
        if isinstance(x, bool) or name in WHOLE and number != int(number):
            raise SpecError(f"{where}: a {'whole ' * (name in WHOLE)}number is needed")
        return int(number) if name in WHOLE else number
    if not isinstance(x, str):
        raise SpecError(f"{where}: a text is needed")
    return x


def from_mapping(given: Any) -> PipelineSpec:
    return build(PipelineSpec, given)


def from_file(path: str | Path) -> PipelineSpec:
    """The pipeline that a YAML file defines."""
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise ConfigurationError(f"no pipeline file can be read at {path}: {e}") from e
    try:
        given = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigurationError(f"{path} is no YAML: {e}") from e
    return from_mapping(given)


def is_valid(path: str | Path) -> bool:
    """Whether a path leads to a good pipeline file; ``from_file`` says what is wrong with another."""
    try:
        from_file(path)
    except ConfigurationError:
        return False
    return True


def resolve_format(explicit: str | Format | None, path: str, what: str) -> Format:
    """The stated format, else the one that the path's suffix names in any case."""
    if explicit is not None:
        return Format(explicit)
    suffix = Path(path).suffix.lower().removeprefix(".")
    if suffix in list(Format):
        return Format(suffix)
    raise ConfigurationError(f"Cannot determine {what} type from {path!r}; state it, or use one of the suffixes {', '.join('.' + f for f in Format)}")
