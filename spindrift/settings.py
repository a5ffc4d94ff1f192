"""Settings of the library: the session's ``spark.spindrift.*`` keys, then the environment, then defaults."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from spindrift.errors import ConfigurationError


@dataclass(frozen=True)
class Settings:
    max_concurrent_records: int = 10
    breaker_failures: int = 5
    breaker_seconds: float = 60.0
    breaker_successes: int = 3
    retry_attempts: int = 3
    retry_initial: float = 1.0
    retry_base: float = 2.0
    retry_longest: float = 60.0
    log_level: str = "INFO"
    pipelines_folder: str = "pipelines"
    column_prefix: str = "etl_"
    #: Seconds that a stage may take; 0 sets no limit.
    extract_seconds: float = 0.0
    transform_seconds: float = 0.0
    evaluate_seconds: float = 0.0
    load_seconds: float = 0.0


_held: dict[str, Settings] = {}


def settings(spark: SparkSession | None = None) -> Settings:
    """The settings in force; read once and kept until ``reload``."""
    if "now" not in _held:
        reload(spark)
    return _held["now"]


def reload(spark: SparkSession | None = None) -> Settings:
    values = {}
    for f in fields(Settings):
        raw = spark.conf.get(f"spark.spindrift.{f.name}", None) if spark else None
        raw = raw if raw is not None else os.environ.get(f"SPINDRIFT_{f.name.upper()}")
        if raw is not None:
            values[f.name] = type(f.default)(raw)
    _held["now"] = Settings(**values)
    return _held["now"]


def filled(value, secrets: Mapping[str, str]):
    """``value`` with every text that is wholly ``${KEY}`` or ``${provider:KEY}`` replaced, in mappings and lists too."""
    if isinstance(value, Mapping):
        return {k: filled(v, secrets) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, secrets) for v in value]
    found = re.fullmatch(r"\$\{([\w.-]+(?::[\w.-]+)?)\}", value) if isinstance(value, str) else None
    if not found:
        return value
    if found[1] not in secrets:
        raise ConfigurationError(f"no secret named {found[1]}")
    return secrets[found[1]]
