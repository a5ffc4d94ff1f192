"""The transform stage: prompts rendered as columns, completed by a provider, failures kept with their reason."""

from __future__ import annotations

import asyncio
import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.errors import ConfigurationError
from spindrift.functions.template import Template
from spindrift.plans.resilience import Backoff, CircuitOpenError, breaker, retried
from spindrift.settings import Settings
from spindrift.spec import Status, TransformSpec

#: An outside model: the prompt, the model's name, the temperature and the most tokens give a text.
Client = Callable[..., "asyncio.Future[str]"]


@dataclass(frozen=True)
class Rules:
    """A provider that needs no model: the text of the first SQL predicate that holds, and errors where one of its own holds."""

    rules: tuple[tuple[str, str], ...] = ()
    default: str | None = None
    fails: str | None = None
    failure: str = "rejected by rule"

    def text(self) -> Column:
        out = F.lit(self.default).cast("string") if self.default is not None else F.col("__prompt")
        for predicate, text in reversed(self.rules):
            out = F.when(F.expr(predicate), text).otherwise(out)
        return F.when(~self._failed(), out)

    def error(self) -> Column:
        return F.when(self._failed(), F.lit(self.failure))

    def _failed(self) -> Column:
        return F.coalesce(F.expr(self.fails), F.lit(False)) if self.fails else F.lit(False)


@dataclass(frozen=True)
class Service:
    """A provider that calls a model from Arrow batches, several prompts in flight, behind a breaker of the worker's own."""

    make: Callable[[], Client]
    run_id: str = "run"
    at_once: int = 10
    retries: Backoff = field(default_factory=lambda: Backoff(attempts=1))
    failures: int = 5
    seconds: float = 60.0
    successes: int = 3


def transform(records: DataFrame, template: Template, spec: TransformSpec, provider: Rules | Service) -> DataFrame:
    """The records with ``__prompt``, ``__text``, ``__error`` and ``__status``; none is dropped.

    Only the row's key and prompt cross over to Python. Where a model is called the caller should stage the result at once: a plan
    that is run again calls again.
    """
    fault = template.error([c for c in records.columns if not c.startswith("__")])
    prompted = records.withColumn("__prompt", template.rendered(records))
    if fault:
        done = prompted.withColumns({"__text": F.lit(None).cast("string"), "__error": F.lit(fault)})
    elif isinstance(provider, Rules):
        done = prompted.withColumns({"__text": provider.text(), "__error": provider.error()})
    else:
        done = _called(prompted, spec, provider)
    return done.withColumn("__status", F.when(F.col("__error").isNotNull(), str(Status.ERROR)).otherwise(str(Status.TRANSFORMED)))


def _called(prompted: DataFrame, spec: TransformSpec, service: Service) -> DataFrame:
    at = prompted.columns.index("__prompt")
    kept = [i for i, c in enumerate(prompted.columns) if c not in ("__text", "__error")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = service.make()
        try:
            for batch in batches:
                told = asyncio.run(complete(batch.column(at).to_pylist(), client, spec, service))
                texts, errors = (pa.array(x, pa.string()) for x in (zip(*told, strict=True) if told else ([], [])))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], texts, errors], names=[*[batch.schema.names[i] for i in kept], "__text", "__error"])
        finally:
            if hasattr(client, "close"):
                client.close()

    fields = [prompted.schema.fields[i] for i in kept]
    return prompted.mapInArrow(of, T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in ("__text", "__error")]]))


async def complete(prompts: list[str], client: Client, spec: TransformSpec, service: Service) -> list[tuple[str | None, str | None]]:
    """Text or error of each prompt, in order; one prompt's failure is its own."""
    gate = asyncio.Semaphore(max(1, service.at_once))
    guard = breaker(f"model-{service.run_id}", failures=service.failures, seconds=service.seconds, successes=service.successes)

    async def one(prompt: str) -> tuple[str | None, str | None]:
        async with gate:
            try:
                call = lambda: asyncio.wait_for(client(prompt, model=spec.model, temperature=spec.temperature, max_tokens=spec.max_tokens), spec.timeout)
                return str(await guard.call(retried, call, service.retries)), None
            except TimeoutError:
                return None, f"LLM call exceeded timeout ({spec.timeout:g}s)"
            except CircuitOpenError as e:
                return None, f"LLM circuit breaker open: {e}"
            except Exception as e:  # noqa: BLE001
                return None, str(e)

    return list(await asyncio.gather(*map(one, prompts)))


def parsed(text: Column, fields: dict[str, str]) -> Column:
    """A JSON reply as a struct of the named fields; other replies are its field ``text``."""
    schema = ", ".join(f"{k} {v}" for k, v in fields.items())
    read = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.struct(*[read[k].alias(k) for k in fields], F.when(F.try_parse_json(text).isNull(), text).alias("text"))


def cache_key(content: Column, model: str, version: str) -> Column:
    return F.sha2(F.concat_ws(":", content, F.lit(model), F.lit(version)), 256)


def complete_once(prompted: DataFrame, cache: DataFrame | None, finish: Callable[[DataFrame], DataFrame], model: str, version: str, now: Column | None = None) -> DataFrame:
    """``prompted`` with ``text`` and ``cached``: each distinct prompt is completed once, or not at all if the cache has it fresh.

    ``cache(key, text, cached_at, ttl_seconds)`` may be None, as after a failed read; that is a miss of every key. ``finish``
    adds ``text`` to rows of ``(key, __prompt)``.
    """
    keyed = prompted.withColumn("key", cache_key(F.col("__prompt"), model, version))
    wanted = keyed.select("key", "__prompt").dropDuplicates(["key"])
    if cache is None:
        return keyed.join(finish(wanted).select("key", "text"), "key").withColumn("cached", F.lit(False))
    moment = now if now is not None else F.current_timestamp()
    fresh = cache.where(F.col("cached_at") + F.make_dt_interval(secs=F.col("ttl_seconds")) > moment).groupBy("key").agg(F.max_by("text", "cached_at").alias("text"))
    hits = wanted.join(fresh, "key").select("key", "text", F.lit(True).alias("cached"))
    misses = finish(wanted.join(fresh, "key", "left_anti")).select("key", "text", F.lit(False).alias("cached"))
    return keyed.join(hits.unionByName(misses), "key")


def without_prefix(cache: DataFrame, prefix: str) -> DataFrame:
    """The cache less the keys that start with a prefix."""
    return cache.where(~F.col("key").startswith(prefix))


_providers: dict[str, Rules | Service] = {"echo": Rules(), "rules": Rules()}


def register_provider(name: str, provider: Rules | Service) -> None:
    """Make a provider available to pipeline files under a name."""
    _providers[name] = provider


def need(name: str) -> Rules | Service:
    """The provider registered under a name, or the one that ``module:factory`` leads to: a provider, or a function that makes a client."""
    if name in _providers:
        return _providers[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ConfigurationError(f"no provider named {name!r}; register one, or name a factory as module:function")
    try:
        found = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as e:
        raise ConfigurationError(f"no provider at {name!r}: {e}") from e
    return found if isinstance(found, (Rules, Service)) else Service(found)


def tuned(provider: Rules | Service, s: Settings, run_id: str) -> Rules | Service:
    """A service with the settings' concurrency, retries and breaker, whose breaker is the run's own."""
    if isinstance(provider, Rules):
        return provider
    retries = Backoff(s.retry_attempts, s.retry_initial, s.retry_base, s.retry_longest)
    return replace(provider, run_id=run_id, at_once=s.max_concurrent_records, retries=retries, failures=s.breaker_failures, seconds=s.breaker_seconds, successes=s.breaker_successes)
