"""Retries, a circuit breaker and recovery decisions for calls to outside services, within one process."""

from __future__ import annotations

import asyncio
import time
from collections import Counter
from collections.abc import Awaitable, Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.errors import DeadlineError, RetryableError, SpindriftError

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


@dataclass(frozen=True)
class Backoff:
    """How often and after what waits a call is tried."""

    attempts: int = 3
    initial: float = 1.0
    base: float = 2.0
    longest: float = 60.0
    on: tuple[type[BaseException], ...] = (RetryableError, TimeoutError)

    def wait(self, attempt: int) -> float:
        return min(self.initial * self.base**attempt, self.longest)

    def waits(self) -> list[float]:
        return [self.wait(i) for i in range(self.attempts - 1)]


async def retried(call: Callable[..., Awaitable[Any]], how: Backoff, *args: Any, sleep: Callable[[float], Awaitable[None]] = asyncio.sleep, **kwargs: Any) -> Any:
    """The call's result, or the last attempt's error. Errors that aren't listed come through at once."""
    if how.attempts < 1:
        raise RuntimeError("a call needs at least one attempt")
    for wait in [*how.waits(), None]:
        try:
            return await call(*args, **kwargs)
        except how.on:
            if wait is None:
                raise
            await sleep(wait)


async def within_growing_time(call: Callable[[], Awaitable[Any]], seconds: float, attempts: int = 3, base: float = 2.0, sleep: Callable[[float], Awaitable[None]] = asyncio.sleep) -> Any:
    """The call's result, each attempt having a multiple of ``seconds`` more than the one before."""
    for attempt in range(attempts):
        try:
            return await asyncio.wait_for(call(), seconds * (1 + attempt))
        except TimeoutError:
            if attempt + 1 < attempts:
                await sleep(base**attempt)
    raise DeadlineError(f"no answer within {seconds * attempts:g} seconds")


class CircuitOpenError(SpindriftError):
    def __init__(self, name: str, until: float):
        super().__init__(f"circuit breaker {name!r} is open until {until:g}")
        self.name, self.until = name, until


@dataclass
class BreakerCounts:
    """What a breaker has seen; rejected calls aren't calls."""

    calls: int = 0
    succeeded: int = 0
    failed: int = 0
    rejected: int = 0
    transitions: Counter = field(default_factory=Counter)


@dataclass
class Breaker:
    """Stops calling what keeps failing, and probes it after a while."""

    name: str
    failures: int = 5
    seconds: float = 60.0
    successes: int = 3
    probes: int = 3
    excluded: tuple[type[BaseException], ...] = ()
    clock: Callable[[], float] = time.monotonic
    state: str = CLOSED
    until: float = 0.0
    streak: int = 0
    probing: int = 0
    counts: BreakerCounts = field(default_factory=BreakerCounts)

    def admit(self) -> bool:
        """Whether a call may go ahead, as a probe or not; raises where it may not."""
        if self.state == OPEN:
            if self.clock() < self.until:
                self._reject(self.until)
            self._turn(HALF_OPEN)
        if self.state == HALF_OPEN:
            if self.probing >= self.probes:
                self._reject(self.clock() + self.seconds)
            self.probing += 1
            return True
        return False

    def _reject(self, until: float) -> None:
        self.counts.rejected += 1
        raise CircuitOpenError(self.name, until)

    def settle(self, worked: bool) -> None:
        """Take note of a call's outcome."""
        self.counts.calls += 1
        if worked:
            self.counts.succeeded += 1
            self.streak = self.streak + 1 if self.state == HALF_OPEN else 0
            if self.state == HALF_OPEN and self.streak >= self.successes:
                self._turn(CLOSED)
        else:
            self.counts.failed += 1
            self.streak += 1
            if self.state == HALF_OPEN or self.state == CLOSED and self.streak >= self.failures:
                self._turn(OPEN)

    def _turn(self, state: str) -> None:
        self.counts.transitions[f"{self.state}->{state}"] += 1
        self.state, self.streak = state, 0
        if state == OPEN:
            self.until = self.clock() + self.seconds
        if state != HALF_OPEN:
            self.probing = 0

    async def call(self, of: Callable[..., Awaitable[Any]], *args: Any, **kwargs: Any) -> Any:
        probe = self.admit()
        try:
            result = await of(*args, **kwargs)
        except self.excluded:
            raise
        except Exception:
            self.settle(False)
            raise
        else:
            self.settle(True)
            return result
        finally:
            if probe:
                self.probing = max(0, self.probing - 1)

    def reset(self) -> None:
        if self.state != CLOSED:
            self._turn(CLOSED)
        self.streak = self.probing = 0


_breakers: dict[str, Breaker] = {}


def breaker(name: str, **how: Any) -> Breaker:
    """This process's breaker of a name; the first caller decides its limits."""
    return _breakers.setdefault(name, Breaker(name, **how))


def breakers() -> dict[str, Breaker]:
    return dict(_breakers)


def trace(outcomes: list[str], **how: Any) -> list[tuple[str, str]]:
    """Each outcome (``ok``, ``fail`` or ``wait``, a second passing) with the state after it; rejected calls say so."""
    now = [0.0]
    b = Breaker("trace", clock=lambda: now[0], **how)
    out = []
    for outcome in outcomes:
        said = outcome
        if outcome == "wait":
            now[0] += 1
        else:
            try:
                probe = b.admit()
                b.settle(outcome == "ok")
                b.probing -= probe and b.probing > 0
            except CircuitOpenError:
                said = "rejected"
        out.append((said, b.state))
    return out


def recovery_action(stage: Column, retryable: Column, attempts: Column, most: int = 3, on_failure: str = "quarantine") -> Column:
    """What to do about a failed row: retry while that may help, else by stage and policy."""
    return (
        F.when(retryable & (attempts < most), "retry")
        .when(stage == "extract", "abort")
        .when(stage == "load", "abort" if on_failure == "abort" else "quarantine")
        .when(stage == "evaluate", "skip" if on_failure == "skip" else "quarantine")
        .otherwise(on_failure)
    )
