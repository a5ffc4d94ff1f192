import asyncio

import pytest

from spindrift.errors import DeadlineError, RetryableError
from spindrift.plans.resilience import Backoff, Breaker, CircuitOpenError, breaker, breakers, retried, trace, within_growing_time


async def no_wait(seconds):
    no_wait.waits.append(seconds)


def failing(times, error=ValueError):
    left = [times]

    async def call():
        if left[0]:
            left[0] -= 1
            raise error("no")
        return "yes"

    return call


def test_retry():
    no_wait.waits = []
    for error in (RetryableError, TimeoutError):
        no_wait.waits = []
        assert asyncio.run(retried(failing(2, error), Backoff(3, 1, 2, 60), sleep=no_wait)) == "yes"
        assert no_wait.waits == [1, 2]
        with pytest.raises(error):
            asyncio.run(retried(failing(3, error), Backoff(3), sleep=no_wait))
    no_wait.waits = []
    with pytest.raises(ValueError):  # not listed, so it comes through at once
        asyncio.run(retried(failing(1), Backoff(3), sleep=no_wait))
    assert no_wait.waits == []
    with pytest.raises(KeyError):
        asyncio.run(retried(failing(1, KeyError), Backoff(3, on=(ValueError,)), sleep=no_wait))
    with pytest.raises(RuntimeError):
        asyncio.run(retried(failing(0), Backoff(0)))
    assert Backoff(8).waits() == [1, 2, 4, 8, 16, 32, 60]


def test_breaker_walks_through_its_states():
    steps = trace(["ok"] + ["fail"] * 3 + ["ok"] + ["wait"] * 2 + ["ok", "ok", "fail"], failures=3, seconds=2, successes=2)
    assert [s for _, s in steps] == ["closed", "closed", "closed", "open", "open", "open", "open", "half_open", "closed", "closed"]
    assert steps[4][0] == "rejected"
    again = trace(["fail"] * 2 + ["wait", "fail"], failures=2, seconds=1, successes=2)
    assert again[-1][1] == "open"


def test_breaker_probes_and_counts():
    now = [0.0]
    b = Breaker("x", failures=1, seconds=5, successes=1, probes=1, excluded=(KeyError,), clock=lambda: now[0])

    async def ask(error=None, wait=0.0):
        async def call():
            await asyncio.sleep(wait)
            if error:
                raise error("no")
            return 1

        return await b.call(call)

    with pytest.raises(KeyError):
        asyncio.run(ask(KeyError))
    assert b.state == "closed" and b.counts.failed == 0
    with pytest.raises(ValueError):
        asyncio.run(ask(ValueError))
    with pytest.raises(CircuitOpenError) as e:
        asyncio.run(ask())
    assert e.value.until == 5 and b.counts.rejected == 1 and b.counts.calls == 1
    now[0] = 6.0

    async def two():
        return await asyncio.gather(ask(wait=0.05), ask(wait=0.05), return_exceptions=True)

    one, other = asyncio.run(two())
    assert one == 1 and isinstance(other, CircuitOpenError) and b.state == "closed" and b.probing == 0
    b.reset()
    assert Breaker("z").probes == 3
    assert breaker("y", failures=2) is breaker("y") and "y" in breakers()


def test_growing_time():
    async def slow():
        await asyncio.sleep(1)

    no_wait.waits = []
    with pytest.raises(DeadlineError):
        asyncio.run(within_growing_time(slow, 0.01, 2, sleep=no_wait))
    assert no_wait.waits == [1]
