"""Retries and circuit breakers for sinks; they run in the driver, around a batch's write."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

from ..functions.checks import jittered

T = TypeVar("T")


def retry(call: Callable[[], T], most: int = 3, initial: float = 0.1, factor: float = 2.0, longest: float = 5.0, jitter: bool = False, final: tuple[type[Exception], ...] = (), wait: Callable[[float], None] = time.sleep) -> T:
    """The call's result, after up to ``most`` further tries; errors of the ``final`` kinds are not tried again."""
    delay, draw = initial, random.Random()
    for attempt in range(most + 1):
        try:
            return call()
        except final:
            raise
        except Exception:
            if attempt == most:
                raise
            if jitter:
                delay = jittered(delay, draw)
            wait(delay)
            delay = min(delay * factor, longest)
    raise AssertionError("unreachable")


def retry_with(call: Callable[[], T], backoff: Callable[[int], float], most: int = 3, wait: Callable[[float], None] = time.sleep) -> T:
    """Like ``retry`` with a wait of one's own for each attempt."""
    for attempt in range(most + 1):
        try:
            return call()
        except Exception:
            if attempt == most:
                raise
            wait(backoff(attempt))
    raise AssertionError("unreachable")


class OpenError(RuntimeError):
    """The breaker refuses calls just now."""


class Breaker:
    """Closed, open after failures in a row, half-open after a time-out; a generation's late results don't count."""

    def __init__(self, trips: int = 5, timeout: float = 60.0, interval: float = 60.0, probes: int = 1, ready: Callable[[dict], bool] | None = None, good: Callable[[Exception | None], bool] | None = None, clock: Callable[[], float] = time.monotonic):
        self.ready = ready or (lambda counts: counts["failures_in_row"] >= trips)
        self.good = good or (lambda error: error is None)
        self.timeout, self.interval, self.probes, self.clock = timeout, interval, probes, clock
        self.generation = 0
        self._enter("closed")

    def _enter(self, state: str) -> None:
        self.current, self.generation = state, self.generation + 1
        self.counts = {"requests": 0, "successes": 0, "failures": 0, "successes_in_row": 0, "failures_in_row": 0}
        length = self.interval if state == "closed" else self.timeout if state == "open" else 0
        self.until = self.clock() + length if length else None

    @property
    def state(self) -> str:
        if self.until is not None and self.clock() > self.until:
            self._enter("half-open" if self.current == "open" else "closed")
        return self.current

    def allow(self) -> Callable[[Exception | None], None]:
        """Raises OpenError, or gives the function that takes the call's outcome."""
        state = self.state
        if state == "open" or state == "half-open" and self.counts["requests"] >= self.probes:
            raise OpenError(state)
        self.counts["requests"] += 1
        generation = self.generation
        return lambda error=None: self._done(generation, error)

    def _done(self, generation: int, error: Exception | None) -> None:
        state = self.state
        if generation != self.generation:
            return
        c = self.counts
        if self.good(error):
            c["successes"], c["successes_in_row"], c["failures_in_row"] = c["successes"] + 1, c["successes_in_row"] + 1, 0
            if state == "half-open" and c["successes_in_row"] >= self.probes:
                self._enter("closed")
        else:
            c["failures"], c["failures_in_row"], c["successes_in_row"] = c["failures"] + 1, c["failures_in_row"] + 1, 0
            if state == "half-open" or self.ready(c):
                self._enter("open")

    def call(self, run: Callable[[], T]) -> T:
        done = self.allow()
        try:
            out = run()
        except Exception as e:
            done(e)
            raise
        done(None)
        return out


class Breakers:
    """A breaker for each key."""

    def __init__(self, **options):
        self.options, self.known = options, {}

    def get(self, key: str) -> Breaker:
        return self.known.setdefault(key, Breaker(**self.options))


class RateCapped:
    """A breaker that also refuses calls beyond a number per window."""

    def __init__(self, breaker: Breaker, most: int, window: float):
        self.breaker, self.most, self.window = breaker, most, window
        self.begin, self.used = breaker.clock(), 0

    def call(self, run: Callable[[], T]) -> T:
        now = self.breaker.clock()
        if now - self.begin >= self.window:
            self.begin, self.used = now, 0
        if self.used >= self.most:
            raise OpenError("rate")
        self.used += 1
        return self.breaker.call(run)
