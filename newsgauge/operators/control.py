"""Driver-side control: typed errors, retry with jitter, a circuit breaker, run configuration."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field


class SourceError(Exception):
    """A failed call to a source or model. retryable says whether the same call may succeed later."""

    retryable = False

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = context


class Unavailable(SourceError):
    retryable = True


class RateLimited(SourceError):
    """The source asks to stop: opens a breaker at once."""

    retryable = True


class BadPayload(SourceError):
    pass


class BadConfig(SourceError):
    pass


def retry[T](call: Callable[[], T], attempts: int = 3, base: float = 0.5, most: float = 8.0, sleep=time.sleep, rng=random.random) -> T:
    """Call until it succeeds, fails for good, or attempts run out; waits grow exponentially, with full jitter."""
    for n in range(attempts):
        try:
            return call()
        except SourceError as problem:
            if not problem.retryable or n + 1 == attempts:
                raise
            sleep(rng() * min(most, base * 2**n))
    raise ValueError("attempts must be positive")


@dataclass
class Breaker:
    """Open after ``limit`` failures in a row or one rate limit; after ``cool_down`` seconds one probe may pass."""

    limit: int = 3
    cool_down: float = 300.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened_at: float | None = field(default=None)

    @property
    def state(self) -> str:
        if self.opened_at is None:
            return "closed"
        return "half-open" if self.clock() - self.opened_at >= self.cool_down else "open"

    def allows(self) -> bool:
        return self.state != "open"

    def success(self) -> None:
        self.failures, self.opened_at = 0, None

    def failure(self, at_once: bool = False) -> None:
        probe = self.state == "half-open"
        self.failures += 1
        if at_once or probe or self.failures >= self.limit:
            self.opened_at = self.clock()


@dataclass(frozen=True)
class Config:
    """Settings of a run, read from text values; every problem is reported at once."""

    window_days: int = 90
    daily_window_days: int = 7
    lookback_hours: int = 48
    max_items_per_company: int = 25
    sources: tuple[str, ...] = ("corpus",)
    model: str = "offline"

    @classmethod
    def read(cls, values: Mapping[str, str]) -> Config:
        made, problems = {}, []
        for name, default in vars(cls()).items():
            raw = values.get(name.upper(), "").strip()
            if not raw:
                continue
            if isinstance(default, int):
                if raw.isdigit() and int(raw) > 0:
                    made[name] = int(raw)
                else:
                    problems.append(f"{name.upper()}: a positive whole number is needed, not {raw!r}")
            elif isinstance(default, tuple):
                made[name] = tuple(dict.fromkeys(x.strip() for x in raw.split(",") if x.strip()))
            else:
                made[name] = raw
        if problems:
            raise BadConfig("; ".join(problems))
        return cls(**made)
