"""Retrying with backoff, and a token bucket, with clock, sleep and draw passed in."""

from __future__ import annotations

import enum
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field


class Action(enum.Enum):
    DONE, RETRY, ABORT = range(3)


class ExhaustedError(Exception):
    """All tries ended in a transient error, which is the cause."""


@dataclass
class Retry:
    """How often, and how long between: full jitter below ``base * 2 ** (attempt - 1)``, both held to ``cap`` seconds."""

    attempts: int = 5
    base: float = 1.0
    cap: float = 120.0
    sleep: Callable[[float], None] = time.sleep
    draw: Callable[[], float] = field(default_factory=lambda: random.Random().random)

    def delay(self, attempt: int, retry_after: float = 0.0) -> float:
        if retry_after > 0:
            return min(retry_after, self.cap)
        return self.draw() * min(self.cap, self.base * 2.0 ** min(attempt - 1, 60))

    def run(self, body: Callable[[int], tuple[Action, float, Exception | None]], on_attempt: Callable[[int, Exception | None], None] | None = None) -> int:
        """Calls ``body(attempt)`` until it is done; returns the number of tries, raises what made it give up."""
        most = max(self.attempts, 1)
        for attempt in range(1, most + 1):
            action, retry_after, error = body(attempt)
            if on_attempt is not None:
                on_attempt(attempt, error)
            if action is Action.DONE:
                return attempt
            if action is Action.ABORT:
                raise error if error is not None else RuntimeError("aborted")
            if attempt < most:
                self.sleep(self.delay(attempt, retry_after))
        raise ExhaustedError(f"exhausted {most} attempts") from error


class TokenBucket:
    """At most ``rate`` tokens a second with a burst of one; ``wait`` tells how long the next caller sleeps."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = (1.0 / rate if rate > 0 else 0.0), clock, sleep
        self.free_at = float("-inf")

    def wait(self) -> float:
        now = self.clock()
        at = max(now, self.free_at)
        self.free_at = at + self.gap
        if at > now:
            self.sleep(at - now)
        return at - now
