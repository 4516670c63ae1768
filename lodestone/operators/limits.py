"""A token bucket for the tools of one process."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class RateLimited(RuntimeError):
    pass


class TokenBucket:
    def __init__(self, capacity: int = 60, per_seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.rate, self.clock = capacity, capacity / per_seconds, clock
        self.tokens, self.last, self._lock = float(capacity), clock(), threading.Lock()

    def take(self) -> bool:
        with self._lock:
            now = self.clock()
            self.tokens, self.last = min(self.capacity, self.tokens + (now - self.last) * self.rate), now
            if self.tokens < 1:
                return False
            self.tokens -= 1
            return True
