"""What a store did since it was opened: calls, rows and latencies, kept on the driver in bounded space."""

from __future__ import annotations

import threading
import time
from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager

from keytide.operators.stats import WINDOW

SCHEMA = "op string, calls bigint, failures bigint, rows bigint, per_second double, p50_ms double, p95_ms double, p99_ms double"


class Meter:
    """Percentiles are over the last `window` calls of an operation, at floor(n * p / 100), counted from 0."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self._lock = window, threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self.since = time.monotonic()
            self.calls, self.failures, self.rows = Counter(), Counter(), Counter()
            self.samples: dict[str, deque[float]] = {}

    def note(self, op: str, seconds: float, rows: int = 0, failed: bool = False) -> None:
        with self._lock:
            self.calls[op] += 1
            self.failures[op] += failed
            self.rows[op] += rows
            self.samples.setdefault(op, deque(maxlen=self.window)).append(seconds * 1000)

    @contextmanager
    def timed(self, op: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        except BaseException:
            self.note(op, time.perf_counter() - start, failed=True)
            raise
        self.note(op, time.perf_counter() - start)

    def seconds(self) -> float:
        return max(1.0, time.monotonic() - self.since)

    def percentile(self, op: str, percent: int) -> float:
        with self._lock:
            x = sorted(self.samples.get(op, ()))
        return x[min(len(x) - 1, len(x) * percent // 100)] if x else 0.0

    def table(self) -> list[tuple]:
        return [(op, self.calls[op], self.failures[op], self.rows[op], self.calls[op] / self.seconds(), *(self.percentile(op, p) for p in (50, 95, 99))) for op in sorted(self.calls)]
