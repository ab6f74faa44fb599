"""Scalar functions on keys: on the driver for bounds and quoting, as Catalyst expressions for columns."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_meta(text: str) -> str:
    """`text` as a pattern that matches it and nothing else."""
    return "".join(f"\\{c}" if c in "\\.+*?()|[]{}^$" else c for c in text)


def next_prefix(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is no such bound."""
    stripped = prefix.rstrip(b"\xff")
    return stripped[:-1] + bytes([stripped[-1] + 1]) if stripped else None


def common_prefix_length(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([a, b]))


def expiry(as_of: int, ttl: int) -> int:
    """Absolute expiry of a relative time-to-live in nanoseconds; 0 stays never."""
    return as_of + ttl if ttl else 0


def shown_bytes(n: float) -> str:
    """A byte count for people."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def in_range(key: Column, low: bytes | None, high: bytes | None) -> Column:
    """low <= key < high, in a form that reaches Parquet's statistics for binary columns."""
    out = F.lit(True)
    if low:
        out = key >= F.lit(low)
    if high is not None:
        out = (out & (key < F.lit(high))) if low else key < F.lit(high)
    return out


def trigrams(key: Column) -> Column:
    """The distinct three-byte substrings of a binary key; none for shorter keys."""
    n = F.octet_length(key)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: key.substr(i, F.lit(3))))).otherwise(F.array().cast("array<binary>"))


def key_parts(key: Column, separator: str = ":") -> Column:
    """The parts of a hierarchical key."""
    return F.split(key.cast("string"), quote_meta(separator))


def key_digest(key: Column) -> Column:
    return F.sha2(key, 256)
