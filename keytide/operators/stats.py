"""Statistics: levels, percentiles, rates, and the autotuner as a pure function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10_000


def level_stats(segments: DataFrame) -> DataFrame:
    """(level, segments, bytes, num_keys, tombstone_fraction) of a table of segments."""
    return segments.groupBy("level").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), F.sum("num_keys").alias("num_keys"), ratio(F.sum("num_tombstones"), F.sum("num_keys")).alias("tombstone_fraction"))


def least(column: str) -> Column:
    """min of a binary column in an aggregation that hashes; see `_hashed`."""
    return _hashed(F.min(column), column)


def greatest(column: str) -> Column:
    """max of a binary column in an aggregation that hashes; see `_hashed`."""
    return _hashed(F.max(column), column)


def _hashed(found: Column, column: str) -> Column:
    """`found`, with a set beside it that stays empty.

    Spark sorts all rows by the group for a min or max of variable length, whatever the number of groups, so a task's memory grows
    with its file. Next to an aggregate whose buffer is an object it keeps one buffer a group instead.
    """
    return F.coalesce(found, F.get(F.collect_set(F.when(F.lit(False), F.col(column))), F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rate(delta: Column, seconds: Column) -> Column:
    """Events a second over at least a second."""
    return delta.cast("double") / F.greatest(F.lit(1.0), seconds.cast("double"))


def floor_percentiles(df: DataFrame, value: str, order: str, percents: tuple[int, ...] = (50, 95, 99), window: int = WINDOW) -> DataFrame:
    """One row p50, p95, ...: of the last `window` values, sorted, the one at floor(n * p / 100), counted from 0.

    The window bounds what is sorted in one place; no more than its rows are gathered.
    """
    last = df.where(F.col(value).isNotNull()).orderBy(F.desc(order)).limit(window)
    sorted_ = last.agg(F.array_sort(F.collect_list(value)).alias("x"))
    at = lambda p: F.least(F.floor(F.size("x") * p / 100), F.size("x") - 1).cast("int")
    return sorted_.select(*[F.when(F.size("x") > 0, F.get("x", at(p))).alias(f"p{p}") for p in percents])


def reservoir(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A uniform sample of n rows, the same on every run: the n smallest hashes (a top-n, no full sort)."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


MIB = 1 << 20
# The thresholds, factors and bounds in `autotune`, so that stores tune as users expect them to.


def autotune(stats: dict[str, float], options: dict[str, int]) -> dict[str, int]:
    """New values of memtable_target_bytes, cache_label_advance_bytes and cache_nfa_transition_bytes."""
    out = dict(options)
    memory, writes, latency = options["memtable_target_bytes"], stats.get("writes_per_second", 0.0), stats.get("p99_ms", 0.0)
    if writes > 1000 and latency < 100:
        out["memtable_target_bytes"] = min(int(memory * 1.5), 512 * MIB)
    elif latency > 500 or stats.get("memory_bytes", 0) > 10 << 30:
        out["memtable_target_bytes"] = max(int(memory * 0.8), 16 * MIB)
    elif writes < 10 and memory > 32 * MIB:
        out["memtable_target_bytes"] = int(memory * 0.9)
    labels, hits = options["cache_label_advance_bytes"], stats.get("label_hit_rate", 0.0)
    if hits < 0.7:
        out["cache_label_advance_bytes"] = min(int(labels * 1.3), 64 * MIB)
    elif hits > 0.95:
        out["cache_label_advance_bytes"] = max(int(labels * 0.9), MIB)
    steps, hits, queries = options["cache_nfa_transition_bytes"], stats.get("nfa_hit_rate", 0.0), stats.get("queries_per_second", 0.0)
    if hits < 0.8 and queries > 100:
        out["cache_nfa_transition_bytes"] = min(int(steps * 1.4), 128 * MIB)
    elif hits > 0.98 and queries < 10:
        out["cache_nfa_transition_bytes"] = max(int(steps * 0.85), 2 * MIB)
    return out
