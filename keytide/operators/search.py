"""Searches over the live set: patterns, prefixes, ranges, several patterns, modes and limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.keys import in_range, next_prefix
from keytide.operators.newest import live, newest_wins
from keytide.plans.pattern import Analysis, analyze
from keytide.schema import DELETE


def key_condition(analysis: Analysis, key: Column) -> Column | None:
    """The part of a pattern that is a comparison of keys and reaches Parquet's statistics."""
    if analysis.exact is not None:
        return key == F.lit(analysis.exact)
    out = None
    for low, high in analysis.ranges():
        part = in_range(key, low, high)
        out = part if out is None else out | part
    return out


def matches(pattern: str, key: Column, match: str = "search") -> Column | None:
    """The whole condition in the JVM; None if every key matches."""
    analysis = analyze(pattern, match)
    if analysis.broad:
        return None
    pruned = key_condition(analysis, key)
    if analysis.exact is not None or (pruned is not None and analysis.prefix_is_enough):
        return pruned
    if analysis.contains is not None:
        return F.contains(key, F.lit(analysis.contains))
    if analysis.suffix is not None:
        return F.endswith(key, F.lit(analysis.suffix))
    found = key.cast("string").rlike(analysis.java)
    return found if pruned is None else pruned & found


def _linear(df: DataFrame, pattern: str) -> DataFrame:
    """Filters by a linear-time matcher on Arrow batches, for patterns on which backtracking may explode."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index("key"))
            try:
                text = keys.cast(pa.large_string())
            except pa.ArrowInvalid:  # bytes that aren't UTF-8 are U+FFFD, as in the JVM
                text = pa.array([k if k is None else k.decode(errors="replace") for k in keys.to_pylist()], pa.large_string())
            yield b.filter(pc.match_substring_regex(text, pattern))

    return df.mapInArrow(kept, df.schema)


def where_pattern(df: DataFrame, pattern: str, match: str = "search") -> DataFrame:
    """The rows whose binary `key` matches an RE2 pattern."""
    analysis = analyze(pattern, match)
    if analysis.risky:
        pruned = key_condition(analysis, F.col("key"))
        return _linear(df if pruned is None else df.where(pruned), pattern if match == "search" else f"\\A(?:{pattern})\\z")
    condition = matches(pattern, F.col("key"), match)
    return df if condition is None else df.where(condition)


def shaped(rows: DataFrame, mode: str = "strings", limit: int = 0, order: str | None = None) -> DataFrame:
    """strings: (id, key, op); ids: (id); count: (n). The limit stands above the newest-wins decision."""
    if mode not in ("strings", "ids", "count") or order not in (None, "key", "newest") or limit < 0:
        raise ValueError("mode is strings, ids or count; order is None, 'key' or 'newest'; limit is 0 or more")
    if order:
        rows = rows.orderBy("key") if order == "key" else rows.orderBy(F.desc("seq"))
    if limit:
        rows = rows.limit(limit)
    if mode == "count":
        return rows.agg(F.count("*").alias("n"))
    rows = rows.withColumn("id", F.col("seq"))
    return rows.select("id") if mode == "ids" else rows.select("id", "key", "op")


def regex_search(log: DataFrame, pattern: str, as_of: Column | int, *, match: str = "search", mode: str = "strings", limit: int = 0, order: str | None = None, unique: bool = False) -> DataFrame:
    """Live keys that match. The condition is on the key alone, so it is applied below the newest-wins exchange."""
    return shaped(live(where_pattern(log, pattern, match), as_of, unique), mode, limit, order)


def prefix_scan(log: DataFrame, prefix: bytes, as_of: Column | int, *, unique: bool = False, **shape: object) -> DataFrame:
    return range_scan(log, prefix, next_prefix(prefix), as_of, unique=unique, **shape)


def range_scan(log: DataFrame, start: bytes | None, end: bytes | None, as_of: Column | int, *, unique: bool = False, **shape: object) -> DataFrame:
    """Live keys in [start, end); an empty or missing bound is open."""
    return shaped(live(log.where(in_range(F.col("key"), start or None, end or None)), as_of, unique), **shape)


def multi_search(log: DataFrame, patterns: list[str], as_of: Column | int, *, match: str = "search", unique: bool = False) -> DataFrame:
    """(pattern, id, key): a row for each pattern that a live key matches.

    The log is scanned and deduplicated once, below it only keys that some pattern wants; then
    each key is tested against the patterns in one projection, without a join.
    """
    conditions = [matches(p, F.col("key"), match) for p in patterns]
    if not patterns:
        return live(log.where("false"), as_of).select(F.lit("").alias("pattern"), F.col("seq").alias("id"), "key")
    if any(analyze(p, match).risky for p in patterns):
        return _union([regex_search(log, p, as_of, match=match, unique=unique).select(F.lit(p).alias("pattern"), "id", "key") for p in patterns])
    rows = log
    if all(c is not None for c in conditions):
        wanted = conditions[0]
        for c in conditions[1:]:
            wanted = wanted | c
        rows = log.where(wanted)
    hits = F.array(*[F.when(F.lit(True) if c is None else c, F.lit(p)) for p, c in zip(patterns, conditions)])
    return live(rows, as_of, unique).select(F.explode(F.array_compact(hits)).alias("pattern"), F.col("seq").alias("id"), "key")


def pattern_union(log: DataFrame, patterns: list[str], as_of: Column | int) -> DataFrame:
    """UNION ALL of one search for each pattern."""
    return _union([regex_search(log, p, as_of).select(F.lit(p).alias("pattern"), "key") for p in patterns])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """The newest row of each key over several runs, deletes included: what compaction keeps before collecting garbage."""
    return newest_wins(_union(runs))


def vacuum_tombstones(log: DataFrame, prefix: bytes, as_of: Column | int, seq: Column | int) -> DataFrame:
    """A delete for each live key with the prefix."""
    high = next_prefix(prefix)
    rows = live(log.where(in_range(F.col("key"), prefix or None, high)), as_of)
    return rows.select("key", F.lit(DELETE).cast("byte").alias("op"), (F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("seq"), F.lit(0).cast("long").alias("expires_at"))


