"""The trigram index: which segments hold which three-byte substrings, to prune by required literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.functions.keys import trigrams


def postings(keys: DataFrame) -> DataFrame:
    """(trigram, n): in how many rows of `key` each trigram occurs. Counted before and after the exchange."""
    return keys.select(F.explode(trigrams(F.col("key"))).alias("trigram")).groupBy("trigram").agg(F.count("*").alias("n"))


def segment_index(keys: DataFrame) -> DataFrame:
    """(segment_id, trigram), distinct, of rows (segment_id, key)."""
    return keys.select("segment_id", F.explode(trigrams(F.col("key"))).alias("trigram")).distinct()


def segments_with(index: DataFrame, literals: tuple[bytes, ...]) -> DataFrame:
    """(segment_id) of the segments that hold every trigram of the literals."""
    wanted = sorted({x[i : i + 3] for x in literals for i in range(len(x) - 2)})
    if not wanted:
        return index.select("segment_id").distinct()
    return index.where(F.col("trigram").isin(wanted)).groupBy("segment_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("segment_id")
