"""Newest-wins: the state of each key is its mutation with the largest sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.schema import DELETE, INSERT


def newest_wins(log: DataFrame) -> DataFrame:
    """One row a key. Filters on the key pass below this operator; filters on op or expiry must stay above it.

    The window's row_number = 1 gives a WindowGroupLimit before and after the one exchange on the key,
    so a key with very many mutations shrinks to one row a task before it is shuffled. Equal sequence numbers
    (a log stamped elsewhere) are settled towards deletes, then towards later expiry, so reruns agree.
    """
    order = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("op"), F.desc("expires_at"))
    return log.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def visible(as_of: Column | int) -> Column:
    """Inserted, and not expired: only for rows that are already the newest of their key."""
    return (F.col("op") == INSERT) & ((F.col("expires_at") == 0) | (F.col("expires_at") > (as_of if isinstance(as_of, Column) else F.lit(as_of))))


def live(log: DataFrame, as_of: Column | int, unique: bool = False) -> DataFrame:
    """The live keys. unique: the log is known to hold one row a key, so nothing is shuffled."""
    return (log if unique else newest_wins(log)).where(visible(as_of))


def tombstones(log: DataFrame) -> DataFrame:
    return log.where(F.col("op") == DELETE)


def anti_tombstones(log: DataFrame) -> DataFrame:
    """Inserts that no later delete of their key shadows: the live set as a join, a cross-check of `live` without expiry."""
    last = log.where(F.col("op") == INSERT).groupBy("key").agg(F.max("seq").alias("seq"))
    gone = tombstones(log).groupBy(F.col("key").alias("k")).agg(F.max("seq").alias("s"))
    return last.join(gone, (F.col("key") == F.col("k")) & (F.col("s") > F.col("seq")), "left_anti")
