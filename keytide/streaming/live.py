"""Streaming ingest into a store, and the live view as a stateful aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keytide.operators.newest import visible
from keytide.sources.store import Store


def ingest(log: DataFrame, store: Store, checkpoint: str, name: str, **trigger: object) -> StreamingQuery:
    """Appends a stream of rows (key, op, seq, expires_at) to a store.

    Each micro-batch is one commit that also moves the stream's mark (its name and the batch's number), so a batch
    that is replayed after a failure, however late, changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        store.apply(df, mark=(name, number))

    writer = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def newest_state(log: DataFrame) -> DataFrame:
    """(key, op, seq, expires_at) of the newest mutation of each key, as a streaming aggregation for update or complete mode.

    Recency is the sequence number, not arrival, so late rows need no watermark.
    """
    best = F.max(F.struct("seq", "op", "expires_at")).alias("s")
    return log.groupBy("key").agg(best).select("key", "s.op", "s.seq", "s.expires_at")


def live_view(log: DataFrame, as_of: Column | int) -> DataFrame:
    return newest_state(log).where(visible(as_of))
