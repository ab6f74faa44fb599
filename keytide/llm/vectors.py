"""What the vector searches share: rows that take part, shards, and rounds of queries of a bounded size.

A search is a stated set of queries against all rows. Rows are dealt to shards once (by id, so all
rows of an id meet), each shard is built into a search structure by a task and written in the shared
folder. The queries are packed into rows of at most `ROUND_BYTES` of vectors, one for each round; a round's row is
broadcast and joined to every shard of its dimension in Spark, so no query passes through the driver's Python, and
the rounds go one after another, so one broadcast is alive at a time. A task sends on its best k a query only.

Vectors that are null, empty or hold null or non-finite components take no part. Of rows with one id
the first vector in order of its components takes part. Vectors of other lengths than a query's
aren't its candidates. Ties go to smaller ids; other columns aren't read; empty tables give empty results.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.session import discard, ship, written

SHARD_ROWS = 16_384
SHARD_BYTES = 16 << 20
ROUND_BYTES = 8 << 20
ROUND_ROWS = 4_096


def taking_part(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x) with x array<double>, of the rows that take part; ids may still repeat."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists(F.col("x"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0").where(~F.coalesce(bad, F.lit(True)))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def sharded(rows: DataFrame, build: Callable[[np.ndarray, np.ndarray], object], name: str) -> DataFrame:
    """(dim, n, built): a row for each shard, with what `build(ids, vectors)` made of it, pickled.

    Shards are classes of ids, so their number follows from the count of rows and no shard is hot.
    """
    ship(rows.sparkSession)
    n, widest = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    per = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(1, widest or 1))))
    shards = max(1, -(-n // per))

    def built(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        ids, x = np.asarray(part["id"], np.int64), matrix(part["x"], dim)
        order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        return pa.table({"dim": pa.array([dim], pa.int32()), "n": pa.array([int(first.sum())], pa.int64()), "built": pa.array([pickle.dumps(build(ids[first], x[first]), protocol=5)], pa.binary())})

    dealt = rows.select(F.size("x").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "x")
    return written(dealt.groupBy("dim", "shard").applyInArrow(built, "dim int, n bigint, built binary"), name)


def rounds(queries: DataFrame) -> DataFrame:
    """(dim, round, ids, vectors): the queries packed, ids in order, one row an id; rounds count from 0 in each dim."""
    one = queries.groupBy("id").agg(F.min(F.struct(F.size("x").alias("dim"), "x")).alias("v")).select("id", "v.dim", "v.x")
    one = written(one, "queries")
    number = one.groupBy("dim").agg(F.count("*").alias("n"))
    per = F.greatest(F.lit(1), F.least(F.lit(ROUND_ROWS), F.floor(F.lit(ROUND_BYTES) / (8 * F.col("dim")))))
    # a round is a class of ids, so it may have a few more queries than `per`
    number = F.broadcast(number.select("dim", F.ceil(F.col("n") / per).alias("rounds")))
    dealt = one.join(number, "dim").select("dim", F.pmod(F.xxhash64("id", F.lit("round")), F.col("rounds")).alias("round"), "id", "x")

    def packed(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        ids, x = np.asarray(part["id"], np.int64), matrix(part["x"], dim)
        order = np.argsort(ids)
        return pa.table({"dim": pa.array([dim], pa.int32()), "round": part["round"][:1].cast(pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([x[order].tobytes()], pa.binary())})

    out = written(dealt.groupBy("dim", "round").applyInArrow(packed, "dim int, round bigint, ids binary, vectors binary"), "rounds")
    discard(one)
    return out


class Best:
    """The k best of each query so far: scores descending, ties to smaller ids."""

    def __init__(self, queries: int, k: int, kind: type = np.float64):
        self.k = k
        #: the score of no candidate
        self.none = np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf
        self.score = np.full((queries, k), self.none, kind)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates `ids` (m) with `score` (len(q), m) for the queries q; an id below a score of the lowest isn't one."""
        if score.shape[1] > 4 * self.k:  # all that tie with the kth stay
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k]
            hit = (score >= np.maximum(kth, self.score[q, -1])[:, None]) & (score > self.none)
            rows = np.flatnonzero(hit.any(axis=1))
            for i in rows.tolist():
                at = np.flatnonzero(hit[i])
                self._put(q[i : i + 1], score[i : i + 1, at], ids[at])
            return
        self._put(q, score, ids)

    def _put(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[q], score], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((i, -s if s.dtype.kind == "f" else ~s), axis=1)[:, : self.k]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        have = self.score > self.none
        q, j = np.nonzero(have)
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(self.id[q, j]), pa.array(self.score[q, j])], ["query_id", "vec_id", "score"])


def searched(shards: DataFrame, queries: DataFrame, search: Callable, k: int, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all shards. `search(ids, vectors, built, best)` offers a shard's candidates.

    A task carries its kth scores from shard to shard.
    """
    dtype = np.int64 if kind == "bigint" else np.float64

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # by dimension; a round has one block of each
        for batch in batches:
            for dim, built, ids, x in zip(batch.column(0).to_pylist(), *(batch.column(c) for c in (1, 2, 3))):
                if dim not in best:
                    own = np.frombuffer(ids.as_buffer(), np.int64).copy()
                    best[dim] = own, np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim).copy(), Best(len(own), k, dtype)
                own, q, kth = best[dim]
                search(own, q, pickle.loads(built.as_buffer()), kth)
        for own, _, kth in best.values():
            yield kth.rows(own)

    schema = f"query_id bigint, vec_id bigint, score {kind}"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = rounds(queries)
    last = asked.agg(F.max("round")).first()[0] or 0
    parts = []
    for r in range(last + 1):
        pairs = shards.join(F.broadcast(asked.where(F.col("round") == r)), "dim").select("dim", "built", "ids", "vectors")
        part = pairs.mapInArrow(found, schema)
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(written(part, "nearest") if last else part)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
