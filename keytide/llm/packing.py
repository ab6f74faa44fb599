"""Best-fit packing of documents into bins, under conflicts.

A bin of `capacity` words never holds two pieces of one duplicate cluster, nor more than
`max_per_source` pieces of one source. Documents longer than a bin are cut: full pieces fill bins of
their own, the rest is packed like a document. Pieces go largest first to the tightest bin that has
room and no conflict: bins stand in order of their residual and carry bitmaps of their sources and
clusters; the search starts at the smallest sufficient residual and goes on to successors until a
bin is compatible, else a bin is opened. The search has no cut-off.

Shards: documents are dealt by a hash of id, text and row number (so that repeated rows spread too)
to about `shard` rows each, a number that follows from the table's count; each shard is packed by itself in a task (ids, sizes, source and
cluster codes only, never texts). A hot source is thus spread over all shards.

Defined cases: null and empty texts have size 0 and one piece of size 0, which is packed with the same
conflicts; a null source is a source; null clusters never conflict; repeated rows are packed each by
itself and conflict as one cluster; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.text import count_words
from keytide.session import ship

CAPACITY = 2048
SHARD = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, max_per_source: int = 2) -> tuple[list[int], int]:
    """The bin of each piece, in the order given, and the number of bins. A cluster below 0 has no conflicts."""
    residuals: list[tuple[int, int]] = []  # (residual, bin), in order
    held: list[list[int]] = []  # of each bin: max_per_source bitmaps of sources, then one of clusters
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        src, dup = 1 << source, (1 << cluster) if cluster >= 0 else 0
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals):
            own = held[residuals[at][1]]
            # the last bitmap has the sources of which the bin holds its most
            if not (own[max_per_source - 1] & src or own[-1] & dup):
                break
            at += 1
        if at < len(residuals):
            residual, b = residuals.pop(at)
        else:
            residual, b = capacity, len(held)
            held.append([0] * (max_per_source + 1))
        own = held[b]
        for k in range(max_per_source):
            if not own[k] & src:
                own[k] |= src
                break
        own[-1] |= dup
        insort(residuals, (residual - size, b))
        out.append(b)
    return out, len(held)


def _packed(pdf: pd.DataFrame, capacity: int, max_per_source: int) -> pd.DataFrame:
    shard = int(pdf["_shard"].iloc[0])
    pdf = pdf.sort_values(["_size", "_hash", "_cluster"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    whole, rest = pdf["_size"] // capacity, pdf["_size"] % capacity
    # the rests, and documents of size 0, in descending order
    small = pdf[(rest > 0) | (pdf["_size"] == 0)].assign(_rest=rest).sort_values("_rest", ascending=False, kind="stable")
    cluster = pd.factorize(small["_cluster"])[0]
    source = pd.factorize(small["_source"], use_na_sentinel=False)[0]
    bins, n = best_fit(small["_rest"].tolist(), source.tolist(), cluster.tolist(), capacity, max_per_source)
    tails = pd.DataFrame({"id": small["id"], "piece": whole[small.index], "n_words": small["_rest"], "bin": bins})
    full = pdf.loc[pdf.index.repeat(whole)]
    heads = pd.DataFrame({"id": full["id"], "piece": full.groupby(level=0).cumcount(), "n_words": capacity, "bin": range(n, n + len(full))})
    out = pd.concat([tails, heads], ignore_index=True)
    out["bin_id"] = (shard << 32) + out.pop("bin").astype("int64")
    return out


def pack(docs: DataFrame, id_col: str, text: str, source: str, *, cluster: str | None = None, capacity: int = CAPACITY, max_per_source: int = 2, shard: int = SHARD) -> DataFrame:
    """(id, piece, n_words, bin_id) of every piece of every document.

    `cluster` names a column of duplicate clusters; without one, texts that are equal but for the
    case of A-Z are a cluster.
    """
    spark = docs.sparkSession
    ship(spark)
    same = F.xxhash64(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        count_words(text).alias("_size"),
        F.xxhash64(F.col(source).cast("string")).alias("_source_hash"),
        F.col(source).isNull().alias("_no_source"),
        (F.when(F.col(text).isNotNull(), same) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(F.col(cluster).cast("string")))).alias("_cluster"),
        F.xxhash64(F.col(id_col).cast("string"), text, F.lit("pack")).alias("_hash"),
    ).withColumn("_source", F.when(~F.col("_no_source"), F.col("_source_hash"))).drop("_source_hash", "_no_source")
    n = max(1, -(-docs.count() // shard))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_hash", F.monotonically_increasing_id()), F.lit(n)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return _packed(pdf, capacity, max_per_source)

    return rows.groupBy("_shard").applyInPandas(packed, f"id {kind}, piece bigint, n_words bigint, bin_id bigint").withColumnRenamed("id", id_col)
