"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Every document starts at rate 1. Among all rates with sum(rate * size) = target in each source, the
ones closest to 1 in relative entropy (for rates bounded by `max_copies`, entropy of the part taken
and of the part left) are exponentially tilted: rate = M e^t / (M - 1 + e^t) with t = lambda * size,
where lambda solves the convex dual of the source's token constraint. Newton's iterations for all
sources run as aggregations over (source, size) counts, to which the documents are reduced once.
Each Newton step is kept inside a bracket of the root, so it can't diverge.

Rates become whole copies by systematic rounding: in a fixed order within a source, a document takes
floor(C) - floor(C - rate) copies, C being a half and the running sum of rates. The running sum is
taken over buckets of one source with at most about `BUCKET` rows each (by size class and hash), and
then within a bucket: no task sees a whole source, nor all copies of one row. Rates are quantised to 2^-40, so sums are exact
and reruns agree.

Targets: sources by code point, null last, weigh as `weights` repeating, and share all tokens;
a target stops at `max_copies` times its source, the excess is shared again by weight. Sources may be as many as documents.

Defined cases: null and empty texts have size 0 and take nothing; null sources are a source;
null and repeated ids count as rows of their own (equal rows may be rounded in either order, which
gives the same rows); an empty table gives an empty result; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.text import count_words
from keytide.session import small, steady, written

BUCKET = 4096
#: Rates are integers of 1 / SCALE.
SCALE = 1 << 40
#: A table of sources or buckets with more rows is shuffled, not broadcast.
FEW = 20_000
ROUNDS = 60
TOLERANCE = 1e-6


def targets(sizes: DataFrame, weights: tuple[float, ...], max_copies: int) -> DataFrame:
    """(_source, source_size, n, largest, target) of a table (_source, _size, n): one row a source.

    The shares that no cap binds are c * weight for one c: the root of the concave sum of min(cap, c * weight)
    less all words. Newton's iteration for it rises from the left and ends at the root: each step sets aside the sources
    that are capped and shares what they leave. A step is an aggregation over the sources, exact in whole words.
    """
    per = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"), F.max("_size").alias("largest"))
    # ranges of sources are numbered on their own, then by the ranges before: no task sees all sources
    per = written(per.repartitionByRange(F.col("_source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix-sources")
    # a row for each shuffle partition
    offsets = per.groupBy("_range").agg(F.count("*").alias("k"))
    offsets = offsets.select(F.col("_range").alias("_of"), (F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("k")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("_source").asc_nulls_last())) - 1 + F.col("offset")
    k = F.pmod(rank, F.lit(len(weights)))
    per = per.join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    per = written(per.withColumn("cap", F.col("source_size") * max_copies).withColumn("ratio", F.col("cap") / F.col("weight")).drop("_range", "_of", "offset"), "mix-weights")
    everything, level = per.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        full = F.col("ratio") <= level
        capped, open_ = per.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        # nothing is left to share: every source is capped
        above = float("inf") if open_ is None else (everything - (capped or 0)) / open_
        if above <= level:
            break
        level = above
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return per.select("_source", "source_size", "n", "largest", target.alias("target"))


def _tilt(x: Column, m: int) -> Column:
    """The rate at exponent x; written so that no exponential overflows."""
    up = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(float(m)) / (1 + (m - 1) * up)).otherwise(m * up / (m - 1 + up))


def rates(sizes: DataFrame, goal: DataFrame, max_copies: int) -> DataFrame:
    """(_source, source_size, target, lambda) after Newton's iterations; lambda is per word."""
    m = max_copies
    fixed = ["_source", "source_size", "target", "n", "largest"]
    mean = F.col("source_size") / F.greatest(F.col("n"), F.lit(1))
    state = goal.select(
        *fixed,
        F.lit(0.0).alias("lambda"),
        F.lit(-1e6).alias("low"),
        F.lit(1e6).alias("high"),
        ((F.col("source_size") == 0) | (F.col("target") >= m * F.col("source_size"))).alias("done"),
    )
    state = written(state.withColumn("unit", F.greatest(mean, F.lit(1.0))), "mix")
    for _ in range(ROUNDS):
        open_ = state.where("not done").select(F.col("_source").alias("_of"), "lambda", "unit")
        number = open_.limit(FEW + 1).count()
        if not number:
            break
        x = F.col("lambda") * F.col("_size") / F.col("unit")
        rate = _tilt(x, m)
        # exact sums: whole multiples of 1 / SCALE, so the order of addition doesn't matter
        whole = lambda c: F.sum(F.round(c * F.lit(float(1 << 20))).cast("decimal(38,0)")).cast("double") / float(1 << 20)
        tokens, size = F.col("_size") * F.col("n"), F.col("_size") / F.col("unit")
        sums = sizes.join(F.broadcast(open_) if number <= FEW else open_, F.col("_source").eqNullSafe(F.col("_of"))).groupBy("_source").agg(whole(tokens * rate).alias("got"), whole(tokens * size * rate * (m - rate) / m).alias("slope"))
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lambda")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lambda")).otherwise(F.col("high"))
        step = F.col("lambda") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        reached = F.abs(gap) <= F.greatest(F.lit(0.5), TOLERANCE * F.col("target"))
        moved = state.alias("s").join(sums.alias("a"), F.col("s._source").eqNullSafe(F.col("a._source")), "left").select(
            *[F.col(f"s.{c}").alias(c) for c in fixed],
            F.when(F.col("got").isNull() | reached, F.col("lambda")).when(inside, step).otherwise((low + high) / 2).alias("lambda"),
            F.when(F.col("got").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("got").isNull(), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | F.coalesce(reached, F.lit(False))).alias("done"),
            "unit",
        )
        state = written(moved, "mix")
    return state.select("_source", "source_size", "target", "unit", "lambda")


def _few(df: DataFrame, most: int = FEW) -> bool:
    """Whether a table of sources is small enough to broadcast."""
    return df.limit(most + 1).count() <= most


def mix(docs: DataFrame, id_col: str, text: str, source: str, *, keep: list[str] | None = None, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and _size, _source_size, _target, _rate, _copies: how often the mix takes each row."""
    docs = steady(docs)
    m = max_copies
    kept = docs.columns if keep is None else keep
    # one pass over the texts leaves a narrow table; whole rows come back only if they are asked for
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), F.col(source).alias("_source"), count_words(text).alias("_size"), F.xxhash64(F.col(id_col).cast("string"), source, text).alias("_hash"))
    # size classes a quarter of a power of two wide
    rows = written(rows.withColumn("_class", F.floor(4 * F.log2(F.col("_size") + 1)).cast("int")), "mix-rows")
    sizes = written(rows.groupBy("_source", "_class", "_size").agg(F.count("*").alias("n")), "mix-sizes")
    solved = rates(sizes, targets(sizes, weights, m), m).withColumnRenamed("_source", "_of")
    # large classes are cut by hash, so that no bucket holds much more than BUCKET rows
    slots = sizes.groupBy(F.col("_source").alias("_of"), F.col("_class").alias("_ofc")).agg(F.ceil(F.sum("n") / BUCKET).alias("_slots"))
    plan = written(slots.alias("s").join(solved.alias("r"), F.col("s._of").eqNullSafe(F.col("r._of"))).select("s.*", "r.source_size", "r.target", "r.unit", "r.lambda"), "mix-plan")
    rows = rows.join(F.broadcast(plan) if _few(plan) else plan, rows["_source"].eqNullSafe(plan["_of"]) & (rows["_class"] == plan["_ofc"]))
    full = F.col("target") >= m * F.col("source_size")
    rate = F.when(F.col("_size") == 0, 0.0).when(full, float(m)).otherwise(_tilt(F.col("lambda") * F.col("_size") / F.col("unit"), m))
    rows = rows.withColumn("_q", F.round(rate * SCALE).cast("long"))
    # equal rows have one hash: where they would overfill a bucket, their row numbers deal them out
    many = written(rows.groupBy(F.col("_hash").alias("_of_hash")).agg(F.count("*").alias("k")).where(F.col("k") > BUCKET).select("_of_hash"), "mix-copies-of-one-row")
    rows = rows.join(F.broadcast(many) if _few(many) else many, rows["_hash"] == many["_of_hash"], "left")
    rows = rows.withColumn("_slot", F.pmod(F.when(F.col("_of_hash").isNotNull(), F.xxhash64("_rid")).otherwise(F.col("_hash")), F.col("_slots"))).drop("_of_hash")
    # what the buckets before a bucket take, modulo a copy
    bucket = ["_source", "_class", "_slot"]
    before = Window.partitionBy("_source").orderBy(F.desc("_class"), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*bucket).agg(F.sum(F.col("_q").cast("decimal(38,0)")).alias("q"))
    start = sums.select(F.col("_source").alias("_of"), F.col("_class").alias("_ofc"), F.col("_slot").alias("_ofs"), F.pmod(F.coalesce(F.sum("q").over(before), F.lit(0)), F.lit(SCALE).cast("decimal(38,0)")).cast("long").alias("_start"))
    start = written(start, "mix-start")
    rows = rows.drop("_of", "_ofc", "_ofs")
    rows = rows.join(F.broadcast(start) if _few(start) else start, rows["_source"].eqNullSafe(start["_of"]) & (rows["_class"] == start["_ofc"]) & (rows["_slot"] == start["_ofs"]))
    inside = Window.partitionBy(*bucket).orderBy(F.desc("_size"), "_hash", "_rid")
    # from half a copy on, largest documents first: what is rounded off stays below half the gaps between sizes
    upto = SCALE // 2 + F.col("_start") + F.sum("_q").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    copies = F.shiftright(upto, 40) - F.shiftright(upto - F.col("_q"), 40)
    out = ["_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), (F.col("_q") / SCALE).alias("_rate"), copies.cast("int").alias("_copies")]
    if set(kept) <= {id_col, source}:
        return rows.select(*[F.col("_id" if c == id_col else "_source").alias(c) for c in kept], *out)
    chosen = written(rows.select("_rid", *out), "mix-copies")
    whole = docs.select(F.monotonically_increasing_id().alias("_rid"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)])
    joined = whole.join(small(chosen, 64 * chosen.count()), "_rid")
    return joined.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *chosen.columns[1:])
