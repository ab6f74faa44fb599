"""The registered queries of the key-log engine and their DuckDB oracles.

`keylog` is a mutation log made from events: the event's number is the sequence number and the clock,
so no query depends on the time of day. `catalog` is a large insert-only set of hierarchical keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import keys as K
from keytide.operators import newest as N
from keytide.operators import search as S
from keytide.operators import stats as A
from keytide.operators import trigrams as G
from keytide.schema import DELETE

Query = Callable[[SparkSession, str], DataFrame]

KEYLOG_SQL = """keylog AS (
  SELECT concat('user:', CAST(user_id AS VARCHAR), ':', CAST(event_id % 4 AS VARCHAR)) AS key,
         CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, CAST(event_id AS BIGINT) AS seq,
         CAST(CASE WHEN event_type = 'view' THEN event_id + 20 * (user_id % 10) + 1 ELSE 0 END AS BIGINT) AS expires_at,
         CAST(event_id % 8 AS INTEGER) AS run_id
  FROM events),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM keylog) WHERE rn = 1),
live AS (SELECT key, seq, expires_at FROM newest WHERE op = 1 AND (expires_at = 0 OR expires_at > (SELECT max(seq) + 1 FROM keylog)))"""
CATALOG_SQL = """catalog AS (
  SELECT concat('customer:', c_mktsegment, ':', CAST(c_custkey AS VARCHAR)) AS key FROM customer UNION ALL
  SELECT concat('part:', p_brand, ':', p_name, ':', CAST(p_partkey AS VARCHAR)) FROM part UNION ALL
  SELECT concat('order:', o_orderstatus, ':', o_orderpriority, ':', CAST(o_orderkey AS VARCHAR)) FROM orders UNION ALL
  SELECT url FROM pages)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keylog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 4).cast("string")).cast("binary").alias("key"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).cast("byte").alias("op"),
        F.col("event_id").cast("long").alias("seq"),
        F.when(F.col("event_type") == "view", F.col("event_id") + 20 * (F.col("user_id") % 10) + 1).otherwise(0).cast("long").alias("expires_at"),
        (F.col("event_id") % 8).cast("int").alias("run_id"),
    )


def log_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keylog(spark, sf_dir).drop("run_id")


def as_of(spark: SparkSession, sf_dir: str) -> int:
    """One past the newest mutation; taken once a query."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1


def catalog_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's keys as inserts that never expire. Keys are unique, so readers may skip newest-wins."""
    c, p, o = (table(spark, sf_dir, n) for n in ("customer", "part", "orders"))
    joined = lambda *x: F.concat_ws(":", *x)
    parts = [
        c.select(joined(F.lit("customer"), "c_mktsegment", F.col("c_custkey").cast("string")).alias("key")),
        p.select(joined(F.lit("part"), "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("key")),
        o.select(joined(F.lit("order"), "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("key")),
        table(spark, sf_dir, "pages").select(F.col("url").alias("key")),
    ]
    keys = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return keys.select(F.col("key").cast("binary").alias("key"), F.lit(1).cast("byte").alias("op"), F.lit(1).cast("long").alias("seq"), F.lit(0).cast("long").alias("expires_at"))


def text(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), *more)


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, ctes: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = (f"WITH {ctes} " if ctes else "") + sql
        return f

    return add


def _register_patterns() -> None:
    """Searches of the catalog's live keys, one for each class of pattern."""
    patterns = {
        "f_regex_broad": (".*", "search"),
        "f_regex_exact": ("^customer:MACHINERY:7$", "search"),
        "f_regex_suffix": (".*:7$", "search"),
        "f_regex_substring": ("URGENT", "search"),
        "f_regex_alternation": ("^(customer|part):.*1", "search"),
        "f_regex_class": ("^order:[FO]:[0-9]-[A-Z]+:[0-9]+$", "search"),
        "f_regex_negated_class": ("^[^:]+:[^0-9]+:[0-9]+$", "search"),
        "f_regex_quantifier": (":[0-9]{2,3}$", "search"),
        "f_regex_optional_group": ("^order:(F:)?.*1(23)?$", "search"),
        "f_regex_case_insensitive": ("(?i)^CUSTOMER:build", "search"),
        "f_regex_posix_class": ("^[[:lower:]]+:[[:upper:]]+:[[:digit:]]+$", "search"),
        "f_regex_full": ("customer:[A-Z]+:[0-9]+", "full"),
        "f_regex_wildcard": ("^part:.*:1.5$", "search"),
    }
    for name, (pattern, match) in patterns.items():
        fn = "regexp_matches" if match == "search" else "regexp_full_match"

        def run(spark: SparkSession, d: str, pattern: str = pattern, match: str = match) -> DataFrame:
            return text(S.regex_search(catalog_log(spark, d), pattern, 0, match=match, unique=True))

        query(name, f"SELECT key FROM catalog WHERE {fn}(key, '{pattern}')", CATALOG_SQL)(run)
    texts = {
        "f_regex_end_anchor_newline": "[a-z]\\.$",
        "f_regex_unicode": "é[a-z]+",
        "f_regex_word_boundary": "\\bthe\\b",
        "f_regex_multiline": "(?m)^[A-Z][a-z]+ the",
        "f_regex_fold_unicode": "(?i)É",
    }
    for name, pattern in texts.items():

        def run_text(spark: SparkSession, d: str, pattern: str = pattern) -> DataFrame:
            docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("key"))
            return S.where_pattern(docs, pattern).select("doc_id")

        query(name, f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{pattern}')")(run_text)


_register_patterns()


@query("s_live_scan", "SELECT key, seq, expires_at FROM live", KEYLOG_SQL)
def s_live_scan(spark: SparkSession, d: str) -> DataFrame:
    return text(N.live(log_only(spark, d), as_of(spark, d)), "seq", "expires_at")


@query("s_point_lookup", "SELECT key, seq FROM live WHERE key = 'user:1:1'", KEYLOG_SQL)
def s_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return text(N.live(log_only(spark, d).where(F.col("key") == F.lit(b"user:1:1")), as_of(spark, d)), "seq")


@query("s_tombstone_scan", "SELECT key, seq FROM keylog WHERE op = 2", KEYLOG_SQL)
def s_tombstone_scan(spark: SparkSession, d: str) -> DataFrame:
    return text(N.tombstones(log_only(spark, d)), "seq")


@query("s_sorted_scan", "SELECT key, CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS rank FROM live ORDER BY key LIMIT 50", KEYLOG_SQL)
def s_sorted_scan(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    first = S.shaped(N.live(log_only(spark, d), as_of(spark, d)), limit=50, order="key")
    return text(first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")).cast("long")), "rank")


@query("f_regex_search", "SELECT key, seq AS id, CAST(1 AS TINYINT) AS op FROM live WHERE regexp_matches(key, '^user:1[0-9]:')", KEYLOG_SQL)
def f_regex_search(spark: SparkSession, d: str) -> DataFrame:
    return text(S.regex_search(log_only(spark, d), "^user:1[0-9]:", as_of(spark, d)), "id", "op")


@query("f_prefix_scan", "SELECT key FROM live WHERE starts_with(key, 'user:1')", KEYLOG_SQL)
def f_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return text(S.prefix_scan(log_only(spark, d), b"user:1", as_of(spark, d)))


@query("f_range_scan", "SELECT key FROM live WHERE key >= 'user:10' AND key < 'user:11'", KEYLOG_SQL)
def f_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return text(S.range_scan(log_only(spark, d), b"user:10", b"user:11", as_of(spark, d)))


@query("f_range_open_end", "SELECT key FROM live WHERE key >= 'user:5'", KEYLOG_SQL)
def f_range_open_end(spark: SparkSession, d: str) -> DataFrame:
    return text(S.range_scan(log_only(spark, d), b"user:5", None, as_of(spark, d)))


@query("f_range_limit_ordered", "SELECT key FROM live WHERE key >= 'user:2' AND key < 'user:5' ORDER BY key LIMIT 10", KEYLOG_SQL)
def f_range_limit_ordered(spark: SparkSession, d: str) -> DataFrame:
    return text(S.range_scan(log_only(spark, d), b"user:2", b"user:5", as_of(spark, d), limit=10, order="key"))


PATTERNS = ["^user:1", ":3$", "^user:[0-9]:", "9"]


@query("f_multi_pattern", "SELECT p.pattern, l.key FROM live l JOIN (VALUES ('^user:1'), (':3$'), ('^user:[0-9]:'), ('9')) p(pattern) ON regexp_matches(l.key, p.pattern)", KEYLOG_SQL)
def f_multi_pattern(spark: SparkSession, d: str) -> DataFrame:
    return text(S.multi_search(log_only(spark, d), PATTERNS, as_of(spark, d)), "pattern")


@query("u_pattern_union_all", "SELECT '^user:1' AS pattern, key FROM live WHERE regexp_matches(key, '^user:1') UNION ALL SELECT ':3$', key FROM live WHERE regexp_matches(key, ':3$')", KEYLOG_SQL)
def u_pattern_union_all(spark: SparkSession, d: str) -> DataFrame:
    return text(S.pattern_union(log_only(spark, d), PATTERNS[:2], as_of(spark, d)), "pattern")


@query("f_mode_count", "SELECT count(*) AS n FROM live WHERE regexp_matches(key, ':2$')", KEYLOG_SQL)
def f_mode_count(spark: SparkSession, d: str) -> DataFrame:
    return S.regex_search(log_only(spark, d), ":2$", as_of(spark, d), mode="count")


@query("f_mode_ids", "SELECT seq AS id FROM live WHERE regexp_matches(key, ':2$')", KEYLOG_SQL)
def f_mode_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.regex_search(log_only(spark, d), ":2$", as_of(spark, d), mode="ids")


@query("f_ttl_visible", "SELECT key, expires_at FROM live WHERE expires_at > 0", KEYLOG_SQL)
def f_ttl_visible(spark: SparkSession, d: str) -> DataFrame:
    return text(N.live(log_only(spark, d), as_of(spark, d)).where("expires_at > 0"), "expires_at")


@query("f_ttl_shadowing", "SELECT key, seq FROM newest WHERE op = 1 AND expires_at <> 0 AND expires_at <= (SELECT max(seq) + 1 FROM keylog)", KEYLOG_SQL)
def f_ttl_shadowing(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose newest row is expired: they stay hidden though older rows of theirs never expire."""
    at = as_of(spark, d)
    return text(N.newest_wins(log_only(spark, d)).where((F.col("op") == 1) & ~N.visible(at)), "seq")


@query("a_newest_wins", "SELECT key, CAST(op AS TINYINT) AS op, seq, expires_at FROM newest", KEYLOG_SQL)
def a_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    return text(N.newest_wins(log_only(spark, d)), "op", "seq", "expires_at")


@query("a_distinct_keys", "SELECT DISTINCT key FROM keylog", KEYLOG_SQL)
def a_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return text(log_only(spark, d).select("key").distinct())


@query("a_count_live", "SELECT count(*) AS n FROM live", KEYLOG_SQL)
def a_count_live(spark: SparkSession, d: str) -> DataFrame:
    return S.shaped(N.live(log_only(spark, d), as_of(spark, d)), mode="count")


RUNS_SQL = "SELECT run_id % 3 AS level, count(DISTINCT run_id) AS segments, sum(length(key)) AS bytes, count(*) AS num_keys, CAST(sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS tombstone_fraction FROM keylog GROUP BY 1"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A table of segments, one for each run of the log."""
    per = keylog(spark, d).groupBy("run_id").agg(F.sum(F.octet_length("key")).alias("bytes"), F.count("*").alias("num_keys"), F.count_if(F.col("op") == DELETE).alias("num_tombstones"), A.least("key").alias("min_key"), A.greatest("key").alias("max_key"))
    return per.withColumn("level", F.col("run_id") % 3)


@query("a_level_stats", f"SELECT level, segments, CAST(bytes AS BIGINT) AS bytes, num_keys FROM ({RUNS_SQL})", KEYLOG_SQL)
def a_level_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.level_stats(runs(spark, d)).drop("tombstone_fraction")


@query("a_tombstone_fraction", f"SELECT level, round(tombstone_fraction, 9) AS tombstone_fraction FROM ({RUNS_SQL})", KEYLOG_SQL)
def a_tombstone_fraction(spark: SparkSession, d: str) -> DataFrame:
    return A.level_stats(runs(spark, d)).select("level", F.round("tombstone_fraction", 9).alias("tombstone_fraction"))


@query("a_min_max_key", "SELECT run_id, min(key) AS min_key, max(key) AS max_key FROM keylog GROUP BY run_id", KEYLOG_SQL)
def a_min_max_key(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select("run_id", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"))


@query(
    "a_percentiles_floor",
    "SELECT x[CAST(floor(len(x) * 50 / 100.0) AS INTEGER) + 1] AS p50, x[CAST(floor(len(x) * 95 / 100.0) AS INTEGER) + 1] AS p95, x[CAST(floor(len(x) * 99 / 100.0) AS INTEGER) + 1] AS p99 FROM (SELECT list(value ORDER BY value) AS x FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY event_id DESC LIMIT 10000))",
)
def a_percentiles_floor(spark: SparkSession, d: str) -> DataFrame:
    return A.floor_percentiles(table(spark, d, "events"), "value", "event_id")


@query("a_rates", "SELECT event_type, round(count(*) / greatest(1.0, CAST(date_sub('second', min(ts), max(ts)) AS DOUBLE)), 9) AS per_second, round(CAST(count(*) FILTER (user_id % 2 = 0) AS DOUBLE) / count(*), 9) AS hit_rate FROM events GROUP BY event_type")
def a_rates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 2 == 0).alias("hits"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("s"))
    return e.select("event_type", F.round(A.rate(F.col("n"), F.col("s")), 9).alias("per_second"), F.round(A.ratio(F.col("hits"), F.col("n")), 9).alias("hit_rate"))


@query("a_trigram_postings", "SELECT substr(key, CAST(i AS INTEGER), 3) AS trigram, count(*) AS n FROM (SELECT DISTINCT key, i, substr(key, CAST(i AS INTEGER), 3) AS t FROM keylog, range(1, 40) r(i) WHERE i <= length(key) - 2) GROUP BY 1", KEYLOG_SQL)
def a_trigram_postings(spark: SparkSession, d: str) -> DataFrame:
    found = G.postings(log_only(spark, d).select("key").distinct())
    return found.select(F.col("trigram").cast("string").alias("trigram"), "n")


_SQL["a_trigram_postings"] = f"WITH {KEYLOG_SQL} SELECT t AS trigram, count(*) AS n FROM (SELECT DISTINCT key, substr(key, CAST(i AS INTEGER), 3) AS t FROM (SELECT DISTINCT key FROM keylog), range(1, 40) r(i) WHERE i <= length(key) - 2) GROUP BY t"


@query("u_merge_runs", "SELECT key, CAST(op AS TINYINT) AS op, seq FROM newest", KEYLOG_SQL)
def u_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    log = keylog(spark, d)
    return text(S.merge_runs([log.where(F.col("run_id") == r).drop("run_id") for r in range(8)]), "op", "seq")


@query("k_vacuum_prefix", "SELECT key, CAST(2 AS TINYINT) AS op, (SELECT max(seq) + 1 FROM keylog) AS seq FROM live WHERE starts_with(key, 'user:2')", KEYLOG_SQL)
def k_vacuum_prefix(spark: SparkSession, d: str) -> DataFrame:
    at = as_of(spark, d)
    return text(S.vacuum_tombstones(log_only(spark, d), b"user:2", at, at), "op", "seq")


@query("k_delete_reinsert", "SELECT n.key, n.seq FROM newest n WHERE n.op = 1 AND EXISTS (SELECT 1 FROM keylog k WHERE k.key = n.key AND k.op = 2)", KEYLOG_SQL)
def k_delete_reinsert(spark: SparkSession, d: str) -> DataFrame:
    """Keys that were deleted once and whose newest row is an insert."""
    log = log_only(spark, d)
    gone = N.tombstones(log).select("key").distinct()
    return text(N.newest_wins(log).where(F.col("op") == 1).join(gone, "key", "left_semi"), "seq")


def _store(spark: SparkSession, d: str, steps: Callable[..., None]) -> DataFrame:
    """A store filled from the log's runs in an order that isn't that of time, after `steps`."""
    store = _opened(spark, background_compaction=False)
    steps(store, keylog(spark, d))
    return store.live(as_of(spark, d))


@query("k_flush_roundtrip", "SELECT key, seq, expires_at FROM live", KEYLOG_SQL)
def k_flush_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    def steps(store: object, log: DataFrame) -> None:
        store.apply(log.drop("run_id"))
        store.flush()

    return text(_store(spark, d, steps), "seq", "expires_at")


@query("k_compact_roundtrip", "SELECT key, seq, expires_at FROM live", KEYLOG_SQL)
def k_compact_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    def steps(store: object, log: DataFrame) -> None:
        middle = as_of(spark, d) // 2
        store.apply(log.where(F.col("seq") < middle).drop("run_id"))
        store.flush()
        store.apply(log.where(F.col("seq") >= middle).drop("run_id"))
        store.flush()
        store.compact(as_of=0)

    return text(_store(spark, d, steps), "seq", "expires_at")


@query("l_limit_ordered", "SELECT key FROM live ORDER BY key LIMIT 7", KEYLOG_SQL)
def l_limit_ordered(spark: SparkSession, d: str) -> DataFrame:
    return text(S.regex_search(log_only(spark, d), ".*", as_of(spark, d), limit=7, order="key"))


@query("l_newest_first", "SELECT key, seq AS id FROM live ORDER BY seq DESC LIMIT 9", KEYLOG_SQL)
def l_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return text(S.regex_search(log_only(spark, d), ".*", as_of(spark, d), limit=9, order="newest"), "id")


@query("x_next_prefix_range", "SELECT key FROM catalog WHERE starts_with(key, 'order:O')", CATALOG_SQL)
def x_next_prefix_range(spark: SparkSession, d: str) -> DataFrame:
    return text(catalog_log(spark, d).where(K.in_range(F.col("key"), b"order:O", K.next_prefix(b"order:O"))))


@query("x_key_parts", "SELECT split_part(key, ':', 2) AS part, count(*) AS n FROM catalog WHERE starts_with(key, 'customer:') GROUP BY 1", CATALOG_SQL)
def x_key_parts(spark: SparkSession, d: str) -> DataFrame:
    keys = S.where_pattern(catalog_log(spark, d), "^customer:")
    return keys.groupBy(K.key_parts(F.col("key"))[1].alias("part")).agg(F.count("*").alias("n"))


@query("x_digest", "SELECT key, sha256(key) AS digest, upper(hex(key)) AS hex FROM live", KEYLOG_SQL)
def x_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = N.live(log_only(spark, d), as_of(spark, d))
    return text(rows.withColumn("digest", K.key_digest(F.col("key"))).withColumn("hex", F.hex("key")), "digest", "hex")


@query("j_anti_tombstones", "SELECT key, seq FROM (SELECT key, max(seq) AS seq FROM keylog WHERE op = 1 GROUP BY key) a WHERE NOT EXISTS (SELECT 1 FROM keylog t WHERE t.key = a.key AND t.op = 2 AND t.seq > a.seq)", KEYLOG_SQL)
def j_anti_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return text(N.anti_tombstones(log_only(spark, d)), "seq")


@query(
    "j_segment_overlap",
    "SELECT a.run_id AS run_a, b.run_id AS run_b FROM (SELECT run_id, min(key) AS lo, max(key) AS hi FROM keylog GROUP BY run_id) a JOIN (SELECT run_id, min(key) AS lo, max(key) AS hi FROM keylog GROUP BY run_id) b ON a.run_id < b.run_id AND a.lo <= b.hi AND a.hi >= b.lo",
    KEYLOG_SQL,
)
def j_segment_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of runs whose key ranges overlap, by the planner's own test over the runs' metadata (one row a run)."""
    from keytide.plans.compaction import touching
    from keytide.sources.manifest import Segment

    meta = [Segment(r.run_id, 0, "", bytes(r.min_key).hex(), bytes(r.max_key).hex(), 0, r.num_keys, 0, 0) for r in runs(spark, d).collect()]
    pairs = [(a.id, b.id) for a in meta for b in touching(meta, bytes.fromhex(a.min_key), bytes.fromhex(a.max_key)) if a.id < b.id]
    return spark.createDataFrame(pairs, "run_a int, run_b int")


@query("t_stream_live", "SELECT key, seq, expires_at FROM live", KEYLOG_SQL)
def t_stream_live(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream, a stateful newest-wins aggregation, and the live view of its last state."""
    import uuid

    from keytide.session import shared_dir
    from keytide.streaming.live import newest_state

    base, name = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", f"live_{uuid.uuid4().hex}"
    keylog(spark, d).drop("run_id").repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(keylog(spark, d).drop("run_id").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    state = newest_state(stream)
    # complete mode writes the state after each batch; the last one is the answer
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")
    run = state.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{base}/state").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return text(spark.read.schema(state.schema).parquet(f"{base}/out").where(N.visible(as_of(spark, d))), "seq", "expires_at")



HALF_SQL = "(SELECT (max(seq) + 1) // 2 FROM keylog)"


def _opened(spark: SparkSession, **options: object) -> object:
    import uuid

    from keytide.session import shared_dir
    from keytide.sources.store import Store

    return Store.open(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", **options)


def _two_runs(spark: SparkSession, d: str, **options: object) -> object:
    """A store with a flushed run of several files and a delta on top of it."""
    store, log, middle = _opened(spark, range_partitions=4, **options), log_only(spark, d), as_of(spark, d) // 2
    store.apply(log.where(F.col("seq") < middle))
    store.flush()
    store.apply(log.where(F.col("seq") >= middle))
    return store


def _register_store_searches() -> None:
    """The same searches on a store, before the delta is flushed and after everything is compacted."""
    searches = {
        "regex": (lambda s, at: s.regex_search("^user:1[0-9]:", as_of=at), "regexp_matches(key, '^user:1[0-9]:')"),
        "suffix": (lambda s, at: s.regex_search(".*:3$", as_of=at), "suffix(key, ':3')"),
        "substring": (lambda s, at: s.regex_search("er:21", as_of=at), "contains(key, 'er:21')"),
        "full": (lambda s, at: s.regex_search("user:[0-9]+:1", match="full", as_of=at), "regexp_full_match(key, 'user:[0-9]+:1')"),
        "prefix": (lambda s, at: s.prefix_scan(b"user:2", as_of=at), "starts_with(key, 'user:2')"),
        "range": (lambda s, at: s.range_scan(b"user:10", b"user:3", as_of=at), "key >= 'user:10' AND key < 'user:3'"),
        "get": (lambda s, at: s.range_scan(b"user:1:1", b"user:1:1\x00", as_of=at), "key = 'user:1:1'"),
    }
    for name, (found, condition) in searches.items():

        def run_delta(spark: SparkSession, d: str, found: Callable = found) -> DataFrame:
            return text(found(_two_runs(spark, d), as_of(spark, d)), "id")

        def run_compacted(spark: SparkSession, d: str, found: Callable = found) -> DataFrame:
            store, at = _two_runs(spark, d), as_of(spark, d)
            store.flush()
            store.compact(as_of=at)
            store.build_trigram_index()
            return text(found(store, at), "id")

        sql = f"SELECT key, seq AS id FROM live WHERE {condition}"
        query(f"k_store_{name}", sql, KEYLOG_SQL)(run_delta)
        query(f"k_store_{name}_compacted", sql, KEYLOG_SQL)(run_compacted)


_register_store_searches()


@query("k_store_multi", "SELECT p.pattern, l.key FROM live l JOIN (VALUES ('^user:1'), (':3$'), ('^user:[0-9]:'), ('9')) p(pattern) ON regexp_matches(l.key, p.pattern)", KEYLOG_SQL)
def k_store_multi(spark: SparkSession, d: str) -> DataFrame:
    return text(_two_runs(spark, d).multi_search(PATTERNS, as_of=as_of(spark, d)), "pattern")


@query("k_ttl", f"SELECT key, seq, expires_at FROM newest WHERE op = 1 AND (expires_at = 0 OR expires_at > {HALF_SQL})", KEYLOG_SQL)
def k_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Expiry as of an earlier time: keys that expire later are still there, though a compaction ran in between."""
    at = as_of(spark, d) // 2
    store = _two_runs(spark, d)
    store.flush()
    store.compact(as_of=at)
    return text(store.live(as_of=at), "seq", "expires_at")


@query("k_readonly", f"SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM keylog WHERE seq < {HALF_SQL}) WHERE r = 1 AND op = 1 AND (expires_at = 0 OR expires_at > {HALF_SQL})", KEYLOG_SQL)
def k_readonly(spark: SparkSession, d: str) -> DataFrame:
    """A reader pinned before the second half came sees none of it, flushed and compacted as it is."""
    from keytide.sources.store import Store

    store, log, middle = _opened(spark), log_only(spark, d), as_of(spark, d) // 2
    store.apply(log.where(F.col("seq") < middle))
    reader = Store.open(spark, store.path, read_only=True)
    store.apply(log.where(F.col("seq") >= middle))
    store.flush()
    store.compact(as_of=0)
    return text(reader.live(as_of=middle), "seq")


@query("k_store_vacuum_prefix", "SELECT key, seq FROM live WHERE NOT starts_with(key, 'user:2')", KEYLOG_SQL)
def k_store_vacuum_prefix(spark: SparkSession, d: str) -> DataFrame:
    at = as_of(spark, d)
    store = _two_runs(spark, d)
    store.vacuum_prefix(b"user:2", as_of=at)
    store.flush()
    store.compact(as_of=at)
    store.vacuum(0)
    return text(store.live(as_of=at), "seq")


@query("k_compaction_scenario", "SELECT o_orderkey % 2 = 0 AS kept_twice, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def k_compaction_scenario(spark: SparkSession, d: str) -> DataFrame:
    """Inserts, then deletes, then overwrites of survivors, a flush after each and a compaction: the survivors are left, no delete is."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("n"))
    key = lambda df: df.select(F.concat(F.lit("key-"), F.col("n").cast("string")).alias("key"))
    store = _opened(spark)
    store.insert_many(key(orders))
    store.flush()
    store.delete_many(key(orders.where("n % 5 = 0")))
    store.flush()
    store.insert_many(key(orders.where("n % 5 <> 0 AND n % 2 = 0")))
    store.flush()
    store.compact()
    n = F.substring(F.col("key").cast("string"), 5, 20).cast("long")
    return store.log_rows().where("op = 1 OR op = 2").groupBy((n % 2 == 0).alias("kept_twice")).agg(F.count("*").alias("n"), F.min(n).alias("low"), F.max(n).alias("high"))


@query("k_stats", "SELECT 0 AS level, count(*) AS num_keys, round(CAST(count(*) FILTER (op = 2) AS DOUBLE) / count(*), 9) AS tombstone_fraction FROM newest", KEYLOG_SQL)
def k_stats(spark: SparkSession, d: str) -> DataFrame:
    store = _opened(spark, range_partitions=3)
    store.apply(log_only(spark, d))
    store.flush()
    return store.stats().select("level", "num_keys", F.round("tombstone_fraction", 9).alias("tombstone_fraction"))


@query("k_quarantine", "SELECT key, max(seq) AS seq FROM keylog WHERE run_id IN (0, 2) GROUP BY key HAVING arg_max(op, seq) = 1", KEYLOG_SQL)
def k_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """One of three deltas is lost; it is quarantined, and the others are read."""
    store, log = _opened(spark), keylog(spark, d)
    for run in (0, 1, 2):
        store.apply(log.where(F.col("run_id") == run).select("key", "op", "seq", F.lit(0).cast("long").alias("expires_at")))
    lost = store.manifest().deltas()[1].path
    store.manifests.fs.delete(store.manifests.path(lost), True)
    if store.quarantine() != [lost]:
        raise AssertionError("the lost delta wasn't found")
    # numbers are those of the store; the log's own come back by the key and the order in the run
    rank = log.where(F.col("run_id").isin(0, 2)).groupBy("key").agg(F.max_by("seq", F.struct(F.col("run_id"), F.col("seq"))).alias("seq"))
    return text(store.live(as_of=0).select("key").join(rank, "key"), "seq")


@query("k_writers", "SELECT key FROM live", KEYLOG_SQL)
def k_writers(spark: SparkSession, d: str) -> DataFrame:
    """Many small batches: the count of deltas triggers flushes, and flushes compactions."""
    store, log = _opened(spark, memtable_max_deltas=2, max_l0=2, background_compaction=True), keylog(spark, d)
    at, parts = as_of(spark, d), 5
    for k in range(parts):
        store.apply(log.where((F.col("seq") >= at * k // parts) & (F.col("seq") < at * (k + 1) // parts)).drop("run_id"))
    return text(store.live(as_of=at))


@query("t_ingest", "SELECT key, seq, expires_at FROM live", KEYLOG_SQL)
def t_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The log streamed into a store, twice: the second time as after a lost checkpoint."""
    import uuid

    from keytide.session import shared_dir
    from keytide.streaming.live import ingest

    base, store = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}", _opened(spark)
    log_only(spark, d).write.parquet(f"{base}/in")
    for checkpoint in ("first", "second"):
        stream = spark.readStream.schema(log_only(spark, d).schema).parquet(f"{base}/in")
        ingest(stream, store, f"{base}/{checkpoint}", "log").awaitTermination()
    return text(store.live(as_of=as_of(spark, d)), "seq", "expires_at")


@query("a_reservoir", "SELECT least(count(*), 100) AS n, least(count(*), 100) AS distinct_keys, CAST(0 AS BIGINT) AS foreign_keys FROM (SELECT DISTINCT key FROM keylog)", KEYLOG_SQL)
def a_reservoir(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 100 keys: as many as asked for, none twice, none that isn't in the log."""
    keys = log_only(spark, d).select("key").distinct()
    sample = A.reservoir(keys, 100, "key")
    known = keys.select("key", F.lit(1).alias("known"))
    return sample.join(known, "key", "left").agg(F.count("*").alias("n"), F.count_distinct("key").alias("distinct_keys"), F.count_if(F.col("known").isNull()).alias("foreign_keys"))


@query("j_postings_intersect", "SELECT run_id FROM (SELECT DISTINCT run_id, substr(key, CAST(i AS INTEGER), 3) AS t FROM keylog, range(1, 40) r(i) WHERE i <= length(key) - 2) WHERE t IN ('r:1', ':11', '11:') GROUP BY run_id HAVING count(*) = 3", KEYLOG_SQL)
def j_postings_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Runs that hold every trigram of a literal."""
    index = G.segment_index(keylog(spark, d).select(F.col("run_id").alias("segment_id"), "key"))
    return G.segments_with(index, (b"r:11:",)).select(F.col("segment_id").alias("run_id"))


@query("x_quote_meta", "SELECT doc_id FROM documents WHERE contains(text, 'e. T')")
def x_quote_meta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("key"))
    return S.where_pattern(docs, K.quote_meta("e. T")).select("doc_id")


@query("x_common_prefix", "SELECT run_id, max(i) AS n FROM (SELECT run_id, min(key) AS lo, max(key) AS hi FROM keylog GROUP BY run_id), range(0, 60) r(i) WHERE i <= length(lo) AND left(lo, CAST(i AS INTEGER)) = left(hi, CAST(i AS INTEGER)) GROUP BY run_id", KEYLOG_SQL)
def x_common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """How much the first and the last key of each run share (one row a run comes to the driver)."""
    rows = [(r.run_id, K.common_prefix_length(bytes(r.min_key), bytes(r.max_key))) for r in runs(spark, d).collect()]
    return spark.createDataFrame(rows, "run_id int, n bigint")


@query("x_expiry", "SELECT concat('customer:', CAST(c_custkey AS VARCHAR)) AS key, CAST(1050 AS BIGINT) AS expires_at FROM customer")
def x_expiry(spark: SparkSession, d: str) -> DataFrame:
    store = _opened(spark)
    store.insert_many(table(spark, d, "customer").select(F.concat_ws(":", F.lit("customer"), F.col("c_custkey").cast("string")).alias("key")), ttl=50, as_of=1000)
    return text(store.live(as_of=1049), "expires_at")


@query("k_verify", "SELECT true AS ok, CAST(4 AS BIGINT) AS n")
def k_verify(spark: SparkSession, d: str) -> DataFrame:
    """Three files of a run and a delta, all as their entries say."""
    store = _opened(spark, range_partitions=3)
    for _ in range(2):
        store.apply(log_only(spark, d))
        if not store.manifest().runs():
            store.flush()
    return store.verify().groupBy("ok").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
