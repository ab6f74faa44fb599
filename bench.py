"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs once to warm up and once for the figure; results go to Spark's noop sink, so the whole plan runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keytide import catalog  # noqa: E402
from keytide.sources.store import Store  # noqa: E402

HEADLINE = ["s_live_scan", "s_point_lookup", "f_regex_search", "f_regex_exact", "f_regex_suffix", "f_regex_class", "f_regex_alternation", "f_prefix_scan", "f_range_scan", "f_multi_pattern", "f_mode_count", "a_newest_wins", "a_level_stats", "a_trigram_postings", "u_merge_runs", "k_vacuum_prefix"]


def drained(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f: object) -> float:
    t = time.perf_counter()
    f()
    return round(time.perf_counter() - t, 3)


def store_figures(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Bulk ingest, flush, compaction and searches of a store that holds every key of the lineitem table."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = line.select(F.concat_ws(":", F.lit("line"), "l_shipdate", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))
    store = Store.open(spark, "file://" + tempfile.mkdtemp(prefix="bench-") + "/store", auto_flush=False)
    out = {"store_ingest": timed(lambda: store.insert_many(keys))}
    out["store_flush"] = timed(store.flush)
    out["store_delete"] = timed(lambda: store.delete_many(keys.where(F.col("key").endswith(":7"))))
    out["store_flush_again"] = timed(store.flush)
    out["store_compact"] = timed(store.compact)
    for name, pattern in (("exact", "^line:1995-01-01 00:00:00:1:1$"), ("prefix", "^line:1995-0.*"), ("suffix", ".*:6$"), ("complex", "^line:199[5-7]-(0[1-6]|12).*:[13]$")):
        run = lambda p=pattern: drained(store.regex_search(p))
        run()
        out[f"store_regex_{name}"] = timed(run)
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    figures = {}
    for name in HEADLINE:
        run = lambda n=name: drained(catalog.queries()[n](spark, sf_dir))
        run()
        figures[name] = timed(run)
    figures |= store_figures(spark, sf_dir)
    print(json.dumps({"metric": "key-log queries and store operations, total", "value": round(sum(figures.values()), 3), "unit": "sec", "queries": figures, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
