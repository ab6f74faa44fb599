"""Helpers around the SparkSession that every part of the library shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Where the tables of `written` are, as long as somebody holds them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Rows of an Arrow batch, where the session keeps Spark's own 10000: texts of a few kilobytes make batches of megabytes.
ARROW_ROWS = 2_000
#: Bytes of an Arrow batch on its way to Python, where none are set: executors hold batches outside the heap, twice while
#: they grow, and keep what the largest took.
ARROW_BYTES = 4 << 20
#: Parquet's vectored reads are switched off where they aren't set: on local files each reading thread keeps a copy of the
#: largest column chunk outside the heap.
VECTORED = "parquet.hadoop.vectored.io.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Where it is unset, a local session (tests, a laptop) gets a temporary folder of its own and any
    other the warehouse, which executors share too; the choice is kept in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.keytide.sharedDir", None)
    if not base:
        one_machine = re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master)
        base = "file://" + tempfile.mkdtemp(prefix="keytide-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir')}/keytide"
        spark.conf.set("spark.keytide.sharedDir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again.

    This cuts the lineage in a way that survives lost executors, and pins rows whose order or
    partition could differ between two evaluations.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keytide-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` returned, once nothing that is still to run reads them."""
    for t in tables:
        if path := _paths.pop(t, None) if t is not None else None:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def steady(df: DataFrame) -> DataFrame:
    """`df` if it only selects from files, so that every read numbers its rows alike; else `df` written first."""
    pin_splits(df.sparkSession)
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation") or not node.deterministic():
            return written(df, "input")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return df


def pin_splits(spark: SparkSession) -> None:
    """Fixes how tables are cut into read tasks for the rest of the session.

    Otherwise the cut follows the number of cores, which changes as executors come and go, and row numbers
    that two jobs give to the same table would differ.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor (once per application)."""
    pin_splits(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if spark.conf.get(VECTORED, None) is None and spark.sparkContext._jsc.hadoopConfiguration().get(VECTORED) is None:
        spark.conf.set(VECTORED, "false")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="keytide-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


#: Tables of more estimated bytes are shuffled, not broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, estimated_bytes: int) -> DataFrame:
    """`df`, marked for broadcast if its measured size allows it; otherwise the join shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes <= BROADCAST_BYTES else df
