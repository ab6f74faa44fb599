"""Bounded samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.session import small, written

_RANGE = 1 << 40


def draw(key: Column) -> Column:
    """A uniform number in [0, 2^40) that depends on the key alone."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(_RANGE))


def bounded(df: DataFrame, label: str, key: str, per_label: int, rows: int) -> tuple[DataFrame, int]:
    """About `per_label` rows of each label, and `rows` in all: whichever is fewer; the same on every run.

    The rows of a label are those with the smallest draws: a share bound / count of the range, and a
    tenth more. Callers cut to the bound, which is returned, exactly, by the column `_draw`. Every label is
    represented, however many there are.
    """
    known = df.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = written(known.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")), "labels")
    n, size = counts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("_label").cast("string")) + 40), F.lit(0))).first()
    bound = max(1, min(per_label, rows // max(n, 1)))
    share = (F.least(F.lit(1.0), F.lit(1.1 * bound) / F.col("_n")) * _RANGE).cast("long")
    out = known.withColumn("_draw", draw(F.col(key))).join(small(counts, size), F.col(label) == F.col("_label"))
    return out.where(F.col("_draw") < share).drop("_label", "_n"), bound
