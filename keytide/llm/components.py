"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of `links` (a, b): comp is the smallest node reachable.

    Each round is written in the shared folder; rounds grow with the logarithm of the paths' lengths.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        next_ = label.join(near, "node", "left").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        root = next_.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        next_ = written(next_.join(root, "comp", "left").select("node", F.least("comp", "root").alias("comp"), "was"), "labels")
        if next_.where("comp <> was").isEmpty():
            return next_.select("node", "comp")
        label = next_.select("node", "comp")
