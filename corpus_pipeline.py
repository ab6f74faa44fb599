"""A corpus pipeline of the operators in keytide.llm: each stage works on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm.line_dedup import dedup_lines
from keytide.llm.mixing import mix
from keytide.llm.packing import pack
from keytide.llm.shingle_join import linked
from keytide.llm.text import crc_mod
from keytide.llm.toxicity import fit, score
from keytide.session import small, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document this likely to be toxic is rejected.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the labels of one fold in four stay unseen, as in the operator's own query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 4) != 2)
    model = fit(docs, labels, "doc_id", "text", "toxic")
    return score(docs, "doc_id", "text", model, keep=COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from later documents; a document of which nothing is left goes."""
    out = dedup_lines(docs, "doc_id", "text", keep=COLUMNS)
    emptied = (F.col("_n_removed") > 0) & (F.trim(F.translate("_text", "\n\t\r", "   ")) == "")
    changed = F.col("_n_removed") > 0
    return out.where(~emptied).select("doc_id", F.col("_text").alias("text"), "lang", "source", F.when(changed, F.length("_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, the one with the smallest id stays."""
    stay = written(linked(docs, "doc_id", "text", width=5, percent=80).where(F.col("_rid") == F.col("rep")).select("_rid"), "representatives")
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), *COLUMNS)
    return rows.join(small(stay, 32 * stay.count()), "_rid").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    out = mix(docs, "doc_id", "text", "source", keep=COLUMNS)
    return out.where(F.col("_copies") > 0).withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; copies of a document are a duplicate cluster, so no bin holds two."""
    return pack(docs, "doc_id", "text", "source", capacity=2048)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Held-out learning, alignment and iterative solving have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
