"""The subpackage's registered queries, one for each operator, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm.text import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    fold = crc_mod("doc_id", 3)
    model = fit(docs.where(fold != 1), "doc_id", "text", "lang")
    return predict(docs, "doc_id", "text", model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", "source", capacity=2048)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", keep=["doc_id", "source"])
    taken = (F.col("_copies") * F.col("_size")).cast("long").alias("taken")
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken, "source", F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.toxicity import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_mod("doc_id", 4)
    model = fit(docs, labels.where(fold != 2), "doc_id", "text", "toxic")
    return score(docs, "doc_id", "text", model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from keytide.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.exact_topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0, k=5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.shingle_join import linked

    out = linked(table(spark, sf_dir, "documents"), "doc_id", "text", width=5, percent=80)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0, k=5)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["doc_id"])
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keytide.llm.substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), "doc_id", "text", width=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP7_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (
  SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

OP10_SQL = f"""
WITH w AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), rep AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (h)
), word AS (
  SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_packing, op3_mixing, op4_toxicity, op5_token_counts, op6_exact_topk, op7_shingle_join, op8_nearest, op9_line_dedup, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": OP6_SQL, "op7_shingle_join": OP7_SQL, "op10_substring_dedup": OP10_SQL}
