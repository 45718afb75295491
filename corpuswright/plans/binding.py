"""The given tables as the library's model tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.quality import measures
from ..session import spread

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread over the cores when the file has too few splits."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def materials(spark: SparkSession, sf_dir: str, heavy: bool = True) -> DataFrame:
    """Documents as materials; tags come from the label row when there is one."""
    docs = documents(spark, sf_dir) if heavy else table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    tags = F.when(
        F.col("quality").isNotNull(),
        F.array(
            F.concat(F.lit("quality_"), F.col("quality").cast("string")),
            F.concat(F.lit("toxic_"), F.col("toxic").cast("string")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    # derived and counted before the join: a query that needs no body shuffles none
    rows = docs.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("https://corpus.example/"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("source_url"),
        F.col("source").alias("source_type"),
        tx.content_hash(F.col("text")).alias("content_hash"),
        tx.first_line(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        F.substring("text", 1, 200).alias("summary"),
        F.col("lang").alias("language"),
        F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{10,}"), F.lit(0))).alias("terms"),
        F.col("source").alias("parent_id"),
        F.col("doc_id").alias("order_index"),
        F.array().cast("array<struct<url:string,alt:string,local_path:string,description:string>>").alias("images"),
        F.array().cast("array<struct<language:string,code:string,comment:string>>").alias("code_blocks"),
        F.array().cast("array<struct<url:string,type:string,title:string>>").alias("references"),
        F.col("n_chars").cast("double").alias("created_at"),
    )
    counts = measures()
    rows = rows.withColumns({n: counts[n] for n in ("content_chars", "term_count")})
    return rows.join(labels, "doc_id", "left").withColumn("tags", tags).drop("doc_id", "quality", "toxic")


#: The same binding for the SQL side.
MATERIALS_SQL = r"""materials AS (
  SELECT d.doc_id::VARCHAR AS id,
         'https://corpus.example/' || d.source || '/' || d.doc_id AS source_url,
         d.source AS source_type, substr(sha256(d.text), 1, 16) AS content_hash,
         substr(split_part(d.text, chr(10), 1), 1, 60) AS title, d.text AS content,
         substr(d.text, 1, 200) AS summary, d.lang AS language,
         CASE WHEN l.quality IS NOT NULL THEN ['quality_' || l.quality, 'toxic_' || l.toxic] ELSE [] END AS tags,
         list_distinct(regexp_extract_all(d.text, '[A-Za-z]{10,}')) AS terms,
         d.source AS parent_id, d.doc_id AS order_index, d.n_chars::DOUBLE AS created_at,
         trim(d.text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS body
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

#: Completeness, score and readiness of every material.
ASSESSED_SQL = (
    MATERIALS_SQL
    + r""",
missing AS (
  SELECT *, trim(title) = '' AS m_title, length(body) < 80 AS m_short,
         len(tags) = 0 AS m_tags, len(terms) = 0 AS m_terms,
         language NOT IN ('', 'zh', 'mixed') AS foreign_lang
  FROM materials),
scored AS (
  SELECT *, greatest(0, least(100, 100 - 5 - 20 * m_title::INT - 35 * m_short::INT - 10 * m_tags::INT
                    - 10 * m_terms::INT - 10 * foreign_lang::INT))::BIGINT AS score
  FROM missing),
assessed AS (
  SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade,
         concat_ws(',', CASE WHEN m_title THEN 'missing_title' END, CASE WHEN m_short THEN 'content_too_short' END,
                   CASE WHEN m_tags THEN 'missing_tags' END, CASE WHEN m_terms THEN 'missing_terms' END) AS missing_fields,
         NOT (m_title OR m_short OR m_tags OR m_terms) AND score >= 60 AS ready
  FROM scored)"""
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time as epoch microseconds beside the timestamp."""
    df = table(spark, sf_dir, "events")
    return df.withColumn("ts_us", F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)"))


def hour(col: str = "ts_us"):
    """Ordered part for time-ordered work: the hour."""
    return F.floor(F.col(col) / 3_600_000_000).cast("long")
