"""Training-data pipeline over ``documents``: quality, near duplicates, repeated passages, benchmark, mix.

Every stage takes what the one before has kept, written as Parquet and read
again. There is no SQL for the whole, because the first stage's verdict comes
from expectation-maximisation; the tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm import decontam, jaccard, mixing, quality, substring
from corpuswright.session import materialize, scratch_path, small_batches

ORACLE_SQL = None


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are likelier good than bad.

    Null and empty texts are rejected; null and repeated ids and extra columns
    of any name stay as they are.
    """
    small_batches(spark)
    own = {c: c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    judged = quality.judge(materialize(quality.measure(plain), "measured")).where("kept")
    return judged.select(*[F.col(f"`{n}`").alias(c) for c, n in own.items()])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; ``n_chars`` follows the text."""
    small_batches(spark)
    cut = substring.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    kind = docs.schema["n_chars"].dataType
    size = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.clean(docs, _read(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
