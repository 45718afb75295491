"""Configuration sources: the registry, curricula and the category list."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_REGISTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "config", "registry.json")
REGISTRY_SCHEMA = "ord long, name string, url string, type string, language string, keywords array<string>"
TOPIC_FIELDS = (
    "struct<name:string,status:string,difficulty:string,description:string,search_queries:array<string>,"
    "known_sources:array<struct<name:string,url:string,type:string>>,"
    "discovered_sources:array<struct<url:string,type:string,title:string>>>"
)
CURRICULUM_SCHEMA = (
    "goal string, depth string, status string,"
    f" domains array<struct<name:string,priority:int,description:string,topics:array<{TOPIC_FIELDS}>>>"
)


def load_config(path: str) -> dict:
    """A JSON or YAML settings file; a missing or unreadable one is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                return yaml.safe_load(f) or {}
            return json.load(f)
    except (OSError, ValueError, ImportError):
        return {}


def registry_rows(path: str = DEFAULT_REGISTRY) -> list[dict]:
    return load_config(path).get("sources", [])


def read_registry(spark: SparkSession, path: str = DEFAULT_REGISTRY) -> DataFrame:
    """Curated sources with their keywords; type defaults to ``doc``."""
    rows = [
        (i, r["name"], r["url"], r.get("type", "doc"), r.get("language", ""), list(r.get("keywords", [])))
        for i, r in enumerate(registry_rows(path))
    ]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def read_curriculum(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Topics of curriculum documents (JSON), one row each, defaults filled in."""
    docs = spark.read.schema(CURRICULUM_SCHEMA).json(path, multiLine=multi_line)
    return flatten_topics(docs)


def flatten_topics(docs: DataFrame) -> DataFrame:
    """Domains and topics of nested curricula as rows."""
    domains = docs.select("goal", F.posexplode_outer("domains").alias("domain_pos", "d"))
    topics = domains.select("goal", "domain_pos", "d", F.posexplode_outer("d.topics").alias("topic_pos", "t"))

    def default(col: str, value):
        return F.coalesce(col, F.lit(value) if not isinstance(value, list) else F.array()).alias(col.split(".")[-1])

    return topics.select(
        "goal",
        F.col("domain_pos").cast("long").alias("domain_pos"),
        F.col("d.name").alias("domain"),
        F.coalesce("d.priority", F.lit(99)).cast("long").alias("priority"),
        F.col("topic_pos").cast("long").alias("topic_pos"),
        F.trim(F.coalesce("t.name", F.lit(""))).alias("topic"),
        default("t.status", "pending"),
        default("t.difficulty", "intermediate"),
        default("t.description", ""),
        default("t.search_queries", []),
        default("t.known_sources", []),
        default("t.discovered_sources", []),
    )
