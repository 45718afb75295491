"""Repository trees: key-file ranking and catalogue lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.urls import arxiv_id, repo_name
from .ordering import sparse_left_join, top_per_key


def key_file_score(path: Column) -> Column:
    """Points for name, entry or build file, depth and source folder."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    depth = F.size(parts) - 1
    pattern = F.lit(False)
    for p in vocab.KEY_FILE_PATTERNS:
        pattern = pattern | path.rlike("(?i)" + p)
    return (
        F.when(pattern, 10).otherwise(0)
        + F.when(base.isin(*vocab.ENTRY_FILES), 15).when(base.isin(*vocab.BUILD_FILES), 8).otherwise(0)
        + F.when(depth <= 1, 5).when(depth == 2, 2).otherwise(0)
        + F.when(parts[0].isin(*vocab.SOURCE_DIRS), 3).otherwise(0)
    ).cast("long")


def select_key_files(tree: DataFrame) -> DataFrame:
    """Scored candidate files: no binaries, no large files, no skipped folders."""
    ext = F.lower(F.regexp_extract("path", r"[^/.](\.[^./]*)$", 1))
    parts = F.split("path", "/")
    kept = tree.where(
        ~ext.isin(*vocab.BINARY_EXTENSIONS)
        & (F.coalesce("size", F.lit(0)) <= 100_000)
        & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in vocab.SKIP_DIRS]))
    )
    return kept.withColumn("score", key_file_score(F.col("path"))).where("score > 0")


def key_files_topk(tree: DataFrame, k: int = 15) -> DataFrame:
    """Best ``k`` files of every repository."""
    return top_per_key(select_key_files(tree), ["repo"], [F.col("score").desc(), F.col("path")], k, "file_rank")


def attach_catalog(urls: DataFrame, papers: DataFrame, repos: DataFrame) -> DataFrame:
    """Join URLs to known papers by paper id and to known repositories by name."""
    keyed = urls.withColumn("arxiv_id", F.nullif(arxiv_id(F.col("url")), F.lit(""))).withColumn(
        "repo", F.nullif(repo_name(F.col("url")), F.lit(""))
    )
    return sparse_left_join(sparse_left_join(keyed, papers, "arxiv_id", "url"), repos, "repo", "url")
