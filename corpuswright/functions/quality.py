"""Completeness, score, grade and readiness of a material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from .text import is_blank, strip


def _count(col: Column) -> Column:
    return F.greatest(F.coalesce(F.size(col), F.lit(0)), F.lit(0)).cast("long")


def measures() -> dict[str, Column]:
    """The counts the rules rest on. Narrow, so text need not travel further."""
    return {
        "content_chars": F.length(strip(F.coalesce(F.col("content"), F.lit("")))).cast("long"),
        "tag_count": _count(F.col("tags")),
        "term_count": _count(F.col("terms")),
        "reference_count": _count(F.col("references")),
        "image_count": _count(F.col("images")),
        "code_block_count": _count(F.col("code_blocks")),
    }


def measure(df: DataFrame) -> DataFrame:
    """Add the counts a table does not carry yet."""
    return df.withColumns({name: col for name, col in measures().items() if name not in df.columns})


def missing_fields() -> Column:
    return F.array_compact(
        F.array(
            F.when(is_blank(F.col("title")), F.lit("missing_title")),
            F.when(F.col("content_chars") < vocab.MIN_CONTENT_CHARS, F.lit("content_too_short")),
            F.when(F.col("tag_count") == 0, F.lit("missing_tags")),
            F.when(F.col("term_count") == 0, F.lit("missing_terms")),
        )
    )


def completeness(df: DataFrame) -> DataFrame:
    """Missing fields and the six counts of every material."""
    return measure(df).withColumn("missing_fields", missing_fields()).withColumn(
        "is_complete", F.size("missing_fields") == 0
    )


def grade(score: Column) -> Column:
    return (
        F.when(score >= vocab.GRADE_A, "A")
        .when(score >= vocab.GRADE_B, "B")
        .when(score >= vocab.GRADE_C, "C")
        .otherwise("D")
    )


def quality_score(df: DataFrame) -> DataFrame:
    """Score 0..100, grade and flags; needs ``missing_fields``."""
    missing = F.col("missing_fields")
    no_refs = F.col("reference_count") == 0
    foreign = ~F.coalesce(F.col("language"), F.lit("")).isin(*vocab.ACCEPTED_LANGUAGES)

    def lost(test: Column, points: int) -> Column:
        return F.when(test, points).otherwise(0)

    raw = (
        F.lit(100)
        - lost(F.array_contains(missing, "missing_title"), vocab.PENALTY_TITLE)
        - lost(F.array_contains(missing, "content_too_short"), vocab.PENALTY_SHORT)
        - lost(F.array_contains(missing, "missing_tags"), vocab.PENALTY_TAGS)
        - lost(F.array_contains(missing, "missing_terms"), vocab.PENALTY_TERMS)
        - lost(no_refs, vocab.PENALTY_REFERENCES)
        - lost(foreign, vocab.PENALTY_LANGUAGE)
    )
    extra = F.array_compact(
        F.array(
            F.when(no_refs, F.lit("missing_references")),
            F.when(F.col("image_count") == 0, F.lit("no_images")),
            F.when(F.col("code_block_count") == 0, F.lit("no_code_blocks")),
            F.when(foreign, F.lit("non_chinese_content")),
        )
    )
    return df.withColumns(
        {"score": F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long"), "flags": F.concat(missing, extra)}
    ).withColumn("grade", grade(F.col("score")))


def readiness(df: DataFrame, min_score: int = vocab.READY_SCORE) -> DataFrame:
    """Reasons against publishing; ready when there is none."""
    low = F.when(F.col("score") < min_score, F.lit("quality_score_below_threshold"))
    return df.withColumn(
        "reasons", F.concat(F.col("missing_fields"), F.array_compact(F.array(low)))
    ).withColumn("ready", F.size("reasons") == 0)


def assess(df: DataFrame, min_score: int = vocab.READY_SCORE) -> DataFrame:
    """Completeness, score and readiness in one projection chain."""
    return readiness(quality_score(completeness(df)), min_score)
