"""Taking few rows out of a table of long texts without shuffling the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from . import bloom


def body(text: str = "text") -> Column:
    """Hash that names a text (null has one too)."""
    return F.xxhash64(F.col(f"`{text}`"))


def free(name: str, df: DataFrame) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    while name in df.columns:
        name = "_" + name
    return name


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` but the rows whose ``doc_id`` and text hash are in ``bad`` (``doc_id``, ``body``).

    Rows the filter of bad ones does not know pass straight through; the few
    others are joined. Columns of ``docs`` may have any names.
    """
    key, hashed = free("_bad_id", docs), free("_bad_body", docs)
    bad = materialize(bad.select(F.col("doc_id").alias(key), F.col("body").alias(hashed)).distinct(), "bad")
    suspect = bloom.build(bad.select(hashed)).might_contain(body())
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (body() == F.col(hashed))
    return docs.where(~suspect).unionByName(docs.where(suspect).join(bad, same, "left_anti"))


def once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row each of those whose ``doc_id`` and text hash are in ``repeated``."""
    repeated = materialize(repeated.select("doc_id", "body").distinct(), "repeated")
    suspect = bloom.build(repeated.select("body")).might_contain(body())
    place = free("_place", docs)
    first = F.row_number().over(W.partitionBy("doc_id", body()).orderBy(F.lit(0)))
    single = docs.where(suspect).withColumn(place, first).where(F.col(place) == 1).drop(place)
    return docs.where(~suspect).unionByName(single)
