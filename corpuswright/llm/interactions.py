"""Filter interaction audit: what every order of the filters would keep, remove and lose.

Each document becomes one bit mask of the filters it fails, and equal masks of a
part are counted into cells, so whatever the corpus, a part has at most
``2 ** len(letters)`` cells. A recursive query then walks over all filter
prefixes: each level extends a prefix by every unused letter, joins the cells of
its part and carries the bits applied so far; the level's row holds the counts
of that step.

Nulls: a null text is empty, a null part or key ``''`` or without label, a null
id is no copy of anything and smaller than nothing. Equal texts under one id are
not copies of one another (no id is smaller). Labels that repeat an id count
once, the larger value. An empty table has no parts and gives no rows. Texts are
read whole; other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

_SPACE = r"[\x20\x09-\x0D]+"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a whole text that is not null."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def _labelled(labels: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.groupBy(F.col("doc_id").alias("_label_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def failure_cells(
    docs: DataFrame, labels: DataFrame, part: str = "lang", rules: Mapping[str, Column] | None = None, copies: str = "E"
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail.

    ``rules`` maps a letter to its failure condition over the columns of ``docs``
    (default: ``text_rules``); ``copies`` is the letter of the copy filter, which
    a text fails that some smaller id has too. Bit ``i`` of ``mask`` is the
    ``i``-th letter. Texts stay in the scan: only hashes and masks are shuffled,
    and the hash of a text that very many documents share is met together with
    the id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = rules or text_rules(text)
    bits = [F.when(F.coalesce(fails, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(rules.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    narrow = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.struct(F.xxhash64(text).alias("x"), F.substring(F.md5(text), 1, 16).alias("y")).alias("body"),
    )
    known = narrow.join(_labelled(labels), F.col("id") == F.col("_label_id"), "left").select(
        "id", "part", "mask", "body", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    known = materialize(known, "failures")
    first = known.groupBy("body").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copied = F.col("first").isNull() & F.col("id").isNotNull()
    marked = known.join(first, ["body", "id"], "left").withColumn(
        "mask", F.when(copied, F.col("mask").bitwiseOR(F.lit(1 << len(rules)))).otherwise(F.col("mask"))
    )
    if list("".join(rules) + copies) != sorted(set("".join(rules) + copies)):
        raise ValueError("letters must be distinct and in order")
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")]
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *counts)


@contextmanager
def _any_number_of_rows(spark: SparkSession) -> Iterator[None]:
    """Recursion is bounded by the letters; the rows follow the number of parts."""
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, before)


def _total(value: str, condition: str) -> str:
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (s, x) -> s + x.{value})"


_FAILS, _UNSEEN = "x.mask & t.bit <> 0", "x.mask & w.applied = 0"
_WALK = f"""
WITH RECURSIVE walk(part, prefix, applied, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
  UNION ALL
  SELECT w.part, concat(w.prefix, t.letter), w.applied | t.bit, w.step + 1, t.letter,
         {_total("n", "x.mask & (w.applied | t.bit) = 0")},
         {_total("n", f"{_FAILS} AND {_UNSEEN}")},
         {_total("n", f"{_FAILS} AND NOT ({_UNSEEN})")},
         {_total("n", "x.mask = t.bit")},
         {_total("good", f"{_FAILS} AND {_UNSEEN}")},
         {_total("toxic", f"{_FAILS} AND {_UNSEEN}")}
  FROM walk w JOIN {{unused}} t ON t.applied = w.applied JOIN {{cells}} c ON c.part = w.part)
SELECT * FROM walk WHERE step > 0
"""


def prefixes(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Counts of the last step of every filter prefix of every part, by a recursive query.

    The letters a prefix has not used are an equi-join on the bits it has applied.
    """
    spark = cells.sparkSession
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    unused = spark.createDataFrame(
        [(a, x, 1 << i) for a in range(1 << len(letters)) for i, x in enumerate(letters) if not a >> i & 1],
        "applied int, letter string, bit int",
    )
    with _any_number_of_rows(spark):
        return materialize(spark.sql(_WALK, cells=materialize(packed, "cells"), unused=unused), "prefixes")


def audit(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, filter order and step, with the step's counts and its filter's Shapley sum.

    A prefix of ``k`` letters begins ``(len(letters) - k)!`` orders, so the sum
    over all orders needs the prefixes only.
    """
    found = prefixes(cells, letters)
    n = len(letters)
    begun = F.element_at(F.array(*[F.lit(factorial(n - k)) for k in range(1, n + 1)]), F.col("step"))
    shapley = found.groupBy("part", "letter").agg(F.sum(F.col("removed") * begun).alias("shapley"))
    orders = found.where(F.col("step") == n).select(
        "part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")
    )
    orders = orders.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    return (
        orders.join(found.drop("step", "applied"), ["part", "prefix"])
        .join(shapley, ["part", "letter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
