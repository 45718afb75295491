"""Chunking of long texts, as folds over the paragraphs of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside a fold."""
    return F.transform(F.array(value), body)[0]


def overlap_chunks(text: Column, size: int = 6000, overlap: int = 500) -> Column:
    """Greedy paragraph chunks; a new one starts with whole trailing paragraphs.

    Each paragraph counts two characters more than its length. A text within
    ``size`` is one chunk, and a paragraph longer than a chunk stays whole.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n\\s*\n"), tx.strip), lambda p: p != "")
    # the fold carries paragraph numbers only; texts are joined once, at the end
    def fold(ps: Column) -> Column:
        cuts = F.array().cast("array<struct<a:int,b:int>>")
        state = F.struct(cuts.alias("out"), F.lit(0).alias("a"), F.lit(0).alias("n"))

        def cost(i: Column) -> Column:
            return F.length(ps[i]) + 2

        def tail(a: Column, i: Column) -> Column:
            """First paragraph of the overlap ahead of ``i``, and its characters."""
            return F.aggregate(
                F.reverse(F.sequence(a, i - 1)),
                F.struct(i.alias("a"), F.lit(0).alias("n")),
                lambda t, j: F.when((t["a"] < i) & (t["n"] >= overlap), t).otherwise(
                    F.struct(j.alias("a"), (t["n"] + cost(j)).alias("n"))
                ),
            )

        def step(acc: Column, i: Column) -> Column:
            full = (i > acc["a"]) & (acc["n"] + cost(i) > size)
            fresh = bind(
                tail(acc["a"], i),
                lambda t: F.struct(
                    F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), i.alias("b")))).alias("out"),
                    t["a"].alias("a"),
                    (t["n"] + cost(i)).alias("n"),
                ),
            )
            more = F.struct(acc["out"].alias("out"), acc["a"].alias("a"), (acc["n"] + cost(i)).alias("n"))
            return F.when(full, fresh).otherwise(more)

        def finish(acc: Column) -> Column:
            last = F.struct(acc["a"].alias("a"), F.size(ps).alias("b"))
            return F.transform(
                F.concat(acc["out"], F.array(last)), lambda c: F.concat_ws("\n\n", F.slice(ps, c["a"] + 1, c["b"] - c["a"]))
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(ps) - 1), state, step, finish)

    chunks = bind(paragraphs, fold)
    return F.when((F.length(text) <= size) | (F.size(paragraphs) == 0), F.array(text)).otherwise(chunks)


def segments(text: Column, max_len: int = 1200) -> Column:
    """Paragraphs packed up to ``max_len``, trimmed; a blank tail is dropped."""
    state = F.struct(_none().alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > max_len) & (acc["cur"] != "")
        joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(tx.strip(acc["cur"])))).otherwise(acc["out"]).alias("out"),
            F.when(full, p).otherwise(joined).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        last = tx.strip(acc["cur"])
        return F.when(last != "", F.concat(acc["out"], F.array(last))).otherwise(acc["out"])

    return F.aggregate(F.split(text, "\n\n"), state, step, finish)


def chunk_rows(df: DataFrame, key: str, text: str, size: int = 6000, overlap: int = 500) -> DataFrame:
    """One row per chunk, numbered from 0."""
    return df.select(key, F.posexplode(overlap_chunks(F.col(text), size, overlap)).alias("chunk_no", "chunk")).withColumn(
        "chunk_no", F.col("chunk_no").cast("long")
    )


def segment_rows(df: DataFrame, key: str, text: str, max_len: int = 1200) -> DataFrame:
    return df.select(key, F.posexplode(segments(F.col(text), max_len)).alias("seg_no", "segment")).withColumn(
        "seg_no", F.col("seg_no").cast("long")
    )


def route_segments(rows: DataFrame) -> DataFrame:
    """Fenced code and very short segments pass through, the rest is translated."""
    body = tx.strip(F.col("segment"))
    code = body.startswith("```") & body.endswith("```")
    route = F.when(code, "code").when(F.length(body) < 10, "short").otherwise("translate")
    return rows.withColumn("route", route)
