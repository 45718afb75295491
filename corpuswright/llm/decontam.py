"""Benchmark decontamination by winnowing.

A run of ``WINDOW`` words shared by two texts holds ``WINDOW - GRAM + 1`` shared
grams, so both texts keep that run's smallest gram hash. The kept fingerprints
of documents are tested against a filter of those of the benchmark and joined;
documents with a hit are then checked window by window on their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import bloom, rows

WINDOW = 13
GRAM = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _gram_hashes(hashes: str, k: int, enough: int) -> Column:
    """Hash of every ``k`` consecutive word hashes; none when there are fewer than ``enough`` words."""
    last = F.size(hashes) - k
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= max(enough, k), each).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, words: str, window: int, gram: int, short: list[int], out: str) -> DataFrame:
    """Add the distinct fingerprints: window minima, and all grams of the ``short`` lengths."""
    steps = window - gram + 1
    lowest = F.transform(
        F.sequence(F.lit(0), F.size("_g") - steps), lambda i: F.least(*[F.get("_g", i + j) for j in range(steps)])
    )
    lowest = F.when(F.size("_g") >= steps, lowest).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_g", _gram_hashes("_h", gram, window))
    shorts = [_gram_hashes("_h", n, n) for n in short]
    return df.withColumn(out, F.array_distinct(F.concat(lowest, *shorts))).drop("_h", "_g")


def _windows(words: str, lengths: list[int]) -> Column:
    """Every window of the given lengths as ``(at, n, window)``."""
    def of(n: int) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(words) - n),
            lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("window")),
        )
        none = F.array().cast("array<struct<at:int,n:int,window:string>>")
        return F.when(F.size(words) >= n, each).otherwise(none)

    return F.concat(*[of(n) for n in lengths])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``body`` (hash of the text), ``n_words``, ``n_hit``, ``items`` of every row of ``docs``.

    A benchmark item gives all its runs of ``window`` words, or itself when it is
    shorter; a document word inside any occurrence of one is hit. ``items`` are
    the sorted ids (as strings, null as empty) of items with an occurring run.
    Null and empty texts have no words; repeated rows get the same result; ids
    may be null or repeated. Other columns are not read.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    items = materialize(items.where(F.size("w") > 0), "bench")
    short = sorted(r[0] for r in items.where(F.size("w") < window).select(F.size("w")).distinct().collect())
    lengths = [*short, window]
    # an item shorter than a window is one window; longer ones have only windows of full length
    own = items.select("item", F.size("w").alias("_size"), F.inline(_windows("w", lengths)))
    own = own.where((F.col("n") == window) | (F.col("n") == F.col("_size"))).select("item", "n", "window").distinct()
    own = materialize(own, "bench_windows")
    # written before they are exploded: filters inferred from explode would move the whole computation into its lambdas
    marks = materialize(fingerprints(items.select("w"), "w", window, gram, short, "f").select("f"), "bench_prints")
    marks = materialize(marks.select(F.explode("f").alias("mark")).distinct(), "bench_marks")

    read = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("body"), words_of(F.col("text")).alias("w")
    )
    read = fingerprints(read, "w", window, gram, short, "f").select("doc_id", "body", F.size("w").cast("long").alias("n_words"), "f")
    read = materialize(read, "marks")
    known = bloom.build(marks)
    tried = read.select("doc_id", "body", F.explode("f").alias("mark")).where(known.might_contain(F.col("mark")))
    suspects = materialize(tried.join(marks, "mark", "left_semi").select("doc_id", "body").distinct(), "suspects")

    wanted = bloom.build(suspects.select("body"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("body"), "text").where(wanted.might_contain(F.col("body")))
    same = texts["doc_id"].eqNullSafe(suspects["doc_id"]) & (texts["body"] == suspects["body"])
    texts = texts.join(suspects, same, "left_semi").select("doc_id", "body", words_of(F.col("text")).alias("w"))
    texts = materialize(texts, "suspect_words")
    known_windows = bloom.build(own.select(F.xxhash64("window")).distinct())
    found = texts.select("doc_id", "body", F.inline(_windows("w", lengths)))
    found = found.where(known_windows.might_contain(F.xxhash64("window"))).distinct()
    hits = materialize(found.join(own.select("n", "window").distinct(), ["n", "window"], "left_semi"), "hits")

    covered = F.array_distinct(F.flatten(F.transform("_s", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    counts = hits.groupBy("doc_id", "body").agg(F.collect_list(F.struct("at", "n")).alias("_s"))
    counts = counts.select("doc_id", "body", F.size(covered).cast("long").alias("n_hit"))
    named = hits.select("doc_id", "body", "n", "window").distinct().join(own, ["n", "window"])
    named = named.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = counts.join(named, counts["doc_id"].eqNullSafe(named["doc_id"]) & (counts["body"] == named["body"])).select(
        counts["doc_id"].alias("_d"), counts["body"].alias("_b"), "n_hit", "items"
    )
    met = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body") == F.col("_b"))
    return read.select("doc_id", "body", "n_words").join(result, met, "left").select(
        "doc_id",
        "body",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(hit: Column, words: Column) -> Column:
    """A twentieth of the words or more are hit."""
    return (hit > 0) & (20 * hit >= words)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs, benchmark)
    return rows.without(docs, found.where(contaminated(F.col("n_hit"), F.col("n_words"))))
