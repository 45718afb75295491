"""Key terms, topic tags and knowledge gaps from token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from .chunking import bind
from .explore import keyword_counts
from .ordering import top_per_key

#: A key above this share of the rows is hot; there are at most as many hot keys.
HOT_KEYS = 500_000


def _runs(tokens: Column) -> Column:
    """Sorted tokens as ``(term, tf)``, one per run of equal ones."""

    def lengths(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda a, k: F.struct(
                F.get(tokens, a).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(tokens)) - a).cast("long").alias("tf")
            ),
        )

    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))
    return F.when(F.size(tokens) > 0, bind(starts, lengths))


def token_runs(tokens: Column | str) -> Column:
    """Tokens of a row as ``(term, tf)``; null when there are none."""
    return bind(F.sort_array(tokens), _runs)  # array_sort would run a comparator


def token_counts(df: DataFrame, key: str, text: str, max_len: int = 50) -> DataFrame:
    """Occurrences of every lower-cased token shorter than ``max_len`` per row.

    A row holds all tokens of its document, so they are counted inside it and
    nothing is shuffled. ``key`` is unique.
    """
    tokens = F.filter(tx.word_tokens(F.col(text)), lambda t: F.length(t) < max_len)
    # outer: an inner explode would have the optimizer evaluate the array twice
    rows = df.select(key, F.explode_outer(token_runs(tokens)).alias("_c"))
    return rows.where("_c IS NOT NULL").select(key, "_c.term", "_c.tf")


def join_counts(rows: DataFrame, counts: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """Join per-key counts to rows of which a few keys may hold a large part.

    Keys with more than 1/HOT_KEYS of the rows number at most HOT_KEYS, so they
    are broadcast and their rows, the most by far in texts, stay where they are.
    Only rows of other keys are shuffled. Rows without a key are spread by their
    own id.
    """
    counts = materialize(counts.select(key, count), "counts")
    total = counts.agg(F.sum(count)).scalar()
    hot = counts.where(F.col(count) * HOT_KEYS > total)
    cold = counts.where(F.col(count) * HOT_KEYS <= total).select(F.col(key).alias("_ck"), F.col(count))
    here = rows.join(F.broadcast(hot), key).select(*rows.columns, count)
    other = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    other = other.withColumn("_jk", F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.col(spread).cast("string"))))
    return here.unionByName(other.join(cold, F.col("_jk") == F.col("_ck"), "left").select(*rows.columns, count))


def key_terms(df: DataFrame, key: str, text: str, n: int = 20) -> DataFrame:
    """Best ``n`` terms per document by tf * ln(N / df)."""
    tf = materialize(token_counts(df, key, text), "tf")  # tokenised once, read again for the counts and the scores
    frequency = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = df.agg(F.count(F.lit(1))).scalar()
    joined = join_counts(tf, frequency, "term", "df", key)
    scored = joined.withColumn("score", F.round(F.col("tf") * F.ln(total / F.col("df")), 6))
    return top_per_key(scored, [key], [F.col("score").desc(), F.col("term")], n, "term_rank").select(
        key, "term_rank", "term", "tf", "df", "score"
    )


def topic_tags(df: DataFrame, dictionary: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """Best ``n`` tags per document by occurrences of their keywords.

    ``dictionary(tag, keyword)``; tags of 30 characters and more are left out.
    """
    words = dictionary.where(F.length("tag") < 30).select("tag", F.lower("keyword").alias("keyword")).distinct()
    low = df.select(key, F.lower(text).alias("_text"))
    counted = keyword_counts(low, words, key, "_text")
    per_tag = counted.join(words, "keyword").groupBy(key, "tag").agg(F.sum("n").alias("hits"))
    return top_per_key(per_tag, [key], [F.col("hits").desc(), F.col("tag")], n, "tag_rank")


def gap_report(df: DataFrame, topics: DataFrame, key: str, text: str, n: int = 30) -> DataFrame:
    """Most widespread content terms that no topic text mentions."""
    seen = token_counts(df, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    covered = topics.select(F.explode(tx.word_tokens(F.col("topic"))).alias("term")).distinct()
    gaps = seen.join(covered, "term", "left_anti")
    return gaps.orderBy(F.col("df").desc(), F.col("tf").desc(), "term").limit(n)
