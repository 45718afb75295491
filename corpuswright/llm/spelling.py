"""Spelling variants of the corpus vocabulary, found over a reduced alphabet.

Letters are hashed to a few symbols. The one-edit neighbourhood of a word over
the few symbols is small and can be written out in full, whatever letters stand
in the other word; where it meets the reduced vocabulary, the original words are
compared. Two words that differ by one edit reduce to words that differ by one
edit or none, so no pair is missed.

Nulls: a null text has no words, a null id is the empty string in the hash.
Repeated rows and texts count as often as they stand. Empty tables give no rows.
Texts are read whole. Other columns are not looked at, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Letters of a word: A-Z, a-z and the code points C0 to FF.
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
UPPER = "".join(map(chr, range(0x41, 0x5B)))
MIN_LENGTH = 5
MIN_COUNT = 3
#: One run in so many loses a letter.
NOISE = 97


def _lower(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are; words of ASCII alone take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def damaged(key: Column, word: Column, every: int = NOISE) -> Column:
    """``word`` without one letter where ``every`` divides the CRC of ``key:word``."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int | None = NOISE) -> DataFrame:
    """``word, n`` of all words of ``docs(doc_id, text)``, long and frequent enough.

    Occurrences are counted map-side, so a very frequent word costs a row per task.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", _lower(F.col("run")).alias("run"))
    word = F.col("run") if every is None else damaged(F.col("doc_id"), F.col("run"), every)
    counted = found.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def symbols_for(size: int) -> int:
    """Symbols of the reduced alphabet: the fourth root of the vocabulary, so that a reduced word
    keeps a few originals at every size while its neighbourhood grows slowly."""
    return min(max(4, round(0.2 * size**0.25)), len(LETTERS))


def reduced(word: Column, symbols: int) -> Column:
    """The word over the reduced alphabet: each letter's code is hashed to one of ``symbols``."""
    to = "".join(chr(0x61 + (ord(c) * 2654435761 % 2**32 >> 16) % symbols) for c in LETTERS)
    return F.translate(word, "".join(LETTERS), to)


def neighbourhood(word: Column, symbols: int) -> Column:
    """The word and all words one edit away from it, over the reduced alphabet."""
    alphabet = F.array(*[F.lit(chr(0x61 + s)) for s in range(symbols)])
    places = F.sequence(F.lit(1), F.length(word))
    before = lambda i: F.substring(word, F.lit(1), i - 1)
    after = lambda i: F.substring(word, i, F.length(word))

    def with_symbol(at: Column, skip: int) -> Column:
        return F.flatten(F.transform(at, lambda i: F.transform(alphabet, lambda s: F.concat(before(i), s, after(i + skip)))))

    dropped = F.transform(places, lambda i: F.concat(before(i), after(i + 1)))
    added = F.sequence(F.lit(1), F.length(word) + 1)
    return F.array_distinct(F.concat(F.array(word), dropped, with_symbol(places, 1), with_symbol(added, 0)))


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """``word, n, other, other_n``: each pair of words one edit apart, once.

    Each reduced word meets the reduced words of its neighbourhood that are not
    smaller (the others meet it), and only then the words behind them.
    """
    kept = materialize(words.select("word", "n", reduced(F.col("word"), symbols).alias("short")), "reduced")
    short = kept.select("short").distinct()
    around = short.select("short", F.explode(F.filter(neighbourhood(F.col("short"), symbols), lambda x: x >= F.col("short"))).alias("near"))
    met = materialize(around.join(short.select(F.col("short").alias("near")), "near", "left_semi"), "met")
    other = kept.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("short").alias("other_short"))
    one_edit = F.levenshtein("word", "other", 1) == 1
    once = (F.col("short") < F.col("near")) | (F.col("word") < F.col("other"))
    found = kept.join(met, "short").join(other, (F.col("near") == F.col("other_short")) & once & one_edit)
    return found.select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: forms followed to the last one.

    Counts at least double from a word to its form, so chains are short and end;
    each round doubles the steps taken.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        further = at.join(jump, F.col("root") == F.col("_from"), "left")
        after = materialize(
            further.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots"
        )
        at = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: int = 2, symbols: int | None = None) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for ``words(word, n)``.

    The form of a word is its most frequent near word (ties: the smallest), if
    that is ``ratio`` times as frequent; else null. The root is the end of the
    chain of forms.
    """
    words = materialize(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words, symbols or symbols_for(words.count()))
    pairs = materialize(pairs, "near")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    known = words.join(best, "word", "left")
    strong = -F.col("best.less") >= F.col("n") * ratio
    known = materialize(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
