"""Related sections: title words that stand in a text, as a set-containment join.

A title word has no white space, so where a text holds it, one of the text's
tokens does. A word is indexed under the rarest of its three-letter grams,
tokens probe with their grams, and only what meets is compared. Up to ``FEW``
words are broadcast and every text's tokens probe where they are; more are
settled once on the vocabulary, which tokens then join. Sections are then found by the
rarest words of their titles: one that has the needed share of its words in a
text has one of those there. All of it is equi-joins on words, tokens and ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import top_per_key

GRAM = 3
#: Title words that every task may hold, with a gram each.
FEW = 1 << 15


def _grams(word: str) -> Column:
    """Distinct grams of a word of at least ``GRAM`` letters."""
    places = F.sequence(F.lit(1), F.length(word) - (GRAM - 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(word, i, GRAM)))


def words_in_tokens(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``token, word`` of all words that a token holds; both sides distinct, words of ``GRAM`` letters and more."""
    probes = tokens.where(F.length("token") >= GRAM).select("token", F.explode(_grams("token")).alias("gram"))
    probes = materialize(probes, "grams")
    seen = probes.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    grams = words.select("word", F.explode(_grams("word")).alias("gram")).join(seen, "gram")
    # a word with a gram that no token has is in none of them; the rarest gram of the others finds their tokens
    rarest = grams.groupBy("word").agg(F.min(F.struct("df", "gram"))["gram"].alias("gram"))
    return probes.join(rarest, "gram").where(F.contains("token", "word")).select("token", "word")


def _held_few(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``id, word`` of broadcast words that tokens (``id, token``) hold; a word's gram is the rarest among the words."""
    grams = words.select("word", F.explode(_grams("word")).alias("gram"))
    seen = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = grams.join(seen, "gram").groupBy("word").agg(F.min(F.struct("df", "gram"))["gram"].alias("gram"))
    rarest = F.broadcast(materialize(rarest, "rarest"))
    places = F.explode(F.sequence(F.lit(1), F.length("token") - (GRAM - 1))).alias("place")
    probes = tokens.where(F.length("token") >= GRAM).select("id", "token", places)
    probes = probes.select("id", "token", F.substring("token", F.col("place"), GRAM).alias("gram"))
    return probes.join(rarest, "gram").where(F.contains("token", "word")).select("id", "word")


def related_sections(contents: DataFrame, sections: DataFrame, share: float = 0.3, first: int = 5) -> DataFrame:
    """First sections whose title words occur, by ``share``, in a text.

    ``contents(id, title, content)`` with unique ids, ``sections(ord, title)``
    with ``ord`` unique; words of three letters and more count, each as often as
    the title has it. A text's own title is left out. Null texts and titles match
    nothing.
    """
    split = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) >= GRAM)
    sections = sections.select("ord", "title", split.alias("words")).where(F.size("words") > 0)
    sections = materialize(sections.withColumn("needed", F.greatest(F.lit(1), F.ceil(F.size("words") * F.lit(share)))), "sections")
    listed = sections.select("ord", "needed", F.size("words").alias("n"), F.explode("words").alias("word"))

    tokens = contents.select("id", F.explode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("token"))
    words = materialize(listed.select("word").distinct(), "words")
    if words.count() <= FEW:
        held = _held_few(tokens, words)
    else:
        pairs = words_in_tokens(tokens.select("token").distinct(), words)
        held = tokens.join(materialize(pairs, "pairs"), "token").select("id", "word")
    held = materialize(held.distinct(), "held")

    # of n words, needed are there: one of the first n - needed + 1 is
    spread = held.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    rarity = W.partitionBy("ord").orderBy("texts", "word")
    ranked = listed.join(spread, "word", "left").withColumn("texts", F.coalesce("texts", F.lit(0))).withColumn("place", F.row_number().over(rarity))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.col("needed") + 1).select("ord", "word").distinct()
    met = held.join(prefix, "word").select("id", "ord").distinct()

    own = held.groupBy("id").agg(F.collect_set("word").alias("held"))
    texts = own.join(contents.select("id", F.col("title").alias("own")), "id")
    hits = F.size(F.filter("words", lambda w: F.array_contains("held", w)))
    found = met.join(texts, "id").join(sections, "ord").where((hits >= F.col("needed")) & ~F.col("title").eqNullSafe(F.col("own")))
    found = found.select("id", F.col("ord").cast("long").alias("ord"), F.col("title").alias("related_title"))
    return top_per_key(found, ["id"], [F.col("ord")], first, "related_rank")
