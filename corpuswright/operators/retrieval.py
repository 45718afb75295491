"""Keyword and hybrid retrieval, and the store of chunks they search; vectors are in ``vectors``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from .chunking import chunk_rows
from .ordering import top_per_key
from .terms import token_runs

# --- fixed values: published BM25 and rank fusion constants -------------------------
K1, B = 1.2, 0.75
RRF = 60

#: Impact levels of a term's postings, and postings per term that may start the running k-th score, per row asked for.
LEVELS = 16
HEADS = 2
#: Sums of the same weights in another order differ by less.
MARGIN = 1e-5


class _Corpus:
    """Chunks as word counts, with the numbers BM25 takes from all of them.

    Texts are read and counted once; the counts are stored, and read for the
    document frequencies, the postings and the chunks that are scored. They never
    leave the row of their chunk but as a posting of a word that some query has.
    """

    def __init__(self, asked: DataFrame, chunks: DataFrame):
        keys = [c for c in chunks.columns if c != "text"]
        read = chunks.select(F.struct(*keys).alias("chunk"), tx.word_tokens(F.col("text")).alias("tokens"))
        runs = F.coalesce(token_runs("tokens"), F.array().cast("array<struct<term:string,tf:bigint>>"))
        self.counts = materialize(read.select("chunk", F.size("tokens").alias("length"), runs.alias("runs")), "counts")
        # the empty term stands for the chunk itself: how many there are, and their length
        terms = F.concat(F.array(F.lit("")), F.transform("runs", lambda r: r["term"]))
        counted = self.counts.select("length", F.explode(terms).alias("term")).groupBy("term")
        counted = counted.agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("total"))
        wanted = asked.select("term").unionByName(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
        known = materialize(counted.join(wanted, "term", "left_semi"), "frequencies")
        size = known.where("term = ''").first()
        self.n, self.average = (size["df"], size["total"] / size["df"] or 1.0) if size else (0, 1.0)
        self.terms = known.where("term <> ''").select("term", "df")

    def weight(self, tf: Column, df: Column, length: Column) -> Column:
        rare = F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5))
        return rare * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.average)))

    def postings(self) -> DataFrame:
        """``chunk, term, w`` of the words that some query has; whole numbers are stored, which pack well."""
        rows = self.counts.select("chunk", "length", F.explode("runs").alias("r")).select("chunk", "length", "r.term", "r.tf")
        held = materialize(rows.join(self.terms, "term"), "postings")
        return held.select("chunk", "term", self.weight(F.col("tf"), F.col("df"), F.col("length")).alias("w"))

    def score(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """``qid, chunk, score`` of the given pairs, over all words of the query."""
        pairs = materialize(pairs, "pairs")
        queries = asked.join(self.terms, "term").groupBy("qid").agg(F.collect_list(F.struct("term", "df")).alias("words"))
        held = self.counts.join(pairs.select("chunk").distinct(), "chunk", "left_semi")
        held = held.select("chunk", "length", F.map_from_entries("runs").alias("tf"))
        both = pairs.join(held, "chunk").join(queries, "qid")

        def add(total: Column, word: Column) -> Column:
            return total + F.coalesce(self.weight(F.try_element_at("tf", word["term"]), word["df"], F.col("length")), F.lit(0.0))

        return both.select("qid", "chunk", F.round(F.aggregate("words", F.lit(0.0), add), 6).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    return top_per_key(scored, ["qid"], [F.col("score").desc(), F.col("chunk")], k)


def _level(w: Column, most: Column) -> Column:
    return F.least(F.floor(w / most * LEVELS), F.lit(LEVELS - 1)).cast("int")


def keyword_pairs(asked: DataFrame, corpus: _Corpus, k: int) -> DataFrame:
    """``qid, chunk`` of all chunks that can be among a query's best ``k``, and few others.

    The best postings of each word give a first list per query, whose k-th score
    is a bound from below. A query's words are put in the order of their largest
    weight. A chunk whose first word in that order is ``t`` scores at most its
    weight plus the largest weights of the words behind ``t``; a posting whose
    weight stays under what the bound leaves of that (``need``) is not looked at.
    Postings are joined by word and level of weight, so those of frequent words
    are mostly left alone; a word with no more postings than are looked at anyway
    is looked at in full. Words of a chunk that were not met weigh less than their
    need, which bounds the chunk once more.
    """
    postings = corpus.postings()
    terms = materialize(postings.groupBy("term").agg(F.max("w").alias("most"), F.count(F.lit(1)).alias("df")), "terms")
    words = asked.join(terms, "term")
    later = W.partitionBy("qid").orderBy(F.col("most").desc(), "term").rowsBetween(1, W.unboundedFollowing)
    words = materialize(words.withColumn("behind", F.coalesce(F.sum("most").over(later), F.lit(0.0))), "words")

    heads = top_per_key(postings, ["term"], [F.col("w").desc(), F.col("chunk")], HEADS * k, "place").drop("place")
    partial = words.join(heads, "term").groupBy("qid", "chunk").agg(F.sum("w").alias("score"))
    first = corpus.score(_best(partial, HEADS * k).select("qid", "chunk"), asked)
    bound = _best(first, k).where(F.col("rank") == k).select("qid", (F.col("score") - MARGIN).alias("bound"))

    needs = words.join(bound, "qid", "left").withColumn("need", F.greatest(F.col("bound") - F.col("behind"), F.lit(0.0)))
    query = W.partitionBy("qid")
    paid = F.sum(F.when(F.col("need") == 0, F.col("df"))).over(query)
    needs = needs.withColumn("need", F.when(F.col("df") <= paid, F.lit(0.0)).otherwise(F.col("need"))).withColumn("cap", F.least("most", "need"))
    needs = materialize(needs.withColumn("caps", F.sum("cap").over(query)).drop("df"), "needs")
    looked = needs.where("most >= need").withColumn(
        "level", F.explode(F.sequence(_level(F.col("need"), F.col("most")), F.lit(LEVELS - 1)))
    )
    levelled = postings.join(terms.select("term", F.col("most").alias("_most")), "term").select("chunk", "term", "w", _level(F.col("w"), F.col("_most")).alias("level"))
    met = looked.join(levelled, ["term", "level"]).where("w >= need")
    reach = met.groupBy("qid", "chunk").agg((F.sum(F.col("w") - F.col("cap")) + F.first("caps")).alias("reach"), F.first("bound").alias("bound"))
    return reach.where("bound IS NULL OR reach >= bound - 1e-9").select("qid", "chunk")


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Best chunks per query by BM25. ``queries(qid, tokens)``; ``chunks``: ``text`` and the columns that name a chunk.

    The result has the columns ``qid``, those of the chunk, ``score`` and ``rank``;
    ties go to the chunk that comes first. It is exact: only chunks that cannot be
    among the best are left out before scoring.
    """
    asked = materialize(queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term")), "asked")
    corpus = _Corpus(asked, chunks)
    scored = corpus.score(keyword_pairs(asked, corpus, k), asked)
    return _best(scored, k).select("qid", "chunk.*", "score", "rank")


def hybrid_topk(vector: DataFrame, keyword: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (qid, id, rank); an id's best chunk gives its rank.

    A query without a keyword result falls back to its vector list.
    """
    keyword = keyword.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    both = vector.select("qid", "id", "rank").unionByName(keyword)
    found = keyword.select("qid").distinct()
    fused = (
        both.join(found, "qid", "left_semi")
        .groupBy("qid", "id")
        .agg(F.round(F.sum(F.lit(1.0) / (RRF + F.col("rank"))), 6).alias("score"))
    )
    top = top_per_key(fused, ["qid"], [F.col("score").desc(), F.col("id")], k).withColumn("mode", F.lit("hybrid"))
    naive = vector.join(found, "qid", "left_anti").where(F.col("rank") <= k)
    return top.unionByName(naive.select("qid", "id", "score", "rank", F.lit("naive").alias("mode")))


def index_text(df: DataFrame, out: str, size: int = 6000, overlap: int = 500) -> DataFrame:
    """Enrich, chunk and store texts. ``df(id, source, topic, content)``."""
    enriched = F.concat(F.lit("来源: "), "source", F.lit("\n主题: "), "topic", F.lit("\n\n"), "content")
    rows = df.select(F.struct("id", "source").alias("key"), enriched.alias("text"))
    chunks = chunk_rows(rows, "key", "text", size, overlap).select("key.id", "key.source", "chunk_no", "chunk")
    chunks.write.partitionBy("source").parquet(out)
    return df.sparkSession.read.parquet(out)
