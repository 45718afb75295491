"""Filtering, deduplication, lookup and ranking over the materials table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordering import first_per_key, row_numbers, sparse_left_join, top_per_key


def filter_materials(
    df: DataFrame,
    source_type: str | None = None,
    parent_id: str | None = None,
    tags: Sequence[str] = (),
    keyword: str | None = None,
) -> DataFrame:
    """Rows meeting every given condition; each tag must be present."""
    if source_type:
        df = df.where(F.col("source_type") == source_type)
    if parent_id:
        df = df.where(F.col("parent_id") == parent_id)
    for tag in tags:
        df = df.where(F.array_contains("tags", tag))
    if keyword:
        needle = F.lit(keyword.lower())
        df = df.where(F.contains(F.lower("title"), needle) | F.contains(F.lower("summary"), needle))
    return df


def first_wins(df: DataFrame, seq: str = "order_index") -> DataFrame:
    """Keep the first row per content hash; rows without content are all kept.

    Only the row keys go through the aggregation. The bodies are joined back by
    their own unique id, so a hash shared by a third of the rows moves no text.
    """
    keyed = df.where(_has_hash())
    winners = first_per_key(keyed.select("content_hash", seq, "id"), ["content_hash"], [seq, "id"]).select("id")
    return keyed.join(winners, "id", "left_semi").unionByName(df.where(~_has_hash()))


def _has_hash() -> Column:
    return F.coalesce("content_hash", F.lit("")) != ""


def with_content_hash(df: DataFrame) -> DataFrame:
    """Hash of the content where a row has content and no hash yet."""
    missing = F.coalesce(F.col("content_hash"), F.lit("")) == ""
    has_content = F.coalesce(F.col("content"), F.lit("")) != ""
    return df.withColumn(
        "content_hash",
        F.when(missing & has_content, tx.content_hash(F.col("content"))).otherwise(F.col("content_hash")),
    )


def resolve_by_hash(new: DataFrame, store: DataFrame, seq: str = "order_index", in_batch: str = "first") -> DataFrame:
    """Where each incoming row ends up: ``resolved_id`` and ``inserted``.

    A hash known to the store resolves to the stored id. Inside the batch the
    first row of a hash is inserted and later ones resolve to it
    (``in_batch='keep'`` inserts them all). Rows without a hash are inserted.
    """
    incoming = new.select("id", "content_hash", F.col(seq).alias("_seq"))
    candidates = store.select(F.lit(0).alias("_src"), F.col(seq).alias("_seq"), "id", "content_hash")
    if in_batch == "first":
        candidates = candidates.unionByName(
            incoming.select(F.lit(1).alias("_src"), "_seq", "id", "content_hash")
        )
    winners = first_per_key(
        candidates.where(_has_hash()), ["content_hash"], ["_src", "_seq", "id"]
    ).select("content_hash", F.col("_src").alias("_win_src"), F.col("id").alias("_win_id"))
    # rows without a hash match nothing and are spread, not gathered on one null key
    keyed = incoming.withColumn("_hash", F.when(_has_hash(), F.col("content_hash")))
    joined = sparse_left_join(keyed, winners.withColumnRenamed("content_hash", "_hash"), "_hash", "id")
    own = F.col("_win_id").isNull() | ((F.col("_win_src") == 1) & (F.col("_win_id") == F.col("id")))
    return joined.select(
        "id", "content_hash", F.coalesce("_win_id", "id").alias("resolved_id"), own.alias("inserted")
    )


def new_materials(new: DataFrame, store: DataFrame, seq: str = "order_index", in_batch: str = "first") -> DataFrame:
    """The incoming rows that are to be written."""
    ids = resolve_by_hash(new, store, seq, in_batch).where("inserted").select("id")
    return new.join(ids, "id", "left_semi")


def skip_known_urls(urls: DataFrame, store: DataFrame, normalize: bool = False) -> DataFrame:
    """URLs the store does not hold; raw equality unless ``normalize``."""
    from ..functions.urls import url_normalize

    def key(c: Column) -> Column:
        return url_normalize(c) if normalize else c

    known = store.select(key(F.col("source_url")).alias("_known")).distinct()
    return urls.join(known, key(urls["url"]) == F.col("_known"), "left_anti")


def known_url_ids(urls: DataFrame, store: DataFrame) -> DataFrame:
    """Id of the stored material of every URL, null when there is none."""
    known = store.groupBy(F.col("source_url").alias("url")).agg(F.min("id").alias("material_id"))
    return urls.join(known, "url", "left")


def fetch_by_ids(lists: DataFrame, store: DataFrame, key: str = "list_id") -> DataFrame:
    """Materials of each id list with their list position (from 0)."""
    wanted = lists.select(key, F.posexplode("material_ids").alias("pos", "id"))
    return wanted.join(store, "id").withColumn("pos", F.col("pos").cast("long"))


def dangling_ids(lists: DataFrame, store: DataFrame, key: str = "list_id") -> DataFrame:
    """Listed ids the store does not hold."""
    wanted = lists.select(key, F.posexplode("material_ids").alias("pos", "id"))
    return wanted.join(store.select("id"), "id", "left_anti").withColumn("pos", F.col("pos").cast("long"))


def children(store: DataFrame, cap: int = 500) -> DataFrame:
    """Rows of every parent by order, at most ``cap`` (the listing limit) each."""
    order = [F.col("order_index"), F.col("created_at").desc(), F.col("id")]
    return top_per_key(store, ["parent_id"], order, cap, "child_rank")


def priority_order() -> list[Column]:
    """Ready first, then score, then order, then newest; id settles ties."""
    return [
        F.col("ready").desc(),
        F.col("score").desc(),
        F.col("order_index"),
        F.col("created_at").desc(),
        F.col("id"),
    ]


def query_materials(df: DataFrame, limit: int = 100, mode: str = "reference") -> DataFrame:
    """Listing of assessed materials.

    ``reference`` takes ``limit`` rows by order and age first and ranks those;
    ``global`` ranks before it cuts.
    """
    if mode == "reference":
        df = df.orderBy("order_index", F.col("created_at").desc(), "id").limit(limit)
        return df.orderBy(*priority_order())
    if mode == "global":
        return df.orderBy(*priority_order()).limit(limit)
    raise ValueError(f"unknown mode {mode!r}")


def planning_candidates(
    df: DataFrame, topic: str, parent_id: str | None = None, tags: Sequence[str] = (), limit: int = 200
) -> DataFrame:
    """Materials a book is planned from: by parent and tags, else by keyword.

    Without parent and tags every material qualifies and the topic only matters
    when the table is empty of them.
    """
    chosen = filter_materials(df, parent_id=parent_id, tags=tags)
    if chosen.isEmpty():
        chosen = filter_materials(df, keyword=topic)
    return query_materials(chosen, limit)


def prioritize(df: DataFrame) -> DataFrame:
    """Position of every assessed material in priority order (from 1)."""
    ordered = df.withColumn("_nready", ~F.col("ready")).withColumn("_nscore", -F.col("score")).withColumn(
        "_ncreated", -F.col("created_at")
    )
    out = row_numbers(ordered, [], ["_nready", "_nscore", "order_index", "_ncreated", "id"], "priority")
    return out.drop("_nready", "_nscore", "_ncreated")


def summary_line() -> Column:
    """One-line summary of an assessed material used for outline planning."""
    from .. import vocab

    tags = F.when(
        F.size("tags") > 0, F.concat(F.lit(" | " + vocab.SUMMARY_TAGS), F.concat_ws(", ", "tags"))
    ).otherwise("")
    score = F.when(
        F.col("score").isNotNull(), F.concat(F.lit(" | " + vocab.SUMMARY_QUALITY), F.col("score").cast("string"))
    ).otherwise("")
    state = F.when(F.col("ready"), " | " + vocab.SUMMARY_READY).otherwise(" | " + vocab.SUMMARY_PENDING)
    body = F.when(F.col("summary") != "", F.concat(F.lit(" | "), F.substring("summary", 1, 100))).otherwise("")
    return F.concat(F.lit("["), F.col("source_type"), F.lit("] "), F.col("title"), tags, score, state, body)


def outline_input(df: DataFrame, n: int = 50) -> DataFrame:
    """Summary lines of the first ``n`` materials in priority order."""
    return df.orderBy(*priority_order()).limit(n).select("id", summary_line().alias("summary_line"))


def count_by_type(df: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Rows per source type over a fixed list (zero filled) and the total.

    The total counts every row, also those of unlisted types.
    """
    counts = df.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.createDataFrame([(v,) for v in vocabulary], "source_type string")
    per_type = listed.join(counts, "source_type", "left").select("source_type", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("source_type"), "n")
    return per_type.unionByName(total)


def all_tags(df: DataFrame) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def tag_cloud(df: DataFrame) -> DataFrame:
    """Rows per tag and the share of all tag uses."""
    uses = df.select(F.explode("tags").alias("tag"))
    total = uses.agg(F.count(F.lit(1))).scalar()
    counts = uses.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("tag", "n", F.round(F.col("n") / total, 6).alias("share"))
