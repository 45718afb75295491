"""Resource discovery: registry matches, channel union, URL deduplication, queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_by_script
from ..functions.urls import classify_url, is_low_quality, url_normalize
from .ordering import row_numbers, top_per_key

INLINE_KEYWORDS = 1000
_WINDOW = 256


def keyword_hits(texts: DataFrame, keywords: DataFrame, key: str, text: str, inline: int = INLINE_KEYWORDS) -> DataFrame:
    """Distinct ``(key, keyword)`` pairs where the keyword occurs in the text.

    ``keywords(keyword)`` and the texts are compared as given (lower both for a
    case-insensitive match). Up to ``inline`` keywords become one expression over
    each row, with no join. A larger dictionary is matched by an equi join: each
    text is cut into its substrings of the keyword lengths.
    """
    words, distinct = _inline_words(keywords, inline)
    if words is None:
        return _hits_by_substring(texts, distinct, key, text)
    hits = F.filter(words, lambda w: F.contains(F.col(text), w))
    return texts.select(key, F.explode(hits).alias("keyword"))


def keyword_counts(texts: DataFrame, keywords: DataFrame, key: str, text: str, inline: int = INLINE_KEYWORDS) -> DataFrame:
    """As ``keyword_hits``, with the occurrences ``n`` (not overlapping)."""
    words, distinct = _inline_words(keywords, inline)
    if words is None:
        hits = _hits_by_substring(texts, distinct, key, text)
        return hits.join(texts, key).select(key, "keyword", _occurrences(F.col(text), F.col("keyword")).alias("n"))
    hits = F.filter(words, lambda w: F.contains(F.col(text), w))
    counted = F.transform(hits, lambda w: F.struct(w.alias("keyword"), _occurrences(F.col(text), w).alias("n")))
    return texts.select(key, F.explode(counted).alias("hit")).select(key, "hit.keyword", "hit.n")


def _inline_words(keywords: DataFrame, inline: int) -> tuple[Column | None, DataFrame]:
    """The keywords as an array, or none when they exceed the bound."""
    distinct = keywords.select("keyword").where("keyword <> ''").distinct()
    listed = distinct.limit(inline + 1).collect()
    if len(listed) > inline:
        return None, distinct
    return F.array(*[F.lit(r[0]) for r in sorted(listed)]).cast("array<string>"), distinct


def _occurrences(text: Column, word: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")


def _hits_by_substring(texts: DataFrame, keywords: DataFrame, key: str, text: str) -> DataFrame:
    lengths = sorted(r[0] for r in keywords.select(F.length("keyword")).distinct().collect())
    longest = lengths[-1]
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(_WINDOW))
    windows = texts.select(key, F.explode(starts).alias("_at"), F.col(text).alias("_t")).select(
        key, F.substring("_t", F.col("_at"), F.lit(_WINDOW + longest - 1)).alias("_w")
    )
    sizes = F.array(*[F.lit(n) for n in lengths])
    cuts = F.flatten(
        F.transform(
            sizes,
            lambda n: F.when(
                F.length("_w") >= n,
                F.transform(
                    F.sequence(F.lit(1), F.least(F.lit(_WINDOW), F.length("_w") - n + 1)),
                    lambda p: F.substring(F.col("_w"), p, n),
                ),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    grams = windows.select(key, F.explode(F.array_distinct(cuts)).alias("keyword"))
    return grams.join(keywords, "keyword", "left_semi").select(key, "keyword").distinct()


def match_registry(queries: DataFrame, registry: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Registry sources whose keywords occur in the query text.

    Score 100 + 10 per matching keyword. ``registry(name, url, type, keywords)``.
    """
    entries = registry.select("name", "url", "type", F.explode("keywords").alias("keyword")).withColumn(
        "keyword", F.lower("keyword")
    )
    low = queries.select(key, F.lower(text).alias("_text"))
    hits = keyword_hits(low, entries, key, "_text")
    return (
        hits.join(entries, "keyword")
        .groupBy(key, "name", "url", "type")
        .agg((100 + 10 * F.count(F.lit(1))).alias("score"))
    )


def fill_known_sources(topics: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry sources to add to each topic: any keyword match, URL not there yet.

    ``topics(topic_id, name, description, search_queries, known_urls)``;
    ``registry`` carries ``ord``; of entries with one URL the first is taken.
    """
    text = F.concat_ws(" ", "name", "description", F.concat_ws(" ", "search_queries"))
    texts = topics.select("topic_id", text.alias("text"))
    matched = match_registry(texts, registry, "topic_id", "text").select("topic_id", "url").distinct()
    known = topics.select("topic_id", F.explode("known_urls").alias("url"))
    fresh = matched.join(known, ["topic_id", "url"], "left_anti")
    firsts = registry.groupBy("url").agg(F.min(F.struct("ord", "name", "type")).alias("r"))
    return fresh.join(firsts, "url").select("topic_id", "r.name", "url", "r.type", F.col("r.ord").alias("ord"))


def web_search_terms(queries: Column) -> Column:
    """Search phrases: the first two English queries, else the first CJK one."""
    english, chinese = split_by_script(queries, cjk=False), split_by_script(queries, cjk=True)

    def phrase(source: Column, i: int, tail: str, wanted: Column) -> Column:
        return F.when(wanted, F.concat(F.try_element_at(source, F.lit(i)), F.lit(tail)))

    return F.array_compact(
        F.array(
            phrase(english, 1, " tutorial documentation", F.size(english) > 0),
            phrase(english, 2, " guide", F.size(english) > 1),
            phrase(chinese, 1, " 教程 文档", F.size(english) == 0),
        )
    )


def catalogue_term(queries: Column) -> Column:
    """Phrase for repository and paper search: English first, else the topic."""
    english = split_by_script(queries, cjk=False)
    return F.coalesce(F.try_element_at(english, F.lit(1)), F.try_element_at(queries, F.lit(1)))


#: Scores of hits whose channel brings none.
WEB_SCORE, ARXIV_SCORE = 50, 60


def github_score(stars: Column, fallback: bool = False) -> Column:
    top, base = (65, 25) if fallback else (70, 30)
    return F.least(F.lit(top), base + F.floor(stars / 1000)).cast("long")


def union_channels(registry: DataFrame, web: DataFrame, github: DataFrame, arxiv: DataFrame) -> DataFrame:
    """Hits of the four channels with their scores; earlier channels come first.

    Every input has ``seq, url, title, type``; registry brings its own ``score``
    and github its ``stars``.
    """
    cols = ["channel", "channel_ord", "seq", "url", "title", "type", "score"]
    parts = [
        (registry, F.col("score")),
        (web, F.lit(WEB_SCORE)),
        (github, github_score(F.col("stars"))),
        (arxiv, F.lit(ARXIV_SCORE)),
    ]
    names = ("registry", "web", "github", "arxiv")
    out = None
    for i, (name, (df, score)) in enumerate(zip(names, parts, strict=True)):
        rows = df.withColumns(
            {"channel": F.lit(name), "channel_ord": F.lit(i).cast("long"), "score": score.cast("long")}
        ).select(*cols)
        out = rows if out is None else out.unionByName(rows)
    return out


def cap_channels(hits: DataFrame, keys: Sequence[str], caps: dict[str, int]) -> DataFrame:
    """At most the channel's cap of hits per key, in hit order; channels without a cap keep all.

    ``hit_rank`` counts within key and channel.
    """
    capped = F.coalesce(F.col("channel").isin(list(caps)), F.lit(False))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("channel"))
    top = top_per_key(hits.where(capped), [*keys, "channel"], [F.col("seq")], max(caps.values()), "hit_rank")
    free = row_numbers(hits.where(~capped), [*keys, "channel"], ["seq"], "hit_rank")
    return top.where(F.col("hit_rank") <= limit).unionByName(free)


def dedup_urls(hits: DataFrame, order: Sequence[str] = ("seq",), keys: Sequence[str] = ()) -> DataFrame:
    """Best-scored hit per normalised URL; the first seen settles ties.

    The winner takes the position of the first occurrence (``first_*``). One
    map-side combined aggregation.
    """
    rest = [c for c in hits.columns if c not in keys]
    first = F.min(F.struct(*order)).alias("_first")
    # least struct: highest score, then first seen
    best = F.min(F.struct((-F.coalesce("score", F.lit(0))).alias("neg"), *[F.col(o).alias(f"o_{o}") for o in order], F.struct(*rest).alias("row")))
    out = (
        hits.withColumn("norm_url", url_normalize(F.col("url")))
        .where("norm_url <> ''")
        .groupBy(*keys, "norm_url")
        .agg(best.alias("_best"), first)
    )
    return out.select(
        *keys, "norm_url", *[F.col(f"_best.row.{c}").alias(c) for c in rest],
        *[F.col(f"_first.{o}").alias(f"first_{o}") for o in order],
    )


def explore_topk(hits: DataFrame, n: int = 10, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Deduplicate, then the ``n`` best; earlier hits win ties."""
    deduped = dedup_urls(hits, order)
    return deduped.orderBy(F.col("score").desc(), *[f"first_{o}" for o in order], "norm_url").limit(n)


#: Hits taken of one web search, of a repository search, of its fallback, and of a paper search.
CAPS = {"web": 5, "github": 5, "fallback": 3, "arxiv": 3}
CHANNELS = ("registry", "web", "github", "arxiv")


def explore_topics(
    topics: DataFrame,
    registry: DataFrame,
    web: DataFrame,
    github: DataFrame,
    arxiv: DataFrame,
    n: int = 10,
    channels: Sequence[str] = CHANNELS,
) -> DataFrame:
    """The ``n`` best resources of every topic over the chosen channels.

    ``topics(topic_id, queries)``; ``registry(ord, name, url, type, keywords)``;
    search hits in the order found: ``web(topic_id, term, seq, url, title)``,
    ``github(topic_id, seq, url, title, stars, fallback)``, ``arxiv(topic_id, seq,
    url, title)``. Searches are capped before hits of low-quality hosts or without
    a URL go. Fallback repositories count, at a lower score, for topics that ask
    in Chinese only. Of hits with one address the best stays, at the place of the
    first. Result: ``topic_id, rank, norm_url, url, title, type, channel, score``.
    """
    cols = ["topic_id", "channel", "channel_ord", "seq", "url", "title", "type", "score"]

    def hits(channel: str, rows: DataFrame, kind: Column, score: Column) -> DataFrame:
        named = rows.withColumns({"channel": F.lit(channel), "channel_ord": F.lit(CHANNELS.index(channel)).cast("long")})
        return named.withColumns({"type": kind, "score": score.cast("long"), "seq": F.col("seq").cast("long")}).select(*cols)

    asked = topics.select("topic_id", F.concat_ws(" ", "queries").alias("text"))
    matched = match_registry(asked, registry, "topic_id").join(registry.select("name", "url", F.col("ord").alias("seq")), ["name", "url"])
    web_found = top_per_key(web, ["topic_id", "term"], [F.col("seq")], CAPS["web"], "_hit").drop("_hit")
    web_found = web_found.where("url <> ''").where(~is_low_quality(F.col("url")))
    only_cjk = (F.size(split_by_script(F.col("queries"), cjk=False)) == 0) & (F.size(split_by_script(F.col("queries"), cjk=True)) > 0)
    repos = top_per_key(github, ["topic_id", "fallback"], [F.col("seq")], CAPS["github"], "_hit")
    repos = repos.join(topics.select("topic_id", only_cjk.alias("_cjk")), "topic_id")
    repos = repos.where(~F.col("fallback") | (F.col("_cjk") & (F.col("_hit") <= CAPS["fallback"])))
    stars = F.when(F.col("fallback"), github_score(F.col("stars"), True)).otherwise(github_score(F.col("stars")))
    papers = top_per_key(arxiv, ["topic_id"], [F.col("seq")], CAPS["arxiv"], "_hit")
    found = {
        "registry": hits("registry", matched.withColumn("title", F.col("name")), F.col("type"), F.col("score")),
        "web": hits("web", web_found, classify_url(F.col("url")), F.lit(WEB_SCORE)),
        "github": hits("github", repos, F.lit("github"), stars),
        "arxiv": hits("arxiv", papers, F.lit("arxiv"), F.lit(ARXIV_SCORE)),
    }
    every = [found[c] for c in CHANNELS if c in channels]
    if not every:
        raise ValueError("no channel chosen")
    union = every[0]
    for rows in every[1:]:
        union = union.unionByName(rows)
    best = dedup_urls(union, ("channel_ord", "seq"), ("topic_id",))
    order = [F.col("score").desc(), F.col("first_channel_ord"), F.col("first_seq"), F.col("norm_url")]
    top = top_per_key(best, ["topic_id"], order, n)
    return top.select("topic_id", "rank", "norm_url", "url", "title", "type", "channel", "score")


def enqueue_urls(new: DataFrame, queue: DataFrame) -> DataFrame:
    """Queue rows to add: URLs in neither state, first occurrence kept.

    ``new(url, seq)``, ``queue(url, state)``.
    """
    firsts = new.groupBy("url").agg(F.min("seq").alias("seq"))
    return firsts.join(queue.select("url"), "url", "left_anti").withColumn("state", F.lit("pending"))


def mark_processed(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Queue with the finished pending URLs moved to processed."""
    finished = done.select("url").distinct().withColumn("_done", F.lit(True))
    state = F.when((F.col("state") == "pending") & F.col("_done"), "processed").otherwise(F.col("state"))
    return queue.join(finished, "url", "left").withColumn("state", state).drop("_done")


def route_tasks(queue: DataFrame, policy: str = "study") -> DataFrame:
    """Queue rows per handler kind."""
    return queue.groupBy(classify_url(F.col("url"), policy).alias("route")).agg(F.count(F.lit(1)).alias("n"))
