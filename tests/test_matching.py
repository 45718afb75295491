"""Keyword matching, registry, related sections, terms."""

import random

from pyspark.sql import functions as F

from corpuswright.operators import explore as ex
from corpuswright.operators import related as rl
from corpuswright.operators import terms as tm


def texts(spark, n=60, seed=3):
    rng = random.Random(seed)
    made = ["".join(rng.choice("ab ć") for _ in range(rng.randrange(0, 700))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(made)), "id long, text string"), made


def test_both_ways_of_matching_agree(spark, rows):
    df, made = texts(spark)
    words = ["ab", "a b", "ćć", "bbbb", "aaaaaaa", "zz", "b ć a", "ab" * 9]
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = sorted((i, w) for i, t in enumerate(made) for w in words if w in t)
    assert sorted(rows(ex.keyword_hits(df, keywords, "id", "text"))) == want
    assert sorted(rows(ex.keyword_hits(df, keywords, "id", "text", inline=0))) == want
    counted = sorted((i, w, made[i].count(w)) for i, w in want)
    assert sorted(rows(ex.keyword_counts(df, keywords, "id", "text"), "id", "keyword", "n")) == counted
    assert sorted(rows(ex.keyword_counts(df, keywords, "id", "text", inline=0), "id", "keyword", "n")) == counted


def test_no_keywords(spark):
    df, _ = texts(spark, 3)
    none = spark.createDataFrame([], "keyword string")
    assert ex.keyword_hits(df, none, "id", "text").count() == 0


def registry(spark):
    data = [
        (0, "One", "http://one", "course", ["Spark", "join"]),
        (1, "Two", "http://two", "doc", ["window"]),
        (2, "One again", "http://one", "doc", ["shuffle"]),
    ]
    return spark.createDataFrame(data, "ord long, name string, url string, type string, keywords array<string>")


def test_registry_scores(spark, rows):
    q = spark.createDataFrame([(1, "SPARK joins"), (2, "windows"), (3, "nothing")], "query_id long, text string")
    assert sorted(rows(ex.match_registry(q, registry(spark)), "query_id", "name", "score")) == [(1, "One", 120), (2, "Two", 110)]


def test_known_sources_are_not_repeated(spark, rows):
    schema = "topic_id long, name string, description string, search_queries array<string>, known_urls array<string>"
    topics = spark.createDataFrame(
        [(1, "Shuffle", "", [], []), (2, "", "spark", ["window"], ["http://two"]), (3, "x", "y", ["z"], [])], schema
    )
    got = sorted(rows(ex.fill_known_sources(topics, registry(spark)), "topic_id", "name", "url"))
    assert got == [(1, "One", "http://one"), (2, "One", "http://one")]


def test_dedup_keeps_best_and_first_place(spark, rows):
    hits = [
        (0, "http://a/", 50, "first"), (1, "http://b", 60, "b"), (2, "http://a#x", 70, "best"),
        (3, "http://a?y", 70, "late"), (4, "", 99, "none"),
    ]
    df = spark.createDataFrame(hits, "seq long, url string, score long, title string")
    for n in (1, 7):
        got = sorted(rows(ex.dedup_urls(df.repartition(n)), "norm_url", "title", "score", "first_seq"))
        assert got == [("http://a", "best", 70, 0), ("http://b", "b", 60, 1)]
    assert [r[0] for r in rows(ex.explore_topk(df, 1), "title")] == ["best"]


def test_ties_follow_the_first_occurrence(spark, rows):
    hits = [(0, "http://b/", 10), (1, "http://a", 60), (2, "http://b", 60)]
    df = spark.createDataFrame(hits, "seq long, url string, score long")
    # b reached 60 later, but was seen first
    assert [r[0] for r in rows(ex.explore_topk(df, 2), "norm_url")] == ["http://b", "http://a"]


def test_github_scores(spark, rows):
    df = spark.createDataFrame([(999,), (12_345,), (90_000,)], "stars long")
    assert rows(df, ex.github_score(F.col("stars")), ex.github_score(F.col("stars"), True)) == [(30, 25), (42, 37), (70, 65)]


def brute_related(contents, sections, share, first):
    out = []
    for key, title, text in contents:
        n = 0
        for o, t in sections:
            words = [w for w in t.lower().split() if len(w) > 2]
            if t == title or not words:
                continue
            if sum(w in text.lower() for w in words) >= len(words) * share:
                out.append((key, o, n + 1))
                n += 1
                if n == first:
                    break
    return sorted(out)


def test_related_sections(spark, rows):
    rng = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "delta", "lambda", "mu", "eta", "alphabet"]
    sections = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 5)))) for i in range(40)]
    contents = [(i, sections[i][1], " ".join(rng.choices(vocab + ["x"] * 20, k=8)).title()) for i in range(40)]
    c = spark.createDataFrame(contents, "id long, title string, content string")
    s = spark.createDataFrame(sections, "ord long, title string")
    want = brute_related(contents, sections, 0.3, 5)
    assert want
    assert sorted(rows(rl.related_sections(c.repartition(3), s.repartition(2)), "id", "ord", "related_rank")) == want
    assert rl.related_sections(c, s.where("ord < 0")).count() == 0
    assert rl.related_sections(c.where("id < 0"), s).count() == 0


def test_related_sections_by_broadcast_words_and_by_vocabulary(spark, rows, monkeypatch):
    contents = [(1, "own", "the Reading-list of graphs, in\tGRAPHS"), (2, None, "ab \u00e9t\u00e9s listing"), (3, "x", None), (4, "y", "no or"), (5, "z", "")]
    sections = [(1, "reading list graphs"), (2, "\u00e9t\u00e9 list"), (3, "no words listing"), (4, "list list"), (5, None)]
    c, s = spark.createDataFrame(contents, "id long, title string, content string"), spark.createDataFrame(sections, "ord long, title string")
    words = rows(c.select("id", F.explode(F.split(F.lower("content"), r"\s+")).alias("token")).transform(
        lambda t: rl._held_few(t, spark.createDataFrame([("list",), ("\u00e9t\u00e9",), ("graphs",)], "word string"))
    ).distinct(), "id", "word")
    assert sorted(words) == [(1, "graphs"), (1, "list"), (2, "list"), (2, "\u00e9t\u00e9")]
    few = sorted(rows(rl.related_sections(c, s), "id", "ord", "related_title", "related_rank"))
    monkeypatch.setattr(rl, "FEW", 0)
    assert few == sorted(rows(rl.related_sections(c, s), "id", "ord", "related_title", "related_rank"))
    assert {(i, o) for i, o, _, _ in few} == {(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4)}


def test_related_sections_of_odd_texts(spark, rows):
    """Words inside longer tokens, repeated title words, other shares, nulls, short words, letters beyond ASCII."""
    sections = [(0, "Data data base"), (1, "is it ok"), (2, "Überblick der Änderung"), (3, "tab\tseparated\nwords"), (4, None), (5, "data-base index"), (6, "zzz yyy xxx www"), (7, "")]
    texts = ["a database is ok", "ÜBERBLICK über", "separated,words tab", "metadata-basement", "", "zzzyyy xxx", "databas e", "x" * 5000 + "index" + "y" * 5000]
    contents = [(i, [None, "Data data base", "is it ok"][i % 3], t) for i, t in enumerate(texts)]
    c = spark.createDataFrame([*contents, (99, "t", None)], "id long, title string, content string")
    s = spark.createDataFrame(sections, "ord long, title string")
    for share in (0.3, 0.5, 1.0):
        want = brute_related(contents, [x for x in sections if x[1] is not None], share, 2)
        assert sorted(rows(rl.related_sections(c, s, share, 2), "id", "ord", "related_rank")) == want


def test_counts_join_with_hot_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(tm, "HOT_KEYS", 5)
    data = [("hot" if i % 3 else f"k{i}", i) for i in range(300)]
    df = spark.createDataFrame(data, "term string, id long")
    counts = df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    got = sorted(rows(tm.join_counts(df, counts, "term", "df", "id"), "id", "term", "df"))
    assert got == sorted((i, t, 200 if t == "hot" else 1) for t, i in data)


def test_rows_of_hot_keys_stay_where_they_are(spark, rows, monkeypatch):
    monkeypatch.setattr(tm, "HOT_KEYS", 5)
    data = [("hot" if i % 3 else f"k{i}" if i % 2 else None, i) for i in range(300)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(data, 4), "term string, id long").withColumn("at", F.spark_partition_id())
    counts = df.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = tm.join_counts(df, counts, "term", "df", "id").withColumn("now", F.spark_partition_id())
    got = rows(joined, "id", "term", "df", "at", "now")
    assert sorted(r[:3] for r in got) == sorted((i, t, None if t is None else 200 if t == "hot" else 1) for t, i in data)
    assert len({r[3:] for r in got if r[1] == "hot"}) == 4


def test_gap_report(spark, rows):
    docs = spark.createDataFrame([(1, "spark join join"), (2, "Join window")], "id long, text string")
    topics = spark.createDataFrame([("Window functions",)], "topic string")
    assert rows(tm.gap_report(docs, topics, "id", "text")) == [("join", 2, 3), ("spark", 1, 1)]


def explored(spark, rows, topics, web=(), github=(), arxiv=(), **more):
    frame = lambda data, kind: spark.createDataFrame(list(data), kind)
    base = "topic_id long, seq long, url string, title string"
    sources = [(0, "One", "https://one.org/", "doc", ["rag"]), (1, "Two", "https://two.org", "course", ["rag", "agent"])]
    found = ex.explore_topics(
        frame(topics, "topic_id long, queries array<string>"),
        frame(sources, "ord long, name string, url string, type string, keywords array<string>"),
        frame(web, "topic_id long, term long, seq long, url string, title string"),
        frame(github, base + ", stars long, fallback boolean"),
        frame(arxiv, base),
        **more,
    )
    return [(r["topic_id"], r["rank"], r["url"], r["channel"], r["type"], r["score"]) for r in found.orderBy("topic_id", "rank").collect()]


def test_explore_topics(spark, rows):
    topics = [(1, ["RAG agents"]), (2, ["检索"]), (3, ["检索", "x"])]
    web = [(1, 0, i, u, "t") for i, u in enumerate(["https://www.reddit.com/a", "", None, "https://one.org", "https://docs.a.org/x", "https://late.org"])]
    web += [(1, 1, 9, "https://b.org/course", "t")]
    github = [(t, i, f"https://github.com/{t}/{i}{'f' if f else ''}", "g", i * 9000, f) for t in (1, 2, 3) for f in (False, True) for i in range(7)]
    arxiv = [(2, i, f"https://arxiv.org/abs/{i}", "p") for i in range(5)]
    got = explored(spark, rows, topics, web, github, arxiv, n=30)
    assert [r for r in got if r[0] == 1] == [
        (1, 1, "https://two.org", "registry", "course", 120),
        (1, 2, "https://one.org/", "registry", "doc", 110),  # better than the web hit of the same address
        (1, 3, "https://github.com/1/4", "github", "github", 66),
        (1, 4, "https://github.com/1/3", "github", "github", 57),
        (1, 5, "https://docs.a.org/x", "web", "doc", 50),
        (1, 6, "https://b.org/course", "web", "course", 50),
        (1, 7, "https://github.com/1/2", "github", "github", 48),
        (1, 8, "https://github.com/1/1", "github", "github", 39),
        (1, 9, "https://github.com/1/0", "github", "github", 30),
    ]
    second = [r[2:] for r in got if r[0] == 2]
    assert [r[0] for r in second if r[1] == "arxiv"] == [f"https://arxiv.org/abs/{i}" for i in range(3)]
    assert [(r[0], r[3]) for r in second if r[0].endswith("f")] == [("https://github.com/2/2f", 43), ("https://github.com/2/1f", 34), ("https://github.com/2/0f", 25)]
    assert len([r for r in got if r[0] == 3]) == 5  # asks in English too: no fallback
    chosen = explored(spark, rows, topics, web, github, arxiv, n=2, channels=("arxiv", "web"))
    assert [(r[0], r[3]) for r in chosen] == [(1, "web"), (1, "web"), (2, "arxiv"), (2, "arxiv")]
    assert explored(spark, rows, []) == []
