"""Completeness, score, readiness, priority and listing with hand-computed values."""

import pytest

from corpuswright.functions import quality
from corpuswright.operators import materials as mt

SCHEMA = (
    "id string, source_url string, source_type string, content_hash string, title string, content string, summary string,"
    " language string, tags array<string>, terms array<string>, parent_id string, order_index bigint,"
    " images array<struct<url:string>>, code_blocks array<struct<code:string>>,"
    " references array<struct<url:string,type:string,title:string>>, created_at double"
)
LONG = "word " * 40
REF = [("https://github.com/a/b", "github", "a/b")]


def row(i, title="T", content=LONG, tags=("x",), terms=("y",), language="zh", refs=REF, order=0, created=0.0, parent="p"):
    return (
        i, f"u/{i}", "web", None, title, content, f"About {i}", language, list(tags), list(terms), parent, order,
        [], [], refs, created,
    )


CASES = [
    # id, row, missing, score, grade, ready
    ("full", row("full"), [], 100, "A", True),
    ("refs", row("refs", refs=[]), [], 95, "A", True),
    ("title", row("title", title=" \t"), ["missing_title"], 80, "B", False),
    ("short", row("short", content="  " + "x" * 79 + "\n"), ["content_too_short"], 65, "C", False),
    ("edge", row("edge", content="x" * 80), [], 100, "A", True),
    ("tags", row("tags", tags=()), ["missing_tags"], 90, "A", False),
    ("english", row("english", language="en"), [], 90, "A", True),
    ("nolang", row("nolang", language=None), [], 100, "A", True),
    ("mixed", row("mixed", language="mixed"), [], 100, "A", True),
    (
        "worst", row("worst", None, None, (), (), "en", []),
        ["missing_title", "content_too_short", "missing_tags", "missing_terms"], 10, "D", False,
    ),
]


@pytest.fixture(scope="module")
def assessed(spark):
    return quality.assess(spark.createDataFrame([c[1] for c in CASES], SCHEMA)).cache()


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_assessment(assessed, case):
    name, _, missing, score, grade, ready = case
    got = assessed.where(assessed.id == name).first()
    assert (got.missing_fields, got.score, got.grade, got.ready) == (missing, score, grade, ready)


def test_flags_and_reasons(assessed):
    worst = assessed.where("id = 'worst'").first()
    assert worst.flags == [
        "missing_title", "content_too_short", "missing_tags", "missing_terms", "missing_references", "no_images",
        "no_code_blocks", "non_chinese_content",
    ]
    assert worst.reasons == worst.missing_fields + ["quality_score_below_threshold"]


def ranked(spark):
    data = [
        row("a", order=5, created=1.0),
        row("b", order=1, tags=()),
        row("c", order=2, refs=[]),
        row("d", order=2, refs=[], created=9.0),
        row("e", order=9),
    ]
    return quality.assess(spark.createDataFrame(data, SCHEMA))


def test_listing_modes(spark, rows):
    df = ranked(spark)
    # the first three by order are b, d, c; then they are ranked
    assert [r[0] for r in rows(mt.query_materials(df, 3), "id")] == ["d", "c", "b"]
    assert [r[0] for r in rows(mt.query_materials(df, 3, "global"), "id")] == ["a", "e", "d"]


def test_priority_is_independent_of_partitions(spark, rows):
    df = ranked(spark)
    want = [("a", 1), ("e", 2), ("d", 3), ("c", 4), ("b", 5)]
    for n in (1, 7):
        assert sorted(rows(mt.prioritize(df.repartition(n)), "id", "priority"), key=lambda r: r[1]) == want


def test_hash_resolution(spark, rows):
    schema = "id string, content_hash string, order_index long"
    store = spark.createDataFrame([("s1", "h1", 3), ("s2", "h1", 4), ("s3", "", 5)], schema)
    new = spark.createDataFrame(
        [("n1", "h1", 1), ("n2", "h2", 2), ("n3", "h2", 3), ("n4", None, 4), ("n5", "", 5), ("n6", None, 6)], schema
    )
    first = {r[0]: r[1:] for r in rows(mt.resolve_by_hash(new, store), "id", "resolved_id", "inserted")}
    assert first == {
        "n1": ("s1", False), "n2": ("n2", True), "n3": ("n2", False),
        "n4": ("n4", True), "n5": ("n5", True), "n6": ("n6", True),
    }
    keep = {r[0] for r in rows(mt.resolve_by_hash(new, store, in_batch="keep").where("inserted"), "id")}
    assert keep == {"n2", "n3", "n4", "n5", "n6"}


def test_first_wins_keeps_rows_without_content(spark, rows):
    schema = "id string, content_hash string, order_index long"
    df = spark.createDataFrame([("a", "h", 2), ("b", "h", 1), ("c", None, 3), ("d", None, 4), ("e", "", 5)], schema)
    assert {r[0] for r in rows(mt.first_wins(df), "id")} == {"b", "c", "d", "e"}


def test_filter_takes_wildcards_literally(spark, rows):
    data = [row("a", title="100% sure"), row("b", title="1000 sure"), row("c", title="x_y", tags=("t1", "t2"))]
    df = spark.createDataFrame(data, SCHEMA)
    assert [r[0] for r in rows(mt.filter_materials(df, keyword="0% S"), "id")] == ["a"]
    assert [r[0] for r in rows(mt.filter_materials(df, keyword="_"), "id")] == ["c"]
    assert [r[0] for r in rows(mt.filter_materials(df, tags=["t1", "t2"]), "id")] == ["c"]
    assert mt.filter_materials(df, tags=["t1", "x"]).count() == 0
    assert mt.filter_materials(df).count() == 3


def test_known_urls(spark, rows):
    store = spark.createDataFrame([("1", "http://a/x"), ("2", "http://a/y/")], "id string, source_url string")
    urls = spark.createDataFrame([("http://a/x",), ("http://a/x#top",), ("http://a/y",)], "url string")
    assert {r[0] for r in rows(mt.skip_known_urls(urls, store))} == {"http://a/x#top", "http://a/y"}
    assert rows(mt.skip_known_urls(urls, store, normalize=True)) == []
    assert dict(rows(mt.known_url_ids(urls, store))) == {"http://a/x": "1", "http://a/x#top": None, "http://a/y": None}


def test_planning_candidates(spark, rows):
    df = ranked(spark)
    assert [r[0] for r in rows(mt.planning_candidates(df, "none", parent_id="p"), "id")] == ["a", "e", "d", "c", "b"]
    # no such parent: the topic is looked for instead
    assert [r[0] for r in rows(mt.planning_candidates(df, "about E", parent_id="other"), "id")] == ["e"]
    assert mt.planning_candidates(df, "nothing", tags=["no such tag"]).count() == 0
