"""Model runs, reply parsing and conversations."""

from pyspark.sql import functions as F

from corpuswright.operators import responses as rs


def test_model_rows(spark, rows):
    def call(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper(), "d"

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, prompt string")
    got = sorted(rows(rs.run_model(df, call, retries=2, name="w"), "id", "success", "content", "attempts", "error"))
    assert got == [(1, True, "OK", 1, ""), (2, False, "", 3, "Worker w failed (2 retries): no")]


def test_reviews(spark):
    text = "PASSED:YES\n- before\nissues:\n- a \n-b\n - c\nSUGGESTIONS\n- d\nISSUES again\n- e"
    got = rs.parse_reviews(spark.createDataFrame([(text,)], "reply string")).first()
    assert (got.passed, got.issues, got.suggestions) == (True, ["a", "c", "e"], ["d"])


def test_terms_and_tags(spark):
    df = spark.range(1)
    terms = "- Spark\n• Join\nspark\n\n" + "x" * 50 + "\n" + "\n".join(f"t{i}" for i in range(30))
    got = df.select(rs.parse_terms(F.lit(terms)).alias("t"), rs.parse_tags(F.lit("#a\n- b\n" + "y" * 30 + "\nc\nd\ne\nf")).alias("g")).first()
    assert got.t == ["Spark", "Join"] + [f"t{i}" for i in range(18)]
    assert got.g == ["a", "b", "c", "d", "e"]


def test_topics(spark, rows):
    data = [("d", i, n, c) for i, (n, c) in enumerate([(" A ", "2"), ("", "2"), ("A", "2"), ("B", "2"), ("C", "2")])]
    data += [("many", i, f"T{i}", "70") for i in range(80)] + [("zero", 0, "Z", "0"), ("zero", 1, "Y", "0")]
    df = spark.createDataFrame(data, "k string, seq long, name string, topic_count string")
    for c in ("status", "difficulty", "description"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = rows(rs.normalize_topics(df, "k", "seq"), "k", "name")
    assert sorted(n for k, n in got if k == "d") == ["A", "B"]
    assert sum(k == "many" for k, _ in got) == 70
    assert [n for k, n in got if k == "zero"] == ["Z"]


def test_conversations(spark, rows):
    data = [(1, 0, "system", "S1"), (1, 1, "user", " hi "), (1, 2, "assistant", " "), (1, 3, "system", "S2"), (1, 4, "user", "bye"), (2, 0, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(rows(rs.flatten_conversations(df)))
    assert got == [(1, 0, "S1\n\nS2", "[user]\nhi\n\n[user]\nbye"), (2, 0, "", "[user]\nx")]
    parts = sorted(rows(rs.flatten_conversations(df, part_size=2)))
    assert [p[1] for p in parts if p[0] == 1] == [0, 1, 2]


def test_depth_presets(spark):
    got = {r.depth: r.default_topic_count for r in rs.depth_settings(spark).collect()}
    assert got == {"quick": 2, "comprehensive": 4, "expert": 6}
