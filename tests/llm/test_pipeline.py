"""Each stage of the pipeline on what the one before kept, against brute force."""

import os
import sys

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = texts or {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DIR)
        if name == "mixing":
            found = {r["doc_id"]: r for r in out.collect()}
            assert set(found) == set(before)
            assert all(r["taken"] <= 2 * r["size"] and r["size"] == len(brute.WORD.findall(before[k] or "")) for k, r in found.items())
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert len(texts) == len(rows)
        if name == "quality_rules":
            for k, text in before.items():
                n, _, _, _, repeated = brute.quality(text)
                if n < 50 or 100 * repeated > 50 * n or labels.get(k) == 0:
                    assert k not in texts
                elif labels.get(k) == 1:
                    assert k in texts
        elif name == "jaccard_join":
            assert set(texts) == {c for _, c in brute.components(before.items()).values()}
        elif name == "substring_dedup":
            for k, (words, kept) in brute.kept_words(before.items()).items():
                assert texts[k] == (before[k] if words == kept else " ".join(kept))
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "decontamination":
            assert set(texts) == {k for k, n, hit, _ in brute.contamination(before.items(), bench) if not (hit and 20 * hit >= n)}


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, _votes long, p_good string, _place long, _bad_id long, _q string, body string"


def odd_rows():
    prose = " ".join(f"The word of the {i} and that is a thing {i * 7 % 31}." for i in range(40))
    other = " ".join(f"It was the {i * i} for which they had been with {i}." for i in range(40))
    texts = [prose, prose, prose.replace("thing 7", "thong 7"), other, None, "", "short", " ".join(["junk"] * 500), other * 30]
    return [(None if i == 3 else i // 2, t, None, None, None, "mine", 6317, "x", 5, -1, "q", "b") for i, t in enumerate(texts + texts[:2])]


def test_stages_of_odd_rows(spark):
    """Null and repeated ids, repeated rows, null sources, columns with the operators' own names, an empty table."""
    given = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "mine", 6317, "x", 5, -1, "q", "b") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    docs = spark.createDataFrame(odd_rows() + given, ODD).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, DIR)
        assert docs.columns == [c.split()[0] for c in ODD.split(", ")], name
        found = docs.collect()
        assert 0 < len(found) <= before
        assert {(r["kept"], r["_votes"], r["_place"], r["_bad_id"], r["_q"], r["body"]) for r in found} == {("mine", 6317, 5, -1, "q", "b")}
        docs = spark.createDataFrame(found, ODD)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count()
    empty = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0


def test_texts_reach_workers_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(2500).selectExpr("id AS doc_id", "'a text' AS text").coalesce(1)
    corpus_pipeline.substring_dedup(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["id"])

    rows = docs.select(docs.doc_id.alias("id")).mapInArrow(sizes, "id bigint").collect()
    assert max(r[0] for r in rows) == 1000
