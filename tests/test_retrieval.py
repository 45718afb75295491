"""Retrieval against brute force, and the recall of the approximate search."""

import collections
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuswright.operators import retrieval as rt
from corpuswright.operators import vectors as vt


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8))
    base[7] = base[3]  # a tie
    base[11] = 0
    queries = base[:6] + rng.normal(scale=0.1, size=(6, 8))
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "qid long, embedding array<double>")
    return base, queries, b, q


def brute(base, queries, k):
    out = []
    for qi, q in enumerate(queries):
        norm = np.linalg.norm(base, axis=1) * np.linalg.norm(q)
        score = np.round(np.divide(base @ q, norm, out=np.zeros(len(base)), where=norm > 0), 6)
        best = sorted(range(len(base)), key=lambda i: (-score[i], i))[:k]
        out += [(qi, i, r + 1) for r, i in enumerate(best)]
    return out


@pytest.mark.parametrize("cell_rows", [None, 40, 7])
def test_vector_topk(vectors, rows, cell_rows):
    base, queries, b, q = vectors
    assert sorted(rows(vt.vector_topk(q, b, 5, cell_rows), "qid", "id", "rank")) == sorted(brute(base, queries, 5))


def test_vector_topk_of_copies_and_clusters(spark, rows):
    """One vector holds a third of all rows, some are null or zero, a query asks for more than the sample's copies."""
    rng = np.random.default_rng(3)
    base = np.vstack([np.tile(rng.normal(size=6), (200, 1)), rng.normal(size=(8, 6)).repeat(50, axis=0) + rng.normal(scale=0.05, size=(400, 6)), np.zeros((3, 6))])
    queries = np.vstack([base[[0, 210, 602]], -base[0]])
    given = [(i, v.tolist()) for i, v in enumerate(base)] + [(9999, None)]
    b = spark.createDataFrame(given, "id long, embedding array<float>").repartition(4)
    base = np.array([np.float32(v) for v in base], dtype=np.float64)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)] + [(77, None)], "qid long, embedding array<float>")
    queries = queries.astype(np.float32).astype(np.float64)
    for cell_rows in (None, 50):
        assert sorted(rows(vt.vector_topk(q, b, 20, cell_rows), "qid", "id", "rank")) == sorted(brute(base, queries, 20))
    assert vt.vector_topk(q, b.where("false"), 3).count() == 0 and vt.vector_topk(q.where("false"), b, 3).count() == 0
    assert vt.approx_vector_topk(q, b.where("false"), 3).count() == 0 and vt.approx_vector_topk(q.where("false"), b, 3).count() == 0


def test_far_lists_are_skipped(spark):
    """Tight clusters: a query reaches few lists, so the other cells are never built."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    base = centres.repeat(40, axis=0) + rng.normal(scale=0.01, size=(800, 16))
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, embedding array<double>")
    known = vt.fit(b, 800, 20)
    home = known.list_of(vt._coarse(base))
    toward = vt._unit(known.centroids)
    angle = vt._angles((vt._unit(base) * toward[home]).sum(axis=1))
    radius = np.array([angle[home == j].max() if (home == j).any() else -np.pi for j in range(20)]) + 1e-6
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([v.tolist() for v in centres])], ["qid", "vector"])
    reached = next(vt._lists_in_reach(known, radius, 10)(iter([batch]))).column("lists").to_pylist()
    assert sum(map(len, reached)) <= 20 * 6


def test_approximate_recall(vectors, rows):
    base, queries, b, q = vectors
    want = {(qi, i) for qi, i, _ in brute(base, queries, 5)}
    got = set(rows(vt.approx_vector_topk(q, b, 5), "qid", "id"))
    assert len(want & got) / len(want) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_approximate_search_of_the_given_vectors(spark, rows):
    """Every twentieth vector asks all: recall at 10, and at most a tenth of the base as candidate rows."""
    b = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = b.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    n, asked = b.count(), q.count()
    assert vt.candidates(q, b).count() <= asked * n / 10
    want = set(rows(vt.vector_topk(q, b), "qid", "id"))
    got = set(rows(vt.approx_vector_topk(q, b), "qid", "id"))
    assert len(want) == 10 * asked and len(want & got) / len(want) >= 0.9


def scored(docs, asked):
    n, avg = len(docs), sum(len(d.split()) for d in docs) / len(docs)
    df = collections.Counter(t for d in docs for t in set(d.split()))
    for q, terms in enumerate(asked):
        for i, d in enumerate(docs):
            tokens, s = d.split(), 0.0
            for t in set(terms):
                tf = tokens.count(t)
                if tf:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / avg))
            if s > 0:
                yield q, i, round(s, 6)


def ranked(docs, asked, k):
    best = collections.defaultdict(list)
    for q, i, s in scored(docs, asked):
        best[q].append((-s, i))
    return sorted((q, i, r + 1) for q, found in best.items() for r, (_, i) in enumerate(sorted(found)[:k]))


def frames(spark, docs, asked):
    chunks = spark.createDataFrame([(i // 3, i % 3, d) for i, d in enumerate(docs)], "id long, chunk_no int, text string").repartition(4)
    return chunks, spark.createDataFrame(list(enumerate(asked)), "qid long, tokens array<string>")


def test_keyword_topk(spark, rows):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [" ".join(rng.choices(words, weights=range(1, 31), k=rng.randrange(0, 40))) for _ in range(120)]
    asked = [["w1", "w2"], ["w29"], ["none"], ["w5", "w5", "w9"], words, [], ["w28", "w29", "w27", "w3"]]
    chunks, queries = frames(spark, docs, asked)
    got = rows(rt.keyword_topk(queries, chunks, 4), "qid", "id", "chunk_no", "rank")
    assert sorted((q, 3 * i + c, r) for q, i, c, r in got) == ranked(docs, asked, 4)
    assert rt.keyword_topk(queries, chunks.where("false"), 4).count() == 0
    assert rt.keyword_topk(queries.where("false"), chunks, 4).count() == 0


def test_few_pairs_are_scored(spark, rows):
    """Words that every chunk has do not pair every chunk with every query."""
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(15)], [f"r{i}" for i in range(800)]
    docs = [" ".join(rng.sample(common, 12) + rng.choices(rare, k=20)) for _ in range(600)]
    asked = [rng.sample(common, 10) + docs[i].split()[-14:] for i in range(0, 600, 40)] + [rng.sample(common, 3)]
    chunks, queries = frames(spark, docs, asked)
    got = rows(rt.keyword_topk(queries, chunks, 3), "qid", "id", "chunk_no", "rank")
    assert sorted((q, 3 * i + c, r) for q, i, c, r in got) == ranked(docs, asked, 3)
    terms = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    pairs = rt.keyword_pairs(terms, rt._Corpus(terms, chunks), 3).where("qid < 15").count()
    assert pairs < 0.15 * 15 * 600


def test_hybrid_and_fallback(spark, rows):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 20, 0.7, 1)], "qid long, id long, score double, rank long")
    k = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "qid long, id long, score double, rank long")
    got = sorted(rows(rt.hybrid_topk(v, k, 3), "qid", "rank", "id", "mode"))
    assert got == [(1, 1, 11, "hybrid"), (1, 2, 10, "hybrid"), (1, 3, 12, "hybrid"), (2, 1, 20, "naive")]


def test_index_text(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "s", "t", "p\n\n" * 9)], "id long, source string, topic string, content string")
    stored = rt.index_text(df, str(tmp_path / "i"), size=20, overlap=4)
    assert stored.where(F.col("chunk").startswith("来源: s\n主题: t")).count() >= 1
    assert stored.count() > 2


def test_chunks_are_counted_once(spark, monkeypatch):
    """Frequencies, postings and scores read stored counts, not the texts again."""
    from corpuswright.operators import retrieval

    stored = []
    monkeypatch.setattr(retrieval, "materialize", lambda df, label: stored.append(label) or df.localCheckpoint())
    chunks = spark.createDataFrame([(1, "a b a"), (2, "b c")], "id long, text string")
    corpus = retrieval._Corpus(spark.createDataFrame([(1, "a")], "qid long, term string"), chunks)
    assert stored[0] == "counts" and corpus.n == 2
    assert "regexp_extract_all" not in corpus.counts._jdf.queryExecution().toString()
