"""Chunking folds against a plain description of the rule."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import chunking as ck
from corpuswright.operators import publish as pb


def plain_chunks(text, size, overlap):
    """Chunks of one text, written as a loop over its paragraphs."""
    pieces = [p.strip() for p in re.split(r"\n\s*\n", text)]
    pieces = [p for p in pieces if p]
    if len(text) <= size or not pieces:
        return [text]
    done, held = [], []
    for p in pieces:
        if held and sum(len(x) + 2 for x in held) + len(p) + 2 > size:
            done.append("\n\n".join(held))
            keep = 1
            while keep < len(held) and sum(len(x) + 2 for x in held[-keep:]) < overlap:
                keep += 1
            held = held[-keep:]
        held.append(p)
    return [*done, "\n\n".join(held)]


def joined(paragraphs):
    """A packed run: leading empty paragraphs leave no trace."""
    return "\n\n".join(itertools.dropwhile(lambda p: not p, paragraphs))


def plain_segments(text, most):
    """Cut positions first, then the runs between them."""
    paras = text.split("\n\n")
    cuts = [0]
    for j in range(1, len(paras)):
        run = joined(paras[cuts[-1] : j])
        if run and len(run) + len(paras[j]) > most:
            cuts.append(j)
    runs = [joined(paras[a:b]).strip() for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
    return runs if runs[-1] else runs[:-1]


def texts(n=80):
    rng = random.Random(11)
    seps = ["\n\n", "\n \n", "\n\n\n\n", "\n"]
    made = []
    for _ in range(n):
        paras = ["x" * rng.randrange(0, 90) for _ in range(rng.randrange(0, 25))]
        made.append("".join(p + rng.choice(seps) for p in paras))
    return [*made, "", "\n\n", "y" * 500, "  lead\n\n" + "z" * 300]


@pytest.mark.parametrize(("size", "overlap"), [(200, 50), (100, 0), (120, 400), (6000, 500)])
def test_chunks(spark, rows, size, overlap):
    made = texts()
    df = spark.createDataFrame(list(enumerate(made)), "id long, text string")
    got = {}
    for i, no, chunk in sorted(rows(ck.chunk_rows(df, "id", "text", size, overlap))):
        got.setdefault(i, []).append(chunk)
        assert no == len(got[i]) - 1
    assert [got[i] for i in range(len(made))] == [plain_chunks(t, size, overlap) for t in made]


def test_segments_and_routes(spark, rows):
    made = texts()
    df = spark.createDataFrame(list(enumerate(made)), "id long, text string")
    got = {}
    for i, _, seg in sorted(rows(ck.segment_rows(df, "id", "text", 150))):
        got.setdefault(i, []).append(seg)
    assert [got.get(i, []) for i in range(len(made))] == [plain_segments(t, 150) for t in made]
    df = spark.createDataFrame([("```\ncode\n```",), (" tiny ",), ("long enough text",), ("``` open",)], "segment string")
    assert [r[0] for r in rows(ck.route_segments(df), "route")] == ["code", "short", "translate", "short"]


def test_merge_plan(spark, rows):
    def loop(n):
        rounds = 0
        while n > 1:
            n, rounds = -(-n // 3), rounds + 1
        return rounds

    df = spark.range(0, 1000)
    assert all(r == loop(n) for n, r in rows(df, "id", pb.merge_rounds(F.col("id"))))
    assert rows(spark.range(1), pb.chunk_target(F.lit(4000), F.lit(7)), pb.chunk_target(F.lit(100), F.lit(0))) == [(572, 300)]
