"""Batch model calls and the parsing of their replies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from .ordering import first_per_key, row_numbers

RESULT = "id long, success boolean, content string, data string, error string, attempts long, elapsed double"


def run_model(
    prompts: DataFrame, call: Callable[[str], tuple[str, str]], retries: int = 1, name: str = "worker", pause: float = 0.0
) -> DataFrame:
    """Call a model for every prompt (id, prompt): one result row each.

    ``call`` returns content and data. A failing call is tried ``retries`` more
    times (waiting ``pause * 2**attempt``) and then becomes an error row, so one
    bad prompt never fails the job.
    """

    def one(prompt: str) -> tuple:
        start, error = time.monotonic(), ""
        for attempt in range(retries + 1):
            try:
                content, data = call(prompt)
                return True, content, data, "", attempt + 1, time.monotonic() - start
            except Exception as exc:  # the reply of any failure is an error row
                error = str(exc)
                if pause and attempt < retries:
                    time.sleep(pause * 2**attempt)
        message = f"Worker {name} failed ({retries} retries): {error}"
        return False, "", "", message, retries + 1, time.monotonic() - start

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["success", "content", "data", "error", "attempts", "elapsed"]
        for b in batches:
            out = pd.DataFrame([one(p) for p in b["prompt"]], columns=columns)
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    return prompts.select("id", "prompt").mapInPandas(run, RESULT)


def _sections(text: Column, headings: dict[str, Callable[[Column], Column]], bullet: Callable[[Column], Column], item: Callable[[Column], Column]) -> dict[str, Column]:
    """Bullets under headings, by a fold that remembers the open heading.

    ``headings`` maps a name to its test of a line; the first match wins.
    """
    names = list(headings)
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("at"), *[empty.alias(n) for n in names])
    lines = F.transform(F.split(text, "\n"), tx.strip)

    def step(acc: Column, line: Column) -> Column:
        at = acc["at"]
        for n in reversed(names):
            at = F.when(headings[n](line), n).otherwise(at)
        is_heading = None
        for n in names:
            test = headings[n](line)
            is_heading = test if is_heading is None else is_heading | test
        take = bullet(line) & ~is_heading
        return F.struct(
            at.alias("at"),
            *[
                F.when(take & (acc["at"] == n), F.concat(acc[n], F.array(item(line)))).otherwise(acc[n]).alias(n)
                for n in names
            ],
        )

    folded = F.aggregate(lines, start, step)
    return {n: folded[n] for n in names}


def parse_reviews(df: DataFrame, text: str = "reply") -> DataFrame:
    """Passed flag, issues and suggestions of each review."""
    low = F.lower(text)
    passed = F.contains(low, F.lit("passed: yes")) | F.contains(low, F.lit("passed:yes"))
    parts = _sections(
        F.col(text),
        {
            "issues": lambda x: F.upper(x).startswith("ISSUES"),
            "suggestions": lambda x: F.upper(x).startswith("SUGGESTIONS"),
        },
        lambda x: x.startswith("- "),
        lambda x: tx.strip(F.substring(x, 3, 1_000_000_000)),
    )
    return df.withColumns({"passed": passed, **parts})


def parse_gap_sections(df: DataFrame, text: str = "reply") -> DataFrame:
    """Gaps and suggestions under their two headings."""
    parts = _sections(
        F.col(text),
        {
            "gaps": lambda x: F.contains(x, F.lit("知识缺口")),
            "suggestions": lambda x: F.contains(x, F.lit("建议补充")),
        },
        lambda x: x.startswith("-"),
        lambda x: tx.strip(F.ltrim(x, F.lit("-"))),
    )
    return df.withColumns(parts)


def parse_outline(text: Column) -> Column:
    """Bullet lines of a section outline."""
    return tx.bullets(text, "-*")


def parse_terms(text: Column, max_len: int = 50, n: int = 20) -> Column:
    """Term lines: shorter than ``max_len``, distinct ignoring case, first ``n``."""
    kept = _short_lines(text, max_len)
    cleaned = F.transform(kept, lambda x: tx.strip(F.btrim(tx.strip(F.btrim(x, F.lit("-"))), F.lit("•"))))
    low = F.transform(cleaned, F.lower)
    first = F.filter(
        F.arrays_zip(cleaned.alias("t"), F.transform(low, lambda x, i: F.array_position(low, x) == i + 1).alias("k")), lambda z: z["k"]
    )
    return F.slice(F.transform(first, lambda z: z["t"]), 1, n)


def parse_tags(text: Column, max_len: int = 30, n: int = 5) -> Column:
    """Tag lines: shorter than ``max_len``, first ``n``."""
    cleaned = F.transform(
        _short_lines(text, max_len),
        lambda x: tx.strip(F.btrim(F.btrim(tx.strip(F.btrim(x, F.lit("-"))), F.lit("•")), F.lit("#"))),
    )
    return F.slice(cleaned, 1, n)


def _short_lines(text: Column, max_len: int) -> Column:
    lines = F.transform(F.split(tx.strip(text), "\n"), tx.strip)
    return F.filter(lines, lambda x: (x != "") & (F.length(x) < max_len))


def align_code_comments(blocks: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Comment of ``BLOCK_i:`` lines for block ``i``; the first such line counts."""
    pattern = r"(?m)^.*?BLOCK_(\d+):(.*)$"
    pairs = F.arrays_zip(
        F.regexp_extract_all("reply", F.lit(pattern), F.lit(1)).alias("i"),
        F.regexp_extract_all("reply", F.lit(pattern), F.lit(2)).alias("c"),
    )
    rows = replies.select(key, F.posexplode(pairs).alias("pos", "p")).select(
        key, F.col("p.i").cast("long").alias("i"), "pos", tx.strip(F.col("p.c")).alias("comment")
    )
    firsts = first_per_key(rows, [key, "i"], ["pos"]).select(key, "i", "comment")
    return blocks.join(firsts, [key, "i"], "left").withColumn("comment", F.coalesce("comment", F.lit("")))


def parse_fact_issues(df: DataFrame, key: str) -> DataFrame:
    """Issues from contradiction and attribution replies (``kind``, ``reply``).

    A reply with the all-clear phrase has none.
    """
    conflict = F.col("kind") == "conflict"
    clear = F.when(conflict, F.contains("reply", F.lit("无矛盾"))).otherwise(F.contains("reply", F.lit("归属充分")))
    lines = df.where(~clear).select(key, "kind", F.posexplode(F.split(tx.strip(F.col("reply")), "\n")).alias("pos", "raw"))
    line = tx.strip(F.col("raw"))
    issue = (
        F.when(conflict & line.startswith("矛盾|"), F.concat(F.lit("RAG 交叉验证: "), F.substring(line, 4, 1_000_000_000)))
        .when(
            conflict & ~F.contains(F.lower(line), F.lit("矛盾")) & (F.length(line) > 5),
            F.concat(F.lit("RAG 交叉验证: "), line),
        )
        .when(~conflict & line.startswith("归属问题|"), F.concat(F.lit("来源归属: "), F.substring(line, 6, 1_000_000_000)))
    )
    return lines.select(key, "kind", F.col("pos").cast("long").alias("pos"), issue.alias("issue")).where("issue IS NOT NULL")


def normalize_topics(topics: DataFrame, key: str, seq: str, depth: str = "comprehensive") -> DataFrame:
    """Topics with defaults: unnamed and repeated names dropped, first ``topic_count``.

    ``topics(key, seq, name, status, difficulty, description, topic_count)``.
    """
    default = vocab.DEPTH_PRESETS[depth]["default_topic_count"]
    named = topics.withColumns(
        {
            "name": tx.strip(F.coalesce("name", F.lit(""))),
            "status": F.coalesce("status", F.lit("pending")),
            "difficulty": F.coalesce("difficulty", F.lit("intermediate")),
            "description": F.coalesce("description", F.lit("")),
            "topic_count": F.greatest(F.lit(1), F.coalesce(F.col("topic_count").cast("long"), F.lit(default))),
        }
    ).where("name <> ''")
    firsts = first_per_key(named, [key, "name"], [seq])
    top = row_numbers(firsts, [key], [seq], "topic_rank")
    return top.where(F.col("topic_rank") <= F.col("topic_count"))


def depth_settings(spark) -> DataFrame:
    rows = [{"depth": name, **values} for name, values in vocab.DEPTH_PRESETS.items()]
    fields = [f for f in rows[0] if f != "depth"]
    return spark.createDataFrame(rows, "depth string, " + ", ".join(f"{f} int" for f in fields))


def review_rollup(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews, pass rate and issue count per key."""
    return reviews.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reviews"),
        F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"),
        F.sum(F.size("issues")).alias("issues"),
    )


def flatten_conversations(turns: DataFrame, part_size: int = 1000) -> DataFrame:
    """System text and prompt of each conversation.

    System turns are joined by a blank line, the others as ``[role]`` over their
    text, in turn order, blank ones skipped. A conversation of more than
    ``part_size`` turns continues in further rows (``part``).
    """
    part = F.floor(F.col("turn") / part_size).cast("long").alias("part")
    items = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t")
    grouped = turns.groupBy("conv_id", part).agg(items)
    system = F.filter("_t", lambda t: t["role"] == "system")
    other = F.filter("_t", lambda t: (t["role"] != "system") & ~tx.is_blank(t["text"]))
    return grouped.select(
        "conv_id", "part",
        F.concat_ws("\n\n", F.transform(system, lambda t: t["text"])).alias("system_text"),
        F.concat_ws(
            "\n\n", F.transform(other, lambda t: F.concat(F.lit("["), t["role"], F.lit("]\n"), tx.strip(t["text"])))
        ).alias("prompt"),
    )
