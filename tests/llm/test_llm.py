"""The operators against brute force, round trips and planted cases; nulls, repeats, ties and empty tables throughout."""

import base64
import collections
import hashlib
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from corpuswright.llm import (  # noqa: E402
    bloom,
    chat,
    components,
    decontam,
    jaccard,
    licences,
    mixing,
    quality,
    queries,
    substring,
    tokens,
    urls,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(x if rng.random() > share else f"x{rng.randrange(10**6)}" for x in text.split())


@pytest.fixture(scope="module")
def texts():
    """Unique ids: plain, exact and near copies of several closeness, shared passages, very short, empty, null, one long."""
    passage = prose(900, 60)
    out = {i: prose(i, 30 + 7 * i) for i in range(30)}
    for i in range(30, 60):
        out[i] = edited(out[i % 6 + 6], i, 0.01 * (i % 9))
    for i in range(60, 72):
        out[i] = f"{prose(i, 40)} {passage}\n{prose(i + 500, 30)}"
    for i in range(72, 80):
        out[i] = out[20].upper() if i % 2 else out[20]
    out |= {80: None, 81: "", 82: " \n\t ", 83: "one two", 84: "One two", 85: "one", 86: "a a a a a " * 30, 87: "a a a a a " * 31}
    out[88] = " ".join([prose(88, 6000), passage, out[25], prose(89, 6000)])
    out[89] = "é 中文 " * 40 + "ÀÉ x " * 25
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 4}" if k % 7 else None, len(t or "")) for k, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(5, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_bloom_filter_never_misses(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    known = bloom.build(keys.where("h % 2 = 0"))
    tried = keys.withColumn("hit", known.might_contain(F.col("h")))
    assert tried.where("h % 2 = 0 AND NOT hit").count() == 0
    assert tried.where("h % 2 <> 0 AND hit").count() < 50
    assert keys.where(bloom.build(keys.where("h IS NULL")).might_contain(F.col("h"))).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    found = dict(rows_of(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_url_rules(spark):
    pages = [
        (1, "https://WWW.Example.com/en/a?x"), (2, "http://example.com/en/"), (3, "http://m.example.com/en"), (4, "http://a.net/es/1"),
        (5, "http://org.org/x.html"), (6, "http://www.org.org/x/"), (7, None), (8, "no scheme"), (9, ""), (9, "http://notexample.com/en/"),
        (10, "http://a.net/es/1"), (None, "http://a.net/es/1#b"),
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in pages], "page_id long, url string, rule string")
    rules = spark.createDataFrame([(h, p, v) for v, h, p in (*queries.URL_RULES, ("allow", "net", "/es/"), ("block", None, "/"))], "host string, path string, verdict string")
    listed = spark.createDataFrame([("org.org/x",), (None,)], "url string")
    out = urls.judge_urls(df, rules, listed)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    found = collections.Counter(rows_of(out.select("page_id", "host", "path", "rule", "verdict")))
    assert found == collections.Counter([
        (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"),
        (3, "m.example.com", "/en", "com/", "allow"), (4, "a.net", "/es/1", "net/es/", "block"), (5, "org.org", "/x.html", None, "block"),
        (6, "www.org.org", "/x/", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
        (9, "notexample.com", "/en/", "com/", "allow"), (10, "a.net", "/es/1", "net/es/", "block"), (None, "a.net", "/es/1", "net/es/", "block"),
    ])
    assert urls.judge_urls(df.limit(0), rules.limit(0), listed.limit(0)).count() == 0


def test_token_counts(spark, docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["x<|endoftext|>y <|endoftext|>", "''s don't\x1c \x85", " \n\n  a　b\xa0c", "😀 ß ½ ², 12.5!?", "x" * 3000]
    extra = spark.createDataFrame([(1000 + i, t, "en", None, 0) for i, t in enumerate(odd)] + [(1000, odd[0], "en", None, 0)], DOCS)
    found = tokens.count_tokens(docs.unionByName(extra).withColumn("n_tokens", F.lit("x")), path, limit=40, keep_text=False)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "n_bytes", "n_tokens", "over_limit"]
    tokenizer = Tokenizer.from_file(path)
    want = []
    for k, t in [*texts.items(), *((1000 + i, t) for i, t in enumerate(odd)), (1000, odd[0])]:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 40))
    assert sorted(rows_of(found.select("doc_id", "n_bytes", "n_tokens", "over_limit"))) == sorted(want)
    assert tokens.count_tokens(empty, path).count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = prose(1, 3000) + "  \n x"
    whole = [p for pieces in tokens._pieces(text) for p in pieces]
    monkeypatch.setattr(tokens, "LONG_TEXT", 100)
    assert [p for pieces in tokens._pieces(text) for p in pieces] == whole


def test_quality_measures_and_verdict(spark, docs, texts, empty):
    good = [(2000 + i, f"The {prose(i, 80, 300)} and this is the end of it.\nWith a line for the {prose(i + 1, 20)}", "en", None, 0) for i in range(120)]
    junk = [(3000 + i, " ".join(f"{w}$$$" for w in prose(i, 90).split()), "en", None, 0) for i in range(12)]
    df = docs.unionByName(spark.createDataFrame(good + junk, DOCS))
    judged = quality.judge(quality.measure(df.withColumn("_q", F.lit(1)))).cache()
    every = {**texts, **{r[0]: r[1] for r in good + junk}}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in judged.select("doc_id", *[f"_q.{n}" for n in names], "base_failed", "kept").collect():
        assert tuple(r)[1:6] == brute.quality(every[r["doc_id"]]), r
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] >= 2000:
            assert r["kept"] == (r["doc_id"] < 3000), r
    assert quality.judge(quality.measure(empty)).count() == 0


def test_estimate_does_not_change_places():
    import numpy as np

    patterns = np.array([[1, 1, 1], [-1, 1, 1], [1, -1, 0]])
    good = quality.estimate(patterns, np.array([900.0, 60.0, 40.0]))
    assert good[0] > 0.9 and good[1] < 0.5 and good[2] < 0.5
    assert len(quality.estimate(patterns[:0], np.zeros(0))) == 0


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rng = random.Random(3)
    html = [f"<p>{prose(i, rng.randrange(400))}\r\n\r\n</p>" for i in range(12)] + ["", None, "é\n中"]
    rows = [(i, f"http://h/{i}\r\nX: y%", html[i % 15]) for i in range(45)]
    rows += [(44, rows[44][1], rows[44][2]), (None, None, html[0]), (None, None, "only"), (7, "http://other", html[7])]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(4), str(tmp_path / "w"))
    best = {}
    for page, url, text in rows:
        key = text or ""
        best[key] = max(best.get(key, (-1, "")), (-1 if page is None else page, url or ""))
    left, want = dict(best), collections.Counter()
    for page, url, text in rows:
        raw = (text or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = (-1 if page is None else page, url or "")
        chosen = left.get(text or "") == first
        if chosen:
            del left[text or ""]
        to = best[text or ""][0]
        want[page, len(raw), digest, "response" if chosen else "revisit", None if chosen or to < 0 else to, (text or "") if chosen else None] += 1
    found = warc.read_records(index)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    assert collections.Counter(rows_of(found.select(*cols))) == want
    assert index.select("archive").distinct().count() > 4
    some = index.where("page_id % 3 = 0")
    assert sorted(rows_of(warc.read_records(some).select("page_id", "url"))) == sorted((p, u) for p, u, _ in rows if p is not None and p % 3 == 0)
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "e"))).count() == 0


def test_substring_dedup(spark, docs, texts, empty):
    want = {k: (len(w), len(w) - len(kept), brute.sha(kept)) for k, (w, kept) in brute.kept_words(texts.items()).items()}
    assert {r[0]: r[1:] for r in rows_of(substring.kept_words(docs))} == want
    assert substring.kept_words(empty).count() == 0


def test_substring_rows_with_one_id(spark):
    long = prose(5, 50)
    rows = [(1, long), (1, long), (None, long), (2, f"{long} tail"), (2, "other")]
    df = spark.createDataFrame([(i, t, "kept", 0) for i, t in rows], "doc_id long, text string, _row string, n_chars long")
    found = substring.remove_repeats(df)
    assert found.columns == df.columns
    # the null id comes first; copies of a row are one document
    assert sorted(rows_of(found), key=repr) == sorted([(1, "", "kept", 0), (1, "", "kept", 0), (None, long, "kept", 0), (2, "tail", "kept", 0), (2, "other", "kept", 0)], key=repr)


def test_mixing(spark, docs, texts, empty):
    found = mixing.mix(docs, block=16, shard_slots=32).cache()
    size = {k: len(brute.WORD.findall(t or "")) for k, t in texts.items()}
    source = {k: f"s{k % 4}" if k % 7 else None for k in texts}
    totals = collections.Counter()
    for k, n in size.items():
        totals[source[k]] += n
    order = ["s0", "s1", "s2", "s3", None]
    weights = dict(zip(order, (5, 2, 1, 5, 2), strict=True))
    target, free, left = {}, set(order), 1.5 * sum(totals.values())
    while True:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > 2 * totals[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * totals[s]
            left -= target[s]
        free -= full
    target |= {s: weights[s] * level for s in free}
    taken = collections.Counter()
    for r in found.collect():
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], totals[source[r["doc_id"]]])
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert found.count() == len(texts)
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * 16 + 1
    again = mixing.mix(docs.repartition(2), block=16, shard_slots=32)
    assert sorted(rows_of(again)) == sorted(rows_of(found))
    assert mixing.mix(empty).count() == 0


def test_mixed_blocks_hold_the_words(spark, docs, texts):
    blocks = mixing.mixed_blocks(docs, block=16, shard_slots=32).collect()
    counted = collections.Counter(w for r in blocks for w in r["text"].split(" "))
    per_doc = mixing.mix(docs, block=16, shard_slots=32).agg(F.sum("taken")).first()[0]
    assert sum(counted.values()) == per_doc
    assert len({(r["shard"], r["slot"]) for r in blocks}) == len(blocks)
    known = {w for t in texts.values() for w in brute.WORD.findall(t or "")}
    assert set(counted) <= known


def test_licences(spark, empty):
    base = [(i, f"{prose(i, 60)}\n{prose(i + 1, 30)}", "en", None, 0) for i in range(60)]
    lines = {"MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    named = [(100 + i, f"{prose(i, 50)}\n{t}\n{prose(i, 5)}", "en", None, 0) for i, t in enumerate(lines.values())]
    other = [(200, "You must have a valid license to drive a car in the general area.", "en", None, 0), (201, None, "en", None, 0), (202, "", "en", None, 0)]
    df = spark.createDataFrame([*base, *named, *named[:1], *other], DOCS)
    model = licences.train(df)
    found = collections.Counter(rows_of(licences.scan(df, model).select("doc_id", "licence")))
    want = collections.Counter([(r[0], None) for r in base + other] + [(100 + i, f) for i, f in enumerate(lines)] + [(100, "MIT")])
    assert found == want
    assert licences.scan(empty, model).count() == 0


WRAPPED = {
    "MIT": """The MIT License (MIT)

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD": """Copyright (c) 2020, A. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation.""",
}


def test_no_template_without_a_mark():
    marks = set(licences.marks())
    for family, pairs in licences.template_pairs():
        bare = [p for p in pairs if marks.isdisjoint(p.split())]
        assert len(bare) < licences.CONFIRM * len(pairs), family


def test_wrapped_licences(spark):
    def marked(text, first, mark, last):
        return "\n".join([first, *[f"{mark} {x}".rstrip() for x in text.split("\n")], last])

    base = [(i, f"{prose(i, 60)}\n{prose(i + 1, 30)}\n\nYou may modify the software.\n", "en", None, 0) for i in range(60)]
    rows, want = list(base), {r[0]: None for r in base}
    for i, (family, text) in enumerate(WRAPPED.items()):
        code = "\n".join(prose(j, 6) for j in range(40))
        forms = [text, text.replace("\n", "\r\n"), f"{prose(i, 20)}\n\n{text}\n\n{prose(i, 90)}"]
        forms += [marked(text, "#!/bin/sh", "#", code), marked(text, "/*", " *", f" */\n{code}"), marked(text, "", "--", code), marked(text, "", "dnl", code)]
        for j, form in enumerate(forms):
            rows.append((100 + 10 * i + j, form, "en", None, 0))
            want[100 + 10 * i + j] = family
    df = spark.createDataFrame(rows, DOCS)
    found = licences.scan(df, licences.train(df)).select("doc_id", "licence", "n_lines").collect()
    assert {r["doc_id"]: r["licence"] for r in found} == want
    assert all((r["n_lines"] > 0) == (r["licence"] is not None) for r in found)


def test_jaccard_join(docs, texts, empty):
    found = jaccard.near_duplicates(docs)
    assert {r[0]: r[1:] for r in rows_of(found)} == brute.components(texts.items())
    assert jaccard.near_duplicates(empty).count() == 0


def test_components_by_shuffles(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (70, 60), (70, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = dict(rows_of(components.components(df)))
    monkeypatch.setattr(components, "SMALL", 0)
    assert few == dict(rows_of(components.components(df)))
    assert few == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 70: 50}


def test_jaccard_weak_classes_leave_no_entry_alone(spark):
    # 1 to 4 share many entries; 5 shares few with 4, and stands in an entry of theirs; 8 and 9 share few
    stars = [(1, 2, 9), (1, 3, 9), (3, 4, 8), (4, 5, 2), (2, 5, 1), (8, 9, 3)]
    stars = spark.createDataFrame(stars, "a long, b long, n long")
    found = dict(rows_of(jaccard._clusters(stars)))
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    named = spark.createDataFrame([(i, 20, i, found.get(i, i)) for i in (1, 2, 3, 4, 5, 8, 9)], "class long, n long, label long, whole long")
    entries = {100: (1, 2, 3, 5), 101: (1, 2, 3, 4, 5), 102: (1, 2, 4, 5), 103: (8, 9)}
    rows = [(e, c) for e, members in entries.items() for c in members]
    member = spark.createDataFrame(rows, "entry long, class long").join(named, "class")
    groups = jaccard._open_groups(member, named).select("level", "group", "class").collect()
    assert sorted(map(tuple, groups)) == [(0, 103, 8), (0, 103, 9), *[(1, 1, i) for i in (1, 2, 3, 4, 5)]]


def test_jaccard_random_small_sets(spark, monkeypatch):
    rng = random.Random(11)
    out = {}
    for i in range(250):
        base = prose(i % 25, rng.choice([3, 5, 6, 7, 8, 9, 11, 14, 20, 33]), 50)
        w = base.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(5)}"
        out[i] = " ".join(w + [f"z{j}" for j in range(rng.randrange(3))])
    df = spark.createDataFrame(list(out.items()), "doc_id long, text string").repartition(4)
    assert {r[0]: r[1:] for r in rows_of(jaccard.near_duplicates(df))} == brute.components(out.items())
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    assert {r[0]: r[1:] for r in rows_of(jaccard.near_duplicates(df))} == brute.components(out.items())


def test_jaccard_open_groups_give_links_not_pairs(spark, monkeypatch):
    # 40 near copies under 40 labels are 780 similar pairs; 40 is too far from each for a link, not for its sketch
    words = prose(31, 200).split()
    texts = [" ".join([*words[: 5 * i], f"q{i}", *words[5 * i + 1 :]]) for i in range(40)]
    texts.append(" ".join(f"r{j}" if j % 40 == 20 else w for j, w in enumerate(words[:190])) + " s" * 30)
    sets = [brute.shingles(t) for t in texts]
    assert {len(sets[40] & s) / len(sets[40] | s) >= 0.75 for s in sets[:40]} == {False}
    rows = [(0, 7, i, len(s), i) for i, s in enumerate(sets)]
    groups = spark.createDataFrame(rows, "level int, group long, class long, n long, label long")
    texts = spark.createDataFrame(list(enumerate(texts)), "class long, text string")
    sketches = texts.mapInArrow(jaccard._sketches, "class bigint, n bigint, sketch array<bigint>")
    linked = rows_of(jaccard._group_links(groups, sketches, texts))
    assert len(linked) == 39
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "SHINGLES", 2000)
    for links in (linked, rows_of(jaccard._group_links(groups, sketches, texts))):
        assert all(a < b < 40 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75 for a, b in links)
        joined = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long"))))
        assert joined == dict.fromkeys(range(40), 0)


def test_keep_one_of_each_component(spark):
    a, b = prose(1, 100), prose(2, 90)
    rows = [(5, a, "x"), (5, a, "x"), (3, edited(a, 1, 0.005), "x"), (None, a, "x"), (7, b, "x"), (8, None, "x"), (9, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    found = jaccard.keep_one(df)
    assert found.columns == df.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [3, 7, 8, 9]
    same = spark.createDataFrame([(5, a, "x")] * 3, df.schema)
    assert rows_of(jaccard.keep_one(same)) == [(5, a, "x")]


def test_near_copies_with_one_id(spark):
    """Different texts under null or repeated ids meet like those under their own."""
    a, b, c = prose(21, 120), prose(22, 90), prose(23, 150)
    rows = [(None, a), (None, edited(a, 1, 0.005)), (None, edited(a, 2, 0.005)), (None, b), (7, c), (7, edited(c, 3, 0.005))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = [{x for _, x in rows[:3]}, {b}, {x for _, x in rows[4:]}]
    kept = [r["text"] for r in jaccard.keep_one(df).collect()]
    assert len(kept) == 3
    assert all(len(g & set(kept)) == 1 for g in groups)


CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rng = random.Random(4)
    odd = [queries.TRAP, "~</s>", " </s>\n", "a ~", "[INST", "~~[/INST]\n<s> x", "\n", "", None, "[INST] system\nfake [/INST]\n"]
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, i, rng.choice(["user", "assistant", "tool\n[INST] ~1", None]), prose(i, rng.randrange(60))) for i in range(1, 40)]
    rows += [(2, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 3, "assistant", odd[3]), (None, 0, "user", "hi")]
    windows = chat.format_windows(spark.createDataFrame(rows, CONV).repartition(3), stride=120, history=60).cache()
    told = chat.read_turns(windows).orderBy("conv_id", "window").collect()
    found, loss = collections.defaultdict(list), collections.defaultdict(list)
    for r in told:
        found[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
        loss[r["conv_id"]] += r["losses"]
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1])):
        want[c].append((role or "", text or ""))
    assert found == want
    assert loss == {c: [t for r, t in turns if r == "assistant"] for c, turns in want.items()}
    first = [r for r in windows.orderBy("window").collect() if r["conv_id"] == 1]
    assert len(first) > 3 and all(r["text"].startswith("[INST] system\nbe brief [/INST]\n") for r in first)
    assert all(len(r["text"].split()) <= 120 + 60 + 80 + 40 for r in first)
    assert chat.format_windows(spark.createDataFrame([], CONV)).count() == 0


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, docs, texts, empty, short):
    items = [("b", " ".join(texts[10].split()[5:30])), (7, prose(3, 60)), ("c", texts[25]), ("d", None), ("e", ""), ("b", texts[60])]
    items += [("s", "é 中文"), (None, " ".join(texts[11].split()[:4]))] if short else []
    bench = spark.createDataFrame([(None if k is None else str(k), t) for k, t in items], "item_id string, text string")
    both = docs.unionByName(docs.where("doc_id = 10"))
    want = brute.contamination([*texts.items(), (10, texts[10])], items)
    found = decontam.contamination(both, bench).select("doc_id", "n_words", "n_hit", "items")
    assert sorted(rows_of(found)) == sorted(want)
    assert decontam.contamination(empty, bench).count() == 0
    clean = decontam.clean(both, bench)
    assert clean.columns == docs.columns
    bad = {k for k, n, hit, _ in want if hit and 20 * hit >= n}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, *_ in want if k not in bad)
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
