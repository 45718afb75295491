"""Filter audit, spelling variants and sharding against plain Python versions."""

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import interactions, shards, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit ---------------------------------------------------------------------


def masks(docs):
    """Failed filters of ``(doc_id, text, lang)`` rows, as sets of letters."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = []
    for i, text, _ in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        out.append({k for k, v in fails.items() if v})
    return out


def audited(docs, labels):
    good, toxic = collections.Counter(), collections.Counter()
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    rows = [((lang or ""), m, good[i] if i is not None else 0, toxic[i] if i is not None else 0) for (i, _, lang), m in zip(docs, masks(docs), strict=True)]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                hit = [r for r in left if letter in r[1]]
                total[letter] += len(hit)
                early = sum(letter in r[1] for r in mine) - len(hit)
                left = [r for r in left if letter not in r[1]]
                alone = sum(r[1] == {letter} for r in mine)
                out[part, "".join(order), step] = [len(left), len(hit), early, alone, sum(r[2] for r in hit), sum(r[3] for r in hit)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one two", "ONE TWO", "a # b", "x y z " * 60, "Aa Bb " * 60 + "$"]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([20, 99, 100, 101, 150]))) for _ in range(40)]
    texts += ["\x0b".join(f"Q{j}" for j in range(120)), "é\x1f" * 130, " ".join(str(j) for j in range(30_000))]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(260)]
    docs += [(7, "one two", "en"), (7, "one two", "de"), (None, "one two", "en"), (None, None, None), (None, "one two", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit(spark, rows, audit_rows):
    docs, labels = audit_rows
    # columns named like the operator's own do no harm
    d = spark.createDataFrame([(*r, 1, "x", True) for r in docs], "doc_id long, text string, lang string, mask int, body string, first boolean")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = interactions.audit(interactions.failure_cells(d.repartition(5), table))
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows(found)}
    assert len(got) == 3 * 600 and got == audited(docs, labels)


def test_audit_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(interactions.failure_cells(d, labels)).count() == 0
    one = spark.createDataFrame([(1, None, None)], d.schema)
    assert interactions.audit(interactions.failure_cells(one, labels)).count() == 600


def test_audit_of_other_rules(spark, rows):
    d = spark.createDataFrame([(i, f"t{i % 3}", "x") for i in range(9)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    cells = interactions.failure_cells(d, labels, rules={"A": F.col("doc_id") < 2}, copies="B")
    got = sorted(rows(interactions.audit(cells, "AB")))
    assert got == [
        ("x", "AB", 1, 7, 2, 0, 2, 1, 1, 4), ("x", "AB", 2, 1, 6, 0, 6, 0, 0, 12), ("x", "BA", 1, 3, 6, 0, 6, 0, 0, 12), ("x", "BA", 2, 1, 2, 0, 2, 1, 1, 4),
    ]


def test_the_row_limit_is_put_back(spark, rows):
    before = spark.conf.get(interactions.ROW_LIMIT)
    parts = spark.range(3200).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").alias("lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = interactions.failure_cells(parts, labels)
    assert interactions.prefixes(cells).count() == 3200 * 325  # beyond the default limit of a million rows
    assert spark.conf.get(interactions.ROW_LIMIT) == before


# --- spelling variants ----------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def grouped(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def words_of(rng, n):
    letters = "abcdeé×ÿÀ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(out)
        i = rng.randrange(len(w) + 1)
        out.append(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return out


def test_vocabulary(spark, rows):
    rng = random.Random(3)
    words = words_of(rng, 60)
    docs = [(i if i % 9 else None, " ".join(rng.choices(words, k=80)).replace("a", rng.choice("aA"))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "12 ab_abcde,abcde;abcde-ABCDE"), (502, "ÀÉÎÕÜ àéîõü " * 4), (7, "x" * 50_000 + " " + "solid " * 5)]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, n long").repartition(4)
    assert dict(rows(spelling.vocabulary(d))) == vocabulary(docs)
    assert spelling.vocabulary(d.where("false")).count() == 0


@pytest.mark.parametrize("symbols", [None, 2, 5, len(spelling.LETTERS)])
def test_variants(spark, rows, symbols):
    rng = random.Random(4)
    words = {w.lower(): rng.choice([3, 3, 4, 6, 12, 24, 50]) for w in words_of(rng, 150)}
    words |= {"aaaaa": 4, "aaaaaa": 8, "aaaaaaa": 16, "aaaaaaaa": 32, "bbbbb": 6, "bbbba": 6, "ccccc": 5, "cccca": 10, "ccccb": 10}
    d = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = set(rows(spelling.variants(d, symbols=symbols), "word", "n", "n_near", "form", "form_n", "root"))
    assert got == grouped(words)
    assert spelling.variants(d.where("false")).count() == 0


# --- sharding -------------------------------------------------------------------------


def sharded(spark, docs, k, links=None):
    d = spark.createDataFrame([(*r, 1, "h", 2) for r in docs], "doc_id long, text string, shard int, hub string, row int").repartition(6)
    return [tuple(r) for r in shards.shard_documents(d, k, links).collect()]


def test_shards(spark):
    rng = random.Random(6)
    docs = [(i, "x" * rng.randrange(50, 150)  + str(i)) for i in range(1500)]
    for g in range(100):  # small groups of copies
        docs += [(2000 + 20 * g + j, f"copy {g} " * 12) for j in range(rng.randrange(2, 12))]
    docs += [(9000 + j, "hot copy " * 20) for j in range(900)]  # a third of all rows, more than one shard holds
    docs += [(None, "no id " * 20), (None, "no id " * 20), (5, "é" * 60), (5, "é" * 60), (9990, None), (9991, "")]
    got = sharded(spark, docs, 10)
    assert sorted((r[0] is None, r[0], r[1], r[2]) for r in got) == sorted(
        (i is None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs
    )
    sizes, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for i, size, crc, shard, slot in got:
        sizes[shard] += size
        slots[shard].append(slot)
        groups[crc][shard] += 1
    assert set(sizes) == set(range(10)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len((t or "").encode()) + 16 for _, t in docs)
    hot = groups.pop(zlib.crc32(("hot copy " * 20).encode()))
    assert sum(n for _, n in hot.most_common(5)) > 850  # its bytes fill about four shards
    split = [g for g in groups.values() if sum(g.values()) > 1 and len(g) > 1]
    assert len(split) <= 10  # of over a hundred groups, about those that the end of a shard cuts


def test_shards_by_links(spark):
    docs = [(i, f"text {i} " * 5) for i in range(400)]
    links = spark.createDataFrame([(i, i // 8) for i in range(400)] + [(None, 3), (77777, 4)], "doc_id long, hub long")
    got = {r[0]: r[3] for r in sharded(spark, docs, 5, links)}
    together = sum(len({got[i] for i in range(g, g + 8)}) == 1 for g in range(0, 400, 8))
    assert together >= 40


def test_shards_of_little(spark):
    assert sharded(spark, [], 4) == []
    got = sharded(spark, [(1, "a"), (1, "a"), (2, None)], 4)
    assert sorted(r[:2] for r in got) == [(1, 17), (1, 17), (2, 16)]
    long = sharded(spark, [(0, "y" * 100_000)] + [(i, "z" * i) for i in range(1, 40)], 4)
    assert sum(r[3] == next(x[3] for x in long if x[0] == 0) for r in long) == 1  # the long one fills its shard alone
