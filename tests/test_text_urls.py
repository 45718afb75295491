"""Text and URL expressions on edge cases."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import images as im
from corpuswright.functions import redact as rd
from corpuswright.functions import text as tx
from corpuswright.functions import urls as ur


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://a/x/", "http://a/x"),
        ("http://a/x//", "http://a/x"),
        ("http://a/x/?q=1", "http://a/x/"),
        ("http://a/x#f?q", "http://a/x"),
        ("http://a/x?q#f", "http://a/x"),
        ("", ""),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, ur.url_normalize(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.youtube.com/watch", True),
        ("https://m.youtube.com/watch", False),
        ("https://x.com", True),
        ("https://notx.com/a", False),
        ("https://x.com:8080/", False),
        ("no url", False),
    ],
)
def test_low_quality(spark, url, want):
    assert one(spark, ur.is_low_quality(F.col("u")), u=url) is want


LADDERS = {
    "https://github.com/learn/x": ("github", "github", "github", "github"),
    "https://arxiv.org/abs/1": ("arxiv", "arxiv", "arxiv", "arxiv"),
    "https://docs.site.io/Course": ("doc", "course", "course", "course"),
    "https://site.io/docs/a": ("doc", "web", "web", "wechat"),
    "https://site.io/Tutorial": ("web", "course", "course", "course"),
    "https://mp.weixin.qq.com/s/1": ("web", "web", "wechat", "wechat"),
    "https://plain.io/": ("web", "web", "web", "wechat"),
}


@pytest.mark.parametrize("url", LADDERS)
def test_ladders(spark, url):
    got = tuple(one(spark, ur.classify_url(F.col("u"), p), u=url) for p in ("explorer", "study", "ui", "full"))
    assert got == LADDERS[url]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://github.com/o/r", "o/r"),
        ("https://github.com/o/r/", "o/r"),
        ("https://github.com/o/r.git", "o/r"),
        ("http://github.com/o/r/tree/main", "o/r"),
        ("https://gitlab.com/o/r", ""),
        ("https://github.com/o", ""),
        ("", ""),
    ],
)
def test_repo_name(spark, url, want):
    assert one(spark, ur.repo_name(F.col("u")), u=url) == want


@pytest.mark.parametrize("base", ["http://h.org/a/b.html", "https://h.org", "http://h.org/a/b/"])
@pytest.mark.parametrize(
    "href",
    ["/x/y", "c.html", "../up", "./same", "//cdn.org/z", "https://o.org/q?a=1", "d/e?x=2", "a/../b/./c", "/", "..", "?only=1"],
)
def test_resolve_href(spark, base, href):
    assert one(spark, ur.resolve_href(F.col("b"), F.col("h")), b=base, h=href) == urljoin(base, href)


@pytest.mark.parametrize("href", ["#top", "javascript:void(0)", "mailto:a@b.c", "", "  ", "ftp://h/x", "tel:1"])
def test_resolve_drops(spark, href):
    assert one(spark, ur.resolve_href(F.col("b"), F.col("h")), b="http://h/a", h=href) is None


def test_natural_order(spark, rows):
    paths = ["/c/chapter10/1", "/c/chapter2/10", "/c/chapter2/9", "/c/chapter2", "/c/intro"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in rows(df.orderBy(ur.natural_key(F.col("p"))), "p")]
    assert got == ["/c/chapter2", "/c/chapter2/9", "/c/chapter2/10", "/c/chapter10/1", "/c/intro"]


def test_references(spark):
    text = (
        "see https://github.com/o/r/tree/main and http://github.com/o/r, https://arxiv.org/pdf/2401.00001v2 "
        "https://arxiv.org/abs/2401.00001 https://huggingface.co/m/n https://github.com/only"
    )
    refs = one(spark, ur.references_in(F.col("t")), t=text)
    assert [(r.url, r.type, r.title) for r in refs] == [
        ("https://github.com/o/r", "github", "o/r"),
        ("https://arxiv.org/abs/2401.00001", "arxiv", "arXiv:2401.00001"),
        ("https://huggingface.co/m/n", "huggingface", "m/n"),
    ]


def test_strip_and_lines(spark):
    assert one(spark, tx.strip(F.col("t")), t="　\xa0 a b \n") == "a b"
    assert one(spark, tx.first_error_line(F.col("t")), t="\n  \n  boom \nmore") == "boom"
    assert one(spark, tx.first_error_line(F.col("t")), t="") == ""
    assert one(spark, tx.summarise_text(F.col("t"), 5), t=" a\n\nb  c d e f") == "a b c..."


@pytest.mark.parametrize(
    ("text", "worker", "agent"),
    [
        ("", True, True),
        ("...", True, True),
        ("中文abc", True, True),
        ("中文" + "a" * 20, False, False),
        ("é" * 3 + "中", False, True),  # accents are letters for one policy only
        ("1234567中", False, True),
        ("㐀a", False, True),  # the extension block counts for one policy only
    ],
)
def test_cjk_dominance(spark, text, worker, agent):
    assert one(spark, tx.cjk_dominant(F.col("t"), "worker"), t=text) is worker
    assert one(spark, tx.cjk_dominant(F.col("t"), "agent"), t=text) is agent


def test_units_and_flags(spark):
    assert one(spark, tx.length_units(F.col("t")), t="ab_1 中文 é c") == 4  # the accent is no ASCII word
    good = "## h\n" + "word " * 300 + "end。 \n"
    assert one(spark, tx.section_flags(F.col("t"), 100), t=good) == []
    assert one(spark, tx.section_flags(F.col("t"), 100), t="x") == ["too_short", "abrupt_end", "missing_headings"]


def test_think_and_fence(spark):
    assert one(spark, tx.strip_think(F.col("t")), t="<think>a\n</think>\nb <think>c") == "b"
    assert one(spark, tx.strip_think(F.col("t")), t=" kept ") == " kept "
    assert one(spark, tx.extract_fenced(F.col("t"), "topics:"), t="x\n```yml\na: 1\n```\n```b```") == "a: 1"
    assert one(spark, tx.extract_fenced(F.col("t"), "topics:"), t="so topics: y ") == "topics: y"
    assert one(spark, tx.extract_fenced(F.col("t"), "topics:"), t=" topics: y") == "topics: y"


def test_file_names(spark):
    assert one(spark, tx.safe_filename(F.col("t")), t="第12章 A/B: c?") == "AB_c"
    assert one(spark, tx.safe_filename(F.col("t")), t="3. Intro") == "Intro"
    assert one(spark, tx.safe_filename(F.col("t")), t="???") == "untitled"
    assert one(spark, tx.safe_filename(F.col("t")), t="x" * 50) == "x" * 40
    assert one(spark, tx.safe_article_name(F.col("t")), t="# a/b - ") == "a b"
    assert one(spark, tx.safe_article_name(F.col("t")), t="---") == "未命名文章"


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("import os\ndef f():\n  pass", "python"),
        ("const a = () => 1", "javascript"),
        ("interface A\ntype B = C", "typescript"),
        ("fn main() { a::b }", "rust"),
        ("package main\nx := 1", "go"),
        ("ls\n#!/bin/sh\necho hi", "bash"),
        ("import only", ""),
    ],
)
def test_code_language(spark, code, want):
    assert one(spark, tx.code_language(F.col("c")), c=code) == want


def test_comment_density(spark):
    assert one(spark, tx.comment_density(F.col("c"), F.lit("go")), c="// a\n\nx\ny") == pytest.approx(1 / 3)
    assert one(spark, tx.comment_density(F.col("c"), F.lit("")), c="# a\nx") == 0.5
    assert one(spark, tx.comment_density(F.col("c"), F.lit("go")), c=" \n") is None


def test_sample_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(101))
    got = one(spark, tx.sample_windows(F.col("t"), 10), t=text)
    assert got == f"[开头]\n{text[:10]}\n\n...\n\n[中间]\n{text[45:55]}\n\n...\n\n[结尾]\n{text[-10:]}"
    assert one(spark, tx.sample_windows(F.col("t"), 40), t=text) == text


@pytest.mark.parametrize(
    ("head", "want"),
    [
        (b"\xff\xd8\xff\xe0", "image/jpeg"),
        (b"\x89PNG\r\n\x1a\n..", "image/png"),
        (b"RIFF....WEBP", "image/webp"),
        (b"RIFF....WAVE", "image/png"),
        (b"GIF89a", "image/gif"),
        (b"\x00\x00\x00\x20ftyp", "image/avif"),
        (b"?", "image/png"),
    ],
)
def test_mime(spark, head, want):
    df = spark.createDataFrame([(bytearray(head),)], "c binary")
    assert df.select(im.mime_type(F.col("c"))).first()[0] == want


def test_article_images(spark, rows):
    cases = [
        ("http://a/QRCODE.png", None, "640", "", 0.5, True),
        ("http://a/x.gif", "gif", "99px", "", 0.5, True),
        ("http://a/x.gif", "gif", "100", "", 0.5, False),
        ("http://a/x.png", None, "49", "", 0.5, True),
        ("http://a/x.png", None, "0", "", 0.5, False),
        ("http://a/x.png", None, "auto", "", 0.5, False),
        ("http://a/x.png", None, "640", "请关注", 0.9, True),
        ("http://a/x.png", None, "640", "请关注", 0.5, False),
        ("http://a/mmbiz_gif/1", None, "640", "", 0.1, True),
        ("http://a/mmbiz_gif/1", None, "640", "", 0.5, False),
    ]
    df = spark.createDataFrame(cases, "src string, kind string, width string, ctx string, pos double, want boolean")
    test = im.is_decorative_article(*[F.col(c) for c in ("src", "kind", "width", "ctx", "pos")])
    assert rows(df.where(test != F.col("want"))) == []


def test_redact_is_recursive(spark):
    schema = (
        "name string, api_key string, key_env string, empty_token string, n_key int,"
        " deep struct<password:string,list:array<struct<secret:string,ok:string>>>, m map<string,string>"
    )
    row = ("n", "k", "k", "", 7, ("p", [("s", "o")]), {"A_Secret": "x", "b": "y", "T_TOKEN_ENV": "z"})
    got = rd.redact(spark.createDataFrame([row], schema)).first()
    assert (got.name, got.api_key, got.key_env, got.empty_token, got.n_key) == ("n", "***", "k", "", None)
    assert got.deep.password == "***"
    assert tuple(got.deep.list[0]) == ("***", "o")
    assert got.m == {"A_Secret": "***", "b": "y", "T_TOKEN_ENV": "z"}
