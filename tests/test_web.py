"""Pages to text, materials, links, course plans and crawls."""

import pytest
from pyspark.sql import functions as F

from corpuswright.functions.html import page_material, page_text
from corpuswright.operators import web as wb

PAGE = """<!DOCTYPE html><html><head><title>Guide &amp; notes</title><style>p{}</style>
<script>var a = "<p>no</p>";</script></head><body>
<nav><a href="/menu">Menu</a></nav><header>Top</header>
<article class="main"><h1>First <b>steps</b></h1>
<p>Hello  world</p>
<img src="/img/a.png" alt="Plot"><img data-src="https://cdn/x.jpg"><img alt="none">
<pre><code class="hl language-python">x = 1
y = 2</code></pre><aside>Advert</aside><h2></h2>
<p>Open <i>item<p>After</article>
<a href="sub/one.html">One</a> <a href='https://o.org/z#part'>Z</a> <a href=/bare>B</a> <a href="#x">x</a>
<a href="javascript:go()">j</a><a href="mailto:a@b">m</a><!-- <a href="/hidden">h</a> -->
<footer>Bottom</footer></body></html>"""


def test_text():
    text = page_text(PAGE)
    assert text.split("\n")[:4] == ["Guide & notes", "First steps", "Hello", "world"]
    assert "no" not in text.split("\n") and "Menu" not in text and "Bottom" not in text and "hidden" not in text
    assert page_text("a &lt;b&gt; c") == "a <b> c"
    assert page_text("") == ""


def test_material():
    m = page_material(PAGE, "http://h.org/p/q")
    assert m["title"] == "Guide & notes"
    assert [(i["url"], i["alt"], i["idx"]) for i in m["images"]] == [
        ("http://h.org/img/a.png", "Plot", 0), ("https://cdn/x.jpg", "", 1),
    ]
    assert m["code_blocks"] == [{"language": "python", "code": "x = 1\ny = 2", "comment": ""}]
    assert m["headings"] == [{"level": 1, "text": "Firststeps"}]
    assert m["content"].startswith("First\nsteps\nHello  world\n[IMAGE_0: Plot]\n[IMAGE_1: image]\n\n```python\nx = 1")
    assert "Advert" not in m["content"] and "One" not in m["content"]
    assert m["images"][0]["position"] == len("First\nsteps\nHello  world\n[IMAGE_0: Plot]")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body>x<main>y</main></body>", "y"),
        ('<div id="js_content">w</div><div class="post">p</div>', "w"),
        ('<div class="Blog-Post">p</div><p>q', "p"),
        ("<body><p>b</body>", "b"),
        ("plain", "plain"),
        ("<article>a<script>s</script></article>", "a"),
    ],
)
def test_main_area(html, want):
    assert page_material(html, "")["content"] == want


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_links(spark, rows):
    df = pages(spark, ("http://h.org/p/q", PAGE))
    assert {r[0] for r in rows(wb.extract_links(df), "link")} == {
        "http://h.org/menu", "http://h.org/p/sub/one.html", "https://o.org/z", "http://h.org/bare",
    }


def test_titles(spark, rows):
    df = pages(spark, ("u", "<TITLE>\nA - B | C</TITLE>"), ("u", "<p>none"))
    html = F.col("html")
    assert rows(df, wb.page_title(html), wb.article_title(html)) == [("\nA - B | C", "A"), ("", "")]


COURSE = """<a href="/c/k/chapter2/1">2</a><a href="/c/k/chapter10/1">10</a><a href="/c/other">o</a><a href="http://x.org/c/k/9">x</a>
<div data-p='{"u": "k/chapter3/2", "v": "/c/k/chapter1"}'></div>"""


def test_course_links(spark, rows):
    df = pages(spark, ("http://h.org/c/k", COURSE))
    got = [r[0] for r in sorted(rows(wb.discover_course_links(df), "link", "ord"), key=lambda r: r[1])]
    root = "http://h.org/c/k/"
    # the source scan also sees the path inside the link to the other host
    assert got == [root + x for x in ("9", "chapter1", "chapter2/1", "chapter3/2", "chapter10/1")]
    assert wb.plan_course(df, cap=2).count() == 2


def test_plan_falls_back_to_same_path_links(spark, rows):
    df = pages(spark, ("http://h.org/a", '<a href="/a">self</a><a href="/ab">next</a><a href="/b">other</a>'))
    assert rows(wb.plan_course(df), "link") == [("http://h.org/ab",)]


def test_course_root_stops_at_first_decrease(spark, rows):
    def anchors(*hrefs):
        return "".join(f'<a href="{h}">x</a>' for h in hrefs)

    df = pages(
        spark,
        ("http://h/l/c/u1/p1", anchors("/l/c/u1/p1/a")),
        ("http://h/l/c/u1", anchors("/l/c/u1/p1", "/l/c/u1/p2", "/l/c/u1/en")),
        ("http://h/l/c", anchors("/l/c/u1")),
        ("http://h/l", anchors(*[f"/l/x{i}" for i in range(9)])),
        ("http://h/none", ""),
    )
    starts = spark.createDataFrame([("http://h/l/c/u1/p1",), ("http://h/none",), ("http://h/unknown/z",)], "start_url string")
    assert sorted(rows(wb.course_root(starts, df))) == [
        ("http://h/l/c/u1/p1", "http://h/l/c/u1", 2), ("http://h/none", "http://h/none", 0), ("http://h/unknown/z", "http://h/unknown/z", 0),
    ]


def site(spark):
    def u(p):
        return "http://h/d" if p == "r" else f"http://h/d/{p}"

    links = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "r"), ("b", "x"), ("x", "y"), ("a", "out")]
    edges = spark.createDataFrame(
        [(u(s), u(t) if t != "out" else "http://h/other") for s, t in links], "src_url string, dst_url string"
    )
    known = [(u(p), p != "x") for p in "rabcxy"] + [("http://h/other", True)]
    roots = spark.createDataFrame([(u("r"),)], "root_url string")
    return edges, spark.createDataFrame(known, "url string, changed boolean"), roots


def crawl(spark, rows, **kw):
    return [("r" if u.endswith("/d") else u[-1], d) for u, d, _ in sorted(rows(wb.crawl_frontier(*site(spark), **kw), "url", "depth", "ord"), key=lambda r: r[2])]


def test_crawl(spark, rows):
    assert crawl(spark, rows, depth=0) == [("r", 0)]
    assert crawl(spark, rows, depth=5, max_pages=50) == [("r", 0), ("a", 1), ("b", 1), ("c", 2)]
    assert crawl(spark, rows, depth=5, max_pages=2) == [("r", 0), ("a", 1)]
    # following unchanged pages reaches y through x
    assert ("y", 3) in crawl(spark, rows, depth=5, max_pages=50, follow_unchanged=True)


def test_code_blocks(spark, rows):
    text = "t\n```python\nprint(1) # one\n```\n```\nshort\n```\n```\nimport os\ndef f(): pass\n```"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    assert rows(wb.extract_code_blocks(df, "id", F.col("t")), "i", "language", "code") == [
        (0, "python", "print(1) # one"), (1, "python", "import os\ndef f(): pass"),
    ]


ARTICLE = (
    '<body><p>outside</p><div id="js_content"><p>One <b>two</b></p><img data-src="https://i/head_mmbiz_gif"><script>x</script>'
    '<section>Mid<img data-src="https://i/plot.png" data-w="640"><img src="/relative.png"><img data-src="https://i/tiny.png" width="20px"></section>'
    '<p>a</p><p>b</p><p>c</p><p>d</p><p>e</p><p>关注我<img data-src="https://i/code.png"></p></div></body>'
)


def test_article_body(spark):
    df = pages(spark, ("u", ARTICLE), ("u", "<p>a</p><p>b"), ("u", '<div id="js_content"></div>'))
    (text, images), plain, blank = [tuple(r)[1:] for r in wb.pages_to_articles(df).orderBy("page_id").collect()]
    assert images == ["https://i/plot.png"]
    assert text.startswith("Onetwo\n\nMid\n\n![](https://i/plot.png)\n\na\n\nb") and text.endswith("关注我")
    assert plain == ("ab", []) and blank == ("", [])


def test_article_plan(spark, rows):
    html = "https://github.com/o/r https://github.com/o/r http://arxiv.org/abs/2401.00001 https://github.com/solo"
    df = pages(spark, ("http://mp/1", html))
    assert rows(wb.plan_article(df), "kind", "ord", "url") == [
        ("page", 0, "http://mp/1"), ("github", 0, "https://github.com/o/r"), ("arxiv", 0, "http://arxiv.org/abs/2401.00001"),
    ]
    assert rows(wb.pages_to_articles(df), "images") == [([],)]


def test_crawl_from_seeds(spark, rows):
    """Seeds stand for the root, links out of them are followed, pages met before are not visited again."""
    edges = [("h/a", "h/x"), ("h/a", "h/b"), ("h/b", "h/y"), ("h/x", "h/z"), ("h/b", "other/q"), ("k/a", "k/x")]
    full = lambda u: f"https://{u}"
    e = spark.createDataFrame([(full(a), full(b)) for a, b in edges], "src_url string, dst_url string")
    pages = [(full(u), u != "h/b") for u in ("h/a", "h/b", "h/x", "h/y", "h/z", "k/a", "k/x", "other/q")]
    p = spark.createDataFrame(pages, "url string, changed boolean")
    seeds = spark.createDataFrame([(full("h"), full("h/a")), (full("h"), full("h/b")), (full("k"), full("k/a")), (full("n"), full("n/a"))], "root_url string, url string")
    roots = seeds.select("root_url").distinct()
    got = sorted(rows(wb.crawl_frontier(e, p, roots, 2, 9, seeds=seeds), "root_url", "url", "depth"))
    want = [("h", "h/a", 0), ("h", "h/x", 1), ("h", "h/z", 2), ("k", "k/a", 0), ("k", "k/x", 1)]
    assert got == [(full(r), full(u), d) for r, u, d in want]
    got = rows(wb.crawl_frontier(e, p, roots, 1, 9, True, seeds).where("depth = 1"), "url")
    assert sorted(got) == [(full("h/x"),), (full("h/y"),), (full("k/x"),)]


def test_pages_are_read_a_few_at_a_time():
    """A batch of many pages is not held as Python objects, nor are its results."""
    import pyarrow as pa

    class Pages:
        def mapInArrow(self, run, schema):
            return run

    read = []
    run = wb._read_pages(Pages(), lambda row: read.append(row) or {"page_id": row["page_id"]}, "page_id long")
    out = run(iter([pa.RecordBatch.from_pylist([{"page_id": i} for i in range(1000)])]))
    assert next(out).num_rows == len(read) == wb.AT_ONCE
    assert sum(b.num_rows for b in out) == 1000 - wb.AT_ONCE
