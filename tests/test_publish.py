"""Outline coverage, assembly, citations, categories."""

from pyspark.sql import functions as F

from corpuswright.operators import citations as ct
from corpuswright.operators import publish as pb

MAT = "struct<id:string,title:string,source_type:string,source_url:string,references:array<struct<url:string,type:string,title:string>>>"


def one(spark, value, schema, expr):
    return spark.createDataFrame([(value,)], f"m {schema}").select(expr.alias("x")).first()[0]


def test_sources_block(spark):
    refs = [("http://r1", "github", "R1"), ("", "", ""), ("http://r2", "", "")]
    mats = [("1", "A", "web", "http://a", refs), ("2", "", "", "", [])]
    got = one(spark, mats, f"array<{MAT}>", pb.sources_block(F.col("m"), F.array(*[F.lit(u) for u in ("http://a", "http://r1", "http://new", "http://new", "")])))
    assert got.split("\n") == [
        "**来源与延伸阅读：**", "- [web] A - http://a", "  - 延伸 [github] R1 - http://r1", "  - 延伸 [reference] 未命名引用",
        "  - 延伸 [reference] http://r2 - http://r2", "- [source] 2", "- [source] http://new",
    ]
    assert one(spark, [], f"array<{MAT}>", pb.sources_block(F.col("m"), F.array().cast("array<string>"))) == ""


def test_hint(spark):
    mats = [("1", "A", "web", "u", []), ("2", "", "", "http://b", []), ("3", "C", "x", "", []), ("4", "D", "x", "", [])]
    hint = one(spark, mats, f"array<{MAT}>", pb.inline_hint(F.col("m")))
    assert hint == "_来源提示：[web] A；[source] http://b；[x] C_"
    put = pb.inject_hint(F.col("m"), F.lit("H"))
    assert one(spark, "# T\n\nbody\n\nend", "string", put) == "# T\n\nH\n\nbody\n\nend"
    assert one(spark, "body\n\nend", "string", put) == "H\n\nbody\n\nend"
    assert one(spark, "has H\n\nx", "string", put) == "has H\n\nx"


def placed(spark):
    rows = [("s", i, f"m{i}", f"T{i}", "  " if i == 2 else f"body {i} ", "web" if i else "github", f"u{i}", []) for i in range(5)]
    schema = (
        "sec string, pos long, id string, title string, content string, source_type string, source_url string,"
        " references array<struct<url:string,type:string,title:string>>"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


def test_combining_in_parts_keeps_everything(spark, rows):
    whole = rows(pb.combine_materials(placed(spark), ["sec"]), "part", "content")
    assert len(whole) == 1 and whole[0][1].count("正文摘录:") == 4
    parts = sorted(rows(pb.combine_materials(placed(spark), ["sec"], part_size=2), "part", "content"))
    assert "\n\n".join(c for _, c in parts) == whole[0][1]
    assert whole[0][1].startswith("--- 素材: T0 ---\n来源类型: github\n来源链接: u0\n正文摘录:\nbody 0\n\n--- 素材: T1 ---")
    assert rows(pb.section_content_type(placed(spark), ["sec"])) == [("s", "code")]


def test_missing_and_status(spark, rows):
    expected = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "chapter_no long, section_no long, section string")
    done = spark.createDataFrame(
        [(1, 1, "text", None), (1, 2, "", "why")], "chapter_no long, section_no long, content string, reason string"
    )
    missing = pb.missing_sections(expected, done)
    assert sorted(rows(missing, "section", "reason")) == [("b", "why"), ("c", "章节未生成")]
    flagged = spark.createDataFrame([(["too_short"],), ([],)], "flags array<string>")
    none = missing.where(F.lit(False))

    def status(sections, gaps):
        return pb.publish_status(sections, expected, gaps).first().status

    assert status(flagged, none) == "partial"
    assert status(flagged.where("size(flags) = 0"), none) == "success"
    assert status(flagged.where("size(flags) = 0"), missing) == "partial"
    assert status(flagged.where(F.lit(False)), missing) == "error"


def test_citations(spark, rows):
    df = spark.createDataFrame([(1, "see 2401.00001, arXiv:2402.12345v2 and 2401.000012 x2403.11111")], "id long, t string")
    catalog = spark.createDataFrame([("2401.00001",)], "arxiv_id string")
    assert {r[1] for r in rows(ct.verify_citations(df, catalog, "id", "t"))} == {"2402.12345"}
    assert {r[1] for r in rows(ct.verify_citations(df, catalog, "id", "t", require_prefix=True))} == {"2402.12345"}


def test_reference_rounds(spark, rows):
    ref = "array<struct<url:string,type:string,title:string>>"
    mats = spark.createDataFrame([("p", [("g1", "github", ""), ("", "github", ""), ("h", "huggingface", "")])], f"parent_id string, references {ref}")
    plan = spark.createDataFrame([("p", "x1", "arxiv")], "parent_id string, url string, type string")
    store = spark.createDataFrame([("x1",)], "source_url string")
    catalog = spark.createDataFrame([("g1", [("g2", "github", ""), ("g1", "github", "")])], f"source_url string, references {ref}")
    assert rows(ct.follow_references(mats, plan, store, catalog), "url", "depth") == [("g1", 1)]
    assert sorted(rows(ct.follow_references(mats, plan, store, catalog, depth=3), "url", "depth")) == [("g1", 1), ("g2", 2)]


TOC = [{"dir_name": "00_News", "name": "News"}, {"dir_name": "01_AI Theory", "name": "Theory"}]


def test_categories(spark, rows):
    cases = {
        "EXISTING|01_AI Theory": ("01_AI Theory", None),
        "EXISTING|01_AITheory": ("01_AI Theory", None),
        "EXISTING|AI The": ("01_AI Theory", None),
        "EXISTING|unknown": ("00_News", None),
        "well, Theory it is": ("01_AI Theory", None),
        "no idea": ("00_News", None),
        "x\n NEW|05_Agents|about\nEXISTING|00_News": (None, "Agents"),
        "NEW|only name": ("00_News", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "decision string")
    assert {r[0]: r[1:] for r in rows(ct.assign_category(df, TOC))} == cases
    assert ct.assign_category(df, []).where("decision = 'no idea'").first().dir_name == "00_每日资讯"


def test_flows_on_small_tables(spark, rows):
    from corpuswright.plans.flows import ingest_pages, publish

    page = "<html><title>{0}</title><body><article><p>spark joins {0} tables https://github.com/o/r</p></article></body></html>"
    pages = spark.createDataFrame(
        [(1, "http://h/1", page.format("wide")), (2, "http://h/2", page.format("wide")), (3, "http://h/3", page.format("tall")), (4, "http://h/4", "")],
        "page_id long, url string, html string",
    )
    words = spark.createDataFrame([("Spark", "SPARK"), ("Tall", "tall")], "tag string, keyword string")
    got = {r.id: r for r in ingest_pages(pages, words).collect()}
    assert sorted(got) == ["1", "3", "4"]
    assert got["3"].tags == ["Spark", "Tall"] and "tall" in got["3"].terms
    assert [r.url for r in got["1"].references] == ["https://github.com/o/r"]
    assert got["4"].missing_fields == ["missing_title", "content_too_short", "missing_tags", "missing_terms"]
    store = spark.createDataFrame([(got["1"].content_hash, "s", 0)], "content_hash string, id string, order_index long")
    assert sorted(r.id for r in ingest_pages(pages, words, store).collect()) == ["3", "4"]

    materials = ingest_pages(pages, words)
    outline = spark.createDataFrame(
        [(0, "A", "Wide joins", ["1", "9"]), (1, "A", "Tall tables", ["3", "1"]), (2, "B", "Nothing", ["9"])],
        "section_id long, chapter string, section string, material_ids array<string>",
    )
    sections, report = publish(materials, outline, 10)
    assert dict(rows(sections, "section", "related")) == {"Wide joins": ["Tall tables"], "Tall tables": ["Wide joins"]}
    r = report.first()
    assert (r.status, r.expected_sections, r.completed_sections, r.missing_sections) == ("partial", 3, 2, 1)
