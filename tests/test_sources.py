"""Readers and writers on files of their own."""

import json

from pyspark.sql import functions as F

from corpuswright.operators import publish as pb
from corpuswright.sources import book as bk
from corpuswright.sources import config as cf
from corpuswright.sources import files as fs
from corpuswright.sources import tables as tb


def materials(spark, rows):
    schema = "id string, content string, content_hash string, order_index long, source_type string"
    return spark.createDataFrame(rows, schema)


def test_append_is_idempotent_and_delete_rewrites_what_it_must(spark, rows, tmp_path):
    path = str(tmp_path / "m")
    tb.append_materials(materials(spark, [("a", "x", None, 1, "web"), ("b", "x", None, 2, "web"), ("c", "y", None, 3, "doc")]), path)
    assert {r[0] for r in rows(spark.read.parquet(path), "id")} == {"a", "c"}
    again = tb.append_materials(materials(spark, [("d", "y", None, 1, "web"), ("e", "z", None, 2, "web")]), path)
    assert [r[0] for r in rows(again, "id")] == ["e"]
    doc_files = {p.name for p in (tmp_path / "m" / "source_type=doc").glob("*.parquet")}
    tb.delete_materials(path, spark.createDataFrame([("a",), ("nope",)], "id string"))
    assert {r[0] for r in rows(spark.read.parquet(path), "id")} == {"c", "e"}
    # the partition without a deleted id kept its files
    assert {p.name for p in (tmp_path / "m" / "source_type=doc").glob("*.parquet")} == doc_files
    tb.delete_materials(path, spark.createDataFrame([("c",)], "id string"))
    assert {r[0] for r in rows(spark.read.parquet(path), "id")} == {"e"}
    assert not (tmp_path / "m" / "source_type=doc").exists()


def test_scan_with_schema_prunes_bodies(spark, tmp_path):
    path = str(tmp_path / "m")
    tb.append_materials(materials(spark, [("a", "x", None, 1, "web")]), path)
    df = tb.read_materials(spark, path).where("source_type = 'web'").select("id", "tags")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "PartitionFilters: [isnotnull(source_type" in plan
    assert df.first().tags is None


def test_tolerant_decode(spark):
    df = spark.createDataFrame([('["a"]', '{"k":"v"}'), ("[broken", "nope"), (None, None), ("{}", "[]")], "t string, m string")
    got = tb.decode_json_cols(df, {"t": "array<string>", "m": "map<string,string>"}).collect()
    assert [(r.t, r.m) for r in got] == [(["a"], {"k": "v"}), ([], {}), ([], {}), ([], {})]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame(
        [("m1", "body", [("py", "a=1"), ("", "b")])], "id string, content string, code_blocks array<struct<language:string,code:string>>"
    )
    tb.export_meta(df, str(tmp_path / "meta"))
    meta = json.loads(spark.read.text(str(tmp_path / "meta")).first()[0])
    assert meta["id"] == "m1" and "content" not in meta
    tb.export_code_blocks(df, str(tmp_path / "code"))
    files = spark.read.parquet(str(tmp_path / "code"))
    assert {r.extension for r in files.collect()} == {"py", "txt"}
    assert {(r.file_name, r.code) for r in files.collect()} == {("block_0.py", "a=1"), ("block_1.txt", "b")}


LOG = """2026-01-02 03:04:05,678 - app - INFO - started - ok
2026-01-02 03:04:06,000 - app.sub - ERROR - failed
Traceback (most recent call last):
  File "x"
"""


def test_logs(spark, rows, tmp_path):
    (tmp_path / "2026-01-01.log").write_text("2026-01-01 00:00:00,001 - a - INFO - old\n")
    (tmp_path / "2026-01-02.log").write_text(LOG)
    logs = fs.read_logs(spark, str(tmp_path))
    assert logs.count() == 5
    got = rows(fs.log_filter(logs), "level", "message")
    assert got == [(None, None), (None, None), ("ERROR", "failed"), ("INFO", "started - ok"), ("INFO", "old")]
    assert [r[0] for r in rows(fs.log_filter(logs, "INFO"), "message")] == ["started - ok", "old"]
    assert rows(fs.log_tail(logs, 1), "line") == [('  File "x"',)]
    assert rows(logs.where("level = 'INFO' AND message = 'old'"), F.date_format("ts", "SSS"), "logger") == [("001", "a")]


def test_task_history(spark, rows, tmp_path):
    tasks = [
        {"id": "1", "kind": "k", "status": "running", "progress": 30},
        {"id": "2", "kind": "k", "status": "queued", "error": "own"},
        {"id": "3", "kind": "k", "status": "succeeded", "progress": 100, "result": "r"},
        {"id": "4", "status": "running"},
        {"kind": "k"},
        {"id": "5", "kind": "k"},
    ]
    (tmp_path / "h.json").write_text(json.dumps({"version": 1, "tasks": tasks}, indent=1))
    got = {r[0]: r[1:] for r in rows(fs.read_task_history(spark, str(tmp_path / "h.json")), "id", "status", "progress", "error")}
    assert got == {
        "1": ("interrupted", 100, "The API process stopped before this task reached a terminal state."),
        "2": ("interrupted", 100, "own"),
        "3": ("succeeded", 100, ""),
        "5": ("pending", 0, ""),
    }


def test_tree_and_markdown(spark, rows, tmp_path):
    for name in ("b/x.md", "b/A/deep.md", "Z.md", "a.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n\ntext\n")
    tree = fs.read_kb_tree(spark, str(tmp_path))
    assert rows(tree, "path", "type") == [
        ("b/A", "directory"), ("b", "directory"), ("a.md", "file"), ("b/A/deep.md", "file"), ("b/x.md", "file"), ("Z.md", "file"),
    ]
    assert {r[0] for r in rows(fs.kb_filter(tree, " DEEP "), "path")} == {"b/A/deep.md"}
    assert {r[0] for r in rows(fs.kb_filter(tree, "b/a"), "path")} == {"b/A", "b/A/deep.md"}
    assert set(rows(fs.read_markdown(spark, str(tmp_path)), "content")) == {
        (f"# {n}\n\ntext\n",) for n in ("b/x.md", "b/A/deep.md", "Z.md", "a.md")
    }


def test_images(spark, rows, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"GIF87a...")
    (tmp_path / "b.bin").write_bytes(b"\xff\xd8\xff" + b"0" * (5 * 1024 * 1024))
    assert rows(fs.load_images(spark, str(tmp_path)), "length", "mime") == [(9, "image/gif")]


def test_registry_and_curriculum(spark, rows, tmp_path):
    assert cf.read_registry(spark).count() == len(cf.registry_rows())
    assert cf.read_registry(spark, str(tmp_path / "none.json")).count() == 0
    doc = {
        "goal": "g",
        "domains": [
            {"name": "D", "topics": [{"name": " T1 ", "status": "done"}, {"name": "T2", "search_queries": ["q"]}]},
            {"name": "E", "priority": 1, "topics": []},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    got = rows(cf.read_curriculum(spark, str(tmp_path / "c.json")), "domain", "priority", "topic", "status", "difficulty", "search_queries")
    assert sorted(got, key=str) == [
        ("D", 99, "T1", "done", "intermediate", []),
        ("D", 99, "T2", "pending", "intermediate", ["q"]),
        ("E", 1, "", "pending", "intermediate", []),
    ]


def test_book(spark, rows, tmp_path):
    data = [("One", "Intro", "## a\nbody  \n", 1), ("One", "More: x", "", 2), ("Two", "End", "text.", 3)]
    df = spark.createDataFrame(data, "chapter string, section string, content string, seq long")
    numbered = pb.number_sections(df, "seq", F.lit(0))
    sections = pb.section_quality(numbered.withColumns({"chunk_count": F.lit(2), "passed": F.col("seq") != 3}), 0)
    out = str(tmp_path / "book")
    bk.write_book(sections, spark.createDataFrame([("T",)], "title string"), out)
    files = {r[0].split("sections/")[1].rsplit("/", 1)[0]: r[1] for r in rows(fs.read_markdown(spark, out + "/sections"), "path", "content")}
    assert set(files) == {
        "chapter_dir=01_One/section_file=01_Intro.md",
        "chapter_dir=01_One/section_file=02_More_x.md",
        "chapter_dir=02_Two/section_file=01_End.md",
    }
    first = files["chapter_dir=01_One/section_file=01_Intro.md"]
    assert first.startswith("# Intro\n\n> 出版质量信息\n> - 字符数: 12\n> - 估算长度单位: 2\n> - 写作分块: 2\n> - 风险标记: too_short, abrupt_end\n## a\nbody\n")
    assert "review_failed" in files["chapter_dir=02_Two/section_file=01_End.md"]
    toc = "\n".join(r[0] for r in rows(spark.read.text(out + "/contents")))
    assert "## One" in toc and "- [More: x](01_One/02_More_x.md)  _" in toc
