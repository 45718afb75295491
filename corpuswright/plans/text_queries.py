"""Queries over text, URL and image expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as im
from ..functions import redact as rd
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import repos as rp
from .binding import documents, events, pages, table
from .registry import query

WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NORM = "regexp_replace(rtrim({c}, '/'), '[#?].*$', '')"
AUTH = "regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = "regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"

#: A link per page: half of the paths get a word some ladder looks for.
LADDER_SQL = """SELECT page_id, url || CASE WHEN contains(url, 'm.') THEN '/docs/learn'
    WHEN contains(url, 'blog.') THEN '/Tutorial/arxiv.org' WHEN contains(url, 'page=2') THEN '/github.com/a/b'
    WHEN contains(url, '.html') THEN '/mp.weixin.qq.com' WHEN contains(url, 'utm') THEN '/readthedocs'
    ELSE '' END AS url FROM pages"""


def _ladder(spark, d):
    url = F.col("url")
    tail = (
        F.when(F.contains(url, F.lit("m.")), "/docs/learn")
        .when(F.contains(url, F.lit("blog.")), "/Tutorial/arxiv.org")
        .when(F.contains(url, F.lit("page=2")), "/github.com/a/b")
        .when(F.contains(url, F.lit(".html")), "/mp.weixin.qq.com")
        .when(F.contains(url, F.lit("utm")), "/readthedocs")
        .otherwise("")
    )
    return table(spark, d, "pages").select("page_id", F.concat(url, tail).alias("url"))


@query("b2_url_normalize", f"SELECT page_id, {NORM.format(c='url')} AS norm_url FROM pages")
def b2(spark, d):
    return table(spark, d, "pages").select("page_id", ur.url_normalize(F.col("url")).alias("norm_url"))


@query(
    "b3_drop_low_quality",
    f"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '/de/') THEN replace(url, 'example.com', 'x.com')
        WHEN contains(url, '/fr/') THEN 'https://www.reddit.com/' || page_id ELSE url END AS url FROM pages)
    SELECT page_id, url FROM p WHERE replace({AUTH.format(c='url')}, 'www.', '') NOT IN ('youtube.com',
    'twitter.com', 'x.com', 'facebook.com', 'reddit.com', 'medium.com', 'readmedium.com', 'stackoverflow.com')""",
)
def b3(spark, d):
    url = F.col("url")
    moved = (
        F.when(F.contains(url, F.lit("/de/")), F.replace(url, F.lit("example.com"), F.lit("x.com")))
        .when(F.contains(url, F.lit("/fr/")), F.concat(F.lit("https://www.reddit.com/"), F.col("page_id")))
        .otherwise(url)
    )
    rows = table(spark, d, "pages").select("page_id", moved.alias("url"))
    return rows.where(~ur.is_low_quality(F.col("url")))


@query(
    "b4_classify_url",
    f"""WITH p AS ({LADDER_SQL}), f AS (SELECT *, contains(url, 'github.com') AS g, contains(url, 'arxiv.org') AS a,
        contains(url, 'mp.weixin.qq.com') AS w, regexp_matches(lower(url), 'learn|course|tutorial') AS lc,
        regexp_matches(url, 'learn|course|tutorial') AS c,
        regexp_matches(url, 'docs[.]|documentation|readthedocs') AS dd FROM p)
    SELECT page_id, CASE WHEN g THEN 'github' WHEN a THEN 'arxiv' WHEN dd OR contains(url, '/docs/') THEN 'doc'
             WHEN c THEN 'course' ELSE 'web' END AS explorer,
           CASE WHEN g THEN 'github' WHEN a THEN 'arxiv' WHEN lc THEN 'course' ELSE 'web' END AS study,
           CASE WHEN w THEN 'wechat' WHEN a THEN 'arxiv' WHEN g THEN 'github' WHEN lc THEN 'course'
             WHEN dd THEN 'doc' ELSE 'web' END AS ui,
           CASE WHEN g THEN 'github' WHEN a THEN 'arxiv' WHEN w THEN 'wechat' WHEN lc THEN 'course'
             ELSE 'wechat' END AS full_mode FROM f""",
)
def b4(spark, d):
    u = F.col("url")
    return _ladder(spark, d).select(
        "page_id",
        ur.classify_url(u, "explorer").alias("explorer"),
        ur.classify_url(u, "study").alias("study"),
        ur.classify_url(u, "ui").alias("ui"),
        ur.classify_url(u, "full").alias("full_mode"),
    )


@query(
    "b5_repo_name",
    """SELECT doc_id, CASE lang WHEN 'fr' THEN '' ELSE lang || '/' || source END AS repo FROM documents""",
)
def b5(spark, d):
    """French rows carry an owner only, which is no repository name."""
    full = F.concat(F.lit("https://github.com/"), "lang", F.lit("/"), "source", F.lit(".git/tree/main"))
    url = F.when(F.col("lang") == "fr", F.concat(F.lit("https://github.com/"), "lang", F.lit("/"))).otherwise(full)
    return table(spark, d, "documents").select("doc_id", ur.repo_name(url).alias("repo"))


@query(
    "b6_arxiv_id",
    """SELECT doc_id, regexp_extract(text || ' https://arxiv.org/pdf/2401.' || lpad(doc_id::VARCHAR, 5, '0')
    || 'v2', '(\\d{4}\\.\\d{4,5})', 1) AS arxiv_id FROM documents""",
)
def b6(spark, d):
    url = F.concat(
        F.col("text"), F.lit(" https://arxiv.org/pdf/2401."), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("v2")
    )
    return table(spark, d, "documents").select("doc_id", ur.arxiv_id(url).alias("arxiv_id"))


#: Text with CJK runs in the French and German rows.
MIXED_SQL = """SELECT doc_id, lang, text || CASE lang WHEN 'fr' THEN repeat('中文', length(text) // 4)
    WHEN 'de' THEN ' 机器㐀学习' ELSE '' END AS text FROM documents"""


def _mixed(spark, d):
    tail = (
        F.when(F.col("lang") == "fr", F.repeat(F.lit("中文"), F.floor(F.length("text") / 4).cast("int")))
        .when(F.col("lang") == "de", " 机器㐀学习")
        .otherwise("")
    )
    return documents(spark, d).select("doc_id", "lang", F.concat("text", tail).alias("text"))


CJK_N = "len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))"
CJKX_N = "len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]'))"


@query(
    "b8_has_cjk",
    f"""WITH m AS ({MIXED_SQL})
    SELECT doc_id, regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') AS cjk,
      CASE lang WHEN 'de' THEN source_q WHEN 'fr' THEN source_q ELSE text_q END AS english
    FROM (SELECT doc_id, lang, text, text || '|plain' AS text_q, 'plain' AS source_q FROM m
          WHERE NOT regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]')
          UNION ALL SELECT doc_id, lang, text, 'plain', 'plain' FROM m
          WHERE regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]'))""",
)
def b8(spark, d):
    rows = _mixed(spark, d)
    first = F.col("text")
    marked = F.when(F.col("lang").isin("de", "fr"), F.concat(first, F.lit("中"))).otherwise(first)
    queries = F.array(marked, F.lit("plain"), F.lit("图像"))
    english = tx.split_by_script(queries, cjk=False)
    return rows.select("doc_id", tx.has_cjk(F.col("text")).alias("cjk"), F.concat_ws("|", english).alias("english"))


@query(
    "b9_cjk_dominant",
    f"""WITH m AS ({MIXED_SQL}), n AS (SELECT doc_id, text, {CJK_N} AS c, {CJKX_N} AS cx,
        length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS w,
        length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS l FROM m)
    SELECT doc_id, CASE WHEN w = 0 THEN true ELSE c / w > 0.3 END AS worker,
           CASE WHEN cx + l = 0 THEN true ELSE cx / (cx + l) >= 0.3 END AS agent FROM n""",
)
def b9(spark, d):
    t = F.col("text")
    return _mixed(spark, d).select(
        "doc_id", tx.cjk_dominant(t, "worker").alias("worker"), tx.cjk_dominant(t, "agent").alias("agent")
    )


@query(
    "b10_length_units",
    f"""WITH m AS ({MIXED_SQL})
    SELECT doc_id, ({CJK_N} + len(regexp_extract_all(text, '[A-Za-z0-9_]+')))::BIGINT AS units FROM m""",
)
def b10(spark, d):
    return _mixed(spark, d).select("doc_id", tx.length_units(F.col("text")).alias("units"))


@query(
    "b11_section_flags",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9_]+')) < 260 THEN 'too_short' END,
        CASE WHEN NOT regexp_matches(rtrim(text, {WS}), '[。！？.`|]$') THEN 'abrupt_end' END,
        CASE WHEN NOT contains(text, '## ') THEN 'missing_headings' END) AS flags FROM documents""",
)
def b11(spark, d):
    return documents(spark, d).select(
        "doc_id", F.concat_ws(",", tx.section_flags(F.col("text"), 400)).alias("flags")
    )


IMAGE_SQL = """SELECT doc_id, unnest([0, 1, 2]) AS i, unnest([
      'https://cdn.example/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.SVG?x=1' ELSE '.png' END,
      'https://cdn.example/' || CASE lang WHEN 'fr' THEN 'QRcode' WHEN 'de' THEN 'mmbiz' ELSE source END || '/' || doc_id || '.gif',
      'https://cdn.example/fig/' || doc_id || '.jpg']) AS url,
    unnest([source, lang, CASE source WHEN 'src1' THEN 'Site Logo' WHEN 'src2' THEN 'badge' ELSE 'figure' END]) AS alt
    FROM documents"""


def _images(spark, d):
    doc = F.col("doc_id").cast("string")
    cdn = F.lit("https://cdn.example/")
    lang, src = F.col("lang"), F.col("source")
    first = F.concat(cdn, src, F.lit("/"), doc, F.when(lang == "en", ".SVG?x=1").otherwise(".png"))
    second = F.concat(cdn, F.when(lang == "fr", "QRcode").when(lang == "de", "mmbiz").otherwise(src), F.lit("/"), doc, F.lit(".gif"))
    third = F.concat(cdn, F.lit("fig/"), doc, F.lit(".jpg"))
    alt3 = F.when(src == "src1", "Site Logo").when(src == "src2", "badge").otherwise("figure")
    pairs = [(first, src), (second, lang), (third, alt3)]
    return table(spark, d, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        F.array(*[F.struct(u.alias("url"), a.alias("alt")) for u, a in pairs]).alias("images"),
    )


@query(
    "b15_decorative_web",
    f"""WITH i AS ({IMAGE_SQL})
    SELECT doc_id, string_agg(url, ' ' ORDER BY i) AS kept FROM i
    WHERE NOT regexp_matches(lower(url), 'qrcode|reward|donate|sponsor|ad_|banner|tracking')
      AND NOT regexp_matches(lower(alt), 'icon|logo|badge|shield')
      AND NOT (lower(url) LIKE '%.gif' AND contains(lower(url), 'mmbiz'))
      AND NOT (lower(url) LIKE '%.svg' OR contains(lower(url), '.svg?'))
    GROUP BY doc_id""",
)
def b15(spark, d):
    kept = im.keep_web_images(F.col("images"))
    return _images(spark, d).select("doc_id", F.concat_ws(" ", F.transform(kept, lambda x: x["url"])).alias("kept")).where("kept <> ''")


@query(
    "b16_decorative_article",
    """WITH i AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS pos,
        unnest(['https://a/' || source || '.png', 'https://a/mmbiz_gif/' || doc_id, 'https://a/Reward/' || doc_id,
                'https://a/x.png', 'https://a/mmbiz_gif/tail']) AS src,
        unnest(['gif', 'gif', '', '', '']) AS data_type,
        unnest([n_chars::VARCHAR || 'px', '640', '640', CASE lang WHEN 'en' THEN '30' ELSE 'wide' END, '640']) AS width,
        lang FROM documents)
    SELECT doc_id, pos::BIGINT AS pos, (regexp_matches(lower(src), 'qrcode|reward|qr_code|donate|red_packet')
        OR (data_type = 'gif' AND w >= 0 AND w < 100) OR (w > 0 AND w < 50)
        OR (pos / 4 > 0.8 AND lang = 'fr') OR (contains(src, 'mmbiz_gif') AND (pos / 4 < 0.2 OR pos / 4 > 0.8))) AS decorative
    FROM (SELECT *, coalesce(try_cast(replace(width, 'px', '') AS INT), -1) AS w FROM i)""",
)
def b16(spark, d):
    doc = F.col("doc_id").cast("string")
    lit = F.lit
    cells = [
        (F.concat(lit("https://a/"), "source", lit(".png")), lit("gif"), F.concat(F.col("n_chars").cast("string"), lit("px"))),
        (F.concat(lit("https://a/mmbiz_gif/"), doc), lit("gif"), lit("640")),
        (F.concat(lit("https://a/Reward/"), doc), lit(""), lit("640")),
        (lit("https://a/x.png"), lit(""), F.when(F.col("lang") == "en", "30").otherwise("wide")),
        (lit("https://a/mmbiz_gif/tail"), lit(""), lit("640")),
    ]
    arr = F.array(*[F.struct(s.alias("src"), t.alias("data_type"), w.alias("width")) for s, t, w in cells])
    rows = table(spark, d, "documents").select("doc_id", "lang", F.size(arr).alias("n"), F.posexplode(arr).alias("pos", "img"))
    context = F.when(F.col("lang") == "fr", "长按识别").otherwise("")
    test = im.is_decorative_article(
        F.col("img.src"), F.col("img.data_type"), F.col("img.width"), context, F.col("pos") / (F.col("n") - 1)
    )
    return rows.select("doc_id", "pos", test.alias("decorative"))


CODE_SQL = """SELECT doc_id, lang, source, CASE lang WHEN 'en' THEN 'import os' || chr(10) || 'def ' || source || '(x):' || chr(10) || '  # note'
    WHEN 'fr' THEN 'const ' || source || ' = () => 1;' || chr(10) || '// note' || chr(10) || '// more'
    WHEN 'de' THEN 'package main' || chr(10) || 'x := 1' || chr(10) || 'fmt::y' ELSE '#!/bin/sh' || chr(10) || 'echo ' || source END AS code FROM documents"""


def _code(spark, d):
    lang, src, lit = F.col("lang"), F.col("source"), F.lit
    code = (
        F.when(lang == "en", F.concat(lit("import os\ndef "), src, lit("(x):\n  # note")))
        .when(lang == "fr", F.concat(lit("const "), src, lit(" = () => 1;\n// note\n// more")))
        .when(lang == "de", lit("package main\nx := 1\nfmt::y"))
        .otherwise(F.concat(lit("#!/bin/sh\necho "), src))
    )
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text", code.alias("code"))


@query(
    "b17_code_language",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' ELSE 'bash' END
    AS language FROM documents""",
)
def b17(spark, d):
    return _code(spark, d).select("doc_id", tx.code_language(F.col("code")).alias("language"))


@query(
    "b18_comment_density",
    f"""WITH c AS ({CODE_SQL}), l AS (SELECT doc_id, lang, trim(unnest(string_split(code, chr(10)))) AS line FROM c)
    SELECT doc_id, round(sum(CASE WHEN starts_with(line, CASE WHEN lang IN ('fr', 'de') THEN '//' ELSE '#' END)
      THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS density FROM l WHERE line <> '' GROUP BY doc_id""",
)
def b18(spark, d):
    rows = _code(spark, d)
    density = tx.comment_density(F.col("code"), tx.code_language(F.col("code")))
    return rows.select("doc_id", F.round(density, 6).alias("density"))


@query(
    "b19_sample_windows",
    """SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE '[开头]' || chr(10) || substr(text, 1, 300)
      || chr(10) || chr(10) || '...' || chr(10) || chr(10) || '[中间]' || chr(10)
      || substr(text, greatest(0, length(text) // 2 - 150) + 1, 300)
      || chr(10) || chr(10) || '...' || chr(10) || chr(10) || '[结尾]' || chr(10) || substr(text, length(text) - 299, 300)
      END AS sample FROM documents""",
)
def b19(spark, d):
    return documents(spark, d).select("doc_id", tx.sample_windows(F.col("text"), 300).alias("sample"))


THINK_SQL = """SELECT doc_id, lang, CASE lang WHEN 'en' THEN '<think>a' || chr(10) || 'b</think> ' || title || chr(10)
    WHEN 'fr' THEN title || ' <think>never closed' WHEN 'de' THEN 'Plan' || chr(10) || '```YAML' || chr(10) || 'topics: ' || source || chr(10) || '```'
    ELSE 'Intro topics: ' || source END AS reply, title, source
    FROM (SELECT *, text AS title FROM documents)"""


def _replies(spark, d):
    lang, src, lit = F.col("lang"), F.col("source"), F.lit
    title = F.col("text")
    reply = (
        F.when(lang == "en", F.concat(lit("<think>a\nb</think> "), title, lit("\n")))
        .when(lang == "fr", F.concat(title, lit(" <think>never closed")))
        .when(lang == "de", F.concat(lit("Plan\n```YAML\ntopics: "), src, lit("\n```")))
        .otherwise(F.concat(lit("Intro topics: "), src))
    )
    return table(spark, d, "documents").select("doc_id", reply.alias("reply"))


@query(
    "b20_strip_think_extract_fenced",
    f"""WITH r AS ({THINK_SQL})
    SELECT doc_id, CASE lang WHEN 'en' THEN trim(title, {WS}) WHEN 'fr' THEN trim(title, {WS}) ELSE reply END AS stripped,
           CASE lang WHEN 'en' THEN trim(title, {WS}) WHEN 'fr' THEN trim(title, {WS}) ELSE 'topics: ' || source END AS block FROM r""",
)
def b20(spark, d):
    reply = F.col("reply")
    return _replies(spark, d).select(
        "doc_id", tx.strip_think(reply).alias("stripped"), tx.extract_fenced(reply, "topics:").alias("block")
    )


@query(
    "b21_safe_filename",
    f"""WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN '第3章 ' WHEN 'fr' THEN '12. ' WHEN 'de' THEN '# a/b: ' ELSE '' END
        || split_part(text, chr(10), 1) AS title FROM documents),
    s AS (SELECT doc_id, title, substr(replace(trim(regexp_replace(regexp_replace(title, '^第?\\d+[章节.]\\s*', ''),
        '[<>:"/\\\\|?*]', '', 'g'), {WS}), ' ', '_'), 1, 40) AS f,
        substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(title, chr(13), ' '),
          '^[\\s\\-#=]+', ''), '[\\s\\-#=]+$', ''), '[\\\\/:*?"<>|]', '_', 'g'), '[_\\s]+', ' ', 'g'), {WS}), 1, 50) AS g FROM t)
    SELECT doc_id, CASE WHEN f = '' THEN 'untitled' ELSE f END AS section_file,
           CASE WHEN g = '' THEN '未命名文章' ELSE g END AS article_file FROM s""",
)
def b21(spark, d):
    lang = F.col("lang")
    prefix = F.when(lang == "en", "第3章 ").when(lang == "fr", "12. ").when(lang == "de", "# a/b: ").otherwise("")
    title = F.concat(prefix, F.substring_index("text", "\n", 1))
    return table(spark, d, "documents").select(
        "doc_id", tx.safe_filename(title).alias("section_file"), tx.safe_article_name(title).alias("article_file")
    )


@query(
    "b22_summarise_text",
    f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), {WS}) AS flat,
      coalesce(list_extract(list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: trim(x, {WS})),
               lambda x: x <> ''), 1), '') AS l FROM documents)
    SELECT doc_id, CASE WHEN length(flat) > 240 THEN substr(flat, 1, 240) || '...' ELSE flat END AS summary,
           CASE WHEN length(l) > 320 THEN substr(l, 1, 320) || '...' ELSE l END AS first_line FROM t""",
)
def b22(spark, d):
    return documents(spark, d).select(
        "doc_id", tx.summarise_text(F.col("text")).alias("summary"), tx.first_error_line(F.col("text")).alias("first_line")
    )


@query(
    "b24_redact",
    """SELECT event_id, '***' AS api_key, props AS api_key_env, 'k' || CASE WHEN event_type = 'error' THEN '' ELSE '***' END
      AS settings_secret, event_type AS settings_name, '***' AS map_token, user_id::VARCHAR AS map_user FROM events""",
)
def b24(spark, d):
    """A flat secret, an exempt name, a secret struct field and a secret map key."""
    ev = table(spark, d, "events")
    secret = F.when(F.col("event_type") == "error", "").otherwise(F.col("props"))
    raw = ev.select(
        "event_id",
        F.col("props").alias("api_key"),
        F.col("props").alias("api_key_env"),
        F.struct(secret.alias("client_secret"), F.col("event_type").alias("name")).alias("settings"),
        F.create_map(F.lit("My_Token"), F.col("props"), F.lit("user"), F.col("user_id").cast("string")).alias("extra"),
    )
    out = rd.redact(raw)
    return out.select(
        "event_id", "api_key", "api_key_env",
        F.concat(F.lit("k"), "settings.client_secret").alias("settings_secret"),
        F.col("settings.name").alias("settings_name"),
        F.col("extra")["My_Token"].alias("map_token"),
        F.col("extra")["user"].alias("map_user"),
    )


@query(
    "b26_integrate_figures",
    """SELECT doc_id, 'A ![' || source || '](/img/' || doc_id || '.png)' || chr(10) || chr(10) || '> **图 1**: $1 note' || ' B '
      || text || chr(10) || chr(10) || '![图 2](https://x/' || doc_id || ')' AS body FROM documents""",
)
def b26(spark, d):
    doc, lit = F.col("doc_id").cast("string"), F.lit
    first = F.struct(
        F.concat(lit("https://x/"), doc).alias("url"), F.concat(lit("/img/"), doc, lit(".png")).alias("local_path"),
        F.col("source").alias("alt"), lit("$1 note").alias("description"), lit(0).alias("index"),
    )
    second = F.struct(
        F.concat(lit("https://x/"), doc).alias("url"), lit("").alias("local_path"),
        lit("").alias("alt"), lit("").alias("description"), lit(1).alias("index"),
    )
    content = F.concat(lit("A [IMAGE_0: image] B "), F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", im.integrate_figures(content, F.array(first, second)).alias("body")
    )


TREE_SQL = """SELECT source AS repo, n_chars AS size, CASE lang WHEN 'en' THEN 'src/' WHEN 'fr' THEN 'node_modules/x/'
      WHEN 'de' THEN 'docs/guide/deep/' ELSE '' END || CASE source WHEN 'src0' THEN 'main.py' WHEN 'src1' THEN 'package.json'
      WHEN 'src2' THEN 'logo.PNG' WHEN 'src3' THEN 'core/' || doc_id || '.rs' ELSE doc_id || '.py' END AS path, doc_id FROM documents"""

SCORE_SQL = f"""WITH t AS ({TREE_SQL}), f AS (SELECT *, string_split(path, '/') AS parts FROM t),
    s AS (SELECT *, (CASE WHEN regexp_matches(lower(path), '^(setup\\.py|setup\\.cfg|pyproject\\.toml|cargo\\.toml|package\\.json|go\\.mod)$')
        OR regexp_matches(lower(path), '^(main|app|index|server|cli)\\.(py|js|ts|go|rs)$')
        OR regexp_matches(lower(path), '^src/(main|app|index|lib)\\.(py|js|ts|go|rs)$')
        OR regexp_matches(lower(path), '^(src|lib|pkg)/(core|engine|model|agent|pipeline)') THEN 10 ELSE 0 END
      + CASE WHEN parts[-1] = 'main.py' THEN 15 WHEN parts[-1] = 'package.json' THEN 8 ELSE 0 END
      + CASE WHEN len(parts) <= 2 THEN 5 WHEN len(parts) = 3 THEN 2 ELSE 0 END
      + CASE WHEN parts[1] IN ('src', 'lib', 'pkg', 'core') THEN 3 ELSE 0 END)::BIGINT AS score
      FROM f WHERE lower(path) NOT LIKE '%.png' AND size <= 100000 AND NOT list_contains(parts, 'node_modules'))"""


def _tree(spark, d):
    lang, src, doc = F.col("lang"), F.col("source"), F.col("doc_id").cast("string")
    folder = F.when(lang == "en", "src/").when(lang == "fr", "node_modules/x/").when(lang == "de", "docs/guide/deep/").otherwise("")
    name = (
        F.when(src == "src0", "main.py").when(src == "src1", "package.json").when(src == "src2", "logo.PNG")
        .when(src == "src3", F.concat(F.lit("core/"), doc, F.lit(".rs"))).otherwise(F.concat(doc, F.lit(".py")))
    )
    return table(spark, d, "documents").select(
        src.alias("repo"), F.concat(folder, name).alias("path"), F.col("n_chars").alias("size"), "doc_id"
    )


@query("b27_select_key_files", SCORE_SQL + " SELECT repo, path, doc_id, score FROM s WHERE score > 0")
def b27(spark, d):
    return rp.select_key_files(_tree(spark, d)).select("repo", "path", "doc_id", "score")


@query(
    "h4_key_files_topk",
    SCORE_SQL.replace("SELECT source AS repo", "SELECT lang AS repo", 1)
    + """, r AS (SELECT repo, path, score, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS file_rank
    FROM (SELECT DISTINCT repo, path, score FROM s WHERE score > 0)) SELECT * FROM r WHERE file_rank <= 15""",
)
def h4(spark, d):
    lang = table(spark, d, "documents").select("doc_id", F.col("lang").alias("repo"))
    tree = _tree(spark, d).drop("repo").join(lang, "doc_id")
    unique = tree.groupBy("repo", "path").agg(F.min("size").alias("size"))
    return rp.key_files_topk(unique).select("repo", "path", "score", "file_rank")


@query(
    "b28_main_content_link",
    f"""WITH p AS (SELECT page_id, {NORM.format(c='url')} || CASE WHEN contains(url, 'm.') THEN '/zh-CN/x'
        WHEN contains(url, 'blog.') THEN '/events/x' WHEN contains(url, '.html') THEN '' ELSE '/chapter' || page_id END AS url,
        regexp_extract({PATH.format(c='url')}, '^(/[^/]+/[^/]+)', 1) AS base FROM pages),
    q AS (SELECT page_id, string_split(trim({PATH.format(c='url')}, '/'), '/') AS parts,
          len(string_split(trim(base, '/'), '/')) AS depth FROM p)
    SELECT page_id, len(parts) > depth AND NOT regexp_matches(parts[depth + 1], '^[a-zA-Z]{{2,3}}(-[a-zA-Z]{{2,3}})?$')
      AND parts[depth + 1] NOT IN ('events', 'assets', 'static') AS main_content FROM q""",
)
def b28(spark, d):
    url = F.col("url")
    tail = (
        F.when(F.contains(url, F.lit("m.")), "/zh-CN/x").when(F.contains(url, F.lit("blog.")), "/events/x")
        .when(F.contains(url, F.lit(".html")), "").otherwise(F.concat(F.lit("/chapter"), F.col("page_id")))
    )
    base = F.regexp_extract(ur.path(url), "^(/[^/]+/[^/]+)", 1)
    rows = table(spark, d, "pages").select("page_id", F.concat(ur.url_normalize(url), tail).alias("url"), base.alias("base"))
    return rows.select("page_id", ur.main_content_link(F.col("url"), F.col("base")).alias("main_content"))


@query(
    "b30_finish_reason_ok",
    """SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'click')""",
)
def b30(spark, d):
    kind = F.col("event_type")
    reason = F.when(kind == "error", "length").when(kind == "click", "max_tokens").when(kind == "view", "stop")
    rows = table(spark, d, "events").select("event_id", "event_type", reason.alias("finish_reason"))
    return rows.where(tx.finish_reason_ok(F.col("finish_reason"))).drop("finish_reason")


@query(
    "g12_stable_asset_name",
    f"""WITH p AS (SELECT page_id, {NORM.format(c='url')} || CASE WHEN contains(url, 'm.') THEN '.png?v=1'
        WHEN contains(url, 'blog.') THEN '.JPEG' ELSE '' END AS url FROM pages)
    SELECT page_id, substr(md5(url), 1, 12) || CASE WHEN regexp_extract({PATH.format(c='url')}, '[^/.](\\.[^./]*)$', 1)
      IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.svg') THEN regexp_extract({PATH.format(c='url')}, '[^/.](\\.[^./]*)$', 1)
      ELSE '.jpg' END AS asset FROM p
    WHERE page_id NOT IN (SELECT page_id FROM pages WHERE url LIKE '%/fr/%')""",
)
def g12(spark, d):
    """Names of assets not stored yet; those of the French pages are stored."""
    url = F.col("url")
    tail = F.when(F.contains(url, F.lit("m.")), ".png?v=1").when(F.contains(url, F.lit("blog.")), ".JPEG").otherwise("")
    rows = table(spark, d, "pages").select(
        "page_id", F.contains(url, F.lit("/fr/")).alias("stored"),
        ur.stable_asset_name(F.concat(ur.url_normalize(url), tail)).alias("asset"),
    )
    stored = rows.where("stored").select("page_id", "asset")
    return rows.join(stored, ["page_id", "asset"], "left_anti").select("page_id", "asset")


@query(
    "h6_natural_sort",
    f"""WITH p AS (SELECT page_id, {PATH.format(c='url')} AS path FROM pages),
    n AS (SELECT page_id, path, regexp_replace(regexp_replace(path, '(\\d+)', '{'0' * 20}\\1', 'g'), '\\d*(\\d{{20}})', '\\1', 'g') AS k FROM p)
    SELECT page_id, path, k AS sort_key FROM n""",
)
def h6(spark, d):
    p = ur.path(F.col("url"))
    return table(spark, d, "pages").select("page_id", p.alias("path"), ur.natural_key(p).alias("sort_key"))
