"""The dealt operators over their whole tables, with SQL counterparts where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import chat, decontam, interactions, jaccard, licences, mixing, quality, shards, spelling, substring, tokens, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rules of op1: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A host with one of these words is listed; its pages' canonical URLs are the block list of op1.
LISTED_HOSTS = r"(^|[.-])(bets|pills|casino|loans|poker)([.-]|$)"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame([(h, p, v) for v, h, p in URL_RULES], "host string, path string, verdict string")
    host, path = urls.host_and_path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOSTS)).select(urls.canonical(host, path).alias("url")).distinct()
    return urls.judge_urls(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES
    {rules}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts),
canon AS (
  SELECT *, regexp_replace(host, '^www\\.', '')
            || regexp_replace(regexp_replace(path, '(\\.html|/+)$', ''), '/+$', '') AS url
  FROM parts),
listed AS (SELECT DISTINCT url FROM canon WHERE regexp_matches(host, '{hosts}')),
fits AS (
  SELECT c.page_id, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS n
  FROM canon c JOIN rules r
    ON (c.host = r.rhost OR right(c.host, length(r.rhost) + 1) = '.' || r.rhost)
   AND substr(c.path, 1, length(r.rpath)) = r.rpath)
SELECT c.page_id, c.host, c.path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN f.verdict WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM canon c LEFT JOIN fits f ON f.page_id = c.page_id AND f.n = 1
LEFT JOIN listed l ON l.url = c.url AND c.host <> ''
""".format(rules=", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES), hosts=LISTED_HOSTS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; the vocabulary file is a parameter of the operator."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024, keep_text=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(materialize(quality.measure(docs, keep_text=False), "measured"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"_q.{n}").alias(n) for n in counts], "base_failed", "kept", "p_good")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back through the index."""
    index = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    found = warc.read_records(index, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without passages that stand earlier."""
    return substring.kept_words(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS txt, count(*) AS n
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs)).withColumn("families", F.array_join("families", ","))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


#: What both turns of the added conversation say.
TRAP = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted windows."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], given.schema)
    windows = materialize(chat.format_windows(given.unionByName(added)), "formatted")
    sizes = F.length("text").cast("long")
    read = chat.read_turns(windows.withColumn("conv_id", F.struct("conv_id", sizes.alias("chars"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.col("conv_id.chars").alias("chars"),
        F.size("turns").cast("long").alias("n"),
        F.struct("window", told.alias("t"), F.array_join("losses", "").alias("l")).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("p")
    )
    turns = F.array_join(F.transform("p", lambda x: x["t"]), "")
    loss = F.array_join(F.transform("p", lambda x: x["l"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP9_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, len(regexp_extract_all(text, '[^ 	-
]+')) + 4 AS n,
         length(regexp_replace(text, '(~*)(\[/?INST\]|</?s>)', '~\1\2', 'g')) AS body,
         CASE WHEN role = 'assistant' THEN 4 + 6
              ELSE 7 + 1 + 9 + length(role) + length(regexp_replace(role, '[^~
\[<]', '', 'g')) END AS marks
  FROM given),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS pos FROM t),
w AS (SELECT *, pos // 768 AS win, role = 'system' AND pos = 0 AS sys FROM p),
f AS (SELECT conv_id, win, min(pos) AS first FROM w GROUP BY conv_id, win),
formatted AS (
  SELECT conv_id, sum(body + marks)::BIGINT AS chars FROM (
    SELECT conv_id, body, marks FROM w
    UNION ALL SELECT w.conv_id, body, marks FROM w JOIN f ON f.conv_id = w.conv_id AND f.win = w.win + 1
      AND w.pos + 256 >= f.first WHERE NOT sys
    UNION ALL SELECT w.conv_id, body, marks FROM w JOIN f ON f.conv_id = w.conv_id AND f.win > 0 WHERE sys)
  GROUP BY conv_id)
SELECT g.conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       any_value(chars)::BIGINT AS formatted_chars
FROM given g JOIN formatted USING (conv_id) GROUP BY g.conv_id
"""

OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT p.*, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS best FROM p),
bits AS (
  SELECT page_id, g, sum(((strpos('0123456789abcdef', substr(hex, (5 * g + i) // 4 + 1, 1)) - 1) // (1 << (3 - (5 * g + i) % 4)) % 2) * (1 << (4 - i))) AS v
  FROM b, (SELECT unnest(generate_series(0, 31)) AS g) gs, (SELECT unnest(generate_series(0, 4)) AS i) bs GROUP BY page_id, g),
named AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INT + 1, 1), '' ORDER BY g) AS digest FROM bits GROUP BY page_id)
SELECT b.page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN b.page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.page_id <> best THEN best END AS refers_to
FROM b JOIN named USING (page_id)
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP10_SQL = r"""
WITH b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS n
  FROM b, generate_series(1, greatest(len(w) - 12, 1)) g(s) WHERE len(w) > 0 AND s <= greatest(len(w) - 12, 1)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM d, (SELECT DISTINCT n FROM bw) lengths WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every step of every order of the five filters, by language."""
    cells = interactions.failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions.audit(cells)


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT o, s, strpos('ABCDE', substr(o, s, 1)) AS own,
         list_transform(range(1, s), lambda i: strpos('ABCDE', substr(o, i::INT, 1))) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS s) steps),
seen AS (
  SELECT part, o, s, own, n, good, toxic, fails[own] AS hit, list_bool_or(list_transform(earlier, lambda i: fails[i])) AS gone,
         list_sum(list_transform(fails, lambda b: b::INT)) AS faults
  FROM steps, cells),
counted AS (
  SELECT part, o AS filter_order, s::INT AS step, own,
         sum(CASE WHEN NOT hit AND NOT coalesce(gone, false) THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN hit AND coalesce(gone, false) THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN hit AND faults = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, o, s, own)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the vocabulary."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The CRC is folded byte by byte over a table that the query makes; near words meet on what is left without one letter.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i) codes) made),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{5,}')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) found
  GROUP BY doc_id, run),
coded AS (SELECT *, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS code FROM runs),
bytes AS (
  SELECT doc_id, run, times, list_transform(range(0, length(code) // 2),
    lambda i: ((strpos('0123456789ABCDEF', substr(code, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(code, 2 * i + 2, 1)) - 1)::BIGINT) AS b
  FROM coded),
hashed AS (
  SELECT run, times, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h
  FROM bytes, crc),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i) places),
near AS (
  SELECT DISTINCT word, n, other, other_n FROM (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, other_n,
                row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
                 CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
          FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1),
steps AS (SELECT word, word AS at FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN steps s ON s.word = f.word JOIN forms e ON e.word = s.at AND e.form IS NULL
"""


def op13_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; equal texts are linked."""
    placed = shards.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_quality_rules, op4_warc_archive, op5_substring_dedup, op6_mix_sources, op7_licence_scan, op8_jaccard_join, op9_chat_format, op10_decontaminate, op11_filter_audit, op12_spelling_variants, op13_balanced_shards)}
ORACLES = {"op1_url_filter": OP1_SQL, "op4_warc_archive": OP4_SQL, "op9_chat_format": OP9_SQL, "op5_substring_dedup": OP5_SQL, "op10_decontaminate": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_spelling_variants": OP12_SQL}


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
