"""URL filters: a blocked Bloom filter ahead of an exact hash join.

Listed entries are rules (a host with a path prefix) and single canonical URLs.
Every URL proposes the entries that could name it; the Bloom filter drops nearly
all of those inside the scan, and only possible hits are joined exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    fill = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), fill), F.coalesce(path, fill)


def canonical(host: Column, path: Column) -> Column:
    """Canonical URL: host without ``www.``, path without ``.html`` and closing ``/``; null without host."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(\.html|/+)$", ""), r"/+$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), plain))


def _suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``host``, ``path``, ``verdict`` (allow or block); a rule fits its
    host and all subdomains when the path starts with its own. The longest rule
    (host and path together, then the host) wins; of equal rules, block wins.
    Without a rule, a URL whose canonical form is in ``listed`` (column ``url``,
    canonical already) is blocked, any other allowed. Null or malformed URLs have
    an empty host and are allowed. Rows are kept as they are, repeats too; columns
    of ``pages`` named like a result are replaced. Rules or entries with null
    parts are ignored.
    """
    lengths = [r[0] for r in rules.where("path IS NOT NULL").select(F.length("path")).distinct().collect()]
    by_rule = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat(F.lit("r"), "host", "path").alias("_key"),
        F.struct(
            F.lit(1).alias("kind"),
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("depth"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
        ).alias("hit"),
    )
    by_url = listed.where("url IS NOT NULL").select(
        F.concat(F.lit("u"), "url").alias("_key"),
        F.struct(
            F.lit(0).alias("kind"),
            F.lit(0).alias("length"),
            F.lit(0).alias("depth"),
            F.lit(None).cast("string").alias("rule"),
            F.lit("block").alias("verdict"),
        ).alias("hit"),
    )
    entries = by_rule.unionByName(by_url).groupBy("_key").agg(F.max("hit").alias("_hit"))
    possible = bloom.build(entries.select(F.xxhash64("_key")))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]
    heads = F.array_compact(F.array(*prefixes)) if prefixes else F.array().cast("array<string>")
    named = F.flatten(F.transform(_suffixes(F.col("host")), lambda h: F.transform(heads, lambda p: F.concat(F.lit("r"), h, p))))
    # every row keeps one key of its own, so that rows without a hit stay and don't meet in one task
    own = F.concat(F.lit("-"), F.col("_row").cast("string"))
    keys = F.array_compact(F.concat(named, F.array(F.concat(F.lit("u"), canonical(F.col("host"), F.col("path"))), own)))
    tried = rows.withColumn("_key", F.explode(keys)).where(
        F.col("_key").startswith("-") | possible.might_contain(F.xxhash64("_key"))
    )
    first = [F.first(F.col(f"`{c}`")).alias(c) for c in [*kept, "host", "path"]]
    best = tried.join(entries, "_key", "left").groupBy("_row").agg(*first, F.max("_hit").alias("_hit"))
    return best.select(
        *[F.col(f"`{c}`") for c in [*kept, "host", "path"]],
        F.col("_hit.rule").alias("rule"),
        F.coalesce("_hit.verdict", F.lit("allow")).alias("verdict"),
    )
