"""Reference follow-up, citation checks, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..session import materialize


def reference_frontier(
    materials: DataFrame, plan: DataFrame, store: DataFrame, parents: str = "parent_id"
) -> DataFrame:
    """References and plan links to fetch next: distinct, new, repositories and papers.

    ``plan(parent_id, url, type)``. A found child belongs to the parent of the
    material that names it.
    """
    refs = materials.select(parents, F.explode("references").alias("r")).select(parents, "r.url", "r.type")
    wanted = refs.unionByName(plan.select(parents, "url", "type")).where(
        (F.coalesce("url", F.lit("")) != "") & F.col("type").isin("github", "arxiv")
    )
    known = store.select(F.col("source_url").alias("url")).distinct()
    return wanted.distinct().join(known, "url", "left_anti").select(parents, "url", "type")


def follow_references(materials: DataFrame, plan: DataFrame, store: DataFrame, catalog: DataFrame, depth: int = 1) -> DataFrame:
    """Frontier repeated ``depth`` times, each round through the fetched catalogue.

    ``catalog(source_url, references)`` stands for the fetched pages.
    """
    found, level = None, materials
    known = store.select("source_url")
    for d in range(1, depth + 1):
        step = reference_frontier(level, plan if d == 1 else plan.where(F.lit(False)), known)
        step = materialize(step.withColumn("depth", F.lit(d).cast("long")), "frontier")
        found = step if found is None else found.unionByName(step)
        if d == depth or step.isEmpty():
            break
        known = known.unionByName(step.select(F.col("url").alias("source_url")))
        level = step.select("parent_id", F.col("url").alias("source_url")).join(catalog, "source_url")
    return found


def verify_citations(df: DataFrame, catalog: DataFrame, key: str, text: str, require_prefix: bool = False) -> DataFrame:
    """Cited paper ids that the catalogue does not hold.

    Bare ``dddd.ddddd`` numbers count unless ``require_prefix``.
    """
    col = F.col(text)
    prefixed = F.regexp_extract_all(col, F.lit(r"(?i)arxiv[:/](\d{4}\.\d{4,5})"), F.lit(1))
    bare = F.regexp_extract_all(col, F.lit(r"(?U)\b(\d{4}\.\d{4,5})\b"), F.lit(1))
    ids = prefixed if require_prefix else F.array_distinct(F.concat(bare, prefixed))
    cited = df.select(key, F.explode(F.array_distinct(ids)).alias("arxiv_id"))
    return cited.join(catalog.select("arxiv_id").distinct(), "arxiv_id", "left_anti").select(key, "arxiv_id")


def _bare(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit(""))


def assign_category(decisions: DataFrame, toc: list[dict]) -> DataFrame:
    """Directory for each decision text: the category list is a short setting.

    ``EXISTING|dir`` is matched exactly, then without blanks, then by either
    containing the other; the first category is the fallback. ``NEW|name|text``
    keeps its name for numbering. Other texts take the first category whose
    directory or name they contain.
    """
    line = F.regexp_extract(F.col("decision"), r"(?m)^\s*((?:EXISTING|NEW)\|.*?)\s*$", 1)
    parts = F.split(line, r"\|")
    wanted = F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    first = F.lit(toc[0]["dir_name"] if toc else vocab.DEFAULT_CATEGORY)
    dirs = [c["dir_name"] for c in toc]
    exact = F.coalesce(*[F.when(wanted == d, d) for d in dirs], F.lit(None).cast("string"))
    spaced = F.coalesce(*[F.when(_bare(wanted) == d.replace(" ", ""), d) for d in dirs], F.lit(None).cast("string"))
    partial = F.coalesce(
        *[
            F.when(
                F.contains(F.lit(d.replace(" ", "")), _bare(wanted)) | F.contains(_bare(wanted), F.lit(d.replace(" ", ""))), d
            )
            for d in dirs
        ],
        F.lit(None).cast("string"),
    )
    whole = _bare(F.col("decision"))
    loose = F.coalesce(
        *[
            F.when(
                F.contains(whole, F.lit(c["dir_name"].replace(" ", ""))) | F.contains(whole, F.lit(c["name"].replace(" ", ""))),
                c["dir_name"],
            )
            for c in toc
        ],
        F.lit(None).cast("string"),
    )
    is_existing, is_new = line.startswith("EXISTING|"), line.startswith("NEW|") & (F.size(parts) >= 3)
    target = (
        F.when(is_existing, F.coalesce(exact, spaced, partial, first))
        .when(is_new, F.lit(None).cast("string"))
        .when(line == "", F.coalesce(loose, first))
        .otherwise(first)
    )
    clean = F.trim(F.regexp_replace(wanted, r"^\d+[_\s]*", ""))
    new_name = F.when(is_new, F.when(clean == "", wanted).otherwise(clean))
    return decisions.withColumns({"dir_name": target, "new_category": new_name})
