"""URL, reference and link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"

# --- fixed values: link patterns ---------------------------------------------------
GITHUB_LINK = r"https?://github\.com/([\w\-.]+)/([\w\-.]+)(?:/(?:tree|blob)/[\w\-.]+)?"
ARXIV_LINK = r"https?://arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"
HUGGINGFACE_LINK = r"https?://huggingface\.co/([\w\-.]+)/([\w\-.]+)"
ARXIV_ID = r"\d{4}\.\d{4,5}"


def url_normalize(col: Column) -> Column:
    """Strip trailing slashes first, then cut the fragment and the query."""
    return F.regexp_replace(F.regexp_replace(col, "/+$", ""), r"(?s)[#?].*$", "")


def scheme(col: Column) -> Column:
    return F.regexp_extract(col, URL_PARTS, 1)


def authority(col: Column) -> Column:
    return F.regexp_extract(col, URL_PARTS, 2)


def path(col: Column) -> Column:
    return F.regexp_extract(col, URL_PARTS, 3)


def bare_host(col: Column) -> Column:
    """Authority with every ``www.`` removed."""
    return F.replace(authority(col), F.lit("www."), F.lit(""))


def is_low_quality(col: Column) -> Column:
    return bare_host(col).isin(*vocab.LOW_QUALITY_HOSTS)


def _has(col: Column, *parts: str) -> Column:
    test = F.contains(col, F.lit(parts[0]))
    for part in parts[1:]:
        test = test | F.contains(col, F.lit(part))
    return test


def classify_url(col: Column, policy: str = "explorer") -> Column:
    """Source kind of a URL by one of the four precedence ladders."""
    low = F.lower(col)
    github, arxiv = _has(col, vocab.GITHUB_HOST), _has(col, vocab.ARXIV_HOST)
    wechat = _has(col, vocab.WECHAT_HOST)
    course = _has(low, *vocab.COURSE_URL_WORDS)
    if policy == "explorer":
        return (
            F.when(github, "github")
            .when(arxiv, "arxiv")
            .when(_has(col, *vocab.DOC_URL_WORDS, vocab.DOC_URL_FOLDER), "doc")
            .when(_has(col, *vocab.COURSE_URL_WORDS), "course")
            .otherwise("web")
        )
    if policy == "study":
        return F.when(github, "github").when(arxiv, "arxiv").when(course, "course").otherwise("web")
    if policy == "ui":
        return (
            F.when(wechat, "wechat")
            .when(arxiv, "arxiv")
            .when(github, "github")
            .when(course, "course")
            .when(_has(col, *vocab.DOC_URL_WORDS), "doc")
            .otherwise("web")
        )
    if policy == "full":
        return (
            F.when(github, "github")
            .when(arxiv, "arxiv")
            .when(wechat, "wechat")
            .when(course, "course")
            .otherwise("wechat")
        )
    raise ValueError(f"unknown policy {policy!r}")


def repo_name(col: Column) -> Column:
    """``owner/repo`` after the last ``github.com/``; empty when incomplete."""
    rest = F.btrim(F.substring_index(col, "github.com/", -1), F.lit("/"))
    parts = F.split(rest, "/")
    name = F.concat(parts[0], F.lit("/"), F.replace(F.try_element_at(parts, F.lit(2)), F.lit(".git"), F.lit("")))
    return F.when(_has(col, "github.com/") & (F.size(parts) >= 2), name).otherwise("")


def arxiv_id(col: Column) -> Column:
    return F.regexp_extract(col, f"({ARXIV_ID})", 1)


def stable_asset_name(col: Column) -> Column:
    """md5 prefix of the URL plus its image extension, ``.jpg`` when unknown."""
    ext = F.regexp_extract(path(col), r"[^/.](\.[^./]*)$", 1)
    ext = F.when(ext.isin(*vocab.IMAGE_EXTENSIONS), ext).otherwise(".jpg")
    return F.concat(F.substring(F.md5(col), 1, 12), ext)


def natural_key(col: Column, width: int = 20) -> Column:
    """Sort key in which digit runs compare as numbers (zero padded)."""
    digits = F.regexp_replace(col, r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(digits, r"\d*(\d{" + str(width) + r"})", "$1")


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page at ``base``; null when not a page link.

    Anchors, script and mail links are dropped, the fragment is cut and
    dot segments are removed.
    """
    link = F.btrim(href, F.lit(vocab.WHITESPACE))
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    rooted = _drop_dot_segments(
        F.when(link.startswith("/"), F.regexp_replace(link, r"(?s)[#?].*$", "")).otherwise(
            F.concat(folder, F.regexp_replace(link, r"(?s)[#?].*$", ""))
        )
    )
    query = F.regexp_extract(link, r"(?s)^[^#?]*(\?[^#]*)", 1)
    absolute = (
        F.when(link.rlike(r"(?i)^https?://"), F.regexp_replace(link, r"(?s)#.*$", ""))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), F.regexp_replace(link, r"(?s)#.*$", "")))
        .when(link.startswith("?"), F.concat(root, path(base), query))
        .otherwise(F.concat(root, rooted, query))
    )
    dropped = (link == "") | link.startswith("#") | link.startswith("javascript:") | link.startswith("mailto:")
    return F.when(dropped, F.lit(None).cast("string")).otherwise(absolute)


def _drop_dot_segments(col: Column) -> Column:
    """Fold ``.`` and ``..`` path segments."""
    segments = F.split(F.regexp_replace(col, "^/", ""), "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat_ws("/", folded)
    tail = F.when(col.rlike(r"/\.{1,2}$") & (joined != ""), "/").otherwise("")
    cleaned = F.concat(F.lit("/"), joined, tail)
    return F.when(col.rlike(r"/\.{1,2}(/|$)"), cleaned).otherwise(col)


def main_content_link(url: Column, base_path: Column) -> Column:
    """Link deeper than the base path whose next segment is real content."""
    parts = F.split(F.btrim(path(url), F.lit("/")), "/")
    depth = F.size(F.split(F.btrim(base_path, F.lit("/")), "/"))
    nxt = F.try_element_at(parts, depth + 1)
    return F.coalesce(
        (F.size(parts) > depth)
        & ~nxt.rlike(vocab.LOCALE_SEGMENT)
        & ~nxt.isin(*vocab.OTHER_SEGMENTS),
        F.lit(False),
    )


def references_in(text: Column) -> Column:
    """Repository, paper and model-hub links, distinct by URL, first kept."""
    github = F.transform(
        F.regexp_extract_all(text, F.lit(GITHUB_LINK), F.lit(0)),
        lambda m: F.regexp_replace(m, GITHUB_LINK, "$1/$2"),
    )
    arxiv = F.regexp_extract_all(text, F.lit(ARXIV_LINK), F.lit(1))
    hub = F.regexp_extract_all(text, F.lit(HUGGINGFACE_LINK), F.lit(0))
    refs = F.concat(
        F.transform(github, lambda n: _ref(F.concat(F.lit("https://github.com/"), n), "github", n)),
        F.transform(
            arxiv,
            lambda i: _ref(F.concat(F.lit("https://arxiv.org/abs/"), i), "arxiv", F.concat(F.lit("arXiv:"), i)),
        ),
        F.transform(hub, lambda u: _ref(u, "huggingface", F.regexp_replace(u, HUGGINGFACE_LINK, "$1/$2"))),
    )
    # url decides identity; type and title follow from it except for a hub URL
    # seen under both schemes, which stays two references as its URL differs
    return F.array_distinct(refs)


def _ref(url: Column, kind: str, title: Column) -> Column:
    return F.struct(url.alias("url"), F.lit(kind).alias("type"), title.alias("title"))
