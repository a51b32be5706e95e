"""Web-page corpus: metadata, main content, Markdown, links and images.

Operators read the ``nodes`` array added by :func:`docspark.functions.html.with_nodes`
in the row of the page, so no page is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.html import attr, decode_entities, with_nodes
from ..ordering import number_within


def node_table(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per node, clutter left out."""
    return (
        with_nodes(pages.select(key, html), html).select(key, F.explode("nodes").alias("n"))
        .where(~F.col("n.removed"))
        .select(key, "n.node_id", "n.parent_id", "n.end_id", "n.depth", "n.tag", "n.attrs", "n.text")
    )


# ---- metadata ------------------------------------------------------------


def clean_title(c: Column) -> Column:
    """Title without a trailing site suffix."""
    return X.strip_blank(F.regexp_replace(F.coalesce(c, F.lit("")), r"[-_|].*?(政府|门户|网站|委员会).*$", ""))


def meta_entries(nodes: Column) -> Column:
    """array(struct(key, content)) of the meta tags; of equal keys the last."""
    metas = F.transform(F.filter(nodes, lambda n: n["tag"] == "meta"), lambda n: F.struct(
        F.lower(F.coalesce(X.empty_to_null(attr(n, "name")), X.empty_to_null(attr(n, "property")))).alias("key"),
        X.empty_to_null(attr(n, "content")).alias("content")))
    kept = F.filter(metas, lambda m: m["key"].isNotNull() & m["content"].isNotNull())
    stripped = F.transform(kept, lambda m: F.struct(m["key"].alias("key"), X.strip_blank(m["content"]).alias("content")))
    return stripped


def meta_map(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, key, content) rows of the meta tags, the last of equal keys."""
    rows = pages.select(key, meta_entries(F.col("nodes")).alias("m"))
    last = F.filter("m", lambda m, i: ~F.exists(
        F.slice(F.col("m"), i + 2, F.size("m")), lambda other: other["key"] == m["key"]))
    return rows.select(key, F.inline(last).alias("key", "content"))


def _meta(metas: Column, *keys: str) -> Column:
    """Content of the first of the keys that is present and not empty."""


    def last(k):
        return X.empty_to_null(F.try_element_at(F.filter(metas, lambda m: m["key"] == k), F.lit(-1))["content"])

    return F.coalesce(*[last(k) for k in keys])


def page_text(nodes: Column) -> Column:
    """All text but that of scripts, styles and templates."""
    hidden = F.transform(
        F.filter(nodes, lambda n: n["tag"].isin("script", "style", "template")), lambda n: n["node_id"])
    texts = F.filter(nodes, lambda n: (n["tag"] == "#text") & ~F.coalesce(F.array_contains(hidden, n["parent_id"]), F.lit(False)))
    return F.array_join(F.transform(texts, lambda n: n["text"]), "")


# Meta keys and text patterns of date, description and author.
DATE_KEYS = ["article:published_time", "og:published_time", "pubdate", "publishdate", "date"]
DESCRIPTION_KEYS = ["description", "og:description", "twitter:description"]
AUTHOR_KEYS = ["author", "article:author"]
DATE_PATTERNS = [
    r"发布[时日]间[：:]\s*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?)",
    r"日期[：:]\s*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?)",
    r"(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?)\s*(?:发布|来源)",
    r"时间[：:]\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2})",
]
AUTHOR_PATTERNS = [r"来源[：:]\s*([^\s<]+)", r"发布(?:单位|机构)[：:]\s*([^\s<]+)"]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return X.empty_to_null(F.regexp_extract(text, pattern, group))


def publish_date(metas: Column, text: Column, url: Column) -> Column:
    """Date from meta tags, then the text, then the URL; empty when unknown."""
    in_text = F.coalesce(*[_found(text, p) for p in DATE_PATTERNS])
    in_text = F.replace(F.replace(F.replace(in_text, F.lit("年"), F.lit("-")), F.lit("月"), F.lit("-")), F.lit("日"), F.lit(""))
    month = r"(\d{4})(\d{2})[/_](?:t\d+_)?"
    day = r"(\d{4})[-/](\d{2})[-/](\d{2})"
    by_month = F.concat(_found(url, month, 1), F.lit("-"), _found(url, month, 2))
    by_day = F.concat(_found(url, day, 1), F.lit("-"), _found(url, day, 2), F.lit("-"), _found(url, day, 3))
    return F.coalesce(_meta(metas, *DATE_KEYS), in_text, by_month, by_day, F.lit(""))


def page_metadata(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds title, date, description and author from the nodes and the URL."""
    df = pages.withColumns({"_m": meta_entries(F.col("nodes")), "_t": page_text(F.col("nodes"))})
    first = F.get(F.filter("nodes", lambda n: n["tag"] == "title"), F.lit(0))
    title = X.empty_to_null(clean_title(first["flat"]))
    m, t = F.col("_m"), F.col("_t")
    # both helpers are read more than once here, so each is built once per row
    return df.withColumns({
        "title": F.coalesce(title, _meta(m, "og:title"), F.lit("Untitled")),
        "date": publish_date(m, t, F.col(url)),
        "description": F.coalesce(_meta(m, *DESCRIPTION_KEYS), F.lit("")),
        "author": F.coalesce(_meta(m, *AUTHOR_KEYS), *[_found(t, p) for p in AUTHOR_PATTERNS], F.lit("")),
    }).drop("_m", "_t")


# ---- main content --------------------------------------------------------

# Containers that usually hold the content, in order of preference.
CLASS_PARTS = ["tys-main-zt-show", "tys-main"]
CLASSES = ["TRS_Editor", "TRS_UEDITOR", "ucontent", "article-content", "news-content", "detail-content", "content-text",
           "pages_content", "zwgk_content", "content_detail", "text_content", "main-content", "main_content", "view-content",
           "info-content"]
IDS = ["Zoom", "content", "article"]
LATE_CLASSES = ["content"]
TAGS = ["article", "main"]
MIN_LENGTH, GOOD_SCORE, DIV_LENGTH, PER_PARAGRAPH = 100, 200, 200, 50


def _preference(n: Column) -> Column:
    """Place of the first selector an element meets; NULL for none."""
    names = F.split(F.coalesce(attr(n, "class"), F.lit("")), r"\s+")
    whole = attr(n, "class")

    def partly(part):
        return F.exists(names, lambda c: F.contains(F.lower(c), F.lit(part)))

    tests = [partly(p) for p in CLASS_PARTS]
    tests += [F.array_contains(names, c) | F.coalesce(whole == c, F.lit(False)) for c in CLASSES]
    tests += [attr(n, "id") == i for i in IDS]
    tests += [F.array_contains(names, c) | F.coalesce(whole == c, F.lit(False)) for c in LATE_CLASSES]
    tests += [n["tag"] == t for t in TAGS]
    out = F.lit(None).cast("int")
    for i, test in reversed(list(enumerate(tests))):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(i)).otherwise(out)
    return out


def main_content(pages: DataFrame) -> DataFrame:
    """Adds root_id, root_end and root_score of the main content element.

    Known containers win by text length plus twice the CJK letters; below a
    good score divs with direct paragraphs compete; the body is the fallback.
    """
    live = F.filter("nodes", lambda n: ~n["removed"] & (n["tag"] != "#text"))
    known = F.transform(
        F.filter(live, lambda n: n["text_len"] >= MIN_LENGTH),
        lambda n: F.struct((-(n["text_len"] + n["cjk"] * 2)).alias("s"), _preference(n).alias("p"), n["node_id"].alias("id"), n["end_id"].alias("e")))
    known = F.filter(known, lambda k: k["p"].isNotNull())
    divs = F.transform(
        F.filter(live, lambda n: (n["tag"] == "div") & (n["text_len"] > DIV_LENGTH) & (n["p_children"] >= 1)),
        lambda n: F.struct((-(n["text_len"] + n["cjk"] * 2 + n["p_children"] * PER_PARAGRAPH)).alias("s"), F.lit(0).alias("p"),
                           n["node_id"].alias("id"), n["end_id"].alias("e")))
    body = F.get(F.filter(live, lambda n: n["tag"] == "body"), F.lit(0))
    df = pages.withColumns({"_a": F.array_min(known), "_b": F.array_min(divs), "_body": body})
    a, b = F.col("_a"), F.col("_b")
    weak = a.isNull() | (-a["s"] < GOOD_SCORE)
    best = F.when(weak & b.isNotNull() & (a.isNull() | (b["s"] < a["s"])), b).otherwise(a)
    df = df.withColumn("_best", best)
    return df.select(
        *pages.columns, F.coalesce(F.col("_best.id"), F.col("_body.node_id")).alias("root_id"),
        F.coalesce(F.col("_best.e"), F.col("_body.end_id")).alias("root_end"), (-F.col("_best.s")).alias("root_score"))


# ---- Markdown ------------------------------------------------------------

_HEADINGS = [f"h{i}" for i in range(1, 7)]


def _opening(n: Column) -> Column:
    tag, href = n["tag"], attr(n, "href")
    squeezed = F.regexp_replace(n["text"], r"\s+", " ")
    link = (tag == "a") & (href != "") & ~href.startswith("javascript:")
    return (
        F.when(tag == "#text", F.when(n["text"].rlike(r"\S"), squeezed).otherwise(F.lit("")))
        .when(tag.isin(_HEADINGS), F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" ")))
        .when(tag == "p", F.lit("\n\n")).when(tag == "li", F.lit("\n- ")).when(tag == "blockquote", F.lit("\n> "))
        .when(tag == "hr", F.lit("\n\n---\n\n")).when(tag == "br", F.lit("  \n"))
        .when(tag == "pre", F.concat(F.lit("\n\n```\n"), F.coalesce(n["flat"], F.lit("")), F.lit("\n```\n\n")))
        .when(tag.isin("strong", "b"), F.lit("**")).when(tag.isin("em", "i"), F.lit("*")).when(tag == "code", F.lit("`"))
        .when(link, F.lit("["))
        .when((tag == "img") & (attr(n, "src") != ""), F.concat(
            F.lit("!["), F.coalesce(attr(n, "alt"), F.lit("")), F.lit("]("), attr(n, "src"), F.lit(")")))
        .when(tag == "tr", F.concat(n["flat"], F.lit("\n"))).when(tag == "table", F.lit("\n\n"))
        .otherwise(F.lit("")))


def _closing(n: Column) -> Column:
    tag, href = n["tag"], attr(n, "href")
    link = (tag == "a") & (href != "") & ~href.startswith("javascript:")
    return (
        F.when(tag.isin(*_HEADINGS, "p", "table"), F.lit("\n\n")).when(tag == "blockquote", F.lit("\n"))
        .when(tag.isin("strong", "b"), F.lit("**")).when(tag.isin("em", "i"), F.lit("*")).when(tag == "code", F.lit("`"))
        .when(link, F.concat(F.lit("]("), href, F.lit(")"))).otherwise(F.lit("")))


def page_markdown(pages: DataFrame, out: str = "markdown") -> DataFrame:
    """Markdown of the element root_id..root_end.

    Every node gives an opening and a closing text; sorted by place they are
    the rendering, so the tree needs no recursion.
    """
    root, end = F.col("root_id"), F.col("root_end")
    shown = F.filter("nodes", lambda n: n["node_id"].between(root, end) & ~n["removed"]
                     & ~n["tag"].isin("meta", "link") & (n["opaque_id"].isNull() | (n["opaque_id"] < root)))
    events = F.flatten(F.transform(shown, lambda n: F.array(
        F.struct(n["node_id"].alias("a"), F.lit(0).alias("b"), n["node_id"].alias("c"), _opening(n).alias("t")),
        F.struct(n["end_id"].alias("a"), F.lit(1).alias("b"), (-n["node_id"]).alias("c"), _closing(n).alias("t")))))
    text = F.array_join(F.transform(F.array_sort(events), lambda e: e["t"]), "")
    clean = X.strip_blank(X.collapse_newlines(text))
    return pages.withColumn(out, F.coalesce(clean, F.lit("")))


def table_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, row_no, line) of every table row in document order."""
    rows = F.transform(F.filter("nodes", lambda n: (n["tag"] == "tr") & ~n["removed"]), lambda n: n["flat"])
    return pages.select(key, F.posexplode(rows).alias("_p", "line")).select(key, (F.col("_p") + 1).cast("long").alias("row_no"), "line")


# ---- links and images ----------------------------------------------------

LAZY = ["data-src", "data-original", "data-lazy-src", "data-actualsrc", "src"]


def absolute_url(base: Column, ref: Column) -> Column:
    """Reference with scheme, ``//host`` or rooted path against the page URL; other forms give NULL."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(ref.rlike(r"^https?://"), ref).when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref)))


def _image_source(n: Column) -> Column:
    options = F.array(*[attr(n, a) for a in LAZY])
    return F.get(F.filter(options, lambda s: s.rlike(r"^(?:https?://|/)")), F.lit(0))


def image_occurrences(pages: DataFrame, url: str = "url", key: str = "page_id", within_root: bool = False) -> DataFrame:
    """(page, occurrence_index, source_url, alt_text); inline data and unusable sources are skipped."""
    images = F.filter("nodes", lambda n: (n["tag"] == "img") & ~n["removed"])
    if within_root:
        images = F.filter(images, lambda n: n["node_id"].between(F.col("root_id"), F.col("root_end")))
    picked = F.transform(images, lambda n: F.struct(_image_source(n).alias("src"), F.coalesce(attr(n, "alt"), F.lit("")).alias("alt")))
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(picked).alias("_p", "i")).where(F.col("i.src").isNotNull())
    return rows.select(key, (F.col("_p") + 1).cast("long").alias("occurrence_index"),
                       absolute_url(F.col("_base"), F.col("i.src")).alias("source_url"), F.col("i.alt").alias("alt_text"))


def link_occurrences(pages: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """(page, occurrence_index, target) of the links with an absolute target."""
    hrefs = F.transform(F.filter("nodes", lambda n: (n["tag"] == "a") & (attr(n, "href") != "")), lambda n: attr(n, "href"))
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(hrefs).alias("_p", "href"))
    return rows.select(key, (F.col("_p") + 1).cast("long").alias("occurrence_index"), absolute_url(F.col("_base"), F.col("href")).alias("target")).where(
        F.col("target").isNotNull())


def url_usage(occurrences: DataFrame, url: str) -> DataFrame:
    """Use count per URL; its occurrences stay rows of the occurrence table."""
    return occurrences.groupBy(url).agg(F.count(F.lit(1)).alias("usage_count"), F.countDistinct("page_id").alias("pages"))


# ---- names and leftover markup -------------------------------------------


def safe_name(c: Column, length: int | None = None) -> Column:
    """Blanks to underscores, CJK, letters, digits and underscores only; cut where ``length`` is given."""
    flat = F.regexp_replace(F.regexp_replace(c, r"\s+", "_"), r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9_]", "")
    name = F.regexp_replace(flat, r"_+", "_")
    return name if length is None else F.substring(name, 1, length)


def base_name(title: Column, url: Column, length: int | None = None) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    from_url = F.when(path != "", F.concat(host, F.lit("_"), path)).otherwise(F.coalesce(X.empty_to_null(host), F.lit("untitled")))
    return F.coalesce(X.empty_to_null(safe_name(F.coalesce(title, F.lit("")), length)), X.empty_to_null(safe_name(from_url, length)), F.lit("untitled"))


def unique_names(df: DataFrame, base: str, order: str, out: str = "name") -> DataFrame:
    """Collisions get ``_2``, ``_3``, .. in order; a name shared by very many rows stays spread."""
    numbered = number_within(df, [base], [order], "_n")
    return numbered.withColumn(out, F.when(F.col("_n") == 1, F.col(base)).otherwise(
        F.concat(F.col(base), F.lit("_"), F.col("_n")))).drop("_n")


def plain_text(html: Column) -> Column:
    """Text without head, styles and scripts; tags become breaks, entities are decoded."""
    body = F.regexp_replace(html, r"(?is)<(head|style|script|noscript)\b[^>]*>.*?</\1\s*>", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "\n")
    lines = F.regexp_replace(decode_entities(body), r"[ \t]*\n\s*", "\n")
    return X.strip_blank(lines)


def images_to_markdown(md: Column) -> Column:
    """Leftover image tags to ``![alt](src)``; the alt text is used when it
    directly follows the source, else the file stem stands in."""
    pieces = F.regexp_extract_all(md, F.lit(r'(<img\s[^>]*?src="[^"]+"[^>]*>|[^<]+|<)'), F.lit(1))

    def fix(p):
        src = F.regexp_extract(p, r'^<img\s[^>]*?src="([^"]+)"', 1)
        alt = F.regexp_extract(p, r'^<img\s[^>]*?src="[^"]+"alt="([^"]*)"', 1)
        file = F.regexp_extract(src, r"([^/]*)/*$", 1)
        stem = F.coalesce(X.empty_to_null(F.regexp_extract(file, r"^(.+)\.[^.]*$", 1)), file)
        return F.when(src != "", F.concat(F.lit("!["), F.coalesce(X.empty_to_null(alt), stem), F.lit("]("), src, F.lit(")"))).otherwise(p)

    return F.array_join(F.transform(pieces, fix), "")


# ---- annotations ---------------------------------------------------------


def _preview(n: Column, length: int | None) -> Column:
    """Leading text of a text element; a node's place in the array is its number."""
    inner = F.get(F.col("nodes"), n["node_id"] + 1)
    leading = F.when((inner["tag"] == "#text") & (inner["parent_id"] == n["node_id"]), inner["text"])
    text = X.strip_blank(F.coalesce(leading, F.lit("")))
    return F.when(n["tag"] == "text", text if length is None else F.substring(text, 1, length)).otherwise(F.lit(""))


def annotations(pages: DataFrame, key: str = "page_id", preview: int | None = None) -> DataFrame:
    """Elements flagged for edit, with note and the text of text elements, or its first ``preview`` characters."""
    hits = F.filter("nodes", lambda n: attr(n, "data-edit-target") == "true")
    rows = pages.select(key, F.inline(F.transform(hits, lambda n: F.struct(
        F.coalesce(attr(n, "id"), F.lit("(no id)")).alias("element_id"),
        F.regexp_extract(n["tag"], r"([^:}]*)$", 1).alias("tag"),
        F.coalesce(attr(n, "data-edit-annotation"), F.lit("")).alias("annotation"),
        _preview(n, preview).alias("content_preview")))))
    return rows


def annotation_counts(found: DataFrame, key: str = "page_id") -> DataFrame:
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("annotations"))
