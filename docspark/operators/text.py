"""Document structure: repeated edge text, paragraphs, headings, Markdown blocks.

Whole documents (one row each) are worked on in their row, without a shuffle;
element tables use windows partitioned by document and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..ordering import broadcast_if_small, map_of, ordered_concat, stored
from .match import match_titles

PAGE = ["doc_id", "page_no"]


def split_lines(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Lines with a 0-based number."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "text")).select(
        *keep, F.col("_p").cast("long").alias("line_no"), "text")


# ---- repeated headers and footers ----------------------------------------

# Bands and fewest pages of the repeated-text rule.
BAND, MIN_PAGES = 0.15, 3


def repeated_edge_text(blocks: DataFrame, pages: DataFrame, threshold: float = 0.6, sample: int | None = None) -> DataFrame:
    """Noise texts (doc_id, band, text) of blocks(doc_id, page_no, y0, y1, page_h, text).

    pages(doc_id, page_no) lists every page, 0-based. Counts are occurrences
    over all pages, or over the first and last ``sample / 2`` of a longer document
    if ``sample`` is given; a block touching the top band counts as header only.
    """
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    text = X.strip_blank(F.col("text"))
    top = (F.col("y0") < F.col("page_h") * BAND) & (F.col("y1") > 0)
    bottom = (F.col("y1") > F.col("page_h") * (1 - BAND)) & (F.col("y0") < F.col("page_h"))
    edge = blocks.select(
        "doc_id", "page_no", text.alias("text"),
        F.when(top, F.lit("header")).when(bottom, F.lit("footer")).alias("band"),
    ).where(F.col("band").isNotNull() & (F.col("text") != ""))
    edge = edge.withColumn("_h", F.xxhash64("text"))
    n, p = F.col("n_pages"), F.col("page_no")
    if sample is not None:
        edge = edge.join(broadcast_if_small(n_pages), "doc_id").where((n <= sample) | (p < sample // 2) | (p >= n - sample // 2)).drop("n_pages")
    total = n if sample is None else F.least(n, F.lit(sample))
    enough = (n >= MIN_PAGES) & (F.col("hits") / total > threshold)
    # hashes are counted first: equal ones only add up to more, so no repeated text is lost, and few are left to count as texts
    likely = edge.groupBy("doc_id", "band", "_h").agg(F.count(F.lit(1)).alias("hits"))
    # they are written: their files prove how few they are, so the edges need no shuffle
    likely = stored(likely.join(broadcast_if_small(n_pages), "doc_id").where(enough).select("doc_id", "band", "_h", "n_pages"))
    hits = edge.select("doc_id", "band", "text", "_h").join(broadcast_if_small(likely), ["doc_id", "band", "_h"]).groupBy("doc_id", "band", "text").agg(
        F.count(F.lit(1)).alias("hits"), F.first("n_pages").alias("n_pages"))
    return hits.where(enough).select("doc_id", "band", "text", "hits", total.alias("scanned_pages"))


def remove_noise(lines: DataFrame, noise: DataFrame, text: str = "text") -> DataFrame:
    """Lines whose trimmed text is not a noise text of their document."""
    # written, so that their files prove them small and the lines need no shuffle
    keys = stored(noise.select("doc_id", F.col("text").alias("_noise")).distinct())
    mine = X.strip_blank(F.col(text))
    return lines.withColumn("_t", mine).alias("l").join(
        broadcast_if_small(keys).alias("n"),
        (F.col("l.doc_id") == F.col("n.doc_id")) & (F.col("_t") == F.col("_noise")), "left_anti",
    ).drop("_t")


# ---- element tables ------------------------------------------------------


def merge_paragraphs(elements: DataFrame) -> DataFrame:
    """Joins adjacent body lines until one ends a sentence.

    elements(doc_id, page_no, pos, kind, content, is_heading, is_list, is_code);
    kind 0 is text. Headings, list items, code and other kinds stay alone.
    """
    w = Window.partitionBy(*PAGE).orderBy("pos")
    body = (F.col("kind") == 0) & ~F.col("is_heading") & ~F.col("is_list") & ~F.col("is_code")
    el = elements.withColumns({"_body": body, "_end": X.sentence_end(F.col("content"))})
    joins = F.col("_body") & F.coalesce(F.lag("_body").over(w) & ~F.lag("_end").over(w), F.lit(False))
    el = el.withColumn("_start", F.when(joins, 0).otherwise(1))
    el = el.withColumn("_island", F.sum("_start").over(w))
    merged = el.groupBy(*PAGE, "_island").agg(
        F.min("pos").alias("pos"), F.first("kind").alias("kind"),
        ordered_concat("content", "pos", " ").alias("content"),
        F.first("_body").alias("_body"), F.first("is_heading").alias("is_heading"),
        F.first("is_list").alias("is_list"), F.first("is_code").alias("is_code"),
    )
    return merged.select(
        *PAGE, "pos", "kind",
        F.when(F.col("_body"), X.strip_page_footer(F.col("content"))).otherwise(F.col("content")).alias("content"),
        "is_heading", "is_list", "is_code",
    )


# Length limits of heading fragments.
TITLE_OPEN, FRAGMENT_MAX = 60, 40


def merge_headings(elements: DataFrame) -> DataFrame:
    """Joins adjacent headings of one level while the title stays short.

    Only runs of adjacent same-level headings are folded, so the ordered fold
    sees a few fragments and never a whole page.
    """
    w = Window.partitionBy(*PAGE).orderBy("pos")
    level = F.regexp_extract("content", r"^(#{1,6})\s+.+$", 1)
    el = elements.withColumn("_level", F.when((F.col("kind") == 0) & F.col("is_heading") & (level != ""), level))
    same = F.coalesce(F.col("_level") == F.lag("_level").over(w), F.lit(False))
    el = el.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    title = F.regexp_extract("content", r"^#{1,6}\s+(.+)$", 1)
    runs = el.groupBy(*PAGE, "_run").agg(
        F.first("_level").alias("_level"), F.first("kind").alias("kind"),
        F.first("is_heading").alias("is_heading"), F.first("is_list").alias("is_list"), F.first("is_code").alias("is_code"),
        F.sort_array(F.collect_list(F.struct(
            "pos", F.when(F.col("_level").isNotNull(), title).otherwise(F.col("content")).alias("t")))).alias("_parts"),
    )

    def step(acc, part):
        last = F.element_at(acc, -1)
        fits = (F.length(last["t"]) < TITLE_OPEN) & (F.length(part["t"]) <= FRAGMENT_MAX)
        longer = F.struct(last["pos"].alias("pos"), F.concat(last["t"], F.lit(" "), part["t"]).alias("t"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(
            F.concat(acc, F.array(part)))

    folded = F.aggregate(F.slice("_parts", F.lit(2), F.size("_parts")), F.slice("_parts", 1, 1), step)
    out = runs.select(*PAGE, "kind", "is_heading", "is_list", "is_code", "_level", F.inline(folded))
    return out.select(
        *PAGE, "pos", "kind",
        F.when(F.col("_level").isNotNull(), F.concat("_level", F.lit(" "), "t")).otherwise(F.col("t")).alias("content"),
        "is_heading", "is_list", "is_code",
    )


def page_markdown(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Markdown of every page in pages(doc_id, page_no, title); page numbers start at 1.

    The first page opens with the title, later ones with a page marker; the
    pages of a document joined by a blank line are its text.
    """
    w = Window.partitionBy(*PAGE).orderBy("pos")
    text = F.col("kind") == 0
    code = text & F.col("is_code")
    item = text & F.col("is_list") & ~code
    el = elements.withColumns({"_code": code, "_item": item})
    before_item, before_code = (F.coalesce(F.lag(c).over(w), F.lit(False)) for c in ("_item", "_code"))
    after_code = F.coalesce(F.lead("_code").over(w), F.lit(False))
    piece = F.concat(
        F.when(before_item & ~F.col("_item"), F.lit("\n")).otherwise(F.lit("")),
        F.when(F.col("_code") & ~before_code, F.lit("```\n")).otherwise(F.lit("")),
        F.col("content"),
        F.when(F.col("_item"), F.lit("\n"))
        .when(F.col("_code") & after_code, F.lit("\n"))
        .when(F.col("_code"), F.lit("\n```\n\n"))
        .otherwise(F.lit("\n\n")),
    )
    bodies = el.withColumn("_piece", piece).groupBy(*PAGE).agg(ordered_concat("_piece", "pos", "").alias("_body"))
    clean = X.strip_blank(X.collapse_newlines(X.strip_control(F.col("_body"))))
    head = F.when(F.col("page_no") == 1, F.concat(F.lit("# "), "title")).otherwise(
        F.concat(F.lit("<!-- Page "), "page_no", F.lit(" -->")))
    return pages.join(bodies, PAGE, "left").select(
        *PAGE, F.concat_ws("\n\n", head, X.empty_to_null(clean)).alias("markdown"))


# ---- Markdown text, one document per row ---------------------------------

# Line patterns of lists, contents headings, items and rules.
LIST_LINE = r"\s*(?:[-*+]|\d+[.)])\s+"
TOC_HEADING = r"[^\S\n]{0,3}#{2,6}[^\S\n]+(?i:目录|目錄|contents?|table of contents)[^\S\n]*\n"
TOC_ITEM = r"[^\S\n]*(?:[-*+]|\d+[.)])[^\S\n]+\[[^\]\n]+\]\(#[^)\n]+\)[^\S\n]*\n"
RULE = r"[^\S\n]{0,3}(?:-{3,}|\*{3,}|_{3,})[^\S\n]*\n"
BLANK = r"[^\S\n]*\n"
FENCE = r"[^\S\n]*(?:```|~~~)"
#: A fenced block up to its closing line, or to the end when it stays open.
FENCED = rf"{FENCE}[^\n]*\n(?:(?!{FENCE})[^\n]*+\n)*+(?:{FENCE}[^\n]*\n)?"


def markdown_tokens(text: Column) -> Column:
    """Lines with their newline; a fenced block is one token."""
    return F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(rf"(?md)^({FENCED}|[^\n]*\n)"), F.lit(1))


# start of a list item, as LIST_LINE within one line
_ITEM = r"[^\S\n]*(?:[-*+]|\d+[.)])\s"
#: Fenced blocks and the lines that a blank line may follow: their newline is captured once more where one does.
SPACED = (
    rf"(?md)^(?:{FENCED}(?:(?={_ITEM})(?<=(\n)))?+"
    rf"|(?={_ITEM})[^\n]*+(\n)(?=(?!{_ITEM})(?![ \t])[^\S\n]*+\S)"
    rf"|(?!{_ITEM})[^\S\n]*+\S[^\n]*+(\n)(?={_ITEM}))"
)


def list_spacing(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blank line before a list after text and after a list before text.

    Fenced blocks pass unchanged; the full-width pipe becomes ``|``. One pass over the
    text, linear in it: a blank line goes where a list item and another line with something in it meet.
    """
    df = docs.withColumn(text, F.replace(F.col(text), F.lit("｜"), F.lit("|")))
    df = df.withColumn("_t", F.regexp_replace(F.concat(text, F.lit("\n")), SPACED, "$0$1$2$3"))
    tail = F.when(F.col(text).endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    return df.withColumn(text, F.concat(F.substring("_t", F.lit(1), F.length("_t") - 1), tail)).drop("_t")


def strip_contents(text: Column) -> Column:
    """Removes contents headings followed by two or more link items.

    A fenced block matches first and is put back, so it is left alone.
    """
    toc = rf"{TOC_HEADING}(?:{BLANK})*+(?:{TOC_ITEM}){{2,}}+(?:{BLANK})*+(?:{RULE})?+(?:{BLANK})*+"
    out = F.regexp_replace(F.concat(text, F.lit("\n")), rf"(?md)^(?:({FENCED})|{toc})", "$1")
    body = F.substring(out, F.lit(1), F.length(out) - 1)
    return F.concat(body, F.when(text.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))


RULE_BEFORE_HEADING = r"<hr\s*/?>\s*(?=<h[12][\s>])"


def strip_rules_before_headings(html: Column) -> Column:
    """struct(body, removed): rules directly before a first or second heading go."""
    return F.struct(
        F.regexp_replace(html, RULE_BEFORE_HEADING, "").alias("body"),
        F.regexp_count(html, F.lit(RULE_BEFORE_HEADING)).cast("long").alias("removed"),
    )


def split_chapters(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, chapter_no, title, body) at each level-1 heading outside fences.

    Text before the first heading becomes a preface; without headings the whole
    text is one chapter.
    """
    df = docs.select("doc_id", F.col(text).alias("_text")).withColumn("_t", markdown_tokens(F.col("_text")))
    h1 = r"^ {0,3}#[^\S\n]+"
    df = df.withColumn("_at", F.filter(F.transform("_t", lambda t, i: F.when(t.rlike(h1), i + 1)), lambda i: i.isNotNull()))
    cuts = F.concat(F.array(F.lit(1)), "_at", F.array(F.size("_t") + 1))
    df = df.withColumn("_cuts", cuts)
    chapters = F.transform(
        F.slice("_cuts", F.lit(1), F.size("_cuts") - 1),
        lambda c, i: F.array_join(F.slice(F.col("_t"), c, F.get(F.col("_cuts"), i + 1) - c), ""),
    )
    out = df.select("doc_id", (F.size("_at") > 0).alias("_has"), F.posexplode(chapters).alias("_n", "_body"))
    out = out.where((F.col("_n") > 0) | ~F.col("_has") | F.col("_body").rlike(r"\S"))
    title = X.strip_blank(F.regexp_replace(F.regexp_extract("_body", rf"{h1}([^\n]*)", 1), r"\s+#+\s*$", ""))
    return out.select(
        "doc_id", F.col("_n").cast("long").alias("chapter_no"),
        F.when(F.col("_n") > 0, F.coalesce(X.empty_to_null(title), F.lit("章节")))
        .when(F.col("_has"), F.lit("前言")).otherwise(F.lit("章节")).alias("title"),
        F.regexp_replace("_body", r"\n\z", "").alias("body"),
    )


def section_notes(docs: DataFrame, stems: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, stem, notes): lines belong to the last heading that matched a stem.

    Unmatched headings stay as text, rules are dropped, sections of one stem
    are joined by a blank line. Sections are cut in the document's row; only its
    headings are matched in a table of their own.
    """
    title = lambda line: X.empty_to_null(F.regexp_extract(line, r"^#{1,6}\s*(.+?)\s*$", 1))
    lines = docs.select("doc_id", F.split(F.col(text), "\n").alias("_lines"))
    heads = lines.select("doc_id", F.explode(F.array_distinct(F.filter(F.transform("_lines", title), lambda t: t.isNotNull()))).alias("title"))
    keys = match_titles(heads.select("title"), stems).where(F.col("stem").isNotNull())
    known = heads.distinct().join(keys, "title").groupBy("doc_id").agg(map_of("title", F.col("stem")).alias("_stems"))
    rows = lines.join(known, "doc_id").withColumn("_at", F.filter(
        F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.element_at(F.col("_stems"), title(x)).alias("stem"))),
        lambda h: h["stem"].isNotNull()))
    body = lambda h, k: F.filter(
        F.slice("_lines", h["i"] + 2, F.coalesce(F.get(F.col("_at"), k + 1)["i"], F.size("_lines")) - h["i"] - 1),
        lambda x: ~x.rlike(r"^\s*[-*]{3,}\s*$"))
    cut = F.transform("_at", lambda h, k: F.struct(
        h["stem"].alias("stem"), k.alias("_section"), X.strip_blank(F.array_join(body(h, k), "\n")).alias("_text")))
    return rows.select("doc_id", F.inline(cut)).groupBy("doc_id", "stem").agg(
        ordered_concat(X.empty_to_null(F.col("_text")), "_section", "\n\n").alias("notes"))


def normalize_anchor(c: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]", "")


def repair_anchors(docs: DataFrame, html: str = "html") -> DataFrame:
    """Retargets ``#fragment`` links to the last heading id that matches loosely."""
    ids = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<h[1-6]\b[^>]*\bid="([^"]*)"'), F.lit(1))
    pieces = F.regexp_extract_all(
        F.col(html), F.lit(r'(?i)(<a\s+[^>]*href="#[^"]+"|<[^<]*|[^<]+)'), F.lit(1))
    # last heading first, so that the first equal key is the one that wins
    df = docs.withColumns({"_ids": F.reverse(ids), "_p": pieces})
    df = df.withColumn("_keys", F.transform("_ids", normalize_anchor))

    def fix(p):
        fragment = F.regexp_extract(p, r'(?i)^<a\s+[^>]*href="#([^"]+)"\z', 1)
        at = F.array_position(F.col("_keys"), normalize_anchor(fragment)).cast("int")
        hit = F.get(F.col("_ids"), at - 1)
        prefix = F.regexp_extract(p, r'(?i)^(<a\s+[^>]*href=")#[^"]+"\z', 1)
        return F.when((fragment != "") & (hit != ""), F.concat(prefix, F.lit("#"), hit, F.lit('"'))).otherwise(p)

    # the size test reads the key list outside the lambda: it is built once per row
    fixed = F.when(F.size("_keys") == 0, F.col(html)).otherwise(F.array_join(F.transform("_p", fix), ""))
    return df.withColumn(html, fixed).drop("_ids", "_p", "_keys")


def html_statistics(html: Column, source: Column | None = None) -> Column:
    """struct of counts: tables, images, embedded images, diagrams, removed rules."""
    body = F.regexp_replace(html, RULE_BEFORE_HEADING, "")

    def count(c, pattern):
        return F.regexp_count(c, F.lit(pattern)).cast("long")

    return F.struct(
        count(body, r"<table[\s>]").alias("tables"),
        count(body, r"<img[\s>]").alias("images"),
        count(html if source is None else source, r"data:image/").alias("embedded_images"),
        count(body, r'(?s)<pre><code class="[^"]*\blanguage-mermaid\b[^"]*">.*?</code></pre>').alias("diagrams"),
        count(html, RULE_BEFORE_HEADING).alias("removed_rules"),
    )


# ---- notebooks -----------------------------------------------------------

NOTEBOOK_SCHEMA = (
    "struct<cells: array<struct<cell_type: string, source: string, "
    "attachments: map<string, map<string, string>>, "
    "outputs: array<struct<output_type: string, text: string>>>>>"
)

# File extension of an attachment by its type.
MIME_EXTENSIONS = {
    "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/svg+xml": ".svg",
    "image/webp": ".webp", "image/bmp": ".bmp", "image/tiff": ".tiff", "text/plain": ".txt",
}


def notebook_markdown(docs: DataFrame, json: str, stem: str) -> DataFrame:
    """Markdown of notebook JSON: text cells verbatim, code fenced, outputs indented.

    Attachments of text cells get running names below ``<stem>_files`` and
    their references are rewritten.
    """
    df = docs.withColumn("_c", F.from_json(F.col(json), NOTEBOOK_SCHEMA)["cells"])

    def attached(cell):
        entries = F.flatten(F.transform(
            F.map_entries(cell["attachments"]),
            lambda a: F.transform(F.map_entries(a["value"]), lambda m: F.struct(
                a["key"].alias("name"), m["key"].alias("mime")))))
        none = F.array().cast("array<struct<name: string, mime: string>>")
        return F.when(cell["cell_type"] == "markdown", F.coalesce(entries, none)).otherwise(none)

    df = df.withColumn("_a", F.transform("_c", attached))
    df = df.withColumn("_sizes", F.transform("_a", lambda a: F.size(a)))
    mime_map = F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv])

    def text(cell, i):
        first = F.aggregate(F.slice(F.col("_sizes"), F.lit(1), i), F.lit(0), lambda s, n: s + n)
        numbered = F.transform(F.get(F.col("_a"), i), lambda a, k: F.struct(
            a["name"].alias("name"),
            F.concat(F.col(stem), F.lit("_files/attachment_"), F.lpad((first + k + 1).cast("string"), 3, "0"),
                     F.coalesce(F.try_element_at(mime_map, a["mime"]), F.lit(".bin"))).alias("path")))
        source = F.aggregate(numbered, cell["source"], lambda s, a: F.replace(
            s, F.concat(F.lit("attachment:"), a["name"]), a["path"]))
        shown = F.transform(
            F.filter(cell["outputs"], lambda o: o["text"].isNotNull()),
            lambda o: F.regexp_replace(F.regexp_replace(o["text"], r"\n+\z", ""), r"(?md)^", "    "))
        outputs = F.when(F.size(shown) > 0, F.array_join(shown, "\n\n"))
        return F.when(
            cell["cell_type"] == "code",
            F.concat_ws("\n\n", F.concat(F.lit("```python\n"), cell["source"], F.lit("\n```")), outputs),
        ).otherwise(source)

    body = F.array_join(F.transform("_c", text), "\n\n")
    # the size test reads the counts outside the lambda: they are built once per row
    return df.withColumn("markdown", F.when(F.size("_sizes") >= 0, F.concat(body, F.lit("\n")))).drop("_c", "_a", "_sizes")


# ---- paragraph edits -----------------------------------------------------


def edit_paragraphs(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """paragraphs(doc_id, index, text, ..) with edits(doc_id, index, text) applied."""
    new = edits.select("doc_id", "index", F.col("text").alias("_new"))
    return paragraphs.join(broadcast_if_small(new), ["doc_id", "index"], "left").select(
        "doc_id", "index", F.coalesce("_new", "text").alias("text"))


def append_paragraphs(paragraphs: DataFrame, added: DataFrame) -> DataFrame:
    """added(doc_id, seq, text): placed after the last paragraph in order of seq (0, 1, ..)."""
    ends = paragraphs.groupBy("doc_id").agg((F.max("index") + 1).alias("_n"))
    tail = added.join(ends, "doc_id", "left").select(
        "doc_id", (F.coalesce("_n", F.lit(0)) + F.col("seq")).alias("index"), "text")
    return paragraphs.select("doc_id", "index", "text").unionByName(tail)


def edit_errors(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per edit whose index is outside its document."""
    ends = paragraphs.groupBy("doc_id").agg(F.max("index").alias("_last"))
    bad = edits.join(ends, "doc_id", "left").where(
        (F.col("index") < 0) | F.col("_last").isNull() | (F.col("index") > F.col("_last")))
    return bad.select("doc_id", "index", F.concat(
        F.lit("Paragraph index "), "index", F.lit(" out of range (0-"), F.coalesce("_last", F.lit(-1)), F.lit(")")).alias("error"))
