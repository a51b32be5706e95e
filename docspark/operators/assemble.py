"""Page selection, routing and document text assembly.

A document's text is returned as ordered segments (doc_id, part, page_index,
text): joined in that order they are the text. A document of any length thus
never meets in one task; ``write_segments`` stores it in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pagespec as P
from ..functions.text import rstrip_blank
from ..ordering import broadcast_if_small, number_within, running_offsets


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"))


# ---- selection -----------------------------------------------------------


def _cap(max_pages: int | None) -> int | None:
    if max_pages is not None and max_pages < 1:
        raise ValueError("max_pages must be positive")
    return max_pages


def select_pages(pages: DataFrame, specs: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages named by specs(doc_id, spec) in selection order, or all of a document without a spec.

    pages(doc_id, page_index, ..) are 0-based; ``position`` is 1-based. ``max_pages`` keeps the
    first pages of the selection; without it nothing is cut.
    """
    cap = _cap(max_pages)
    parsed = specs.withColumn("_r", P.parse_ranges(F.col("spec"))).where(F.col("_r.error").isNull()).select(
        "doc_id", F.col("_r.ranges").alias("_ranges"))
    page = F.col("page_index") + 1
    hit = F.get(F.filter("_ranges", lambda r: page.between(r["lo"], r["hi"])), F.lit(0))
    position = F.when(F.col("_ranges").isNull(), page).otherwise(hit["before"] + page - hit["lo"] + 1).cast("long")
    picked = pages.join(broadcast_if_small(parsed), "doc_id").withColumn("position", position).drop("_ranges")
    picked = picked.where(F.col("position").isNotNull())
    return picked if cap is None else picked.where(F.col("position") <= cap)


def selection_errors(pages: DataFrame, specs: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Documents whose selection is malformed or names no existing page.

    The message lists the pages asked for, at most ``max_pages``; without it, their ranges.
    """
    cap = _cap(max_pages)
    counts = page_counts(pages).select("doc_id", "page_count")
    df = specs.withColumn("_r", P.parse_ranges(F.col("spec"))).join(counts, "doc_id", "left")
    ranges, n = F.col("_r.ranges"), F.coalesce("page_count", F.lit(0))
    if cap is None:
        shown = F.transform(ranges, lambda r: F.when(r["lo"] == r["hi"], (r["lo"] - 1).cast("string")).otherwise(
            F.concat(r["lo"] - 1, F.lit("-"), r["hi"] - 1)))
        asked = ranges
    else:
        first = F.transform(F.filter(ranges, lambda r: r["before"] < cap), lambda r: F.struct(
            r["lo"].alias("lo"), F.least(r["hi"], r["lo"] + cap - r["before"] - 1).alias("hi")))
        shown, asked = F.transform(P.unrolled(first), lambda p: p - 1), first
    outside = ranges.isNotNull() & ~F.exists(asked, lambda r: r["lo"] <= n)
    message = F.concat(
        F.lit("PAGE_RANGE: Requested pages ["), F.array_join(shown, ", "), F.lit("] are outside the document ("), n,
        F.when(n == 1, F.lit(" page)")).otherwise(F.lit(" pages)")), F.lit(". Page numbers are 0-indexed."))
    df = df.withColumn("error", F.coalesce(F.col("_r.error"), F.when(outside, message)))
    return df.where(F.col("error").isNotNull()).select("doc_id", "spec", "error")


def select_pages_skipping(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Existing pages named by the specs; pages out of range are skipped silently."""
    parsed = specs.withColumn("_r", P.parse_targets(F.col("spec"))).where(F.col("_r.error").isNull())
    ranges = parsed.select("doc_id", F.col("_r.ranges").alias("_ranges"))
    hit = F.exists("_ranges", lambda r: (F.col("page_index") + 1).between(r["lo"], r["hi"]))
    return pages.join(broadcast_if_small(ranges), "doc_id").where(hit).drop("_ranges")


def contiguous_ranges(pages: DataFrame) -> DataFrame:
    """Runs of neighbouring pages as (doc_id, first, last, n_pages, name), 1-based."""
    numbered = number_within(pages.select("doc_id", "page_index"), ["doc_id"], ["page_index"], "_n")
    runs = numbered.groupBy("doc_id", (F.col("page_index") - F.col("_n")).alias("_run")).agg(
        (F.min("page_index") + 1).alias("first"), (F.max("page_index") + 1).alias("last"))
    return runs.select(
        "doc_id", "first", "last", (F.col("last") - F.col("first") + 1).alias("n_pages"),
        F.concat("doc_id", F.lit("_"), "first", F.lit("-"), "last", F.lit(".pdf")).alias("name"))


def concatenate(pages: DataFrame) -> DataFrame:
    """Pages of all documents, in order of doc_id, with one running 1-based number."""
    offsets = running_offsets(page_counts(pages).select("doc_id", "page_count"), "doc_id", "page_count", "_offset")
    return pages.join(offsets.select("doc_id", "_offset"), "doc_id").withColumn(
        "page_no", F.col("_offset") + F.col("page_index") + 1).drop("_offset")


def concatenate_total(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("total_pages"), F.countDistinct("doc_id").alias("documents"))


# ---- document structure --------------------------------------------------


def items_by_page(pages: DataFrame, items: DataFrame) -> DataFrame:
    """pages(doc_id, page_index, ..) with an ordered array of items(doc_id, page, item_no, text).

    Items count pages from 1; pages without items get an empty array.
    """
    grouped = items.groupBy("doc_id", (F.col("page") - 1).alias("page_index")).agg(
        F.sort_array(F.collect_list(F.struct("item_no", "text"))).alias("_items"))
    none = F.array().cast("array<string>")
    return pages.join(grouped, ["doc_id", "page_index"], "left").withColumn(
        "text_items", F.coalesce(F.transform("_items", lambda i: i["text"]), none)).drop("_items")


def document_rollup(pages: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Counts per document; type and confidence default to Unknown and 0."""
    flags = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if("needs_ocr").alias("pages_needing_ocr"),
        F.count_if("has_table").alias("pages_with_tables"),
        F.count_if("has_columns").alias("pages_with_columns"),
    )
    if classes is None:
        return flags.withColumns({"pdf_type": F.lit("Unknown"), "confidence": F.lit(0.0)})
    out = flags.join(broadcast_if_small(classes), "doc_id", "left")
    return out.withColumns({
        "pdf_type": F.coalesce("pdf_type", F.lit("Unknown")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def flagged_pages(pages: DataFrame) -> DataFrame:
    """The page lists of the rollup in long form: (doc_id, flag, page_index), 0-based."""
    flags = F.array(
        F.when(F.col("needs_ocr"), F.lit("ocr")), F.when(F.col("has_table"), F.lit("table")),
        F.when(F.col("has_columns"), F.lit("columns")))
    return pages.select("doc_id", "page_index", F.explode(flags).alias("flag")).where(F.col("flag").isNotNull())


# Messages of a recogniser that could not be set up.
SETUP_ERRORS = (
    r"(?i)failed to load (?:PDFium|ONNX Runtime)|PDFIUM_LIB_PATH|ORT_DYLIB_PATH"
    r"|model (?:cache|download|acquisition)|install a compatible"
)


def ocr_route(docs: DataFrame) -> DataFrame:
    """docs(doc_id, mode, flagged, engine_error) to route, warning and error.

    ``off`` and unflagged ``auto`` stay native; a setup failure falls back with
    a warning, any other failure is passed on.
    """
    native = (F.col("mode") == "off") | ((F.col("mode") == "auto") & (F.col("flagged") == 0))
    message = F.col("engine_error")
    setup = message.rlike(SETUP_ERRORS)
    warning = F.concat(
        F.lit("Local OCR unavailable ("), message,
        F.lit("); returning native text, which may be incomplete for scanned pages."))
    return docs.withColumns({
        "route": F.when(native, F.lit("native")).when(message.isNull(), F.lit("ocr"))
        .when(setup, F.lit("native")).otherwise(F.lit("error")),
        "warning": F.when(~native & setup, warning),
        "error": F.when(~native & ~setup, message),
    })


# Error codes with their message patterns, in test order.
ERROR_CODES = [
    ("PLATFORM_UNSUPPORTED", r"(?i)Cannot find native binding", ""),
    ("BAD_PDF", r"(?i)InvalidFileHeader|Bad PDF|not a valid PDF|Not a PDF", "Invalid PDF file: "),
    ("PAGE_RANGE", r"(?i)selected page \d+ is invalid|page numbers are 1-indexed|invalid page number", "Page selection out of range: "),
    ("DECRYPT", r"(?i)password|encrypted|decrypt", "PDF decryption failed: "),
    ("ENCODING", r"(?i)encoding|CMap|ToUnicode", "PDF encoding issue: "),
    ("OCR_NEEDED", r"(?i)OCR", ""),
]


def classify_error(message: Column) -> Column:
    """struct(code, message); the first matching pattern wins."""
    code = text = None
    for name, pattern, prefix in ERROR_CODES:
        hit, full = message.rlike(pattern), F.concat(F.lit(prefix), message)
        code = F.when(hit, F.lit(name)) if code is None else code.when(hit, F.lit(name))
        text = F.when(hit, full) if text is None else text.when(hit, full)
    return F.struct(
        code.otherwise(F.lit("NATIVE")).alias("code"),
        text.otherwise(F.concat(F.lit("pdf-inspector native error: "), message)).alias("message"))


def content_ops(content: Column) -> Column:
    """struct of text, object and paint operators and the blank-page verdict."""
    text = F.regexp_count(content, F.lit("T[jJ]")).cast("long")
    xobject = F.regexp_count(content, F.lit(r"/[^\s/<>\[\]()%]+\s+Do\b")).cast("long")
    paint = F.regexp_count(content, F.lit(r"(?:^|\s)(?:f\*|B\*|b\*|sh|f|S|s|B|b)(?=\s|\z)")).cast("long")
    return F.struct(
        text.alias("text"), xobject.alias("xobject"), paint.alias("paint"),
        ((text == 0) & (xobject == 0) & (paint <= 2)).alias("blank"))


# ---- text assembly -------------------------------------------------------

PAGE_BREAK = "\n\n--- Page Break ---\n\n"


def _with_ends(pages: DataFrame) -> DataFrame:
    return pages.join(broadcast_if_small(page_counts(pages)), "doc_id")


def _label() -> Column:
    return F.concat(F.lit("[Page "), F.col("page_index") + 1, F.lit("]"))


def _joined(df: DataFrame, parts: Column, sep: str, part: int = 1) -> DataFrame:
    """Page texts with the separator in front of every page but the first; the end is trimmed."""
    text = F.when(F.col("page_index") == F.col("last_page"), rstrip_blank(parts)).otherwise(parts)
    lead = F.when(F.col("page_index") == F.col("first_page"), F.lit("")).otherwise(F.lit(sep))
    return df.select("doc_id", F.lit(part).cast("long").alias("part"), "page_index", F.concat(lead, text).alias("text"))


def text_segments(pages: DataFrame) -> DataFrame:
    """``[Page n]``, OCR note when flagged, Markdown; pages divided by a page break."""
    note = F.when(F.col("needs_ocr"), F.concat(
        F.lit("(Page "), F.col("page_index") + 1, F.lit(" flagged for OCR — text content may be unreliable)")))
    return _joined(_with_ends(pages), F.concat_ws("\n\n", _label(), note, F.nullif("markdown", F.lit(""))), PAGE_BREAK)


def _list_segments(flagged: DataFrame, head: Column, tail: str, part: int) -> DataFrame:
    """A bracketed 1-based page list as one segment per page, with head and tail."""
    ends = flagged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("page_index").alias("_first"), F.max("page_index").alias("_last"))
    df = flagged.join(broadcast_if_small(ends), "doc_id")
    text = F.concat(
        F.when(F.col("page_index") == F.col("_first"), head).otherwise(F.lit(", ")),
        (F.col("page_index") + 1).cast("string"),
        F.when(F.col("page_index") == F.col("_last"), F.lit(tail)).otherwise(F.lit("")))
    return df.select("doc_id", F.lit(part).cast("long").alias("part"), "page_index", text.alias("text"))


def _body(pages: DataFrame) -> DataFrame:
    df = _with_ends(pages)
    lead = F.when(F.col("page_index") == F.col("first_page"), F.lit("")).otherwise(F.lit("\n\n"))
    return df.select("doc_id", F.lit(1).cast("long").alias("part"), "page_index",
                     F.concat(lead, F.coalesce("markdown", F.lit(""))).alias("text"))


def _warned(warnings: DataFrame, before: str, behind: str) -> DataFrame:
    """The warning of each document that has one, as its first segment."""
    return warnings.where(F.col("warning").isNotNull()).select(
        "doc_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("page_index"),
        F.concat(F.lit(before), "warning", F.lit(behind)).alias("text"))


_WARNING_HEAD = "<!-- OCR warning: "


def markdown_segments(pages: DataFrame) -> DataFrame:
    """Pages joined by a blank line, after a comment naming the flagged pages."""
    head = F.concat(F.lit(_WARNING_HEAD), F.col("_n"), F.lit(" page(s) ["))
    warn = _list_segments(
        pages.where(F.col("needs_ocr")).select("doc_id", "page_index"), head,
        "] flagged for OCR; native text may be incomplete. -->\n\n", 0)
    return warn.unionByName(_body(pages))


def ocr_markdown_segments(pages: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """As :func:`markdown_segments` for recognised pages(.., hosted_recommended).

    The comment holds the document's warning(doc_id, warning), else it names the pages that
    still look incomplete.
    """
    hosted = pages.where(F.col("hosted_recommended")).select("doc_id", "page_index")
    out = _body(pages)
    if warnings is not None:
        said = warnings.where(F.col("warning").isNotNull())
        out = out.unionByName(_warned(said, "<!-- ", " -->\n\n"))
        hosted = hosted.join(said.select("doc_id"), "doc_id", "left_anti")
    head = F.concat(F.lit(_WARNING_HEAD), F.col("_n"), F.lit(" page(s) ["))
    return out.unionByName(_list_segments(hosted, head, "] look incomplete after local OCR. -->\n\n", 0))


#: Page lists of the JSON document: its name and the flag column.
PAGE_LISTS = (("pagesNeedingOcr", "needs_ocr"), ("pagesWithTables", "has_table"), ("pagesWithColumns", "has_columns"))


def json_segments(pages: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The nested document as JSON: head, one piece per page, the page lists, tail.

    pages(doc_id, page_index, markdown, needs_ocr, text_items) may have ``has_table`` and
    ``has_columns`` for further lists, and ``source, ocr_confidence, hosted_recommended,
    warnings`` for the provenance of recognised pages; classes(doc_id, pdf_type, confidence)
    may give type and confidence, else ``Unknown`` and 0.
    """
    df = _with_ends(pages)
    if classes is None:
        df = df.withColumns({"_type": F.lit("Unknown"), "_sure": F.lit(0.0)})
    else:
        known = classes.select("doc_id", F.col("pdf_type").alias("_type"), F.col("confidence").cast("double").alias("_sure"))
        df = df.join(broadcast_if_small(known), "doc_id", "left").withColumns({
            "_type": F.coalesce("_type", F.lit("Unknown")), "_sure": F.coalesce("_sure", F.lit(0.0))})
    first = F.col("page_index") == F.col("first_page")
    fields = [F.col("page_index").alias("pageIndex"), F.col("markdown"), F.col("needs_ocr").alias("needsOcr"), F.col("text_items").alias("textItems")]
    page = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    if "source" in pages.columns:
        given = F.to_json(F.struct(
            "source", F.col("ocr_confidence").alias("ocrConfidence"), F.col("hosted_recommended").alias("hostedRecommended"), "warnings"))
        page = F.when(F.col("source").isNull(), page).otherwise(
            F.concat(F.expr("substring(_page, 1, length(_page) - 1)"), F.lit(',"ocrProvenance":'), given, F.lit("}")))
        df = df.withColumn("_page", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    head = F.concat(
        F.lit('{"docId":'), "doc_id", F.lit(',"pageCount":'), "page_count", F.lit(',"pdfType":'), F.to_json(F.array("_type")).substr(F.lit(2), F.length(F.to_json(F.array("_type"))) - 2),
        F.lit(',"confidence":'), F.col("_sure").cast("string"), F.lit(',"pages":['))
    out = df.select(
        "doc_id", F.lit(0).cast("long").alias("part"), "page_index",
        F.concat(F.when(first, head).otherwise(F.lit(",")), page).alias("text"))
    ends = page_counts(pages)
    part, before = 1, "]"
    for name, flag in PAGE_LISTS:
        if flag not in pages.columns:
            continue
        out = out.unionByName(ends.select(
            "doc_id", F.lit(part).cast("long").alias("part"), F.lit(0).cast("long").alias("page_index"), F.lit(f'{before},"{name}":[').alias("text")))
        marked = pages.where(F.col(flag)).select("doc_id", "page_index")
        out = out.unionByName(marked.join(marked.groupBy("doc_id").agg(F.min("page_index").alias("_f")), "doc_id").select(
            "doc_id", F.lit(part + 1).cast("long").alias("part"), "page_index",
            F.concat(F.when(F.col("page_index") == F.col("_f"), F.lit("")).otherwise(F.lit(",")), F.col("page_index").cast("string")).alias("text")))
        part, before = part + 2, "]"
    return out.unionByName(ends.select(
        "doc_id", F.lit(part).cast("long").alias("part"), F.lit(0).cast("long").alias("page_index"), F.lit("]}").alias("text")))


def provenance_segments(pages: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Text with OCR provenance: pages(.., source, ocr_confidence, hosted_recommended).

    A document's warning(doc_id, warning) stands before its first page.
    """
    n = F.col("page_index") + 1
    confidence = F.when(F.col("ocr_confidence").isNotNull(),
                        F.concat(F.lit(" (confidence "), F.format_string("%.2f", "ocr_confidence"), F.lit(")"))).otherwise(F.lit(""))
    applied = F.when(F.col("source") != "Native", F.concat(F.lit("(Page "), n, F.lit(": local OCR applied"), confidence, F.lit(")")))
    incomplete = F.when(F.col("hosted_recommended"), F.concat(
        F.lit("(Page "), n, F.lit(": OCR result looks incomplete — consider a hosted parser)")))
    parts = F.concat_ws("\n\n", _label(), applied, incomplete, F.nullif("markdown", F.lit("")))
    out = _joined(_with_ends(pages), parts, PAGE_BREAK)
    return out if warnings is None else out.unionByName(_warned(warnings, "", "\n\n"))


def write_segments(segments: DataFrame, path: str) -> None:
    """Store segments so that each file holds whole runs in reading order."""
    segments.repartitionByRange("doc_id", "part", "page_index").sortWithinPartitions(
        "doc_id", "part", "page_index").write.mode("errorifexists").parquet(path)
