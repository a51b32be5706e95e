"""Section F: page selection, routing and document assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pagespec as P
from ..operators import assemble as A
from ..ordering import spread_keys
from .registry import query, table

_SPECS = ["1-3,5", "2", "3-1", "1,,2", "4-6,1-2,5", "a", "", "1-200000", "0", " 2 - 4 ,9", "5.0", "1-2-3", "99,1", "50-60", "7,7,1-7"]


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def _pick_sql(values, key):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({key} % {len(values)} AS INT) + 1]"


def pages(spark, d):
    """Turns as pages; flags follow from the turn number."""
    t = F.col("turn")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), t.alias("page_index"), F.when(t % 5 == 4, F.lit("")).otherwise(F.col("text")).alias("markdown"),
        (t % 3 == 0).alias("needs_ocr"), (F.length("text") % 4 == 0).alias("has_table"), (F.col("role") == "user").alias("has_columns"))


_PG = """pg AS (SELECT conv_id AS doc_id, turn AS page_index, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS markdown, turn % 3 = 0 AS needs_ocr,
   length(text) % 4 = 0 AS has_table, role = 'user' AS has_columns FROM conversations),
  pc AS (SELECT doc_id, count(*) AS n, min(page_index) AS f, max(page_index) AS l FROM pg GROUP BY 1)"""


def specs(spark, d):
    # few bytes a document, but a specification may stand for many pages
    docs = spread_keys(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id")
    return docs.withColumn("spec", _pick(_SPECS, F.col("doc_id")))


# every part of every spec with its ends, and the first error per spec
_SP = f"""sp AS (SELECT DISTINCT conv_id AS doc_id, {_pick_sql(_SPECS, 'conv_id')} AS spec FROM conversations),
  pt AS (SELECT doc_id, spec, i, trim(string_split(spec, ',')[i]) AS p FROM (SELECT *, unnest(range(1, len(string_split(spec, ',')) + 1)) AS i FROM sp WHERE spec <> '')),
  en AS (SELECT *, CASE WHEN regexp_full_match(p, '\\d+') THEN p::BIGINT WHEN regexp_full_match(p, '\\d+\\s*-\\s*\\d+') THEN regexp_extract(p, '^(\\d+)', 1)::BIGINT END AS lo,
     CASE WHEN regexp_full_match(p, '\\d+') THEN p::BIGINT WHEN regexp_full_match(p, '\\d+\\s*-\\s*\\d+') THEN regexp_extract(p, '(\\d+)$', 1)::BIGINT END AS hi FROM pt),
  er AS (SELECT doc_id, spec, min_by(e, i) AS error FROM (SELECT *, CASE WHEN lo IS NULL OR lo < 1 OR hi < 1 THEN 'Invalid page range: "' || spec || '"'
     WHEN lo > hi THEN 'Invalid page range (start > end): "' || spec || '"' END AS e FROM en) WHERE e IS NOT NULL GROUP BY ALL),
  ex AS (SELECT doc_id, page, min(i) AS i FROM (SELECT e.doc_id, i, unnest(range(lo, hi + 1)) AS page FROM en e WHERE NOT EXISTS
     (SELECT 1 FROM er WHERE er.doc_id = e.doc_id)) GROUP BY ALL),
  po AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY i, page) AS position FROM ex)"""


@query(
    "f01_page_spec_strict",
    f"""WITH {_SP}, j AS (SELECT doc_id, string_agg(page::VARCHAR, ',' ORDER BY position) AS pages FROM po GROUP BY 1)
        SELECT sp.doc_id, sp.spec, j.pages, er.error FROM sp LEFT JOIN j USING (doc_id) LEFT JOIN er USING (doc_id)""",
)
def _(spark, d):
    r = specs(spark, d).withColumn("r", P.parse_strict(F.col("spec")))
    return r.select("doc_id", "spec", F.array_join("r.pages", ",").alias("pages"), F.col("r.error").alias("error"))


@query(
    "f02_page_spec_clamped",
    f"""WITH {_PG}, {_SP}, sq AS (SELECT DISTINCT doc_id, spec FROM sp),
        p2 AS (SELECT doc_id, spec, i, trim(string_split(spec, ',')[i]) AS p FROM (SELECT *, unnest(range(1, len(string_split(spec, ',')) + 1)) AS i FROM sq)),
        e2 AS (SELECT p2.*, en.lo, en.hi, CASE WHEN p2.p = '' THEN 'Invalid pageRanges syntax: empty segment in "' || p2.spec || '"'
            WHEN NOT regexp_full_match(p2.p, '\\d+(\\s*-\\s*\\d+)?') THEN 'Invalid pageRanges syntax: cannot parse "' || p2.p || '" in "' || p2.spec || '"'
            WHEN lo < 1 THEN 'Invalid pageRanges syntax: page number must be >= 1, got "' || p2.p || '"'
            WHEN lo > hi THEN 'Invalid pageRanges syntax: descending range "' || p2.p || '" (' || lo || '>' || hi || ')' END AS e
          FROM p2 LEFT JOIN en ON en.doc_id = p2.doc_id AND en.i = p2.i),
        r2 AS (SELECT doc_id, min_by(e, i) AS error FROM e2 WHERE e IS NOT NULL GROUP BY 1),
        g2 AS (SELECT DISTINCT doc_id, least(pg, n) - 1 AS page FROM (SELECT e2.doc_id, n, unnest(range(lo, least(hi, lo + 200000) + 1)) AS pg FROM e2 JOIN pc USING (doc_id)
               WHERE NOT EXISTS (SELECT 1 FROM r2 WHERE r2.doc_id = e2.doc_id)))
        SELECT sq.doc_id, sq.spec, (SELECT string_agg(page::VARCHAR, ',' ORDER BY page) FROM g2 WHERE g2.doc_id = sq.doc_id) AS pages, r2.error
        FROM sq LEFT JOIN r2 USING (doc_id)""",
)
def _(spark, d):
    counts = A.page_counts(pages(spark, d)).select("doc_id", "page_count")
    r = specs(spark, d).join(counts, "doc_id").withColumn("r", P.parse_clamped(F.col("spec"), F.col("page_count")))
    return r.select("doc_id", "spec", F.array_join("r.pages", ",").alias("pages"), F.col("r.error").alias("error"))


@query(
    "f03_page_spec_skip",
    f"""WITH {_PG}, {_SP}, q AS (SELECT * FROM en WHERE p <> ''),
        bad AS (SELECT DISTINCT doc_id FROM q WHERE p NOT LIKE '%-%' AND NOT regexp_full_match(p, '\\d+') OR p LIKE '%-%' AND (lo IS NULL OR lo > hi))
        SELECT DISTINCT pg.doc_id, pg.page_index FROM pg JOIN q ON q.doc_id = pg.doc_id AND pg.page_index + 1 BETWEEN q.lo AND q.hi
        WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = pg.doc_id)""",
)
def _(spark, d):
    return A.select_pages_skipping(pages(spark, d), specs(spark, d)).select("doc_id", "page_index")


@query(
    "f04_page_cap",
    f"""WITH {_PG}, {_SP} SELECT pg.doc_id, page_index, position, needs_ocr FROM pg JOIN po ON po.doc_id = pg.doc_id AND po.page = pg.page_index + 1 WHERE position <= 3
        UNION ALL SELECT pg.doc_id, page_index, page_index + 1, needs_ocr FROM pg JOIN sp ON sp.doc_id = pg.doc_id AND spec = '' WHERE page_index < 3""",
)
def _(spark, d):
    return A.select_pages(pages(spark, d), specs(spark, d), 3).select("doc_id", "page_index", "position", "needs_ocr")


@query(
    "f04_page_cap_errors",
    f"""WITH {_PG}, {_SP}, a AS (SELECT doc_id, string_agg((page - 1)::VARCHAR, ', ' ORDER BY position) AS asked, min(page) AS low FROM po WHERE position <= 3 GROUP BY 1),
        j AS (SELECT sp.doc_id, sp.spec, coalesce(er.error, CASE WHEN low > n THEN 'PAGE_RANGE: Requested pages [' || asked || '] are outside the document (' || n ||
           CASE WHEN n = 1 THEN ' page)' ELSE ' pages)' END || '. Page numbers are 0-indexed.' END) AS error
           FROM sp LEFT JOIN er USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN pc USING (doc_id))
        SELECT * FROM j WHERE error IS NOT NULL""",
)
def _(spark, d):
    return A.selection_errors(pages(spark, d), specs(spark, d), 3)


@query(
    "f05_contiguous_ranges",
    f"""WITH {_PG}, r AS (SELECT doc_id, page_index, page_index - row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS g FROM pg WHERE NOT has_table),
        a AS (SELECT doc_id, min(page_index) + 1 AS first, max(page_index) + 1 AS last FROM r GROUP BY doc_id, g)
        SELECT *, last - first + 1 AS n_pages, doc_id || '_' || first || '-' || last || '.pdf' AS name FROM a""",
)
def _(spark, d):
    return A.contiguous_ranges(pages(spark, d).where(~F.col("has_table")))


@query(
    "f06_concatenate",
    f"""WITH {_PG} SELECT doc_id, page_index, row_number() OVER (ORDER BY doc_id, page_index) AS page_no FROM pg""",
)
def _(spark, d):
    return A.concatenate(pages(spark, d)).select("doc_id", "page_index", "page_no")


@query("f06_concatenate_total", "SELECT count(*) AS total_pages, count(DISTINCT conv_id) AS documents FROM conversations")
def _(spark, d):
    return A.concatenate_total(pages(spark, d))


def page_items(spark, d):
    """Words of every turn but those of assistants, pages counted from 1."""
    conv = table(spark, d, "conversations").where(F.col("role") != "assistant")
    return conv.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"),
                       F.posexplode(F.split("text", " ")).alias("item_no", "text"))


@query(
    "f07_items_by_page",
    """SELECT conv_id AS doc_id, turn AS page_index, CASE WHEN role = 'assistant' THEN 0 ELSE len(string_split(text, ' ')) END AS n_items,
         CASE WHEN role = 'assistant' THEN '' ELSE replace(text, ' ', '|') END AS items FROM conversations""",
)
def _(spark, d):
    out = A.items_by_page(pages(spark, d), page_items(spark, d))
    return out.select("doc_id", "page_index", F.size("text_items").cast("long").alias("n_items"), F.array_join("text_items", "|").alias("items"))


@query(
    "f08_document_rollup",
    f"""WITH {_PG} SELECT doc_id, count(*) AS page_count, count_if(needs_ocr)::BIGINT AS pages_needing_ocr, count_if(has_table)::BIGINT AS pages_with_tables,
        count_if(has_columns)::BIGINT AS pages_with_columns, CASE WHEN doc_id % 3 = 0 THEN 'Scanned' ELSE 'Unknown' END AS pdf_type,
        CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM pg GROUP BY 1""",
)
def _(spark, d):
    classes = specs(spark, d).where(F.col("doc_id") % 3 == 0).select("doc_id", F.lit("Scanned").alias("pdf_type"), F.lit(0.5).alias("confidence"))
    return A.document_rollup(pages(spark, d), classes)


@query(
    "f08_flagged_pages",
    f"""WITH {_PG} SELECT doc_id, page_index, 'ocr' AS flag FROM pg WHERE needs_ocr UNION ALL SELECT doc_id, page_index, 'table' FROM pg WHERE has_table
        UNION ALL SELECT doc_id, page_index, 'columns' FROM pg WHERE has_columns""",
)
def _(spark, d):
    return A.flagged_pages(pages(spark, d))


_ENGINE = ["Failed to load pdfium: dlopen", "ort_dylib_path is not set", "Model download failed", "page 3 has low confidence", "please install a compatible build"]


@query(
    "f09_ocr_route",
    f"""WITH {_PG}, k AS (SELECT doc_id, ['off', 'auto', 'force'][CAST(doc_id % 3 AS INT) + 1] AS mode, count_if(needs_ocr AND doc_id % 2 = 0)::BIGINT AS flagged,
          CASE WHEN doc_id % 4 <> 0 THEN {_pick_sql(_ENGINE, 'doc_id')} END AS engine_error FROM pg GROUP BY doc_id),
        s AS (SELECT *, mode = 'off' OR mode = 'auto' AND flagged = 0 AS nat, engine_error NOT LIKE 'page 3%' AS setup FROM k)
        SELECT doc_id, mode, flagged, engine_error, CASE WHEN nat THEN 'native' WHEN engine_error IS NULL THEN 'ocr' WHEN setup THEN 'native' ELSE 'error' END AS route,
          CASE WHEN NOT nat AND setup THEN 'Local OCR unavailable (' || engine_error || '); returning native text, which may be incomplete for scanned pages.' END AS warning,
          CASE WHEN NOT nat AND NOT setup THEN engine_error END AS error FROM s""",
)
def _(spark, d):
    k = F.col("doc_id")
    docs = pages(spark, d).groupBy("doc_id").agg(F.count_if(F.col("needs_ocr") & (k % 2 == 0)).alias("flagged"))
    docs = docs.select("doc_id", _pick(["off", "auto", "force"], k).alias("mode"), "flagged", F.when(k % 4 != 0, _pick(_ENGINE, k)).alias("engine_error"))
    return A.ocr_route(docs)


@query(
    "f10_text_segments",
    f"""WITH {_PG} SELECT pg.doc_id, 1::BIGINT AS part, page_index, CASE WHEN page_index = f THEN '' ELSE chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) END ||
          regexp_replace(concat_ws(chr(10) || chr(10), '[Page ' || (page_index + 1) || ']', CASE WHEN needs_ocr THEN '(Page ' || (page_index + 1) ||
          ' flagged for OCR — text content may be unreliable)' END, nullif(markdown, '')), CASE WHEN page_index = l THEN '\\s+$' ELSE '^$' END, '') AS text
        FROM pg JOIN pc USING (doc_id)""",
)
def _(spark, d):
    return A.text_segments(pages(spark, d))


@query(
    "f11_markdown_segments",
    f"""WITH {_PG}, fl AS (SELECT doc_id, page_index, count(*) OVER w AS n, min(page_index) OVER w AS a, max(page_index) OVER w AS b FROM pg WHERE needs_ocr
          WINDOW w AS (PARTITION BY doc_id))
        SELECT doc_id, 0::BIGINT AS part, page_index, CASE WHEN page_index = a THEN '<!-- OCR warning: ' || n || ' page(s) [' ELSE ', ' END || (page_index + 1) ||
          CASE WHEN page_index = b THEN '] flagged for OCR; native text may be incomplete. -->' || chr(10) || chr(10) ELSE '' END AS text FROM fl
        UNION ALL SELECT pg.doc_id, 1, page_index, CASE WHEN page_index = f THEN '' ELSE chr(10) || chr(10) END || markdown FROM pg JOIN pc USING (doc_id)""",
)
def _(spark, d):
    return A.markdown_segments(pages(spark, d))


def recognised(spark, d):
    """Pages with the provenance of a recogniser."""
    p = F.col("page_index")
    conf = F.floor(F.length("markdown") / 2000.0 * 100 + 0.5) / 100
    return pages(spark, d).withColumns({
        "source": _pick(["Native", "Ocr", "Mixed"], p), "ocr_confidence": F.when(p % 2 == 0, conf),
        "hosted_recommended": p % 4 == 1})


def setup_warnings(spark, d):
    """Warnings of the route for every fifth document."""
    docs = specs(spark, d).select(
        "doc_id", F.lit("force").alias("mode"), F.lit(1).alias("flagged"), F.when(F.col("doc_id") % 5 == 0, F.lit(_ENGINE[0])).alias("engine_error"))
    return A.ocr_route(docs).select("doc_id", "warning")


_WARN_SQL = f"""wn AS (SELECT DISTINCT doc_id, 'Local OCR unavailable ({_ENGINE[0]}); returning native text, which may be incomplete for scanned pages.' AS warning
   FROM pg WHERE doc_id % 5 = 0)"""


@query(
    "f11_ocr_markdown_segments",
    f"""WITH {_PG}, {_WARN_SQL}, fl AS (SELECT doc_id, page_index, count(*) OVER w AS n, min(page_index) OVER w AS a, max(page_index) OVER w AS b FROM pg
          WHERE page_index % 4 = 1 AND doc_id % 5 <> 0 WINDOW w AS (PARTITION BY doc_id))
        SELECT doc_id, 0::BIGINT AS part, page_index, CASE WHEN page_index = a THEN '<!-- OCR warning: ' || n || ' page(s) [' ELSE ', ' END || (page_index + 1) ||
          CASE WHEN page_index = b THEN '] look incomplete after local OCR. -->' || chr(10) || chr(10) ELSE '' END AS text FROM fl
        UNION ALL SELECT doc_id, 0, 0, '<!-- ' || warning || ' -->' || chr(10) || chr(10) FROM wn
        UNION ALL SELECT pg.doc_id, 1, page_index, CASE WHEN page_index = f THEN '' ELSE chr(10) || chr(10) END || markdown FROM pg JOIN pc USING (doc_id)""",
)
def _(spark, d):
    return A.ocr_markdown_segments(recognised(spark, d), setup_warnings(spark, d))


def _list_sql(part, name, flag, before="]"):
    return f"""UNION ALL SELECT doc_id, {part}, 0, '{before},"{name}":[' FROM pc
        UNION ALL SELECT doc_id, {part + 1}, page_index, CASE WHEN page_index = min(page_index) OVER (PARTITION BY doc_id) THEN '' ELSE ',' END || page_index FROM pg WHERE {flag}"""


@query(
    "f12_json_segments",
    f"""WITH {_PG}, it AS (SELECT conv_id AS doc_id, turn AS page_index, CASE WHEN role = 'assistant' THEN '[]' ELSE to_json(string_split(text, ' '))::VARCHAR END AS items FROM conversations),
        q AS (SELECT pg.*, items, f, n FROM pg JOIN it USING (doc_id, page_index) JOIN pc USING (doc_id))
        SELECT doc_id, 0::BIGINT AS part, page_index, CASE WHEN page_index = f THEN '{{"docId":' || doc_id || ',"pageCount":' || n || ',"pdfType":"' ||
            CASE WHEN doc_id % 3 = 0 THEN 'Scanned' ELSE 'Unknown' END || '","confidence":' || CASE WHEN doc_id % 3 = 0 THEN '0.5' ELSE '0.0' END || ',"pages":[' ELSE ',' END ||
          '{{"pageIndex":' || page_index || ',"markdown":' || to_json(markdown)::VARCHAR || ',"needsOcr":' || needs_ocr || ',"textItems":' || items ||
          ',"ocrProvenance":{{"source":"' || ['Native', 'Ocr', 'Mixed'][CAST(page_index % 3 AS INT) + 1] || '","hostedRecommended":' || (page_index % 4 = 1) ||
          ',"warnings":[]}}}}' AS text FROM q
        {_list_sql(1, 'pagesNeedingOcr', 'needs_ocr')} {_list_sql(3, 'pagesWithTables', 'has_table')} {_list_sql(5, 'pagesWithColumns', 'has_columns')}
        UNION ALL SELECT doc_id, 7, 0, ']}}' FROM pc""",
)
def _(spark, d):
    given = A.items_by_page(recognised(spark, d), page_items(spark, d)).withColumns({
        "ocr_confidence": F.lit(None).cast("double"), "warnings": F.array().cast("array<string>")})
    classes = specs(spark, d).where(F.col("doc_id") % 3 == 0).select("doc_id", F.lit("Scanned").alias("pdf_type"), F.lit(0.5).alias("confidence"))
    return A.json_segments(given, classes)


@query(
    "f13_provenance_segments",
    f"""WITH {_PG}, {_WARN_SQL}, q AS (SELECT *, ['Native', 'Ocr', 'Mixed'][CAST(page_index % 3 AS INT) + 1] AS source, CASE WHEN page_index % 2 = 0 THEN length(markdown) / 2000.0 END AS conf,
          page_index % 4 = 1 AS hosted FROM pg)
        SELECT q.doc_id, 1::BIGINT AS part, page_index, CASE WHEN page_index = f THEN '' ELSE chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) END ||
          regexp_replace(concat_ws(chr(10) || chr(10), '[Page ' || (page_index + 1) || ']', CASE WHEN source <> 'Native' THEN '(Page ' || (page_index + 1) || ': local OCR applied'
            || coalesce(' (confidence ' || printf('%.2f', (floor(conf * 100 + 0.5) / 100)::DOUBLE) || ')', '') || ')' END,
          CASE WHEN hosted THEN '(Page ' || (page_index + 1) || ': OCR result looks incomplete — consider a hosted parser)' END, nullif(markdown, '')),
          CASE WHEN page_index = l THEN '\\s+$' ELSE '^$' END, '') AS text FROM q JOIN pc USING (doc_id)
        UNION ALL SELECT doc_id, 0, 0, warning || chr(10) || chr(10) FROM wn""",
)
def _(spark, d):
    return A.provenance_segments(recognised(spark, d), setup_warnings(spark, d))


_MESSAGES = ["Cannot find native binding for x", "InvalidFileHeader at 0", "selected page 7 is invalid", "file is ENCRYPTED", "broken ToUnicode map",
             "page needs ocr", "boom", "not a pdf but password", "invalid page number, bad encoding", "OCR and cmap"]


@query(
    "f14_error_classes",
    f"""WITH m AS (SELECT event_id, {_pick_sql(_MESSAGES, 'event_id')} || ' #' || user_id AS msg, event_id % 10 AS k FROM events)
        SELECT event_id, ['PLATFORM_UNSUPPORTED','BAD_PDF','PAGE_RANGE','DECRYPT','ENCODING','OCR_NEEDED','NATIVE','BAD_PDF','PAGE_RANGE','ENCODING'][CAST(k AS INT) + 1] AS code,
          ['','Invalid PDF file: ','Page selection out of range: ','PDF decryption failed: ','PDF encoding issue: ','','pdf-inspector native error: ','Invalid PDF file: ',
           'Page selection out of range: ','PDF encoding issue: '][CAST(k AS INT) + 1] || msg AS message FROM m""",
)
def _(spark, d):
    k = F.col("event_id")
    msg = F.concat(_pick(_MESSAGES, k), F.lit(" #"), "user_id")
    return table(spark, d, "events").select("event_id", A.classify_error(msg).alias("r")).select("event_id", "r.*")


_OPS = ["BT (x) Tj ET", "/Im0 Do Q", "0 0 m f f* S", "sh", "q Q", "f S B", "/Im1\nDox b", "[(a)] TJ s", " f\nf f", "(f) sfs"]


@query(
    "f15_blank_pages",
    f"""WITH c AS (SELECT event_id, replace({_pick_sql([o.replace(chr(10), '@') for o in _OPS], 'event_id')} || ' ' || {_pick_sql([o.replace(chr(10), '@') for o in _OPS], '(event_id // 10)')}, '@', chr(10)) AS s FROM events),
        k AS (SELECT event_id, len(regexp_extract_all(s, 'T[jJ]')) AS text, len(regexp_extract_all(s, '/Im0\\s+Do')) AS xobject,
              len(list_filter(string_split_regex(s, '\\s+'), lambda t: list_contains(['f*','B*','b*','sh','f','S','s','B','b'], t))) AS paint FROM c)
        SELECT *, text = 0 AND xobject = 0 AND paint <= 2 AS blank FROM k""",
)
def _(spark, d):
    k = F.col("event_id")
    content = F.concat(_pick(_OPS, k), F.lit(" "), _pick(_OPS, F.floor(k / 10)))
    return table(spark, d, "events").select("event_id", A.content_ops(content).alias("r")).select("event_id", "r.*")
