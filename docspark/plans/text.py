"""Section E: text cleaning and document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import text as E
from ..ordering import number_within
from .registry import query, table


def docs(spark, d):
    return table(spark, d, "documents")


# ---- cleaning ------------------------------------------------------------


@query(
    "e01_control_strip",
    r"""SELECT doc_id, regexp_replace(replace(replace(text, ' the ', ' ' || chr(1) || 'the' || chr(11) || ' '), '. ', '.' || chr(9) || chr(31)),
          '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS text FROM documents""",
)
def _(spark, d):
    dirty = F.replace(F.col("text"), F.lit(" the "), F.lit(" \x01the\x0b "))
    dirty = F.replace(dirty, F.lit(". "), F.lit(".\t\x1f"))
    return docs(spark, d).select("doc_id", X.strip_control(dirty).alias("text"))


_GAPPY = """CASE doc_id % 3 WHEN 0 THEN chr(10) || chr(10) || chr(10) ELSE '' END ||
  replace(replace(text, chr(10), ' ' || chr(9) || chr(10) || chr(10) || '  ' || chr(10)), '. ', '.  ' || chr(10))
  || CASE doc_id % 4 WHEN 0 THEN chr(10) || ' ' || chr(10) ELSE '' END"""


def _gappy():
    k3, k4 = F.col("doc_id") % 3, F.col("doc_id") % 4
    mid = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" \t\n\n  \n")), F.lit(". "), F.lit(".  \n"))
    return F.concat(F.when(k3 == 0, F.lit("\n\n\n")).otherwise(F.lit("")), mid,
                    F.when(k4 == 0, F.lit("\n \n")).otherwise(F.lit("")))


@query(
    "e02_blank_line_collapse",
    f"""WITH g AS (SELECT doc_id, list_transform(string_split({_GAPPY}, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')) AS l FROM documents)
        SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(l) + 1),
          lambda i: CASE WHEN l[i] <> '' OR i = 1 OR l[i - 1] <> '' THEN i END), lambda i: i IS NOT NULL), lambda i: l[i]), chr(10)) AS text
        FROM g""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", X.collapse_blank_lines(_gappy()).alias("text"))


@query(
    "e02_newline_collapse",
    f"SELECT doc_id, regexp_replace({_GAPPY}, '\\n\\n\\n+', chr(10) || chr(10), 'g') AS text FROM documents",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", X.collapse_newlines(_gappy()).alias("text"))


@query(
    "e03_whitespace_normalise",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(replace({_GAPPY}, '.  ', chr(13) || chr(10)), ', ', ',' || chr(13)),
          chr(10)), lambda y: array_to_string(list_filter(list_transform(string_split(y, chr(13)),
            lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))), lambda x: x <> ''), chr(10)) AS text FROM documents""",
)
def _(spark, d):
    dirty = F.replace(F.replace(_gappy(), F.lit(".  "), F.lit("\r\n")), F.lit(", "), F.lit(",\r"))
    return docs(spark, d).select("doc_id", X.normalize_lines(dirty).alias("text"))


# ---- repeated headers and footers: a source is a document, a doc its page -


def _headed():
    """Page text with a header on most pages and a footer on some."""
    k = F.col("doc_id") % 10
    return F.concat(
        F.when(F.floor(F.col("doc_id") / 20) % 10 < 8, F.concat(F.lit("Header of "), "source", F.lit(" \n"))).otherwise(F.lit("")),
        F.col("text"),
        F.when(k < 7, F.lit("\nAll rights reserved")).otherwise(F.lit("")),
    )


_HEADED = """CASE WHEN (doc_id // 20) % 10 < 8 THEN 'Header of ' || source || ' ' || chr(10) ELSE '' END || text ||
  CASE WHEN doc_id % 10 < 7 THEN chr(10) || 'All rights reserved' ELSE '' END"""


def edge_blocks(spark, d):
    pages = number_within(
        docs(spark, d).select("source", "doc_id", _headed().alias("text")), ["source"], ["doc_id"], "n")
    pages = pages.select(F.col("source").alias("doc_id"), (F.col("n") - 1).alias("page_no"), "text")
    lines = pages.select("doc_id", "page_no", F.split("text", "\n").alias("l"))
    n = F.col("n_lines")
    return lines.select("doc_id", "page_no", F.size("l").alias("n_lines"), F.posexplode("l").alias("i", "text")).select(
        "doc_id", "page_no", F.col("i").cast("long").alias("line_no"), "text",
        (F.col("i") * 1000.0 / n).alias("y0"), ((F.col("i") + 1) * 1000.0 / n).alias("y1"), F.lit(1000.0).alias("page_h"))


_EDGE = f"""pg AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no,
      string_split({_HEADED}, chr(10)) AS l FROM documents),
  bl AS (SELECT doc_id, page_no, i - 1 AS line_no, l[i] AS text, (i - 1) * 1000.0::DOUBLE / len(l) AS y0, i * 1000.0::DOUBLE / len(l) AS y1
      FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pg)),
  np AS (SELECT doc_id, count(*) AS n FROM pg GROUP BY 1),
  ed AS (SELECT b.doc_id, CASE WHEN y0 < 150 THEN 'header' ELSE 'footer' END AS band, trim(text) AS text, n
      FROM bl b JOIN np USING (doc_id) WHERE trim(text) <> '' AND (y0 < 150 OR y1 > 850) AND n >= 3),
  noise AS (SELECT doc_id, band, text, count(*) AS hits, any_value(n) AS scanned_pages FROM ed
      GROUP BY ALL HAVING count(*) / any_value(n) > 0.6)"""


@query("e04_repeated_edge_text", f"WITH {_EDGE} SELECT * FROM noise")
def _(spark, d):
    blocks = edge_blocks(spark, d)
    return E.repeated_edge_text(blocks, blocks.select("doc_id", "page_no").distinct())


@query(
    "e05_noise_removal",
    f"""WITH {_EDGE} SELECT doc_id, page_no, line_no, text FROM bl b
        WHERE NOT EXISTS (SELECT 1 FROM noise n WHERE n.doc_id = b.doc_id AND n.text = trim(b.text))""",
)
def _(spark, d):
    blocks = edge_blocks(spark, d)
    noise = E.repeated_edge_text(blocks, blocks.select("doc_id", "page_no").distinct())
    return E.remove_noise(blocks.select("doc_id", "page_no", "line_no", "text"), noise)


@query(
    "e06_page_footer_strip",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN regexp_replace(text || ' november 2025 8x', '\\s+$', '')
         ELSE regexp_replace(text, '\\s+$', '') END AS text FROM documents""",
)
def _(spark, d):
    k = F.col("doc_id") % 5
    tail = (
        F.when(k == 0, F.lit("  November 2025 8 ")).when(k == 1, F.lit("\n2025年11月 12"))
        .when(k == 2, F.lit(" MARCH  1999 123\n")).when(k == 3, F.lit(" november 2025 8x")).otherwise(F.lit(" \n"))
    )
    return docs(spark, d).select("doc_id", X.strip_page_footer(F.concat("text", tail)).alias("text"))


_MARK = "['• ', '-  ', '* ', '12. ', '3)', '7、 ', '', '—x', '►', '*', '4 ']"


@query(
    "e07_list_items",
    f"""WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(({_MARK})[CAST((doc_id + i - 1) % 11 AS INT) + 1] || l[i]) AS t, (doc_id + i - 1) % 11 AS k
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
        SELECT doc_id, line_no, regexp_matches(t, '^[•●○◦▪▸►]|^[-–—]\\s|^\\*\\s|^\\d+[.、)]') AS is_list,
          CASE WHEN regexp_matches(t, '^[•●○◦▪▸►]|^[-–—]\\s|^\\*\\s') THEN 'ul' WHEN regexp_matches(t, '^\\d+[.、)]') THEN 'ol' END AS kind,
          CASE WHEN regexp_matches(t, '^[•●○◦▪▸►]') THEN '- ' || regexp_replace(t, '^.\\s*', '')
               WHEN regexp_matches(t, '^[-–—]\\s|^\\*\\s') THEN '- ' || regexp_replace(t, '^.\\s+', '')
               WHEN regexp_matches(t, '^\\d+[.、)]') THEN regexp_extract(t, '^\\d+') || '. ' || regexp_replace(t, '^\\d+.\\s*', '')
               ELSE t END AS text FROM l""",
)
def _(spark, d):
    lines = E.split_lines(docs(spark, d))
    mark = F.element_at(F.expr(f"array({_MARK[1:-1]})"), ((F.col("doc_id") + F.col("line_no")) % 11).cast("int") + 1)
    return lines.select("doc_id", "line_no", X.list_item(F.concat(mark, "text")).alias("r")).select("doc_id", "line_no", "r.*")


# ---- elements ------------------------------------------------------------


def elements(spark, d):
    """Lines as page elements, five to a page, with headings, items, code and tables."""
    lines = E.split_lines(docs(spark, d)).withColumn("text", X.strip_blank(F.col("text"))).where(F.col("text") != "")
    k = (F.col("doc_id") + F.col("line_no")) % 13
    plain = F.when(F.col("line_no") % 3 != 0, F.regexp_replace("text", r"[.]+$", "")).otherwise(F.col("text"))
    head = F.concat(F.lit("## Part "), "line_no", F.lit(" of the long document "), "doc_id")
    content = (
        F.when(k.isin(0, 1, 2), head).when(k.isin(5, 6), F.concat(F.lit("- "), "text"))
        .when(k == 9, F.concat(F.lit("| "), "text", F.lit(" |"))).otherwise(plain)
    )
    return lines.select(
        "doc_id", (F.floor(F.col("line_no") / 9) + 1).alias("page_no"), F.col("line_no").alias("pos"),
        F.when(k == 9, 2).otherwise(0).alias("kind"), X.strip_blank(content).alias("content"),
        k.isin(0, 1, 2).alias("is_heading"), k.isin(5, 6).alias("is_list"), k.isin(7, 8).alias("is_code"))


_EL = """ln AS (SELECT doc_id, i - 1 AS line_no, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS t, (doc_id + i - 1) % 13 AS k
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
  el AS (SELECT doc_id, line_no // 9 + 1 AS page_no, line_no AS pos, CASE WHEN k = 9 THEN 2 ELSE 0 END AS kind,
      trim(CASE WHEN k IN (0, 1, 2) THEN '## Part ' || line_no || ' of the long document ' || doc_id WHEN k IN (5, 6) THEN '- ' || t WHEN k = 9 THEN '| ' || t || ' |'
           WHEN line_no % 3 <> 0 THEN regexp_replace(t, '[.]+$', '') ELSE t END) AS content,
      k IN (0, 1, 2) AS is_heading, k IN (5, 6) AS is_list, k IN (7, 8) AS is_code FROM ln WHERE t <> '')"""


@query(
    "e08_paragraph_merge",
    f"""WITH {_EL}, f AS (SELECT *, kind = 0 AND NOT is_heading AND NOT is_list AND NOT is_code AS body,
            content = '' OR regexp_matches(content, '[.。!！?？:：;；]$') AS fin FROM el),
        s AS (SELECT *, CASE WHEN body AND coalesce(lag(body AND NOT fin) OVER (PARTITION BY doc_id, page_no ORDER BY pos), false) THEN 0 ELSE 1 END AS st FROM f),
        g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS isl FROM s)
        SELECT doc_id, page_no, min(pos) AS pos, any_value(kind) AS kind, string_agg(content, ' ' ORDER BY pos) AS content,
          any_value(is_heading) AS is_heading, any_value(is_list) AS is_list, any_value(is_code) AS is_code
        FROM g GROUP BY doc_id, page_no, isl""",
)
def _(spark, d):
    return E.merge_paragraphs(elements(spark, d))


@query(
    "e09_heading_merge",
    # at most three adjacent headings below 40 characters: the first pair always fits
    f"""WITH {_EL}, s AS (SELECT *, CASE WHEN is_heading AND coalesce(lag(is_heading) OVER w, false) THEN 0 ELSE 1 END AS st FROM el
            WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos)),
        g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS run FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, run ORDER BY pos) AS rn,
              sum(length(content) - 3) OVER (PARTITION BY doc_id, page_no, run ORDER BY pos) AS chars FROM g),
        h AS (SELECT *, CASE WHEN is_heading AND rn = 3 AND chars - (length(content) - 3) + 1 >= 60 THEN 2 ELSE 1 END AS part FROM r)
        SELECT doc_id, page_no, min(pos) AS pos, any_value(kind) AS kind,
          CASE WHEN bool_or(is_heading) THEN '## ' || string_agg(substr(content, 4), ' ' ORDER BY pos) ELSE any_value(content) END AS content,
          any_value(is_heading) AS is_heading, any_value(is_list) AS is_list, any_value(is_code) AS is_code
        FROM h GROUP BY doc_id, page_no, run, part""",
)
def _(spark, d):
    return E.merge_headings(elements(spark, d))


@query(
    "e10_marker_merge",
    """SELECT doc_id, replace(replace(replace(replace(text, ' the ', '******'), '. ', '****'), '******', ' '), '****', ' ') AS text FROM documents""",
)
def _(spark, d):
    stars = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("******")), F.lit(". "), F.lit("****"))
    return docs(spark, d).select("doc_id", X.merge_markers(stars).alias("text"))


# ---- Markdown ------------------------------------------------------------


def _by_line(cases, period, default="x"):
    """Spark and SQL text that rewrite line i of a document by (doc_id + i) % period."""
    spark_cases = " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items())
    k_spark = f"(doc_id + i) % {period}"
    k_sql = f"(doc_id + i - 1) % {period}"
    sp = (f"array_join(transform(split(text, '\\n'), (x, i) -> CASE {k_spark} {spark_cases} ELSE {default} END), '\\n')")
    sql = (f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE {k_sql} {spark_cases} ELSE {default} END), chr(10))")
    return sp, sql


_MD_SPARK, _MD_SQL = _by_line({
    0: "'# ' || x", 1: "x || '｜'", 2: "'- ' || x", 3: "'2) ' || x", 5: "'```'", 6: "'* ' || x", 8: "'```'", 9: "''",
    10: "'---'", 11: "'  - ' || x",
}, 12)
_MD_END = " || CASE WHEN doc_id % 5 = 0 THEN {nl} ELSE '' END"


def markdown_docs(spark, d):
    return docs(spark, d).select("doc_id", F.expr(_MD_SPARK + _MD_END.format(nl="'\\n'")).alias("text"))


_MD = f"md AS (SELECT doc_id, {_MD_SQL}{_MD_END.format(nl='chr(10)')} AS text FROM documents)"

# lines of md with fence state, as SQL
_MDL = """ml AS (SELECT doc_id, i, l[i] AS x, len(l) AS n, regexp_matches(l[i], '^\\s*(```|~~~)') AS fence
    FROM (SELECT doc_id, string_split({t}, chr(10)) AS l, unnest(range(1, len(string_split({t}, chr(10))) + 1)) AS i FROM {src})),
  mf AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM ml)"""


@query(
    "e11_list_spacing",
    f"""WITH {_MD}, {_MDL.format(t="replace(text, '｜', '|')", src="md")},
        a AS (SELECT *, regexp_matches(x, '^\\s*([-*+]|\\d+[.)])\\s+') AS li, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM mf
              WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        b AS (SELECT *, CASE WHEN li AND NOT inside AND trim(coalesce(px, '')) <> '' AND NOT regexp_matches(px, '^\\s*([-*+]|\\d+[.)])\\s+')
                THEN chr(10) ELSE '' END || x || CASE WHEN li AND NOT inside AND nx IS NOT NULL AND trim(nx) <> ''
                AND NOT regexp_matches(nx, '^\\s*([-*+]|\\d+[.)])\\s+') AND NOT starts_with(nx, ' ') AND NOT starts_with(nx, chr(9))
                THEN chr(10) ELSE '' END AS y FROM a)
        SELECT b.doc_id, string_agg(y, chr(10) ORDER BY i) || CASE WHEN arg_max(x, i) = '' AND count(*) > 1 THEN chr(10) ELSE '' END AS text
        FROM b GROUP BY b.doc_id""",
)
def _(spark, d):
    return E.list_spacing(markdown_docs(spark, d))


_TOC_SPARK, _TOC_SQL = _by_line({
    0: "'## Contents '", 1: "''", 2: "'- [a](#a)'", 3: "'1. [b](#b-c)  '", 4: "CASE WHEN doc_id % 3 = 0 THEN x ELSE '* [c](#c)' END",
    5: "''", 6: "CASE WHEN doc_id % 2 = 0 THEN '***' ELSE x END", 7: "' '", 8: "CASE WHEN doc_id % 4 = 0 THEN '```' ELSE x END",
}, 10)


@query(
    "e12_contents_removal",
    f"""WITH md AS (SELECT doc_id, {_TOC_SQL}{_MD_END.format(nl='chr(10)')} AS text FROM documents), {_MDL.format(t="text", src="md")},
        k AS (SELECT *, NOT inside AND regexp_matches(x, '^\\s{{0,3}}#{{2,6}}\\s+(?i:contents?)\\s*$') AS hd, trim(x) = '' AS bl,
              regexp_matches(x, '^\\s*([-*+]|\\d+[.)])\\s+\\[[^\\]]+\\]\\(#[^)]+\\)\\s*$') AS it,
              regexp_matches(x, '^\\s{{0,3}}(-{{3,}}|\\*{{3,}}|_{{3,}})\\s*$') AS hr FROM mf),
        s1 AS (SELECT h.doc_id, h.i AS a, coalesce(min(o.i), any_value(h.n) + 1) AS b FROM k h LEFT JOIN k o
               ON o.doc_id = h.doc_id AND o.i > h.i AND NOT o.bl WHERE h.hd GROUP BY h.doc_id, h.i),
        s2 AS (SELECT h.doc_id, h.a, h.b, coalesce(min(o.i), (SELECT max(n) FROM k q WHERE q.doc_id = h.doc_id) + 1) AS c FROM s1 h
               LEFT JOIN k o ON o.doc_id = h.doc_id AND o.i >= h.b AND NOT o.it GROUP BY h.doc_id, h.a, h.b),
        s3 AS (SELECT h.doc_id, h.a, coalesce(min(o.i), (SELECT max(n) FROM k q WHERE q.doc_id = h.doc_id) + 1) AS e FROM (SELECT * FROM s2 WHERE c - b >= 2) h
               LEFT JOIN k o ON o.doc_id = h.doc_id AND o.i >= h.c AND NOT o.bl GROUP BY h.doc_id, h.a, h.c),
        s4 AS (SELECT h.doc_id, h.a, h.e + CASE WHEN coalesce(o.hr, false) THEN 1 ELSE 0 END AS f FROM s3 h LEFT JOIN k o ON o.doc_id = h.doc_id AND o.i = h.e),
        s5 AS (SELECT h.doc_id, h.a, coalesce(min(o.i), (SELECT max(n) FROM k q WHERE q.doc_id = h.doc_id) + 1) AS g FROM s4 h
               LEFT JOIN k o ON o.doc_id = h.doc_id AND o.i >= h.f AND NOT o.bl GROUP BY h.doc_id, h.a, h.f),
        r AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM k WHERE NOT EXISTS
               (SELECT 1 FROM s5 WHERE s5.doc_id = k.doc_id AND k.i >= s5.a AND k.i < s5.g) GROUP BY doc_id)
        SELECT md.doc_id, coalesce(t, '') || CASE WHEN ends_with(md.text, chr(10)) THEN chr(10) ELSE '' END AS text
        FROM md LEFT JOIN r ON r.doc_id = md.doc_id""",
)
def _(spark, d):
    md = docs(spark, d).select("doc_id", F.expr(_TOC_SPARK + _MD_END.format(nl="'\\n'")).alias("text"))
    return md.select("doc_id", E.strip_contents(F.col("text")).alias("text"))


def _ruled_pages(spark, d):
    html = F.replace(F.col("html"), F.lit("<h1>"), F.lit("<hr/> \n<h1>"))
    html = F.replace(html, F.lit("<p>"), F.lit("<hr><p>"))
    html = F.replace(html, F.lit("</article>"), F.lit('<hr >\n<h2 id="x">end</h2></article>'))
    return table(spark, d, "pages").select("page_id", html.alias("html"))


_RULED = """rp AS (SELECT page_id, replace(replace(replace(html, '<h1>', '<hr/> ' || chr(10) || '<h1>'), '<p>', '<hr><p>'), '</article>',
   '<hr >' || chr(10) || '<h2 id="x">end</h2></article>') AS html FROM pages)"""


@query(
    "e13_rule_before_heading",
    f"""WITH {_RULED} SELECT page_id, regexp_replace(html, '<hr\\s*/?>\\s*(<h[12][\\s>])', '\\1', 'g') AS body,
          len(regexp_extract_all(html, '<hr\\s*/?>\\s*<h[12][\\s>]')) AS removed FROM rp""",
)
def _(spark, d):
    r = E.strip_rules_before_headings(F.col("html"))
    return _ruled_pages(spark, d).select("page_id", r.alias("r")).select("page_id", "r.*")


@query(
    "e14_chapter_split",
    f"""WITH {_MD}, {_MDL.format(t="text", src="md")},
        h AS (SELECT *, NOT inside AND NOT fence AND regexp_matches(x, '^ {{0,3}}#\\s+') AS hd FROM mf),
        c AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY i) AS ch, max(hd::INT) OVER (PARTITION BY doc_id) AS has FROM h),
        g AS (SELECT doc_id, ch AS chapter_no, any_value(has) AS has, string_agg(x, chr(10) ORDER BY i) AS body, min_by(x, i) AS first FROM c GROUP BY ALL)
        SELECT doc_id, chapter_no::BIGINT AS chapter_no, CASE WHEN chapter_no > 0 THEN coalesce(nullif(regexp_replace(
            regexp_replace(first, '^ *#\\s+', ''), '^\\s+|\\s+$', '', 'g'), ''), '章节') WHEN has = 1 THEN '前言' ELSE '章节' END AS title, body
        FROM g WHERE chapter_no > 0 OR has = 0 OR regexp_matches(body, '\\S')""",
)
def _(spark, d):
    return E.split_chapters(markdown_docs(spark, d))


_NOTE_SPARK, _NOTE_SQL = _by_line({
    0: "'# NATION_' || CAST((doc_id + length(x)) % 30 AS STRING)", 1: "'---'", 2: "x",
    3: "'## nation ' || CAST((doc_id * 7) % 27 AS STRING) || '  '", 4: "''",
}, 7)


@query(
    "e15_section_notes",
    f"""WITH md AS (SELECT doc_id, {_NOTE_SQL.replace('AS STRING', 'AS VARCHAR')} AS text FROM documents),
        l AS (SELECT doc_id, i, l[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
              unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM md)),
        m AS (SELECT l.*, n.n_name AS k FROM l LEFT JOIN nation n ON regexp_matches(x, '^#')
              AND replace(lower(trim(regexp_replace(x, '^#+', ''))), ' ', '_') = lower(n_name)),
        s AS (SELECT *, last_value(k IGNORE NULLS) OVER w AS stem, count(k) OVER w AS sec FROM m
              WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        t AS (SELECT doc_id, sec, any_value(stem) AS stem, regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i)
                FILTER (k IS NULL AND NOT regexp_matches(x, '^\\s*[-*]{{3,}}\\s*$')), ''), '^\\s+|\\s+$', '', 'g') AS txt FROM s WHERE stem IS NOT NULL GROUP BY doc_id, sec)
        SELECT doc_id, stem, coalesce(string_agg(txt, chr(10) || chr(10) ORDER BY sec) FILTER (txt <> ''), '') AS notes FROM t GROUP BY doc_id, stem""",
)
def _(spark, d):
    md = docs(spark, d).select("doc_id", F.expr(_NOTE_SPARK).alias("text"))
    stems = table(spark, d, "nation").select(F.col("n_name").alias("stem"))
    return E.section_notes(md, stems)


_ANCHOR_SPARK = """array_join(transform(split(text, '\\n'), (x, i) -> CASE (doc_id + i) % 4
  WHEN 0 THEN '<h2 class="t" id="Sec ' || i || '!">' || replace(x, '<', '') || '</h2>'
  WHEN 1 THEN '<a class="x" href="#sec-' || (i - 1) || '">' || replace(x, '<', '') || '</a> <a href="#none' || i || '">n</a>'
  WHEN 2 THEN '<H3 id="s_e%63-' || (i - 2) || '">' || replace(x, '<', '') || '</H3>'
  ELSE '<A href="#%53EC' || (i - 3) || '">y</A><a href="http://h/#sec1">z</a>' END), '\\n')"""
_ANCHOR_SQL = """WITH x AS (SELECT doc_id, i - 1 AS i, (doc_id + i - 1) % 4 AS k, replace(l[i], '<', '') AS x FROM
   (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
  ids AS (SELECT doc_id, i, abs(i - k) AS num, CASE k WHEN 0 THEN 'Sec ' || i || '!' ELSE 's_e%63-' || (i - 2) END AS id FROM x WHERE k IN (0, 2)),
  last AS (SELECT doc_id, num, arg_max(id, i) AS target FROM ids GROUP BY ALL),
  y AS (SELECT x.*, x.i - k AS b, target FROM x LEFT JOIN last l ON l.doc_id = x.doc_id AND l.num = abs(x.i - k))
  SELECT doc_id, string_agg(CASE k WHEN 0 THEN '<h2 class="t" id="Sec ' || i || '!">' || x || '</h2>'
     WHEN 1 THEN '<a class="x" href="#' || coalesce(target, 'sec-' || b) || '">' || x || '</a> <a href="#none' || i || '">n</a>'
     WHEN 2 THEN '<H3 id="s_e%63-' || b || '">' || x || '</H3>'
     ELSE '<A href="#' || coalesce(target, '%53EC' || b) || '">y</A><a href="http://h/#sec1">z</a>' END, chr(10) ORDER BY i) AS html
  FROM y GROUP BY doc_id"""


@query("e16_anchor_repair", _ANCHOR_SQL)
def _(spark, d):
    html = docs(spark, d).select("doc_id", F.expr(_ANCHOR_SPARK).alias("html"))
    return E.repair_anchors(html)


@query(
    "e17_html_statistics",
    f"""WITH {_RULED}, q AS (SELECT page_id, replace(replace(html, '<br>', '<table><tr></table><img src="data:image/png;x">'), '<b>',
          '<pre><code class="a language-mermaid">g' || chr(10) || '</code></pre><tablet>') AS html FROM rp)
        SELECT page_id, len(string_split(html, '<table>')) - 1 AS tables, len(string_split(html, '<img ')) - 1 AS images,
          len(string_split(html, 'data:image/')) - 1 AS embedded_images, len(string_split(html, 'language-mermaid')) - 1 AS diagrams,
          len(regexp_extract_all(html, '<hr\\s*/?>\\s*<h[12][\\s>]')) AS removed_rules FROM q""",
)
def _(spark, d):
    html = F.replace(F.col("html"), F.lit("<br>"), F.lit('<table><tr></table><img src="data:image/png;x">'))
    html = F.replace(html, F.lit("<b>"), F.lit('<pre><code class="a language-mermaid">g\n</code></pre><tablet>'))
    return _ruled_pages(spark, d).select("page_id", E.html_statistics(html).alias("r")).select("page_id", "r.*")


# ---- notebooks and paragraph edits ---------------------------------------


@query(
    "e18_notebook_markdown",
    """WITH c AS (SELECT doc_id, i - 1 AS i, l[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
       n AS (SELECT *, sum(CASE WHEN i % 3 = 0 THEN 1 WHEN i % 3 = 2 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS a FROM c)
       SELECT doc_id, string_agg(CASE i % 3
           WHEN 0 THEN x || ' ![i](nb' || doc_id || '_files/attachment_' || lpad((coalesce(a, 0) + 1)::VARCHAR, 3, '0') || '.png)'
           WHEN 1 THEN '```python' || chr(10) || x || chr(10) || '```' || chr(10) || chr(10) || '    out ' || i || chr(10) || '    end'
           ELSE x || ' ![j](nb' || doc_id || '_files/attachment_' || lpad((a + 1)::VARCHAR, 3, '0') || '.jpg) nb' || doc_id || '_files/attachment_'
             || lpad((a + 2)::VARCHAR, 3, '0') || '.bin' END, chr(10) || chr(10) ORDER BY i) || chr(10) AS markdown
       FROM n GROUP BY doc_id""",
)
def _(spark, d):
    empty = "map_from_entries(array())"
    cells = f"""transform(split(text, '\\n'), (x, i) -> named_struct(
        'cell_type', CASE i % 3 WHEN 1 THEN 'code' ELSE 'markdown' END,
        'source', CASE i % 3 WHEN 0 THEN x || ' ![i](attachment:p.png)' WHEN 1 THEN x
                  ELSE x || ' ![j](attachment:q) attachment:z.dat' END,
        'attachments', CASE i % 3 WHEN 0 THEN map('p.png', map('image/png', 'QQ=='))
                  WHEN 2 THEN map('q', map('image/jpeg', 'QQ=='), 'z.dat', map('x/y', 'QQ==')) END,
        'outputs', CASE WHEN i % 3 = 1 THEN array(named_struct('output_type', 'stream', 'text', 'out ' || i || '\\nend\\n')) END))"""
    nb = docs(spark, d).select(
        "doc_id", F.concat(F.lit("nb"), "doc_id").alias("stem"), F.to_json(F.expr(f"named_struct('cells', {cells})")).alias("json"))
    return E.notebook_markdown(nb, "json", "stem").select("doc_id", "markdown")


def _paragraphs(spark, d):
    from ..operators.cells import paragraph_list

    return paragraph_list(docs(spark, d))


def _edits(spark, d):
    """One edit per label; some indexes lie outside the document."""
    return table(spark, d, "labels").select(
        "doc_id", (F.col("doc_id") % 9 - 1).alias("index"), F.concat(F.lit("quality "), "quality").alias("text"))


_PAR = """par AS (SELECT doc_id, i - 1 AS index, l[i] AS text, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


@query(
    "e19_paragraph_edit",
    f"""WITH {_PAR} SELECT p.doc_id, p.index, coalesce('quality ' || l.quality, p.text) AS text
        FROM par p LEFT JOIN labels l ON l.doc_id = p.doc_id AND l.doc_id % 9 - 1 = p.index
        UNION ALL SELECT l.doc_id, coalesce((SELECT max(n) FROM par WHERE par.doc_id = l.doc_id), 0), 'toxic ' || toxic FROM labels l""",
)
def _(spark, d):
    edited = E.edit_paragraphs(_paragraphs(spark, d), _edits(spark, d))
    added = table(spark, d, "labels").select(
        "doc_id", F.lit(0).cast("long").alias("seq"), F.concat(F.lit("toxic "), "toxic").alias("text"))
    return E.append_paragraphs(edited, added)


@query(
    "e19_paragraph_edit_errors",
    f"""WITH {_PAR}, n AS (SELECT doc_id, max(n) AS n FROM par GROUP BY 1)
        SELECT l.doc_id, l.doc_id % 9 - 1 AS index, 'Paragraph index ' || (l.doc_id % 9 - 1) || ' out of range (0-' || (coalesce(n, 0) - 1) || ')' AS error
        FROM labels l LEFT JOIN n USING (doc_id) WHERE l.doc_id % 9 - 1 < 0 OR l.doc_id % 9 - 1 > coalesce(n, 0) - 1""",
)
def _(spark, d):
    return E.edit_errors(_paragraphs(spark, d), _edits(spark, d))


@query(
    "e20_page_markdown",
    f"""WITH {_EL}, a AS (SELECT *, kind = 0 AND is_code AS cd, kind = 0 AND is_list AS li FROM el),
        b AS (SELECT *, coalesce(lag(cd) OVER w, false) AS pc, coalesce(lead(cd) OVER w, false) AS nc, coalesce(lag(li) OVER w, false) AS pl FROM a
              WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos)),
        c AS (SELECT doc_id, page_no, string_agg(CASE WHEN pl AND NOT li THEN chr(10) ELSE '' END ||
                CASE WHEN cd AND NOT pc THEN '```' || chr(10) ELSE '' END || content ||
                CASE WHEN li THEN chr(10) WHEN cd AND nc THEN chr(10) WHEN cd THEN chr(10) || '```' || chr(10) || chr(10)
                     ELSE chr(10) || chr(10) END, '' ORDER BY pos) AS t FROM b GROUP BY ALL),
        p AS (SELECT doc_id, unnest(range(1, (len(string_split(text, chr(10))) - 1) // 9 + 2)) AS page_no FROM documents)
        SELECT p.doc_id, p.page_no, CASE WHEN p.page_no = 1 THEN '# doc ' || p.doc_id ELSE '<!-- Page ' || p.page_no || ' -->' END ||
          coalesce(chr(10) || chr(10) || nullif(regexp_replace(regexp_replace(t, '\\n\\n\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), ''), '') AS markdown
        FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.page_no = p.page_no""",
)
def _(spark, d):
    n_pages = F.floor((F.size(F.split("text", "\n")) - 1) / 9) + 1
    pages = docs(spark, d).select(
        "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), n_pages)).alias("page_no"),
        F.concat(F.lit("doc "), "doc_id").alias("title"))
    return E.page_markdown(elements(spark, d), pages)
