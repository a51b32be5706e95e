"""Section I: layout tables derived from the lines of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import text as E
from .registry import query, table

_LINES = """ln AS (SELECT doc_id, i - 1 AS ln, l[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def lines(spark, d):
    return E.split_lines(table(spark, d, "documents")).select("doc_id", F.col("line_no").alias("ln"), F.col("text").alias("t"))


_SIZES = [12.0, 12.04, 24.0, 12.0, 18.0, 14.5, 12.0, 13.2]
_FONTS = ["Times", "Courier New", "Arial", "Arial", "FiraMono Hack"]


def spans(spark, d):
    """Sentences of a line as spans; size, flags and font cycle with their place."""
    s = lines(spark, d).select("doc_id", "ln", F.posexplode(F.split("t", r"\. ")).alias("sn", "text"))
    k = F.col("doc_id") + F.col("ln")
    return s.select(
        "doc_id", F.floor(F.col("ln") / 9).alias("page_no"), F.floor(F.col("ln") / 3).alias("block_no"), F.col("ln").alias("line_no"),
        F.col("sn").cast("long").alias("span_no"), F.element_at(F.array(*[F.lit(x) for x in _SIZES]), (k % 8).cast("int") + 1).alias("size"),
        (((k + F.col("sn")) % 4 == 0).cast("int") * 16 + ((k + F.col("sn")) % 3 == 0).cast("int") * 2).alias("flags"),
        F.element_at(F.array(*[F.lit(x) for x in _FONTS]), ((k + F.floor(F.col("sn") / 4)) % 5).cast("int") + 1).alias("font"),
        F.when(k % 10 == 0, F.concat(F.lit("1) "), "text")).when(k % 10 == 5, F.concat(F.col("text"), F.lit("\x02. ")))
        .otherwise(F.concat(F.col("text"), F.lit(" "))).alias("text"),
        (F.col("ln") * 13.5).alias("y0"))


_SP = f"""{_LINES}, s0 AS (SELECT doc_id, ln, doc_id + ln AS k, j - 1 AS sn, p[j] AS x FROM (SELECT *, string_split(t, '. ') AS p,
     unnest(range(1, len(string_split(t, '. ')) + 1)) AS j FROM ln)),
  sp AS (SELECT doc_id, ln // 9 AS page_no, ln // 3 AS block_no, ln AS line_no, sn AS span_no, [12.0, 12.04, 24.0, 12.0, 18.0, 14.5, 12.0, 13.2][CAST(k % 8 AS INT) + 1]::DOUBLE AS size,
     CASE WHEN (k + sn) % 4 = 0 THEN 16 ELSE 0 END + CASE WHEN (k + sn) % 3 = 0 THEN 2 ELSE 0 END AS flags,
     ['Times', 'Courier New', 'Arial', 'Arial', 'FiraMono Hack'][CAST((k + sn // 4) % 5 AS INT) + 1] AS font,
     CASE WHEN k % 10 = 0 THEN '1) ' || x WHEN k % 10 = 5 THEN x || chr(2) || '. ' ELSE x || ' ' END AS text FROM s0)"""
_FS = """cs AS (SELECT doc_id, round(size, 1) AS size, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')))::BIGINT AS c,
     min(page_no * 1000000000 + line_no * 10000 + span_no) AS f FROM sp WHERE regexp_matches(text, '\\S') GROUP BY ALL),
  bd AS (SELECT doc_id, arg_min(size, (-c, f)) AS body FROM cs GROUP BY 1),
  lg AS (SELECT cs.doc_id, cs.size, row_number() OVER (PARTITION BY cs.doc_id ORDER BY cs.size DESC) AS r FROM cs JOIN bd USING (doc_id) WHERE cs.size > body + 1),
  fs AS (SELECT d.doc_id, coalesce(body, 12.0) AS body, CASE WHEN body IS NULL THEN 24.0 ELSE h1 END AS h1, CASE WHEN body IS NULL THEN 18.0 ELSE h2 END AS h2,
     CASE WHEN body IS NULL THEN 14.0 ELSE h3 END AS h3 FROM documents d LEFT JOIN bd USING (doc_id) LEFT JOIN (SELECT doc_id, max(size) FILTER (r = 1) AS h1,
       max(size) FILTER (r = 2) AS h2, max(size) FILTER (r = 3) AS h3 FROM lg GROUP BY 1) USING (doc_id))"""


@query("i01_font_sizes", f"WITH {_SP}, {_FS} SELECT doc_id, body::DOUBLE AS body, h1::DOUBLE AS h1, h2::DOUBLE AS h2, h3::DOUBLE AS h3 FROM fs")
def _(spark, d):
    return L.font_sizes(spans(spark, d), table(spark, d, "documents"))


def _level_sql(size, text, flags):
    by = f"CASE WHEN {size} >= h1 - 0.5 THEN 1 WHEN {size} >= h2 - 0.5 THEN 2 WHEN {size} >= h3 - 0.5 THEN 3 ELSE 0 END"
    t = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN {text} = '' THEN {by} WHEN length({t}) > 80 THEN 0 WHEN regexp_matches({t}, '[.。!！?？]$') AND NOT regexp_matches({t}, '^[\\d第]+[.、章节]') THEN 0 "
            f"WHEN ({flags} & 16) = 0 AND ({by}) >= 2 AND {size} < body + 2 THEN 0 ELSE {by} END")


@query(
    "i02_heading_level",
    f"""WITH {_SP}, {_FS} SELECT doc_id, line_no, span_no, {_level_sql('size', 'text', 'flags')} AS level FROM sp JOIN fs USING (doc_id)""",
)
def _(spark, d):
    s = spans(spark, d)
    sizes = L.font_sizes(s, table(spark, d, "documents"))
    return s.join(sizes, "doc_id").select("doc_id", "line_no", "span_no", L.heading_level(F.col("size"), F.col("text"), F.col("flags")).alias("level"))


_CTRL = "regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"


@query(
    "i03_line_assembly",
    f"""WITH {_SP}, {_FS}, c AS (SELECT sp.* EXCLUDE (text), {_CTRL} AS text, body, h1, h2, h3, regexp_matches(lower(font), 'courier|hack') AS mono FROM sp JOIN fs USING (doc_id)),
        f AS (SELECT *, regexp_matches(text, '\\S') AS ink, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, {_level_sql('size', 'text', 'flags')} AS lv FROM c),
        g AS (SELECT *, CASE WHEN NOT ink OR mono THEN text WHEN lv > 0 OR t = '' THEN t ELSE
            ['', '*', '**', '***'][CASE WHEN (flags & 16) > 0 THEN 2 ELSE 0 END + CASE WHEN (flags & 2) > 0 THEN 1 ELSE 0 END + 1] || t ||
            ['', '*', '**', '***'][CASE WHEN (flags & 16) > 0 THEN 2 ELSE 0 END + CASE WHEN (flags & 2) > 0 THEN 1 ELSE 0 END + 1] END AS sh FROM f),
        l AS (SELECT doc_id, page_no, block_no, line_no, regexp_replace(string_agg(sh, '' ORDER BY span_no), '^\\s+|\\s+$', '', 'g') AS x, max(size) FILTER (ink) AS size,
            coalesce(bit_or(flags) FILTER (ink), 0) AS flags, coalesce(bool_or(ink AND mono), false) AS is_code, any_value(body) AS body, any_value(h1) AS h1, any_value(h2) AS h2, any_value(h3) AS h3
            FROM g GROUP BY doc_id, page_no, block_no, line_no),
        m AS (SELECT * EXCLUDE (x), replace(replace(x, '******', ' '), '****', ' ') AS x FROM l WHERE x <> ''),
        n AS (SELECT *, {_level_sql('size', 'x', 'flags')} AS lv, regexp_matches(i, '^[•●○◦▪▸►]|^[-–—]\\s|^\\*\\s') AS ul, regexp_matches(i, '^\\d+[.、)]') AS ol
            FROM (SELECT *, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS i FROM m))
        SELECT doc_id, page_no, block_no, line_no, line_no * 13.5::DOUBLE AS y0, CASE WHEN lv > 0 THEN repeat('#', lv) || ' ' || regexp_replace(x, '\\*+([^*]+)\\*+', '\\1', 'g')
          WHEN ul THEN '- ' || regexp_replace(i, '^[•●○◦▪▸►]\\s*|^[-–—]\\s+|^\\*\\s+', '')
          WHEN ol THEN regexp_replace(i, '^(\\d+)[.、)]\\s*', '\\1. ') ELSE x END AS content, lv > 0 AS is_heading, ul OR ol AS is_list, is_code FROM n""",
)
def _(spark, d):
    s = spans(spark, d)
    return L.assemble_lines(s, L.font_sizes(s, table(spark, d, "documents")))


# ---- rectangles ----------------------------------------------------------


def rects(spark, d):
    n = F.col("ln")
    k = F.length("t")
    x0, y0 = (n * 37 % 300).cast("double"), (n * 53 % 500).cast("double")
    return lines(spark, d).select(
        "doc_id", F.floor(n / 20).alias("page_no"), n.alias("pos"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 60 + k * 7 % 400).alias("x1"), (y0 + 40 + k * 11 % 350).alias("y1"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"))


_RC = f"""{_LINES}, rc AS (SELECT doc_id, ln // 20 AS page_no, ln AS pos, (ln * 37 % 300)::DOUBLE AS x0, (ln * 53 % 500)::DOUBLE AS y0,
   (ln * 37 % 300 + 60 + length(t) * 7 % 400)::DOUBLE AS x1, (ln * 53 % 500 + 40 + length(t) * 11 % 350)::DOUBLE AS y1 FROM ln)"""


def _tables(r):
    return r.where(F.col("pos") % 5 == 0)


_AREA = "(greatest({p}x1 - {p}x0, 0) * greatest({p}y1 - {p}y0, 0))"
_OVER = "(greatest(least(r.x1, t.x1) - greatest(r.x0, t.x0), 0) * greatest(least(r.y1, t.y1) - greatest(r.y0, t.y0), 0))"


@query(
    "i04_blocks_in_tables",
    f"""WITH {_RC} SELECT doc_id, page_no, pos FROM rc r WHERE pos % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM rc t WHERE t.pos % 5 = 0 AND t.doc_id = r.doc_id
        AND t.page_no = r.page_no AND {_OVER} > 0.6 * {_AREA.format(p='r.')})""",
)
def _(spark, d):
    r = rects(spark, d)
    return L.drop_blocks_in_tables(r.where(F.col("pos") % 5 != 0), _tables(r)).select("doc_id", "page_no", "pos")


_FIG = f"""fg AS (SELECT doc_id, page_no, pos, greatest(x0 - 4, 0) AS x0, greatest(y0 - 4, 0) AS y0, least(x1 + 4, 612) AS x1, least(y1 + 4, 792) AS y1 FROM rc WHERE pos % 5 <> 0),
  ok AS (SELECT * FROM fg r WHERE x1 - x0 >= 100 AND y1 - y0 >= 80 AND {_AREA.format(p='')} >= 30000
     AND greatest(x1 - x0, y1 - y0) / greatest(least(x1 - x0, y1 - y0), 1) <= 8
     AND NOT EXISTS (SELECT 1 FROM rc t WHERE t.pos % 10 = 0 AND t.doc_id = r.doc_id AND t.page_no = r.page_no
         AND {_OVER} > 0.5 * least({_AREA.format(p='r.')}, {_AREA.format(p='t.')})))"""


def figures(spark, d):
    r = rects(spark, d)
    return L.figure_candidates(r.where(F.col("pos") % 5 != 0), r.where(F.col("pos") % 10 == 0)).select(
        "doc_id", "page_no", "pos", "x0", "y0", "x1", "y1")


@query("i05_figure_candidates", f"WITH {_RC}, {_FIG} SELECT doc_id, page_no, pos, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM ok")
def _(spark, d):
    return figures(spark, d)


@query(
    "i06_contained_suppression",
    f"""WITH {_RC}, s AS (SELECT doc_id, page_no, list([{{'pos': pos, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': (x1 - x0) * (y1 - y0)}}]
          ORDER BY -((x1 - x0) * (y1 - y0)), pos) AS l FROM rc GROUP BY ALL),
        k AS (SELECT doc_id, page_no, list_reduce(l, lambda kept, r: CASE WHEN r[1].area > 0 AND len(list_filter(kept, lambda o:
            greatest(0, least(o.x1, r[1].x1) - greatest(o.x0, r[1].x0)) * greatest(0, least(o.y1, r[1].y1) - greatest(o.y0, r[1].y0)) / r[1].area >= 0.9)) > 0
            THEN kept ELSE list_concat(kept, r) END) AS kept FROM s)
        SELECT doc_id, page_no, r.pos, r.x0, r.y0, r.x1, r.y1 FROM (SELECT doc_id, page_no, unnest(kept) AS r FROM k)""",
)
def _(spark, d):
    return L.suppress_contained(rects(spark, d))


@query(
    "i07_reading_order",
    f"""WITH {_RC} SELECT doc_id, page_no, pos, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, pos) AS order_no FROM rc""",
)
def _(spark, d):
    return L.reading_order(rects(spark, d)).select("doc_id", "page_no", "pos", "order_no")


_CAPS = ["Figure 1: ", "fig. 12 | ", "Figure 3 shows ", "FIG 4. ", " Fig.5｜", "Figures 1: ", "", "x Figure 2: "]


@query(
    "i08_captions",
    f"""WITH {_LINES}, c AS (SELECT doc_id, ln, ['Figure 1: ', 'fig. 12 | ', 'Figure 3 shows ', 'FIG 4. ', ' Fig.5｜', 'Figures 1: ', '', 'x Figure 2: '][CAST((doc_id + ln) % 8 AS INT) + 1] || t AS text FROM ln)
        SELECT doc_id, ln, text FROM c WHERE regexp_matches(trim(text), '^(?i:figure|fig\\.?)\\s*\\d+\\s*[:.|｜]')""",
)
def _(spark, d):
    head = F.element_at(F.array(*[F.lit(c) for c in _CAPS]), ((F.col("doc_id") + F.col("ln")) % 8).cast("int") + 1)
    return L.captions(lines(spark, d).select("doc_id", "ln", F.concat(head, "t").alias("text")))
