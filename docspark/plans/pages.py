"""Section D (and the page export of A): web-page corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import decode_entities, with_nodes
from ..operators import pages as P
from ..sources import export
from .registry import query, table


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def _pick_sql(values, key):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({key} % {len(values)} AS INT) + 1]"


def pages(spark, d):
    return table(spark, d, "pages")


# Heads, bodies and URL ends that give every page its own mix of metadata.
_HEAD = ["", '<meta name="Author" content=" Ann ">', '<meta property="og:description" content="og words"><meta name="description" content="">',
         '<META NAME="PubDate" CONTENT="2024-01-02"><meta name="pubdate" content=" 2024-02-03 ">', '<meta name="description" content="a &lt;b&gt;">',
         '<meta property="article:author" content="Org"><meta name="date" content="">']
_BODY = ["", "<p>发布时间：2024年3月5日</p>", "<p>2023/7/9 来源：Agency x</p>", "<p>时间: 2022-1-2 日期：2021年12月3</p>", "<p>发布机构: City</p>",
         "<p>发布单位：Office<b>y</b></p>", "<p>日期:2020-10-11日 </p>"]
_URL = ["", "/202405/a", "/202312_t1_x", "/2022-03-04/b", "/1999/05/06"]
_TITLE = ["", " - x 政府", "|中国网站首页", "_y委员会 z", "-plain"]


def rich_pages(spark, d):
    """Pages with metadata, dates and authors in turn."""
    k = F.col("page_id")
    html = F.replace(F.col("html"), F.lit("</title>"), F.concat(_pick(_TITLE, k), F.lit("</title>"), _pick(_HEAD, k)))
    html = F.replace(html, F.lit("</article>"), F.concat(_pick(_BODY, k), F.lit("</article>")))
    return pages(spark, d).select("page_id", F.concat("url", _pick(_URL, k)).alias("url"), html.alias("html"))


def rich_nodes(spark, d):
    return with_nodes(rich_pages(spark, d), "html")


_RICH = f"""rp AS (SELECT page_id, url || {_pick_sql(_URL, 'page_id')} AS url, replace(replace(html, '</title>', {_pick_sql(_TITLE, 'page_id')} || '</title>' || {_pick_sql(_HEAD, 'page_id')}),
   '</article>', {_pick_sql(_BODY, 'page_id')} || '</article>') AS html FROM pages)"""
_DECODE = "replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
# as in HTML, these names are references without their semicolon too; the ampersand comes last, so nothing is decoded twice
_TITLE_DECODE = "{c}"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
    _TITLE_DECODE = f"regexp_replace({_TITLE_DECODE}, '&{_name};?', '{_char}', 'g')"


@query("d01_node_table")
def _(spark, d):
    nodes = P.node_table(pages(spark, d))
    return nodes.select("page_id", "node_id", "parent_id", "end_id", "depth", "tag", F.to_json("attrs").alias("attrs"), "text")


@query(
    "d01_node_counts",
    """SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_p, len(regexp_extract_all(html, '<br>')) AS n_br, len(regexp_extract_all(html, '<b>')) AS n_b,
         len(regexp_extract_all(html, '<h1>')) AS n_h1, len(regexp_extract_all(html, '<div')) AS n_div FROM
       (SELECT page_id, regexp_replace(html, '(?s)<(script|style|nav|footer)\\b.*?</(script|style|nav|footer)>', '', 'g') AS html FROM pages)""",
)
def _(spark, d):
    nodes = P.node_table(pages(spark, d))
    return nodes.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("p", "br", "b", "h1", "div")])


_META_SQL = """CASE page_id % 6 WHEN 1 THEN [('author', 'Ann')] WHEN 2 THEN [('og:description', 'og words')] WHEN 3 THEN [('pubdate', '2024-02-03')]
   WHEN 4 THEN [('description', 'a <b>')] WHEN 5 THEN [('article:author', 'Org')] ELSE [] END"""


@query(
    "d02_page_title",
    f"""WITH {_RICH}, t AS (SELECT page_id, {_TITLE_DECODE.format(c="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS t FROM rp)
        SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(t, '[-_|].*?(政府|门户|网站|委员会).*$', ''), '^\\s+|\\s+$', '', 'g'), ''), 'Untitled') AS title FROM t""",
)
def _(spark, d):
    return P.page_metadata(rich_nodes(spark, d)).select("page_id", "title")


@query(
    "d03_meta_map",
    f"""SELECT page_id, unnest(list_transform({_META_SQL}, lambda m: m[1])) AS key, unnest(list_transform({_META_SQL}, lambda m: m[2])) AS content FROM pages""",
)
def _(spark, d):
    return P.meta_map(rich_nodes(spark, d))


_DATE_TEXT = ["", "2024-3-5", "2023/7/9", "2021-12-3", "", "", "2020-10-11"]


@query(
    "d04_publish_date",
    f"""WITH {_RICH}, x AS (SELECT page_id, url, CASE WHEN page_id % 6 = 3 THEN '2024-02-03' END AS m, contains(html, '</article>') AS a,
          {_pick_sql(_DATE_TEXT, 'page_id')} AS t FROM rp)
        SELECT page_id, coalesce(m, CASE WHEN a THEN nullif(t, '') END,
          CASE WHEN regexp_matches(url, '\\d{{6}}[/_]') THEN regexp_extract(url, '(\\d{{4}})\\d{{2}}[/_]', 1) || '-' || regexp_extract(url, '\\d{{4}}(\\d{{2}})[/_]', 1) END,
          CASE WHEN regexp_matches(url, '\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}') THEN replace(regexp_extract(url, '\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}'), '/', '-') END, '') AS date FROM x""",
)
def _(spark, d):
    return P.page_metadata(rich_nodes(spark, d)).select("page_id", "date")


_AUTHOR_TEXT = ["", "", "Agency", "", "City", "Officey", ""]


@query(
    "d05_description_author",
    f"""WITH {_RICH} SELECT page_id, CASE page_id % 6 WHEN 2 THEN 'og words' WHEN 4 THEN 'a <b>' ELSE '' END AS description,
          CASE page_id % 6 WHEN 1 THEN 'Ann' WHEN 5 THEN 'Org' ELSE CASE WHEN contains(html, '</article>') THEN {_pick_sql(_AUTHOR_TEXT, 'page_id')} ELSE '' END END AS author FROM rp""",
)
def _(spark, d):
    # the closing tag right behind the text ends the match like a blank would
    return P.page_metadata(rich_nodes(spark, d)).select("page_id", "description", F.regexp_extract("author", r"^(Ann|Org|Agency|City|Officey)", 1).alias("author"))


def content_pages(spark, d):
    """Pages whose article is renamed in turn, so that every kind of choice occurs."""
    k = F.col("page_id")
    opening = _pick(["<article>", '<div class="x news-content">', '<div id="content">', "<main>", '<div class="plain">', "<section>"], k)
    closing = _pick(["</article>", "</div>", "</div>", "</main>", "</div>", "</section>"], k)
    html = F.replace(F.replace(F.col("html"), F.lit("<article>"), opening), F.lit("</article>"), closing)
    return with_nodes(pages(spark, d).select("page_id", "url", html.alias("html")), "html")


@query("d06_main_content")
def _(spark, d):
    found = P.main_content(content_pages(spark, d))
    root = F.get("nodes", F.col("root_id"))
    return found.select("page_id", "root_id", "root_end", "root_score", root["tag"].alias("tag"), root["text_len"].alias("text_len"))


@query("d07_page_markdown")
def _(spark, d):
    return P.page_markdown(P.main_content(content_pages(spark, d))).select("page_id", "markdown")


_IMG = ['<img src="/a.png" alt="A">', '<img data-src="//cdn.example.org/b.jpg" src="data:image/gif;base64,x">', '<img src="data:image/png;y">',
        '<img src="rel/c.png"><img src="https://x.example.org/d.png">', '<img data-original="" src="/a.png">', ""]


def image_pages(spark, d):
    html = F.replace(F.col("html"), F.lit("<p>"), F.concat(F.lit("<p>"), _pick(_IMG, F.col("page_id"))))
    return with_nodes(pages(spark, d).select("page_id", "url", html.alias("html")), "html")


_IMGS = """im AS (SELECT page_id, url, i, page_id % 6 AS k FROM (SELECT page_id, url, unnest(range(1, len(string_split(html, '<p>')))) AS i FROM pages)),
  oc AS (SELECT page_id, CASE WHEN k = 3 THEN i * 2 ELSE i END AS occurrence_index, CASE k WHEN 1 THEN split_part(url, ':', 1) || '://cdn.example.org/b.jpg' WHEN 3 THEN 'https://x.example.org/d.png'
     ELSE regexp_extract(url, '^https?://[^/?#]*') || '/a.png' END AS source_url, CASE WHEN k = 0 THEN 'A' ELSE '' END AS alt_text FROM im WHERE k NOT IN (2, 5))"""


@query("d08_image_occurrences", f"WITH {_IMGS} SELECT * FROM oc")
def _(spark, d):
    return P.image_occurrences(image_pages(spark, d))


@query("d08_image_usage", f"WITH {_IMGS} SELECT source_url, count(*) AS usage_count, count(DISTINCT page_id) AS pages FROM oc GROUP BY 1")
def _(spark, d):
    return P.url_usage(P.image_occurrences(image_pages(spark, d)), "source_url")


@query(
    "d08_link_occurrences",
    """WITH h AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS h FROM pages), l AS (SELECT page_id, url, i AS occurrence_index, h[i] AS r FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM h)),
       a AS (SELECT page_id, occurrence_index, CASE WHEN regexp_matches(r, '^https?://') THEN r WHEN starts_with(r, '//') THEN split_part(url, ':', 1) || ':' || r
          WHEN starts_with(r, '/') THEN regexp_extract(url, '^https?://[^/?#]*') || r END AS target FROM l)
       SELECT page_id, occurrence_index, replace(target, '&amp;', '&') AS target FROM a WHERE target IS NOT NULL""",
)
def _(spark, d):
    return P.link_occurrences(with_nodes(pages(spark, d), "html"))


def tabled_pages(spark, d):
    """Every paragraph start becomes a table row with its own number of cells."""
    k = F.col("page_id")
    row = F.concat(F.lit("<table><tr><th> a "), k, F.lit(" </th><td>b <i> c </i></td>"), F.when(k % 2 == 0, F.lit("<td></td>")).otherwise(F.lit("")), F.lit("</tr></table><p>"))
    return with_nodes(pages(spark, d).select("page_id", F.replace(F.col("html"), F.lit("<p>"), row).alias("html")), "html")


@query(
    "d09_table_rows",
    """SELECT page_id, i AS row_no, '| a ' || page_id || ' | bc |' || CASE WHEN page_id % 2 = 0 THEN '  |' ELSE '' END AS line
       FROM (SELECT page_id, unnest(range(1, len(string_split(html, '<p>')))) AS i FROM pages)""",
)
def _(spark, d):
    return P.table_rows(tabled_pages(spark, d))


@query(
    "d10_safe_names",
    """WITH t AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Same  title!' ELSE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title FROM pages),
       s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(title, '\\s+', '_', 'g'), '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g') AS a,
         regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1) || coalesce('_' || nullif(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), ''), ''),
           '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g') AS b FROM t),
       n AS (SELECT page_id, coalesce(nullif(a, ''), b) AS base FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS rn FROM n)
       SELECT page_id, base, CASE WHEN rn = 1 THEN base ELSE base || '_' || rn END AS name FROM r""",
)
def _(spark, d):
    k = F.col("page_id")
    title = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("Same  title!")).otherwise(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    named = pages(spark, d).select("page_id", P.base_name(title, F.col("url")).alias("base"))
    return P.unique_names(named, "base", "page_id").select("page_id", "base", "name")


_PLAIN = """regexp_replace(regexp_replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t]*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"""
_STRIPPED = """regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"""


@query("d11_plain_text", f"SELECT page_id, {_PLAIN.format(c=_STRIPPED)} AS text FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", P.plain_text(F.col("html")).alias("text"))


@query(
    "d12_images_to_markdown",
    """SELECT doc_id, replace(replace(text, '. ', '. ![pic.v2](/a/b.c/pic.v2.png) '), ' the ', ' ![cap](x/y)<b>![.z](q/.z) ') AS text FROM documents""",
)
def _(spark, d):
    t = F.replace(F.col("text"), F.lit(". "), F.lit('. <img class="x" src="/a/b.c/pic.v2.png" alt="no"> '))
    t = F.replace(t, F.lit(" the "), F.lit(' <img src="x/y"alt="cap" /><b><img alt="q" src="q/.z"> '))
    return table(spark, d, "documents").select("doc_id", P.images_to_markdown(t).alias("text"))


# ---- export and annotations ----------------------------------------------


@query(
    "a09_markdown_export",
    f"""WITH {_RICH}, x AS (SELECT page_id, url, CASE WHEN page_id % 6 = 3 THEN '2024-02-03' END AS pub, CASE page_id % 6 WHEN 1 THEN 'Ann' WHEN 5 THEN 'Org' END AS author,
          CASE page_id % 6 WHEN 2 THEN 'og words' WHEN 4 THEN 'a <b>' END AS descr, {_DECODE.format(c="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
          {_PLAIN.format(c=_STRIPPED)} AS body FROM rp)
        SELECT page_id, concat_ws(chr(10), '<!--', '  Source: ' || url, '  Crawled: 2024-06-01T00:00:00', '  Published: ' || pub, '  Author: ' || author, '-->' || chr(10),
          '# ' || title || chr(10), '> ' || descr || chr(10), body) AS markdown FROM x""",
)
def _(spark, d):
    df = rich_nodes(spark, d).withColumns({"m": P.meta_entries(F.col("nodes")), "body": P.plain_text(F.col("html"))})
    title = decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))

    def meta(*keys):
        return F.coalesce(P._meta(F.col("m"), *keys), F.lit(""))

    return df.select("page_id", export.markdown_with_header(
        F.col("url"), F.lit("2024-06-01T00:00:00"), title, F.col("body"), meta(*P.DATE_KEYS), meta(*P.AUTHOR_KEYS),
        meta(*P.DESCRIPTION_KEYS)).alias("markdown"))


def annotated_pages(spark, d):
    k = F.col("page_id")
    mark = F.concat(
        F.lit('<svg:text data-edit-target="true" id="t'), k, F.lit('" data-edit-annotation="fix &amp; go">n</svg:text><text data-edit-target="true"> '),
        F.lit("x" * 60), F.lit(" </text><rect data-edit-target=\"false\"/><p>"))
    return with_nodes(pages(spark, d).select("page_id", F.replace(F.col("html"), F.lit("<p>"), mark).alias("html")), "html")


@query(
    "h22_annotation_scan",
    """WITH i AS (SELECT page_id, unnest(range(1, len(string_split(html, '<p>')))) AS i FROM pages WHERE NOT contains(split_part(html, '</head>', 1), '<p>'))
       SELECT page_id, 't' || page_id AS element_id, 'text' AS tag, 'fix & go' AS annotation, '' AS content_preview FROM i
       UNION ALL SELECT page_id, '(no id)', 'text', '', repeat('x', 60) FROM i""",
)
def _(spark, d):
    return P.annotations(annotated_pages(spark, d))


@query("h22_annotation_counts", "SELECT page_id, 2 * (len(string_split(html, '<p>')) - 1) AS annotations FROM pages WHERE contains(html, '<p>')")
def _(spark, d):
    return P.annotation_counts(P.annotations(annotated_pages(spark, d)))
