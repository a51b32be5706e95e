"""Section H: profiling, rollups, validation, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rollup as R
from ..operators import text as E
from ..ordering import number_within
from .registry import query, table


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def _pick_sql(values, key):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({key} % {len(values)} AS INT) + 1]"


def docs(spark, d):
    return table(spark, d, "documents")


@query("h01_exact_dedupe", "SELECT md5(text) AS content_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(spark, d):
    return R.first_per_content(docs(spark, d), "text", "doc_id")


def assets(spark, d):
    """One asset per document, grouped by source; sizes follow from length and number."""
    k, n = F.col("doc_id"), F.col("n_chars")
    return docs(spark, d).select(
        F.col("source").alias("doc_id"), k.alias("pos"), (80 + n % 700).alias("width"), (90 + k * 13 % 900).alias("height"),
        (n * 9).alias("n_bytes"), F.col("text").alias("content"), (10 + k % 60).cast("double").alias("render_w"),
        (10 + n % 80).cast("double").alias("render_h"), F.when(k % 9 == 0, 0.0).otherwise(612.0).alias("page_w"), F.lit(792.0).alias("page_h"))


@query(
    "h02_asset_filter",
    """WITH a AS (SELECT source AS doc_id, doc_id AS pos, 80 + n_chars % 700 AS width, 90 + doc_id * 13 % 900 AS height, n_chars * 9 AS n_bytes, md5(text) AS h,
         (10 + doc_id % 60)::DOUBLE AS rw, (10 + n_chars % 80)::DOUBLE AS rh, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 612 END::DOUBLE AS pw FROM documents),
       s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY pos) AS rn FROM a WHERE width >= 100 AND height >= 100 AND width * height >= 30000 AND n_bytes >= 2048)
       SELECT doc_id, pos, width, height FROM s WHERE rn = 1 AND NOT (pw > 0 AND rw / pw < 0.05 AND rh / 792.0::DOUBLE < 0.05)
         AND greatest(width, height) / greatest(least(width, height), 1) <= 12 AND NOT (n_bytes / (width * height) < 0.08 AND width * height < 500000)""",
)
def _(spark, d):
    return R.filter_assets(assets(spark, d)).select("doc_id", "pos", "width", "height")


@query(
    "h03_canonical_dedupe",
    """WITH k AS (SELECT doc_id AS path, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || (doc_id % 2)) AS k FROM documents)
       SELECT path, min(path) OVER (PARTITION BY k) AS first_path, count(*) OVER (PARTITION BY k) AS copies FROM k""",
)
def _(spark, d):
    k = F.col("doc_id")
    stamp = F.concat(
        F.lit("  Crawled: 2024-"), k, F.lit("\r\nImported:  "), k * 7, F.lit("\r\n![x](doc"), k, F.lit("_files/a.png) "),
        F.when(k % 2 == 0, F.lit("even")).otherwise(F.lit("odd")), F.lit("\n"))
    stamped = docs(spark, d).select(k.alias("path"), F.concat(stamp, X.strip_blank(F.col("text")), F.when(k % 3 == 0, F.lit(" \n")).otherwise(F.lit(""))).alias("text"))
    return R.equivalent_documents(stamped, "text", "path")


def _changes(spark, d):
    """Suppliers as changed and new customers, some twice."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.when(k % 3 == 0, k * 10 + 1_000_000).otherwise(F.floor(k / 2) * 7).alias("key"), (1000 - k % 100 + F.floor(k / 100) * 1000).alias("pos"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


@query(
    "h04_keyed_merge",
    """WITH n AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 10 + 1000000 ELSE s_suppkey // 2 * 7 END AS key, 1000 - s_suppkey % 100 + s_suppkey // 100 * 1000 AS pos,
         s_name AS name, s_acctbal AS balance FROM supplier),
       l AS (SELECT key, arg_max(name, pos) AS name, arg_max(balance, pos) AS balance, min(pos) AS pos FROM n GROUP BY 1)
       SELECT c_custkey AS key, 0::BIGINT AS part, c_custkey AS pos, coalesce(l.name, c_name) AS name, coalesce(l.balance, c_acctbal) AS balance, l.key IS NOT NULL AS replaced
       FROM customer LEFT JOIN l ON l.key = c_custkey
       UNION ALL SELECT key, 1, pos, name, balance, true FROM l WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = key)""",
)
def _(spark, d):
    old = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return R.keyed_merge(old, _changes(spark, d), "key", "pos")


def _files(spark, d):
    k = F.col("doc_id")
    return docs(spark, d).select(
        F.concat("lang", F.lit("/"), "source", F.lit("/f"), F.col("n_chars") % 40, _pick([".md", ".svg", ".html", "", ".txt"], F.col("n_chars"))).alias("path"),
        k.alias("pos"), F.col("n_chars").alias("bytes"))


_FILES = """fl AS (SELECT lang || '/' || source || '/f' || n_chars % 40 || ['.md', '.svg', '.html', '', '.txt'][CAST(n_chars % 5 AS INT) + 1] AS path,
   doc_id AS pos, n_chars AS bytes FROM documents)"""


@query("h05_last_per_path", f"WITH {_FILES} SELECT path, arg_max(bytes, pos) AS bytes, max(pos) AS pos, count(*) AS versions FROM fl GROUP BY 1")
def _(spark, d):
    return R.last_per_path(_files(spark, d), "path", "pos", "bytes")


@query(
    "h05_file_totals",
    f"WITH {_FILES}, l AS (SELECT path, arg_max(bytes, pos) AS b FROM fl GROUP BY 1) SELECT count(*) AS file_count, sum(b)::BIGINT AS total_bytes FROM l",
)
def _(spark, d):
    return R.file_totals(_files(spark, d), "path", "pos", "bytes")


_PRE = ["", "/", "./", "../", "a\\..\\", "x/./", "//", "b/..c/"]


@query(
    "h06_path_traversal",
    f"""WITH e AS (SELECT page_id, {_pick_sql(_PRE, 'page_id')} || replace(url, '://', '/') AS name FROM pages),
        p AS (SELECT page_id, list_filter(string_split(replace(name, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.') AS p FROM e)
        SELECT page_id, CASE WHEN NOT list_contains(p, '..') THEN array_to_string(p, '/') END AS entry FROM p""",
)
def _(spark, d):
    name = F.concat(_pick(_PRE, F.col("page_id")), F.replace(F.col("url"), F.lit("://"), F.lit("/")))
    return table(spark, d, "pages").select("page_id", R.safe_entry(name).alias("entry"))


_HREF = r'href="/?([^"]+)"'


def page_refs(spark, d):
    return R.reference_occurrences(table(spark, d, "pages").withColumnRenamed("page_id", "doc_id"), "html", _HREF)


_REFS = """rf AS (SELECT doc_id, regexp_extract(h[i], '([^/]*)$', 1) AS filename, i AS occurrence_index FROM (SELECT page_id AS doc_id,
   regexp_extract_all(html, 'href="/?([^"]+)"', 1) AS h, unnest(range(1, len(regexp_extract_all(html, 'href="/?([^"]+)"', 1)) + 1)) AS i FROM pages))"""


@query("h07_occurrence_index", f"WITH {_REFS} SELECT * FROM rf")
def _(spark, d):
    return page_refs(spark, d)


@query(
    "h07_usage_counts",
    f"""WITH {_REFS}, a AS (SELECT DISTINCT filename FROM rf UNION SELECT p_name FROM part), u AS (SELECT filename, count(*) AS n FROM rf GROUP BY 1)
        SELECT filename, coalesce(n, 1) AS usage_count FROM a LEFT JOIN u USING (filename)""",
)
def _(spark, d):
    refs = page_refs(spark, d)
    names = refs.select("filename").union(table(spark, d, "part").select("p_name")).distinct()
    return R.usage_counts(names, refs, ["filename"])


@query(
    "h07_ratio_variants",
    f"WITH {_REFS} SELECT DISTINCT filename, round((occurrence_index % 4 + 1) / 2.0::DOUBLE, 6) AS ratio FROM rf WHERE occurrence_index % 7 <> 0",
)
def _(spark, d):
    i = F.col("occurrence_index")
    refs = page_refs(spark, d).withColumn("ratio", F.when(i % 7 != 0, F.round((i % 4 + 1) / 2.0, 6)))
    return R.ratio_variants(refs, ["filename"], "ratio")


@query("h08_shared_assets", f"WITH {_REFS} SELECT filename, count(*) AS uses FROM rf GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return R.shared_assets(page_refs(spark, d), "filename")


def _slides(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("slide"), F.col("o_orderstatus").alias("page_type"))


def _images(spark, d):
    li = table(spark, d, "lineitem")
    return li.where(F.col("l_returnflag") != "A").select(F.col("l_orderkey").alias("slide"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_partkey").cast("string").alias("item"))


def _tables(spark, d):
    li = table(spark, d, "lineitem")
    return li.where(F.col("l_quantity") < 10).select((F.col("l_orderkey") + 5).alias("slide"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_suppkey").cast("string").alias("item"))


@query(
    "h09_slide_ledger",
    """WITH i AS (SELECT l_orderkey AS s, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1), t AS (SELECT l_orderkey + 5 AS s, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY 1),
       c AS (SELECT c_custkey AS s, count(*) AS n FROM customer GROUP BY 1)
       SELECT o_orderkey AS slide, o_orderstatus AS page_type, coalesce(i.n, 0) AS n_images, coalesce(t.n, 0) AS n_tables, coalesce(c.n, 0) AS n_charts
       FROM orders LEFT JOIN i ON i.s = o_orderkey LEFT JOIN t ON t.s = o_orderkey LEFT JOIN c ON c.s = o_orderkey""",
)
def _(spark, d):
    charts = table(spark, d, "customer").select(F.col("c_custkey").alias("slide"))
    return R.slide_ledger(_slides(spark, d), "slide", images=_images(spark, d), tables=_tables(spark, d), charts=charts)


@query(
    "h09_slide_ledger_items",
    """SELECT l_orderkey AS slide, 'images' AS kind, l_linenumber::BIGINT AS seq, l_partkey::VARCHAR AS item FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey IN (SELECT o_orderkey FROM orders)
       UNION ALL SELECT l_orderkey + 5, 'tables', l_linenumber, l_suppkey::VARCHAR FROM lineitem WHERE l_quantity < 10 AND l_orderkey + 5 IN (SELECT o_orderkey FROM orders)""",
)
def _(spark, d):
    return R.slide_ledger_items(_slides(spark, d), "slide", images=_images(spark, d), tables=_tables(spark, d))


@query(
    "h10_frequency_rank_words",
    """SELECT value, count(*) AS count FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS value FROM documents) WHERE value <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(spark, d):
    words = docs(spark, d).select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    return R.frequency_rank(words, F.nullif("w", F.lit("")), 20)


@query("h10_frequency_rank_sizes", "SELECT l_quantity AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, d):
    return R.frequency_rank(table(spark, d, "lineitem"), F.col("l_quantity"), 8)


def _charts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chart_id")).agg(
        F.sort_array(F.collect_set("l_returnflag")).alias("plot_types"), F.count(F.lit(1)).alias("series_count"))


@query(
    "h11_chart_totals",
    """WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS p, count(*) AS s FROM lineitem GROUP BY 1)
       SELECT count(*) AS chart_count, sum(s)::BIGINT AS series_count, count_if(p > 1)::BIGINT AS multi_plot_chart_count FROM c""",
)
def _(spark, d):
    return R.chart_totals(_charts(spark, d))


@query(
    "h11_chart_rows",
    """SELECT l_orderkey AS chart_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS plot_types, count(*) AS series_count FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    return _charts(spark, d).withColumn("plot_types", F.array_join("plot_types", ","))


@query(
    "h12_chart_grid",
    """WITH m AS (SELECT o_orderpriority AS chart_id, o_orderstatus AS s, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1 AS idx, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY ALL),
       c AS (SELECT DISTINCT chart_id, idx FROM m), x AS (SELECT chart_id, s, idx, CASE s WHEN 'F' THEN n::VARCHAR WHEN 'O' THEN CASE WHEN v = floor(v) THEN floor(v)::BIGINT::VARCHAR
          ELSE (n + 0.5)::DOUBLE::VARCHAR END END AS t FROM m WHERE s <> 'P')
       SELECT c.chart_id, c.idx + 5 AS line_no, '| ' || (1990 + idx // 12) || '-' || (idx % 12 + 1) || ' | ' || coalesce((SELECT t FROM x WHERE x.chart_id = c.chart_id AND x.idx = c.idx AND s = 'F'), '') || ' | '
         || coalesce((SELECT t FROM x WHERE x.chart_id = c.chart_id AND x.idx = c.idx AND s = 'O'), '') || ' |' AS line FROM c
       UNION ALL SELECT chart_id, i, ['> [Chart] ' || chart_id || ' — LINE', '', '| Category | F | O |', '| --- | --- | --- |'][i] FROM (SELECT DISTINCT chart_id FROM m), (SELECT unnest(range(1, 5)) AS i)""",
)
def _(spark, d):
    idx = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1).cast("long")
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("chart_id"), F.col("o_orderstatus").alias("s"), idx.alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    whole = F.col("v") == F.floor("v")
    value = F.when(F.col("s") == "F", F.col("n").cast("double")).otherwise(F.when(whole, F.col("v").cast("double")).otherwise(F.col("n") + 0.5))
    points = m.where(F.col("s") != "P").select("chart_id", F.when(F.col("s") == "F", 1).otherwise(2).alias("series_pos"), "idx", value.alias("value"))
    cats = m.select("chart_id", "idx").distinct().select(
        "chart_id", "idx", F.concat((1990 + F.floor(F.col("idx") / 12)).cast("string"), F.lit("-"), (F.col("idx") % 12 + 1).cast("string")).alias("label"))
    series = m.where(F.col("s") != "P").select("chart_id", "s").distinct().select(
        "chart_id", F.col("chart_id").alias("name"), F.lit("LINE").alias("chart_type"),
        F.when(F.col("s") == "F", 1).otherwise(2).alias("series_pos"), F.col("s").alias("series"))
    return R.chart_grid(points, series, cats)


def _checked(spark, d):
    p = F.col("o_totalprice")

    def some(cond, text):
        return F.when(cond, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))

    return table(spark, d, "orders").select(
        some(p > 450000, "too large").alias("errors"), some(F.col("o_orderstatus") == "P", "pending").alias("warnings"),
        (F.col("o_custkey") % 11 == 0).alias("missing_readme"), (F.col("o_orderpriority") == "5-LOW").alias("missing_spec"), "o_orderpriority")


@query(
    "h13_validation_summary",
    """WITH c AS (SELECT o_totalprice > 450000 AS e, o_orderstatus = 'P' AS w, o_custkey % 11 = 0 AS r, o_orderpriority = '5-LOW' AS s FROM orders),
       a AS (SELECT count(*) AS total, count_if(NOT e AND NOT w)::BIGINT AS valid, count_if(e)::BIGINT AS has_errors, count_if(NOT e AND w)::BIGINT AS has_warnings,
         count_if(r)::BIGINT AS missing_readme, count_if(s)::BIGINT AS missing_spec FROM c)
       SELECT *, floor(valid / total * 100)::BIGINT AS valid_pct, floor(has_errors / total * 100)::BIGINT AS errors_pct, floor(has_warnings / total * 100)::BIGINT AS warnings_pct FROM a""",
)
def _(spark, d):
    return R.validation_summary(_checked(spark, d))


@query("h13_distribution", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return R.distribution(_checked(spark, d), "o_orderpriority")


_ISSUES = ["Invalid XML in viewBox", "bad viewBox", "foreignObject with font", "FONT-size missing", "nothing"]


@query(
    "h14_issue_categories",
    """SELECT ['XML well-formedness','viewBox issues','foreignObject','Font issues','Other'][CAST(event_id % 5 AS INT) + 1] AS category, count(*) AS n FROM events GROUP BY 1""",
)
def _(spark, d):
    msg = F.concat(_pick(_ISSUES, F.col("event_id")), F.lit(" "), "user_id")
    return R.distribution(table(spark, d, "events").select(R.issue_category(msg).alias("category")), "category")


_COLORS = ["#fff", "#00AA11", "#123456", "#00aa11"]
_STACKS = ['"Arial, \'Courier New\'"', "'Georgia'", '"arial,Courier New"', '"Comic Sans"']
_PX = ["12", "18px", " 20 ", "300", "6", "12.5em"]


def styled_pages(spark, d):
    """Pages whose paragraphs, headings and items carry style attributes."""
    k = F.col("page_id")
    html = F.replace(F.col("html"), F.lit("<p>"), F.concat(F.lit("<p fill = '"), _pick(_COLORS, k), F.lit("' font-size=\""), _pick(_PX, k), F.lit('">')))
    html = F.replace(html, F.lit("<h1>"), F.concat(F.lit("<h1 stop-color=\""), _pick(_COLORS, F.floor(k / 4)), F.lit("\" font-family="), _pick(_STACKS, k), F.lit(">")))
    html = F.replace(html, F.lit("<li>"), F.concat(F.lit("<li stroke=\"#00AA11\" xfill=\"#999999\" font-size='"), _pick(_PX, F.floor(k / 6)), F.lit("'>")))
    return table(spark, d, "pages").select("page_id", html.alias("html"))


def _drift(spark, d):
    return R.allow_list_drift(styled_pages(spark, d), "page_id", "html", ["#00aa11"], ["Arial, 'Courier New'"], ["12", "20px"], body=20.0)


_DRIFT = f"""sd AS (SELECT page_id, {_pick_sql(_COLORS, 'page_id')} AS c1, {_pick_sql(_COLORS, '(page_id // 4)')} AS c2, {_pick_sql(_STACKS, 'page_id')} AS f,
     trim({_pick_sql(_PX, 'page_id')}) AS s1, trim({_pick_sql(_PX, '(page_id // 6)')}) AS s2, html FROM pages),
  us AS (SELECT page_id, 'colors' AS category, upper(c1) AS value FROM sd WHERE contains(html, '<p>') UNION SELECT page_id, 'colors', upper(c2) FROM sd WHERE contains(html, '<h1>')
     UNION SELECT page_id, 'fonts', substr(f, 2, length(f) - 2) FROM sd WHERE contains(html, '<h1>')
     UNION SELECT page_id, 'sizes', replace(s1, 'px', '') FROM sd WHERE contains(html, '<p>') UNION SELECT page_id, 'sizes', replace(s2, 'px', '') FROM sd WHERE contains(html, '<li>')),
  dr AS (SELECT * FROM us WHERE (category = 'colors' AND value <> '#00AA11') OR (category = 'fonts' AND value IN ('Georgia', 'Comic Sans'))
     OR (category = 'sizes' AND value IN ('300', '6', '12.5em')))"""


@query("h15_allow_list_drift", f"WITH {_DRIFT} SELECT * FROM dr")
def _(spark, d):
    return _drift(spark, d)


@query("h15_drift_summary", f"WITH {_DRIFT} SELECT category, value, count(*) AS files FROM dr GROUP BY ALL")
def _(spark, d):
    return R.drift_summary(_drift(spark, d), "page_id")


@query(
    "h16_small_size_drift",
    """WITH u AS (SELECT l_orderkey AS file, CAST(l_quantity AS INTEGER)::VARCHAR AS s, l_quantity AS v FROM lineitem),
       o AS (SELECT file, s, v, count(*) AS n FROM u WHERE s NOT IN ('18', '24', '12') AND (v <= 13.5 OR v < 12) GROUP BY ALL),
       f AS (SELECT file, count(*) AS k, sum(n) AS t, bool_or(v < 12) AS b FROM o GROUP BY 1 HAVING count(*) >= 2 OR sum(n) >= 4 OR bool_or(v < 12)),
       r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY v) AS rn FROM o)
       SELECT f.file, 'possible template font-size drift: undeclared sub-body size(s) ' || (SELECT string_agg(s || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, ', ' ORDER BY v) FROM r WHERE r.file = f.file)
         || '. Map each text item to a spec_lock typography role first, then reflow card height / y / dy / line-height from the locked px values.' AS message
       FROM f""",
)
def _(spark, d):
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_quantity").cast("int").cast("string").alias("size"))
    return R.small_size_drift(used, "file", "size", ["18", "24", "12"], 18.0)


_TAILS = ["_ppt169_20240115", "_XHS_20231301", "_wechat_moment_20240229", "_story", "_a4_20240101", "_ppt43", "_none_20240101", "", "_小红书_20240202", "_Banner_2024"]
_TAIL_OUT = [
    ("", "ppt169", "PPT 16:9", "20240115", "2024-01-15"), ("", "xiaohongshu", "小红书", "20231301", None), ("_wechat_moment", None, None, "20240229", "2024-02-29"),
    ("", "story", "Story/Vertical", None, None), ("", "a4", "A4 Print", "20240101", "2024-01-01"), ("", "ppt43", "PPT 4:3", None, None),
    ("_none", None, None, "20240101", "2024-01-01"), ("", None, None, None, None), ("_小红书", None, None, "20240202", "2024-02-02"), ("_Banner_2024", None, None, None, None),
]


def _out_sql(i, default):
    return "[" + ", ".join("NULL" if t[i] is None else f"'{t[i]}'" for t in _TAIL_OUT) + f"][CAST(p_partkey % 10 AS INT) + 1]" if default is None else \
        f"coalesce({_out_sql(i, None)}, '{default}')"


@query(
    "h17_name_parsing",
    f"""SELECT p_partkey, replace(p_name, ' ', '_') || {_out_sql(0, None)} AS name, {_out_sql(1, 'unknown')} AS format, {_out_sql(2, 'Unknown format')} AS format_name,
         {_out_sql(3, 'unknown')} AS date, {_out_sql(4, 'Unknown date')} AS date_formatted FROM part""",
)
def _(spark, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), _pick(_TAILS, F.col("p_partkey")))
    return table(spark, d, "part").select("p_partkey", R.parse_project_name(name).alias("r")).select("p_partkey", "r.*")


@query(
    "h18_folder_statistics",
    f"""WITH {_FILES} SELECT regexp_extract(path, '(\\.[a-z]+)?$', 1) AS extension, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM fl GROUP BY 1
        UNION ALL SELECT '*', count(*), sum(bytes)::BIGINT FROM fl""",
)
def _(spark, d):
    return R.folder_statistics(_files(spark, d), "path", "bytes")


@query("h19_index_formats", "SELECT o_orderpriority, count(*) AS projects, sum(o_custkey)::BIGINT AS amount FROM orders GROUP BY 1")
def _(spark, d):
    return R.index_formats(table(spark, d, "orders"), "o_orderpriority", "o_custkey")


@query(
    "h19_index_recent",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    return R.index_recent(o, "day", "o_orderkey")


@query(
    "h20_landscape_suggestion",
    """WITH i AS (SELECT doc_id, 100 + length(l[i]) % 300 AS w, 150 + (doc_id + i - 1) % 60 AS h FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
       c AS (SELECT doc_id, count(*) AS n, count_if(w > h * 1.2)::BIGINT AS k FROM i GROUP BY 1)
       SELECT doc_id, k || ' of ' || n || ' embedded images are landscape-oriented; consider landscape: true for better page usage' AS warning
       FROM c WHERE n >= 3 AND k / n >= 0.6 AND doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, d):
    images = E.split_lines(docs(spark, d)).select(
        "doc_id", (100 + F.length("text") % 300).alias("width"), (150 + (F.col("doc_id") + F.col("line_no")) % 60).alias("height"))
    return R.landscape_suggestion(images, table(spark, d, "labels"))


@query(
    "h21_read_back",
    """WITH n AS (SELECT count(*) AS n FROM benchmark), t AS (SELECT DISTINCT d.doc_id, d.doc_id % 3 AS slide, replace(b.text, ' ', '  ') AS token, d.text FROM documents d, n JOIN benchmark b ON true
         WHERE b.item_id = d.doc_id % n UNION ALL SELECT doc_id, 9, lang, text FROM documents UNION ALL SELECT doc_id, 8, replace(text, ' ', chr(10)), text FROM documents)
       SELECT doc_id, slide, token FROM t WHERE NOT contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(token, '\\s+', '', 'g'))""",
)
def _(spark, d):
    bench = table(spark, d, "benchmark")
    n = bench.count()
    dd = docs(spark, d)
    k = F.col("doc_id")
    passages = dd.select("doc_id", (k % n).alias("item_id")).join(bench.withColumnRenamed("text", "token"), "item_id").select(
        "doc_id", (k % 3).alias("slide"), F.replace("token", F.lit(" "), F.lit("  ")).alias("token"))
    extra = dd.select("doc_id", F.explode(F.array(
        F.struct(F.lit(9).cast("long").alias("slide"), F.col("lang").alias("token")),
        F.struct(F.lit(8).cast("long").alias("slide"), F.replace("text", F.lit(" "), F.lit("\n")).alias("token")))).alias("t")).select("doc_id", "t.*")
    return R.read_back_misses(passages.unionByName(extra), dd)


@query(
    "h23_color_replace",
    """WITH t AS (SELECT doc_id, replace(replace(text, ' the ', ' #aB12cd '), ' la ', '#AB12CD;') AS t FROM documents)
       SELECT doc_id, len(string_split(lower(t), '#ab12cd')) - 1 AS hits, regexp_replace(t, '(?i)#ab12cd', '#112233', 'g') AS text FROM t WHERE contains(lower(t), '#ab12cd')""",
)
def _(spark, d):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" #aB12cd ")), F.lit(" la "), F.lit("#AB12CD;"))
    return R.replace_color(docs(spark, d).select("doc_id", t.alias("text")), "text", "#AB12CD", "#112233")


def _slots(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    return table(spark, d, "conversations").select(
        c.alias("slide"), t.alias("seq"), F.concat(F.lit("s"), t).alias("slot_id"), F.when(t % 2 == 0, t + 10).alias("shape_id"), F.col("role").alias("shape_name"))


@query(
    "h24_selector_edits",
    """WITH s AS (SELECT conv_id AS slide, turn AS seq, 's' || turn AS slot_id, CASE WHEN turn % 2 = 0 THEN turn + 10 END AS shape_id, role AS shape_name FROM conversations),
       e AS (SELECT conv_id * 100 + turn AS edit_id, conv_id AS slide, CASE turn % 3 WHEN 0 THEN 's' || turn WHEN 1 THEN '' END AS slot_id, CASE WHEN turn % 4 = 1 THEN turn + 9 WHEN turn % 4 = 3 THEN 99 END AS shape_id,
         CASE WHEN turn % 5 <> 0 THEN ['user', 'system', 'nobody'][CAST(turn % 3 AS INT) + 1] END AS shape_name, text FROM conversations),
       r AS (SELECT e.*, coalesce((SELECT max(seq) FROM s WHERE s.slide = e.slide AND s.slot_id = e.slot_id AND e.slot_id <> ''),
         (SELECT max(seq) FROM s WHERE s.slide = e.slide AND s.shape_id = e.shape_id), (SELECT max(seq) FROM s WHERE s.slide = e.slide AND s.shape_name = e.shape_name)) AS target FROM e)
       SELECT edit_id, slide, text, target, coalesce('slot_id:' || nullif(slot_id, ''), 'shape_id:' || shape_id, 'shape_name:' || shape_name, '') AS selector,
         CASE WHEN target IS NULL THEN 'replacement target not found in slide library' END AS error FROM r""",
)
def _(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    edits = table(spark, d, "conversations").select(
        (c * 100 + t).alias("edit_id"), c.alias("slide"), F.when(t % 3 == 0, F.concat(F.lit("s"), t)).when(t % 3 == 1, F.lit("")).alias("slot_id"),
        F.when(t % 4 == 1, t + 9).when(t % 4 == 3, F.lit(99)).alias("shape_id"),
        F.when(t % 5 != 0, _pick(["user", "system", "nobody"], t)).alias("shape_name"), "text")
    return R.resolve_edits(edits, _slots(spark, d))


_WIDE = ["山水", "Ω±é", "ﾊﾝ", "ＡＢ", "😀x"]


@query(
    "h25_visual_width",
    # the appended samples have known widths; the corpus letters outside ASCII are listed by class
    f"""WITH t AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS t, doc_id % 5 AS k FROM documents)
        SELECT doc_id, (length(t) + len(regexp_extract_all(t, '[áàéèêíìóòúùüß°±²³´¶·¸¹º¼½¾¿×ØÞðæ÷øþ§¨ª®¡¤]')) * 0.5 + [4, 4.5, 2, 4, 3][CAST(k AS INT) + 1])::DOUBLE AS width FROM t""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", X.visual_width(F.concat("text", F.lit(" "), _pick(_WIDE, F.col("doc_id")))).cast("double").alias("width"))


_ROLES = ["title_candidate", "body_candidate", "label_candidate", "other"]


def fit_pairs(spark, d):
    """The lines of a document as old texts, the next document's number choosing the new text."""
    lines = E.split_lines(docs(spark, d))
    k, n = F.col("doc_id") + F.col("line_no"), F.length("text")
    return lines.select(
        "doc_id", "line_no", _pick(_ROLES, k).alias("role"), F.when(k % 6 == 0, F.lit("Title")).otherwise(F.col("text")).alias("old_text"),
        F.when(k % 5 == 0, F.concat("text", F.lit("\n"), "text", F.lit("\n\n"), "text")).when(k % 5 == 1, F.repeat(F.concat("text", F.lit("\n")), 4))
        .when(k % 5 == 2, F.lit("Titles"))
        .otherwise(F.concat("text", F.lit(" more words"))).alias("new_text"),
        (1 + k % 3).alias("old_paragraphs"), F.when(k % 7 == 0, F.lit(None)).otherwise(60 + n * 3 % 600).alias("width"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(20 + n * 5 % 400).alias("height"), F.when(k % 4 == 0, 18.0 + n % 9).alias("font_size_px"))


# ASCII and the four corpus languages only, so ambiguous letters can be listed
_AMB = "[áàéèêíìóòúùüß°±²³´¶·¸¹º¼½¾¿×ØÞðæ÷øþ§¨ª®¡¤]"
_FIT = f"""ln AS (SELECT doc_id, i - 1 AS line_no, l[i] AS text, doc_id + i - 1 AS k, length(l[i]) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
  pr AS (SELECT doc_id, line_no, {_pick_sql(_ROLES, 'k')} AS role, CASE WHEN k % 6 = 0 THEN 'Title' ELSE text END AS o, CASE k % 5 WHEN 0 THEN text || chr(10) || text || chr(10) || chr(10) || text
     WHEN 1 THEN repeat(text || chr(10), 4) WHEN 2 THEN 'Titles' ELSE text || ' more words' END AS w, 1 + k % 3 AS op, CASE WHEN k % 7 <> 0 THEN 60 + n * 3 % 600 END AS width,
     CASE WHEN k % 11 <> 0 THEN 20 + n * 5 % 400 END AS height, CASE WHEN k % 4 = 0 THEN (18.0 + n % 9)::DOUBLE END AS fs FROM ln),
  q AS (SELECT *, greatest(length(regexp_replace(o, '\\s+', '', 'g')) + 0.5 * len(regexp_extract_all(o, '{_AMB}')), 1.0)::DOUBLE AS ow,
     (length(regexp_replace(w, '\\s+', '', 'g')) + 0.5 * len(regexp_extract_all(w, '{_AMB}')))::DOUBLE AS nw,
     greatest(len(list_filter(string_split(w, chr(10)), lambda x: trim(x) <> '')), 1) AS np FROM pr),
  s AS (SELECT *, CASE WHEN fs > 0 THEN fs WHEN height / op / 1.25::DOUBLE BETWEEN 8 AND 56 THEN height / op / 1.25::DOUBLE WHEN role = 'title_candidate' THEN 28.0 WHEN role = 'body_candidate' THEN 16.0 ELSE 14.0 END::DOUBLE AS size FROM q),
  u AS (SELECT *, CASE WHEN width > 0 AND height > 0 THEN greatest(width - CASE WHEN width >= 180 THEN 24 ELSE 12 END, width * 0.72::DOUBLE, 1.0) / greatest(size * 0.52::DOUBLE, 1.0)
     * greatest(floor(height / greatest(size * 1.25::DOUBLE, 1.0)), op, np, 1) * CASE role WHEN 'label_candidate' THEN 0.7 WHEN 'title_candidate' THEN 0.85 ELSE 1.0 END::DOUBLE END AS cap FROM s),
  v AS (SELECT *, nw / ow AS ratio, coalesce(nw <= cap, false) AS fits, role = 'label_candidate' OR (ow <= 8 AND op <= 1) AS lab, role = 'title_candidate' AND op <= 1 AS tit FROM u),
  m AS (SELECT *, CASE WHEN lab AND fits AND ow > 8 THEN 'short label fits estimated text-box capacity'
      WHEN lab AND nw > CASE WHEN width >= 220 THEN ow * 1.25::DOUBLE ELSE ow END THEN 'short label exceeds original visual width; rewrite shorter'
      WHEN lab THEN 'short label fits original visual width' WHEN tit AND fits THEN 'title fits estimated text-box capacity'
      WHEN tit AND ratio > CASE WHEN ow <= 12 THEN 1.15 ELSE 1.35 END::DOUBLE THEN 'title is too long for the original slot; rewrite first' WHEN tit THEN 'title stays near original capacity'
      WHEN np > greatest(op + 2, op * 2, 2) THEN 'body paragraph count changed too much; compress or split pages'
      WHEN width * height < 30000 AND ratio > 2.0 THEN 'small text box with much longer text; rewrite shorter'
      WHEN nw > cap THEN 'text exceeds estimated text-box capacity; rewrite or split'
      WHEN ratio > CASE WHEN role = 'body_candidate' THEN 3.0 ELSE 2.2 END::DOUBLE THEN 'text is much longer than source slot; rewrite or choose another page'
      ELSE 'within estimated slot capacity' END AS message FROM v),
  st AS (SELECT *, CASE WHEN regexp_matches(message, '^(short label exceeds|title is too|body para|small text|text )') THEN 'WARN' ELSE 'OK' END AS status FROM m)"""


@query("h26_text_fit", f"WITH {_FIT} SELECT doc_id, line_no, role, round(ow, 2) AS old_width, round(nw, 2) AS new_width, np AS new_paragraphs, status, message FROM st")
def _(spark, d):
    return R.text_fit(fit_pairs(spark, d)).select(
        "doc_id", "line_no", "role", F.round("old_width", 2).alias("old_width"), F.round("new_width", 2).alias("new_width"), "new_paragraphs", "status", "message")


@query("h26_text_fit_summary", f"WITH {_FIT} SELECT count_if(status = 'OK')::BIGINT AS ok, count_if(status = 'WARN')::BIGINT AS warn FROM st")
def _(spark, d):
    return R.fit_summary(R.text_fit(fit_pairs(spark, d)))


_WORDS = ["", " Thank you", " Agenda", " chapter one", " Q&A contact", " departments"]


def deck_slides(spark, d):
    """Turns as slides of a deck, with words that decide the role."""
    from ..operators.assemble import page_counts

    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), "text")
    n = page_counts(conv).select("doc_id", F.col("page_count").alias("total"))
    k = F.col("doc_id") + F.col("page_index")
    body = F.concat(F.when(k % 4 == 0, F.lit("Short")).otherwise(F.col("text")), _pick(_WORDS, k))
    return conv.join(n, "doc_id").select("doc_id", (F.col("page_index") + 1).alias("idx"), "total", body.alias("text"), (k % 5).alias("k5"), F.length("text").alias("n"))


_ROLE_SQL = """sl AS (SELECT conv_id AS doc_id, turn + 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS total, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'Short' ELSE text END ||
   ['', ' Thank you', ' Agenda', ' chapter one', ' Q&A contact', ' departments'][CAST((conv_id + turn) % 6 AS INT) + 1] AS t, (conv_id + turn) % 5 AS k5, length(text) AS n FROM conversations),
  fl AS (SELECT *, regexp_matches(lower(t), 'thank|q&a|qa|contact|致谢|谢谢|感谢|答疑|联系方式') AS th, regexp_matches(lower(t), 'agenda|content|outline|目录|议程') AS tc,
   regexp_matches(lower(t), 'chapter|part|section|章节|部分') AS ch FROM sl)"""


@query(
    "h27_page_roles",
    f"""WITH {_ROLE_SQL} SELECT doc_id, idx, CASE WHEN idx = 1 THEN 'cover_candidate' WHEN idx = total OR th THEN 'ending_candidate' WHEN tc THEN 'toc_candidate' WHEN ch THEN 'chapter_candidate'
          WHEN k5 <= 2 AND length(t) <= 80 THEN 'chapter_candidate' ELSE 'content_candidate' END AS page_type,
        CASE WHEN th THEN 'ending_candidate' WHEN tc THEN 'toc_candidate' WHEN ch THEN 'chapter_candidate' WHEN idx = 1 AND k5 <= 3 THEN 'cover_candidate'
          WHEN idx = total AND k5 + 3 <= 6 THEN 'ending_candidate' WHEN k5 + 3 <= 3 AND n % 20 <= 12 THEN 'chapter_candidate' ELSE 'content_candidate' END AS slide_type,
        CASE WHEN idx = 1 OR k5 = 4 THEN 'title_candidate' WHEN n % 300 < 160 AND length(t) <= 80 THEN 'title_candidate' WHEN n % 6 >= 4 OR length(t) >= 120 THEN 'body_candidate'
          ELSE 'label_candidate' END AS slot_role FROM fl""",
)
def _(spark, d):
    i, n, t, k5, size = (F.col(c) for c in ("idx", "total", "text", "k5", "n"))
    return deck_slides(spark, d).select(
        "doc_id", "idx", R.page_type(i, n, t, k5).alias("page_type"), R.slide_type(i, n, t, k5 + 3, k5, size % 20).alias("slide_type"),
        R.slot_role(i, F.when(k5 == 4, F.lit("Main Title 2")).otherwise(F.lit("box")), size % 300, t, size % 6).alias("slot_role"))
