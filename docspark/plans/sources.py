"""Section A: sources, sinks and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_dir
from ..sources import decode, export
from ..sources import tables as T
from .registry import query, table

_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(
    "a01_capped_scan",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
       ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity LIMIT 500""",
)
def _(spark, d):
    return T.capped_scan(table(spark, d, "lineitem"), _LINE_KEY, max_rows=500, max_cols=5)


@query(
    "a01_capped_scan_flags",
    """SELECT count(*) AS n_rows, 11::BIGINT AS n_cols, count(*) > 500 AS rows_truncated, true AS cols_truncated
       FROM lineitem""",
)
def _(spark, d):
    return T.capped_scan_flags(table(spark, d, "lineitem"), max_rows=500, max_cols=5)


@query(
    "a02_whole_text_scan",
    "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1",
)
def _(spark, d):
    path = shared_dir(spark)
    T.write_texts(table(spark, d, "documents"), "text", path)
    texts = T.written_text(T.read_whole_texts(spark, path))
    return texts.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


_EXTS = "['.pdf','.DOCX','.html','.xlsx','.csv','.pptx','.zip','.ipynb','','.odp','.tar.gz','.rst']"


@query(
    "a03_source_routing",
    f"""WITH p AS (
          SELECT url AS path FROM pages UNION ALL
          SELECT '/data/' || source || '/file.' || doc_id || ({_EXTS})[CAST(doc_id % 12 AS INT) + 1] FROM documents),
        e AS (SELECT path, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS ext FROM p),
        k AS (SELECT path, CASE
          WHEN lower(path) LIKE 'http://%' OR lower(path) LIKE 'https://%' THEN 'web'
          WHEN ext = '.pdf' THEN 'pdf'
          WHEN ext IN ('.docx','.doc','.docm','.odt','.rtf','.epub','.html','.htm','.ipynb','.tex','.latex',
                       '.rst','.org','.typ') THEN 'doc'
          WHEN ext IN ('.xlsx','.xlsm','.xls','.xlsb','.ods','.csv') THEN 'excel'
          WHEN ext IN ('.pptx','.pptm','.ppsx','.ppsm','.ppt','.pps','.pot','.odp') THEN 'ppt' END AS source_type
          FROM e)
        SELECT path, source_type, CASE WHEN source_type IS NULL THEN
          'Cannot detect source type for ' || path || '. Provide sourceType explicitly.' END AS error FROM k""",
)
def _(spark, d):
    exts = F.expr(f"array({_EXTS[1:-1]})")
    files = table(spark, d, "documents").select(
        F.concat(
            F.lit("/data/"), "source", F.lit("/file."), "doc_id",
            F.element_at(exts, (F.col("doc_id") % 12).cast("int") + 1),
        ).alias("path")
    )
    urls = table(spark, d, "pages").select(F.col("url").alias("path"))
    return T.route_sources(urls.unionByName(files), "path")


@query(
    "a04_directory_batch",
    r"""SELECT md5(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'),
              '\n{3,}', E'\n\n', 'g')) AS text_md5, count(*) AS n FROM documents GROUP BY 1""",
)
def _(spark, d):
    path = shared_dir(spark)
    T.write_texts(table(spark, d, "documents"), "text", path)
    texts = T.written_text(T.read_directory(spark, path, "*.txt"))
    clean = X.collapse_newlines(X.strip_control(F.col("text")))
    return texts.groupBy(F.md5(clean).alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a05_url_list",
    r"""WITH l AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '  ' || url || E' \t' WHEN 1 THEN '# ' || url
              WHEN 2 THEN '   ' WHEN 3 THEN replace(url, 'http', 'ftp') WHEN 4 THEN 'http:///' || url
              ELSE upper(url) END AS line FROM pages),
            u AS (SELECT page_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS url FROM l)
       SELECT page_id, url,
              starts_with(lower(url), 'http') AND regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#]') AS valid
       FROM u WHERE url <> '' AND NOT starts_with(url, '#')""",
)
def _(spark, d):
    k, url = F.col("page_id") % 6, F.col("url")
    line = (
        F.when(k == 0, F.concat(F.lit("  "), url, F.lit(" \t")))
        .when(k == 1, F.concat(F.lit("# "), url))
        .when(k == 2, F.lit("   "))
        .when(k == 3, F.replace(url, F.lit("http"), F.lit("ftp")))
        .when(k == 4, F.concat(F.lit("http:///"), url))
        .otherwise(F.upper(url))
    )
    lines = table(spark, d, "pages").select("page_id", line.alias("line"))
    return T.clean_url_list(lines, "line").select("page_id", "url", "valid")


@query(
    "a06_charset_decode",
    """SELECT page_id, md5(html) AS text_md5, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig'
              WHEN 2 THEN CASE WHEN regexp_matches(html, '[^\\x00-\\x{FF}]') THEN 'utf-8' ELSE 'iso8859-1' END
              ELSE 'gb18030' END AS encoding FROM pages""",
)
def _(spark, d):
    k, html = F.col("page_id") % 4, F.col("html")
    latin = decode.encode_text(html, "latin-1")
    utf8 = F.encode(html, "utf-8")
    encoded = table(spark, d, "pages").select(
        "page_id", k.alias("k"), utf8.alias("utf8"), latin.alias("latin"),
        decode.encode_text(html, "gb18030").alias("gb"),
    )
    raw = (
        F.when(F.col("k") == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.col("utf8")))
        .when((F.col("k") == 2) & F.col("latin").isNotNull(), F.col("latin"))
        .when(F.col("k") == 3, F.col("gb"))
        .otherwise(F.col("utf8"))
    )
    head = (
        F.when((F.col("k") == 2) & F.col("latin").isNotNull(), F.lit("text/html; charset=ISO-8859-1"))
        .when(F.col("k") == 3, F.lit('text/html; charset="GB18030"'))
        .when(F.col("k") == 1, F.lit("text/html"))
    )
    got = encoded.select("page_id", decode.decode_bytes(raw, head).alias("r"))
    return got.select("page_id", F.md5("r.text").alias("text_md5"), "r.encoding")


@query(
    "a07_decode_quality",
    """WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN 'Ã© â€™ â€œ' || chr(1) WHEN 1 THEN 'x' || chr(65533)
                   WHEN 2 THEN '鍦锟 Â' || chr(9) ELSE '' END AS text FROM documents),
            m AS (SELECT unnest([chr(65533), '锟', 'Ã', 'Â', 'â€', 'â€™', 'â€œ', 'â€' || chr(157), '琚', '佸', '鍦', '涓',
                   '鏄', '寤', '骞', '鏈', '鏃', '鈥']) AS mark)
       SELECT doc_id, CAST(sum((length(text) - length(replace(text, mark, ''))) // length(mark)) * 20
              + any_value(len(regexp_extract_all(text, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]'))) * 10
              + any_value(length(text) - length(replace(text, chr(65533), ''))) * 50 AS BIGINT) AS score
       FROM t, m GROUP BY doc_id""",
)
def _(spark, d):
    k = F.col("doc_id") % 4
    tail = (
        F.when(k == 0, F.lit("Ã© â€™ â€œ\x01"))
        .when(k == 1, F.lit("x�"))
        .when(k == 2, F.lit("鍦锟 Â\t"))
        .otherwise(F.lit(""))
    )
    return table(spark, d, "documents").select(
        "doc_id", X.decode_quality_score(F.concat("text", tail)).alias("score")
    )


@query(
    "a08_json_safe_orders",
    """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_totalprice":'
              || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) || ',"o_orderdate":"'
              || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","o_orderpriority":"' || o_orderpriority || '"}' AS json
       FROM orders""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
        "o_orderdate", "o_orderpriority",
    )
    return export.to_json_rows(rows, ["o_orderkey"])


@query(
    "a08_json_safe_blobs",
    """SELECT event_id, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
              || CASE WHEN extract(microsecond FROM ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END
              || '","props":{"type":"blob","length":' || strlen(props) || ',"base64":"' || base64(props::BLOB) || '"}}' AS json
       FROM events""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", F.col("props").cast("binary").alias("props"))
    return export.to_json_rows(rows, ["event_id"])


@query(
    "a10_outcome_report",
    """WITH r AS (SELECT url, starts_with(url, 'https://') AS ok, 'HTTP ' || (400 + page_id % 100) AS error FROM pages)
       SELECT 'summary' AS kind, 'Success: ' || count_if(ok) || '/' || count(*) || ', Failed: ' || count_if(NOT ok) AS line
       FROM r UNION ALL SELECT 'failed', '- ' || url || ': ' || error FROM r WHERE NOT ok""",
)
def _(spark, d):
    results = table(spark, d, "pages").select(
        "url", F.col("url").startswith("https://").alias("ok"),
        F.concat(F.lit("HTTP "), 400 + F.col("page_id") % 100).alias("error"),
    )
    return export.outcome_report(results, "url", "ok", "error")
