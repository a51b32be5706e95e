"""Section G: matching, licensing and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import licensing as L
from ..functions import queries as Q
from ..operators import match as M
from ..ordering import number_within
from .registry import query, table

# ---- titles --------------------------------------------------------------


def stems(spark, d):
    """One file stem per part; numbers above 999 share their first digits."""
    return table(spark, d, "part").select(
        "p_partkey", "p_name",
        F.concat(F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")),
                 F.lit("-"), F.substring("p_brand", 7, 5)).alias("stem"))


_STEMS = """st AS (SELECT p_partkey AS k, p_name, lpad(p_partkey::VARCHAR, 4, '0') || '_' || replace(p_name, ' ', '_') || '-' || substr(p_brand, 7) AS stem FROM part)"""
_TITLE = """CASE k % 6 WHEN 0 THEN stem WHEN 1 THEN upper(replace(replace(stem, '_', ' '), '-', ' : ')) || ' ' WHEN 2 THEN 'Slide ' || k || ' x'
   WHEN 3 THEN substr(stem, 3, 9) WHEN 4 THEN p_name WHEN 5 THEN '第' || k || '页' END"""


def titles(spark, d):
    expr = _TITLE.replace("k %", "p_partkey %").replace("|| k ||", "|| p_partkey ||")
    return stems(spark, d).select("p_partkey", F.expr(expr).alias("title"))


_NORM = "trim(regexp_replace(lower(regexp_replace({c}, '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g')), '_+', '_', 'g'), '_')"
_NUM = """TRY_CAST(coalesce(nullif(regexp_extract({c}, '^\\s*(\\d{{1,3}})', 1), ''),
   nullif(regexp_extract(lower({c}), '^\\s*(?:slide|page|p)\\s*[-_:]?\\s*(\\d{{1,3}})', 1), ''),
   nullif(regexp_extract({c}, '^\\s*第\\s*(\\d{{1,3}})\\s*[页张]', 1), '')) AS INTEGER)"""


@query(
    "g01_title_match",
    f"""WITH {_STEMS}, t AS (SELECT k, {_TITLE} AS title FROM st),
        s AS (SELECT DISTINCT stem, {_NORM.format(c='stem')} AS norm, {_NUM.format(c='stem')} AS num FROM st),
        q AS (SELECT DISTINCT title, {_NORM.format(c='title')} AS norm, {_NUM.format(c='title')} AS num FROM t),
        n AS (SELECT norm, min(stem) AS stem FROM s GROUP BY 1 HAVING count(*) = 1),
        m AS (SELECT num, min(stem) AS stem FROM s WHERE num IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
        c AS (SELECT q.title, min(s.stem) AS stem FROM q JOIN s ON q.norm <> '' AND contains(s.norm, q.norm) GROUP BY 1 HAVING count(*) = 1)
        SELECT k AS p_partkey, title, coalesce((SELECT min(stem) FROM s WHERE s.stem = t.title), n.stem, m.stem, c.stem) AS stem
        FROM t JOIN q USING (title) LEFT JOIN n ON n.norm = q.norm LEFT JOIN m ON m.num = q.num LEFT JOIN c USING (title)""",
)
def _(spark, d):
    asked = titles(spark, d)
    found = M.match_titles(asked.select("title"), stems(spark, d).select("stem"))
    return asked.join(found, "title").select("p_partkey", "title", "stem")


@query(
    "g02_title_normalise",
    f"""WITH {_STEMS}, t AS (SELECT k, {_TITLE} AS title FROM st)
        SELECT k AS p_partkey, title, {_NORM.format(c='title')} AS norm, {_NUM.format(c='title')} AS num FROM t""",
)
def _(spark, d):
    t = F.col("title")
    return titles(spark, d).select("p_partkey", "title", M.normalize_title(t).alias("norm"), M.leading_number(t).alias("num"))


# ---- hash then position --------------------------------------------------


@query(
    "g03_hash_position_match",
    """WITH a AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, md5(substr(lang, 1, 1) || n_chars % 40) AS sha, doc_id AS d FROM documents),
       o AS (SELECT doc_id, max(idx) OVER (PARTITION BY doc_id) - idx AS idx, CASE WHEN d % 5 = 0 THEN NULL WHEN d % 7 = 0 THEN 'x' ELSE sha END AS sha FROM a),
       an AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha ORDER BY idx) AS rn FROM a),
       ob AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha ORDER BY idx) AS rn FROM o WHERE sha IS NOT NULL),
       h AS (SELECT an.doc_id, an.idx, ob.idx AS oi FROM an LEFT JOIN ob ON ob.doc_id = an.doc_id AND ob.sha = an.sha AND ob.rn = an.rn),
       fr AS (SELECT doc_id, idx FROM o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = o.doc_id AND h.oi = o.idx))
       SELECT h.doc_id, h.idx, coalesce(h.oi, fr.idx) AS occurrence, CASE WHEN h.oi IS NOT NULL THEN 'hash' WHEN fr.idx IS NOT NULL THEN 'position' END AS matched_by
       FROM h LEFT JOIN fr ON fr.doc_id = h.doc_id AND fr.idx = h.idx""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(
        "source", "doc_id", F.md5(F.concat(F.substring("lang", 1, 1), F.col("n_chars") % 40)).alias("sha"))
    n = number_within(docs, ["source"], ["doc_id"], "n")
    assets = n.select(F.col("source").alias("doc_id"), (F.col("n") - 1).alias("idx"), "sha", F.col("doc_id").alias("d"))
    size = assets.groupBy("doc_id").agg(F.max("idx").alias("_m"))
    k = F.col("d")
    occ = assets.join(size, "doc_id").select(
        "doc_id", (F.col("_m") - F.col("idx")).alias("idx"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("x")).otherwise(F.col("sha")).alias("sha"))
    return M.match_occurrences(assets.select("doc_id", "idx", "sha"), occ)


# ---- licences ------------------------------------------------------------

_NAMES = ["CC0", "cc by 4.0", " CC-BY-SA 3.0 ", "cc by-nc 2.0", "Public domain ", "Pexels License", "pixabay",
          "All rights reserved", "", "PDM", "cc  by sa", "CC BY ND 4.0", "Pexels", "MIT"]
_URLS = ["", "https://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/publicdomain/zero/1.0/", "https://x.org/by-nd"]
_PROVIDERS = ["openverse", "wikimedia", "pexels", "pixabay", ""]


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def _pick_sql(values, key):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({key} % {len(values)} AS INT) + 1]"


_LIC_LINE = r"(Released under the MIT License\.|Licensed under [^\n]*|This work is licensed under [^\n]*)"


def candidates(spark, d):
    """One candidate per document; its license line, or one of a fixed cycle."""
    k = F.col("doc_id")
    line = F.nullif(F.regexp_extract("text", _LIC_LINE, 1), F.lit(""))
    return table(spark, d, "documents").select(
        k.alias("cand_id"), _pick(_PROVIDERS, F.floor(k / 3)).alias("provider"), F.col("text").alias("title"),
        F.when(k % 4 != 0, F.col("source")).otherwise(F.lit("")).alias("author"),
        F.when(k % 3 != 0, F.concat(F.lit("https://img.example.org/"), "lang", F.lit("/bus-"), k)).otherwise(F.lit("")).alias("url"),
        F.coalesce(line, _pick(_NAMES, k)).alias("license_name"), _pick(_URLS, F.floor(k / 2)).alias("license_url"),
        (F.col("n_chars") % 2000).alias("width"), (k * 37 % 1500).alias("height"))


_CAND = f"""ca AS (SELECT doc_id AS cand_id, {_pick_sql(_PROVIDERS, '(doc_id // 3)')} AS provider, text AS title,
   CASE WHEN doc_id % 4 <> 0 THEN source ELSE '' END AS author,
   CASE WHEN doc_id % 3 <> 0 THEN 'https://img.example.org/' || lang || '/bus-' || doc_id ELSE '' END AS url,
   coalesce(nullif(regexp_extract(text, '{_LIC_LINE}', 1), ''), {_pick_sql(_NAMES, 'doc_id')}) AS license_name,
   {_pick_sql(_URLS, '(doc_id // 2)')} AS license_url, n_chars % 2000 AS width, doc_id * 37 % 1500 AS height FROM documents)"""
_TIERED = """ti AS (SELECT *, lower(trim(trim(license_name) || ' ' || license_url)) AS lt FROM ca),
  tier AS (SELECT * EXCLUDE (lt), CASE
    WHEN regexp_matches(lt, 'by-nc|by nc|noncommercial|non-commercial|by-nd|by nd|no derivatives|noderivatives|all rights reserved') THEN NULL
    WHEN regexp_matches(lt, 'cc0|public domain|publicdomain|pexels license|pixabay content license|pixabay license') THEN 'no-attribution'
    WHEN provider IN ('pexels', 'pixabay') AND contains(lt, provider) AND NOT regexp_matches(lt, 'cc by|cc-by|by-sa|by sa|creativecommons.org/licenses/by/|creativecommons.org/licenses/by-sa/') THEN 'no-attribution'
    WHEN regexp_matches(lt, 'cc by|cc-by|by-sa|by sa|creativecommons.org/licenses/by/|creativecommons.org/licenses/by-sa/') THEN 'attribution-required' END AS tier FROM ti)"""


@query(
    "g04_license_name",
    f"""WITH {_CAND}, k AS (SELECT cand_id, trim(license_name) AS t, lower(trim(license_name)) AS k FROM ca)
        SELECT cand_id, CASE k WHEN 'cc0' THEN 'CC0' WHEN 'cc 0' THEN 'CC0' WHEN 'public domain' THEN 'Public Domain' WHEN 'publicdomain' THEN 'Public Domain'
          WHEN 'pdm' THEN 'Public Domain' WHEN 'pexels license' THEN 'Pexels License' WHEN 'pixabay license' THEN 'Pixabay Content License'
          WHEN 'pixabay content license' THEN 'Pixabay Content License'
          ELSE CASE WHEN regexp_matches(k, '^cc[\\s-]+by([\\s-]+(sa|nc|nd))*\\s*[0-9.]*$') THEN
            trim('CC ' || upper(replace(regexp_extract(k, '^cc[\\s-]+(by([\\s-]+(sa|nc|nd))*)', 1), ' ', '-')) || ' ' || regexp_extract(k, '([0-9.]*)$', 1))
          ELSE t END END AS license FROM k""",
)
def _(spark, d):
    return candidates(spark, d).select("cand_id", L.license_name(F.col("license_name")).alias("license"))


@query("g05_license_tier", f"WITH {_CAND}, {_TIERED} SELECT cand_id, tier FROM tier")
def _(spark, d):
    return candidates(spark, d).select(
        "cand_id", L.license_tier(F.col("license_name"), F.col("license_url"), F.col("provider")).alias("tier"))


# ---- queries -------------------------------------------------------------

_QUERIES = ["{t}", "Professional {t}, (see note) #fff012 photo", "with the {t}", "ai tool", "using this from that", "{t} \"modern\" [light] system design",
            "red ring 山水 café", "{t} by the station"]


def request_queries(spark, d):
    """One query per part, plain and decorated."""
    k = F.col("p_partkey") % len(_QUERIES)
    q = F.when(F.lit(False), F.lit(""))
    for i, tpl in enumerate(_QUERIES):
        q = q.when(k == i, F.replace(F.lit(tpl), F.lit("{t}"), F.col("p_name")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("req_id"), q.alias("query"), "p_size")


_REQ = "rq AS (SELECT p_partkey AS req_id, p_size, CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN replace('{t}', '{{t}}', p_name)" for i, t in enumerate(_QUERIES)) + " END AS query FROM part)"
_HARD = "['" + "','".join(Q.NOISE_WORDS) + "']"
_SOFT = "['" + "','".join(Q.SOFT_NOISE_WORDS) + "']"
_WORDS_SQL = """list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({q}, '#[0-9a-fA-F]{{3,8}}', '', 'g'), '\\([^)]*\\)', '', 'g'), '\\s+'),
   lambda w: trim(w, '.,;:!?"''()[]{{}}，。；：！？、')), lambda w: length(w) > 2)"""
_KEPT = f"""wd AS (SELECT req_id, p_size, query, {_WORDS_SQL.format(q='query')} AS w, list_filter({_WORDS_SQL.format(q='lower(query)')}, lambda w: length(w) = strlen(w)) AS lw FROM rq),
  hd AS (SELECT *, list_filter(w, lambda x: NOT list_contains({_HARD}, lower(x))) AS h, list_filter(lw, lambda x: NOT list_contains({_HARD}, x)) AS lh FROM wd),
  sf AS (SELECT *, list_filter(h, lambda x: NOT list_contains({_SOFT}, lower(x))) AS s, list_filter(lh, lambda x: NOT list_contains({_SOFT}, x)) AS ls FROM hd),
  kp AS (SELECT req_id, p_size, query, CASE WHEN len(s) > 0 THEN s ELSE h END AS kept, CASE WHEN len(ls) > 0 THEN ls ELSE lh END AS tokens FROM sf)"""


def _simple_sql(n):
    return f"CASE WHEN len(kept) > 0 THEN array_to_string(kept[1:{n}], ' ') ELSE trim(query) END"


@query(
    "g06_query_simplify",
    f"""WITH {_REQ}, {_KEPT} SELECT req_id, query, {_simple_sql(4)} AS simple, array_to_string(tokens, ' ') AS tokens FROM kp""",
)
def _(spark, d):
    q = F.col("query")
    return request_queries(spark, d).select(
        "req_id", "query", Q.simplify_query(q, 4).alias("simple"), F.array_join(Q.query_tokens(q), " ").alias("tokens"))


@query(
    "g07_query_progression",
    f"""WITH {_REQ}, {_KEPT}, f AS (SELECT req_id, unnest([trim(query), {_simple_sql(4)}, {_simple_sql(3)}, {_simple_sql(2)}, {_simple_sql(1)}]) AS q,
          unnest(range(5)) AS i FROM kp), u AS (SELECT req_id, q, min(i) AS i FROM f WHERE q <> '' GROUP BY ALL)
        SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY i) - 1 AS step, q AS query FROM u""",
)
def _(spark, d):
    return request_queries(spark, d).select("req_id", F.posexplode(Q.query_progression(F.col("query"))).alias("step", "q")).select(
        "req_id", F.col("step").cast("long").alias("step"), F.col("q").alias("query"))


def fetched(spark, d):
    """Candidates with the request that fetched them: the one of their number, wrapping round the parts."""
    n = table(spark, d, "part").agg(F.count(F.lit(1)).alias("_n"))
    # one row, known as such by its aggregate
    return candidates(spark, d).crossJoin(F.broadcast(n)).withColumn("req_id", F.col("cand_id") % F.col("_n")).drop("_n")


def scored_pairs(spark, d):
    return fetched(spark, d).join(request_queries(spark, d), "req_id")


_PAIRS = "pr AS (SELECT c.*, q.req_id, q.p_size, q.query, q.tokens FROM tier c JOIN kp q ON q.req_id = c.cand_id % (SELECT count(*) FROM part))"
_TEXT_SQL = "lower(concat_ws(' ', nullif(title, ''), nullif(author, ''), nullif(url, '')))"
_REL_SQL = """CASE WHEN len(tokens) = 0 THEN 1.0 WHEN txt = '' THEN 0.0 ELSE len(list_filter(tokens, lambda t: contains(txt, t))) / len(tokens) END"""


@query(
    "g08_term_relevance",
    f"""WITH {_CAND}, {_TIERED}, {_REQ}, {_KEPT}, {_PAIRS}, x AS (SELECT *, {_TEXT_SQL} AS txt FROM pr)
        SELECT cand_id, req_id, round(({_REL_SQL})::DOUBLE, 6) AS relevance FROM x""",
)
def _(spark, d):
    text = Q.candidate_text(F.col("title"), F.col("author"), F.col("url"))
    return scored_pairs(spark, d).select(
        "cand_id", "req_id", F.round(Q.relevance(Q.query_tokens(F.col("query")), text), 6).alias("relevance"))


_TERMS = ["the", "red_ring|ou, IN G", "zz|  ", " , |", "en,de ,Ös", "img.example|thth", ""]


def _terms(key):
    return Q.required_terms(_pick(_TERMS, key))


_COMPACT = """replace(trim(regexp_replace(lower({c}), '[\\s\\-_./:;,''"()\\[\\]{{}}]+', ' ', 'g')), ' ', '')"""
_TERMS_SQL = f"list_filter(list_transform(string_split({_pick_sql(_TERMS, '{k}')}, ','), lambda x: trim(x)), lambda x: x <> '')"
_MISS_SQL = f"""list_filter(@t, lambda g: len(list_filter(string_split(g, '|'), lambda a: {_COMPACT.format(c='a')} <> '')) > 0
   AND len(list_filter(string_split(g, '|'), lambda a: {_COMPACT.format(c='a')} <> '' AND contains(@b, {_COMPACT.format(c='a')}))) = 0)"""


def _miss(t, b):
    return _MISS_SQL.replace("@t", t).replace("@b", b)



@query(
    "g09_required_terms",
    f"""WITH {_CAND}, x AS (SELECT cand_id, {_TERMS_SQL.format(k='cand_id')} AS terms, {_COMPACT.format(c=_TEXT_SQL)} AS body FROM ca)
        SELECT cand_id, array_to_string({_miss('terms', 'body')}, ';') AS missing FROM x""",
)
def _(spark, d):
    text = Q.candidate_text(F.col("title"), F.col("author"), F.col("url"))
    return candidates(spark, d).withColumn("body", Q.compact(text)).select(
        "cand_id", F.array_join(Q.missing_terms(_terms(F.col("cand_id")), F.col("body")), ";").alias("missing"))


_WANTED = ["landscape", "Portrait ", "", "square"]
_TRANSIT_SQL = "regexp_matches({c}, 'station|subway|metro|rail|transit|airport|bus|地铁|站|轨道')"
_SCORE_SQL = f"""({{rel}}) * 10000.0 + {{title}} * 1500.0
   - CASE WHEN NOT {_TRANSIT_SQL.format(c='lower(query)')} AND {_TRANSIT_SQL.format(c='txt')} THEN 5000 ELSE 0 END
   + CASE WHEN wanted = '' THEN 0 WHEN wanted = CASE WHEN width <= 0 OR height <= 0 THEN 'unknown' WHEN width > height THEN 'landscape'
       WHEN height > width THEN 'portrait' ELSE 'square' END THEN 1000 ELSE -250 END
   - CASE WHEN min_width > 0 AND width < min_width THEN 500 ELSE 0 END - CASE WHEN min_height > 0 AND height < min_height THEN 500 ELSE 0 END
   + CASE WHEN tier = 'no-attribution' THEN 250 ELSE 0 END + least(greatest(width, 0) * greatest(height, 0) / 1000.0, 1500)"""


@query(
    "g10_candidate_score",
    f"""WITH {_CAND}, {_TIERED}, {_REQ}, {_KEPT}, {_PAIRS}, x AS (SELECT *, {_TEXT_SQL} AS txt, lower(trim({_pick_sql(_WANTED, 'req_id')})) AS wanted,
          (p_size % 3) * 400 AS min_width, (p_size % 2) * 300 AS min_height, {_TERMS_SQL.format(k='(req_id // 2)')} AS terms FROM pr WHERE tier IS NOT NULL),
        y AS (SELECT *, {_COMPACT.format(c='txt')} AS body, {_COMPACT.format(c='title')} AS tbody, {_REL_SQL} AS rel FROM x),
        z AS (SELECT *, len(list_filter(terms, lambda g: len(list_filter(string_split(g, '|'), lambda a: {_COMPACT.format(c='a')} <> ''
                AND contains(tbody, {_COMPACT.format(c='a')}))) > 0)) AS th FROM y
              WHERE len({_miss('terms', 'body')}) = 0 AND (rel > 0 OR len(terms) > 0))
        SELECT cand_id, req_id, round(({_SCORE_SQL.format(rel='rel', title='th')})::DOUBLE, 4) AS score FROM z""",
)
def _(spark, d):
    text = Q.candidate_text(F.col("title"), F.col("author"), F.col("url"))
    df = scored_pairs(spark, d).withColumns({
        "text": text, "tier": L.license_tier(F.col("license_name"), F.col("license_url"), F.col("provider")),
        "terms": _terms(F.floor(F.col("req_id") / 2)), "wanted": _pick(_WANTED, F.col("req_id")),
        "title_body": Q.compact(F.col("title"))})
    df = df.withColumns({
        "rel": Q.relevance(Q.query_tokens(F.col("query")), F.col("text")), "body": Q.compact(F.col("text")),
        "alts": Q.alternatives(F.col("terms"))})
    ok = F.col("tier").isNotNull() & Q.gate_passes(F.col("alts"), F.col("body")) & (
        (F.col("rel") > 0) | (F.size("terms") > 0))
    penalty = ~Q.mentions_transit(F.lower("query")) & Q.mentions_transit(F.col("text"))
    score = Q.rank_score(
        F.col("rel"), Q.title_hits(F.col("alts"), F.col("title_body")), penalty, F.col("width"), F.col("height"), F.col("wanted"),
        F.col("p_size") % 3 * 400, F.col("p_size") % 2 * 300, F.col("tier"))
    return df.where(ok).select("cand_id", "req_id", F.round(score, 4).alias("score"))


def requests(spark, d):
    size = F.col("p_size")
    return request_queries(spark, d).select(
        "req_id", "query", _pick(_WANTED, size).alias("orientation"), (size % 3 * 400).alias("min_width"),
        (size % 2 * 300).alias("min_height"), _terms(size).alias("required"))


_RANKED = f"""r1 AS (SELECT *, {_TEXT_SQL} AS txt, lower(trim({_pick_sql(_WANTED, 'p_size')})) AS wanted, (p_size % 3) * 400 AS min_width,
     (p_size % 2) * 300 AS min_height, {_TERMS_SQL.format(k='p_size')} AS terms FROM pr WHERE tier IS NOT NULL),
  r2 AS (SELECT *, {_COMPACT.format(c='txt')} AS body, {_COMPACT.format(c='title')} AS tbody, {_REL_SQL} AS rel FROM r1),
  r3 AS (SELECT *, len(list_filter(terms, lambda g: len(list_filter(string_split(g, '|'), lambda a: {_COMPACT.format(c='a')} <> ''
           AND contains(tbody, {_COMPACT.format(c='a')}))) > 0)) AS th FROM r2
         WHERE len({_miss('terms', 'body')}) = 0 AND (rel > 0 OR len(terms) > 0)),
  r4 AS (SELECT req_id, cand_id, tier, round(({_SCORE_SQL.format(rel='rel', title='th')})::DOUBLE, 6) AS score FROM r3),
  ranked AS (SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, cand_id) AS rank, cand_id, round(score, 4) AS score
         FROM r4 QUALIFY rank <= 4)"""
_RANK_WITH = f"WITH {_CAND}, {_TIERED}, {_REQ}, {_KEPT}, {_PAIRS}, {_RANKED}"


@query("g11_ranked_top_n", f"{_RANK_WITH} SELECT * FROM ranked")
def _(spark, d):
    return M.rank_candidates(requests(spark, d), fetched(spark, d), 4).withColumn("score", F.round("score", 4))


@query(
    "g11_ranked_no_attribution",
    f"""{_RANK_WITH} SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, cand_id) AS rank, cand_id, round(score, 4) AS score
        FROM r4 WHERE tier = 'no-attribution' QUALIFY rank <= 2""",
)
def _(spark, d):
    return M.rank_candidates(requests(spark, d), fetched(spark, d), 2, strict_no_attribution=True).withColumn("score", F.round("score", 4))


@query(
    "g12_attribution_text",
    f"""WITH {_CAND} SELECT cand_id, concat_ws(' — ', CASE WHEN cand_id % 3 = 0 THEN 'f' || cand_id || '.jpg' WHEN cand_id % 3 = 1 THEN 'http://dl/' || cand_id ELSE 'image' END,
          concat_ws(' ', '"' || nullif(title, '') || '"', 'by ' || nullif(author, ''), 'via ' || CASE provider WHEN 'openverse' THEN 'Openverse'
            WHEN 'wikimedia' THEN 'Wikimedia Commons' WHEN 'pexels' THEN 'Pexels' WHEN 'pixabay' THEN 'Pixabay' ELSE 'unknown' END),
          CASE WHEN license_name <> '' AND license_url <> '' THEN 'license: ' || license_name || ' (' || license_url || ')'
               WHEN license_name <> '' OR license_url <> '' THEN 'license: ' || license_name || license_url END) AS credit FROM ca""",
)
def _(spark, d):
    k = F.col("cand_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("f"), k, F.lit(".jpg"))).otherwise(F.lit(""))
    dl = F.when(k % 3 == 1, F.concat(F.lit("http://dl/"), k)).otherwise(F.lit(""))
    return candidates(spark, d).select("cand_id", L.attribution_text(
        name, F.col("title"), F.col("author"), F.col("provider"), F.col("license_name"), F.col("license_url"), dl).alias("credit"))


@query(
    "g13_orientation_ratio",
    """WITH s AS (SELECT p_partkey, p_size % 7 * 100 AS w, p_partkey % 9 * 70 AS h FROM part)
       SELECT p_partkey, CASE WHEN w <= 0 OR h <= 0 THEN 'unknown' WHEN w > h THEN 'landscape' WHEN h > w THEN 'portrait' ELSE 'square' END AS orientation,
         CASE WHEN h = 0 THEN NULL WHEN w / h > 2.0 THEN 'Ultra-wide' WHEN w / h > 1.5 THEN 'Wide landscape' WHEN w / h > 1.2 THEN 'Standard landscape'
              WHEN w / h > 0.8 THEN 'Near square' ELSE 'Portrait' END AS ratio_class FROM s""",
)
def _(spark, d):
    w, h = F.col("p_size") % 7 * 100, F.col("p_partkey") % 9 * 70
    return table(spark, d, "part").select(
        "p_partkey", Q.orientation(w, h).alias("orientation"),
        F.when(h != 0, Q.ratio_class(F.try_divide(w.cast("double"), h.cast("double")))).alias("ratio_class"))


@query(
    "g14_layout_choice",
    """WITH s AS (SELECT p_partkey, 0.25 + p_size / 16.0::DOUBLE AS r, 800 + p_partkey % 500 AS w, 300 + p_size * 10 AS h FROM part),
       c AS (SELECT *, CAST(round_even(w / r, 0) AS BIGINT) AS th, CAST(round_even(h * r, 0) AS BIGINT) AS lw, CAST(round_even(w * 0.7::DOUBLE, 0) AS BIGINT) AS nw FROM s),
       k AS (SELECT *, CASE WHEN r > 1.5 AND h - th - 20 >= 150 THEN 1 WHEN r <= 1.5 AND w - lw - 20 >= 280 THEN 2 ELSE 3 END AS k FROM c)
       SELECT p_partkey, CASE k WHEN 1 THEN 'top-bottom' ELSE 'left-right' END AS layout_type, CASE k WHEN 1 THEN w WHEN 2 THEN lw ELSE nw END AS image_w,
         CASE k WHEN 1 THEN th WHEN 2 THEN h ELSE least(CAST(round_even(nw / r, 0) AS BIGINT), h) END AS image_h,
         CASE k WHEN 1 THEN w WHEN 2 THEN w - lw - 20 ELSE greatest(w - nw - 20, 280) END AS text_w,
         CASE k WHEN 1 THEN h - th - 20 ELSE h END::BIGINT AS text_h FROM k""",
)
def _(spark, d):
    box = M.layout_dimensions(F.lit(0.25) + F.col("p_size") / 16.0, 800 + F.col("p_partkey") % 500, 300 + F.col("p_size") * 10)
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


# ---- queue ---------------------------------------------------------------

_STATUS = ["Pending", "Sourced", "Failed", "Needs-Manual", "Pending"]


def queue_items(spark, d):
    k = F.col("req_id")
    return requests(spark, d).withColumns({
        "pos": k, "filename": F.concat(F.lit("img_"), k, F.lit(".png")), "status": _pick(_STATUS, k)})


@query(
    "g15_queue_errors",
    """WITH q AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_name || p_size % 5 END AS filename,
          CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS query, CASE p_partkey % 6 WHEN 0 THEN 'Done' WHEN 1 THEN '' ELSE 'Pending' END AS status FROM part),
       f AS (SELECT *, min(pos) OVER (PARTITION BY filename) AS first FROM q),
       e AS (SELECT pos, CASE WHEN trim(filename) = '' THEN 'field ''filename'' must be a non-empty string'
          WHEN query IS NULL THEN 'field ''query'' must be a non-empty string' WHEN status = '' THEN 'field ''status'' must be a non-empty string'
          WHEN status = 'Done' THEN 'status ''Done'' is invalid' WHEN pos > first THEN 'duplicate filename ''' || filename || '''' END AS error FROM f)
       SELECT * FROM e WHERE error IS NOT NULL""",
)
def _(spark, d):
    k = F.col("p_partkey")
    items = table(spark, d, "part").select(
        k.alias("pos"), F.when(k % 13 == 0, F.lit(" ")).otherwise(F.concat("p_name", F.col("p_size") % 5)).alias("filename"),
        F.when(k % 17 != 0, F.col("p_name")).alias("query"),
        F.when(k % 6 == 0, F.lit("Done")).when(k % 6 == 1, F.lit("")).otherwise(F.lit("Pending")).alias("status"))
    return M.queue_errors(items)


def _done(spark, d):
    items = queue_items(spark, d)
    work = items.where(F.col("status").isin(M.PENDING, M.FAILED))
    best = M.rank_candidates(work, fetched(spark, d), 1)
    return M.run_queue(items, best)


_DONE_SQL = f"""dn AS (SELECT q.req_id AS pos, 'img_' || q.req_id || '.png' AS filename, {_pick_sql(_STATUS, 'q.req_id')} AS old, r.cand_id
   FROM rq q LEFT JOIN ranked r ON r.req_id = q.req_id AND r.rank = 1),
  dq AS (SELECT pos, filename, CASE WHEN old NOT IN ('Pending', 'Failed') THEN old WHEN cand_id IS NULL THEN 'Needs-Manual' ELSE 'Sourced' END AS status,
   CASE WHEN old IN ('Pending', 'Failed') THEN cand_id END AS cand_id,
   CASE WHEN old IN ('Pending', 'Failed') AND cand_id IS NULL THEN 'search failed' END AS last_error, old NOT IN ('Pending', 'Failed') AS skipped FROM dn)"""


@query("g15_queue_run", f"{_RANK_WITH}, {_DONE_SQL} SELECT * FROM dq")
def _(spark, d):
    return _done(spark, d)


@query(
    "g15_queue_counts",
    f"""{_RANK_WITH}, {_DONE_SQL} SELECT count_if(NOT skipped AND status = 'Sourced')::BIGINT AS sourced,
        count_if(NOT skipped AND status = 'Needs-Manual')::BIGINT AS needs_manual, count_if(skipped)::BIGINT AS skipped FROM dq""",
)
def _(spark, d):
    return M.queue_counts(_done(spark, d))
