"""Registered queries of the subpackage: thin bindings of the operators to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, collocations, contamination, exact, jaccard, kneser_ney, licences, lines, packing, records, repeats, toxicity, urls

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """File of a public tokenizer; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_OP1 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op1_exact_dedup", _OP1)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


_OP3 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, least(i + 12, len(w))), ' ') AS g, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (g, n)), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op3_decontamination", _OP3)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op8_token_records")
def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as records and read back."""
    return records.roundtrip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney scores of all documents, from six of seven of them."""
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()))
    return kneser_ney.score(docs, model).select(
        "doc_id", kneser_ney.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine of ten three-word shingles."""
    return jaccard.near_groups(table(spark, sf_dir, "documents"), words=3, num=90)


_OP10 = r"""
WITH p AS (
  SELECT page_id, url, CAST(page_id % 366 AS INT) AS day,
         regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '^www\.', ''), '\.+$', '') AS host,
         regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages
), h AS (
  SELECT host, min(page_id) AS first, min(string_split(path, '/')[2]) AS part FROM p WHERE host <> '' GROUP BY host
), e AS (
  SELECT host AS pattern, CAST(first % 200 AS INT) AS day, 1 AS r FROM h WHERE first % 2 = 0
  UNION ALL SELECT host, CAST(first % 200 AS INT) + 60, 0 FROM h WHERE first % 4 = 0
  UNION ALL SELECT host, CAST(first % 200 AS INT) + 120, 1 FROM h WHERE first % 8 = 0
  UNION ALL SELECT host || '/' || part, 30, 2 FROM h WHERE first % 3 = 0 AND part <> ''
), k AS (
  SELECT page_id, day, array_to_string(list_slice(l, i, len(l)), '.') AS pattern
  FROM (SELECT page_id, day, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, day, string_split(host, '.') AS l FROM p WHERE host <> ''))
  UNION SELECT page_id, day, host || '/' || array_to_string(list_slice(l, 2, i), '/')
  FROM (SELECT page_id, day, host, l, unnest(range(2, len(l) + 1)) AS i FROM (SELECT page_id, day, host, string_split(path, '/') AS l FROM p WHERE host <> ''))
), state AS (
  SELECT k.page_id, k.pattern, arg_max(r, e.day * 10 + r) AS r FROM k JOIN e ON e.pattern = k.pattern AND e.day <= k.day GROUP BY ALL
), best AS (
  SELECT page_id, count(*) AS n_active, arg_max(r, (length(pattern), pattern)) AS r, arg_max(pattern, (length(pattern), pattern)) AS matched
  FROM state WHERE r > 0 GROUP BY page_id
)
SELECT page_id, url, p.day, CASE r WHEN 2 THEN 'allow' WHEN 1 THEN 'block' ELSE 'none' END AS verdict, matched, coalesce(n_active, 0) AS n_active
FROM p LEFT JOIN best USING (page_id)
"""


@query("op10_url_filters", _OP10)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active on its fetch day (day of a year, from the page id)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 366).cast("int").alias("day"))
    return urls.url_verdicts(pages, urls.site_history(pages))


_T = ", ".join(f"({i}, '{name}', '{text.lower()}')" for i, (name, text) in enumerate(licences.TEMPLATES))
_OP5 = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN doc_id % 1000 = 0 THEN source || '/LICENSE-' || doc_id
         WHEN doc_id % 100 = 0 THEN source || '/' || (doc_id // 100 % 10) || '/LICENSE-' || doc_id
         WHEN doc_id % 10 = 0 THEN source || '/' || (doc_id // 100 % 10) || '/' || (doc_id // 10 % 10) || '/LICENSE-' || doc_id
         ELSE source || '/' || (doc_id // 100 % 10) || '/' || (doc_id // 10 % 10) || '/f-' || doc_id END AS path,
         doc_id % 10 = 0 AS is_license_file, coalesce(text, '') AS text FROM documents
), l0 AS (
  SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM d)
), w AS (
  SELECT doc_id, no, term, count(*) AS tf FROM (
    SELECT doc_id, no, unnest(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM l0
  ) GROUP BY ALL
), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, no FROM w)), t AS (
  SELECT i, name, term, count(*) AS tf FROM (
    SELECT i, name, unnest(list_filter(regexp_split_to_array(text, '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM (VALUES {_T}) AS v(i, name, text)
  ) GROUP BY ALL
), idf AS (
  SELECT term, ln((any_value(n.n) + 1) / (count(w.term) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM t) LEFT JOIN w USING (term), n GROUP BY term
), tv AS (
  SELECT i, name, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY i)) AS x FROM t JOIN idf USING (term)
), wv AS (
  SELECT doc_id, no, term, tf * coalesce(idf, ln(n.n + 1) + 1) AS x FROM w LEFT JOIN idf USING (term), n
), norm AS (SELECT doc_id, no, sqrt(sum(x * x)) AS norm FROM wv GROUP BY ALL), c AS (
  SELECT doc_id, name, round(sum(wv.x * tv.x) / any_value(norm), 6) AS cosine FROM wv JOIN tv USING (term) JOIN norm USING (doc_id, no) GROUP BY doc_id, no, i, name
), own AS (
  SELECT doc_id, max(cosine) AS cosine, arg_max(name, (cosine, name)) AS license FROM c WHERE cosine >= {licences.THRESHOLD} GROUP BY doc_id
), f AS (SELECT doc_id, path, is_license_file, license, cosine, regexp_replace(path, '/?[^/]*$', '') AS folder FROM d LEFT JOIN own USING (doc_id)), g AS (
  SELECT folder, arg_max(license, (cosine, license)) AS given FROM f WHERE is_license_file AND license IS NOT NULL GROUP BY folder
), up AS (
  SELECT doc_id, arg_max(folder, depth) AS inherited_from, arg_max(given, depth) AS given FROM (
    SELECT doc_id, i AS depth, array_to_string(list_slice(p, 1, i), '/') AS folder
    FROM (SELECT doc_id, p, unnest(range(0, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(folder, '/') AS p FROM f WHERE license IS NULL))
  ) JOIN g USING (folder) GROUP BY doc_id
)
SELECT doc_id, path, license, cosine, coalesce(license, given) AS effective, inherited_from FROM f LEFT JOIN up USING (doc_id)
"""


def file_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a folder a source, then two levels by the id; ids ending in 0 are licence files of their level."""
    a, b = (F.floor(F.col("doc_id") / n) % 10 for n in (100, 10))
    ends = lambda n: F.col("doc_id") % n == 0
    name = F.concat(F.lit("LICENSE-"), "doc_id")
    return docs.select(
        "doc_id", "text", ends(10).alias("is_license_file"),
        F.when(ends(1000), F.concat_ws("/", "source", name)).when(ends(100), F.concat_ws("/", "source", a, name))
        .when(ends(10), F.concat_ws("/", "source", a, b, name))
        .otherwise(F.concat_ws("/", "source", a, b, F.concat(F.lit("f-"), "doc_id"))).alias("path"),
    )


@query("op5_license_scan", _OP5)
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files of a tree."""
    files = file_paths(table(spark, sf_dir, "documents"))
    named = licences.declared(files, keep=("path", "is_license_file"))
    return licences.inherit(named).select("doc_id", "path", "license", "cosine", "effective", "inherited_from")


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line, exactly or with at most two edits."""
    return lines.repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped")
    )


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP11 = rf"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang), g AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS s(m) WHERE len(w) >= m)
), f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2
), cut AS (
  SELECT lang, m, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS pl, array_to_string(list_slice(w, k + 1, m), ' ') AS pr
  FROM c, (VALUES (1), (2)) AS s(k) WHERE k < m
), s AS (
  SELECT cut.*, fl.f AS l, fr.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
  FROM cut JOIN f AS fl ON fl.lang = cut.lang AND fl.phrase = pl JOIN f AS fr ON fr.lang = cut.lang AND fr.phrase = pr
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1), inn AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(list_slice(w, 1, 2), ' ') AS phrase FROM c WHERE m = 3
    UNION ALL SELECT lang, a, array_to_string(list_slice(w, 2, 3), ' ') FROM c WHERE m = 3
  ) GROUP BY ALL
), kept AS (SELECT best.* FROM best LEFT JOIN inn USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_collocations", _OP11)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words that belong together, language by language, over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _op12() -> str:
    """Six rounds over the parts of all vectors, each one step of the statement."""
    steps = ["""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT row, part, list_slice(e, part * len(e) // 8 + 1, (part + 1) * len(e) // 8) AS v FROM v, range(8) AS s(part)
), b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM x WHERE row <= 16)"""]
    near = """a{i} AS MATERIALIZED (
  SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT row, x.part, entry, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d FROM x JOIN b{i} AS b ON b.part = x.part
  ) GROUP BY ALL
)"""
    mean = """b{j} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{i} AS b LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT part, entry, i, sum(c) AS s, count(*) AS n
      FROM (SELECT part, entry, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS c FROM x JOIN a{i} USING (row, part)) GROUP BY ALL
    ) GROUP BY ALL
  ) AS m USING (part, entry)
)"""
    for i in range(6):
        steps += [near.format(i=i), mean.format(i=i, j=i + 1)]
    steps.append(near.format(i=6))
    return ", ".join(steps) + """, o AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b6) AS codebooks_sha256
FROM o JOIN v USING (row)
"""


@query("op12_vector_codes", _op12())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by eight codebooks of sixteen entries."""
    return codebooks.encode(table(spark, sf_dir, "embeddings"))[0]


_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS MATERIALIZED (
  SELECT row, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)), gone AS (
  SELECT row, list(DISTINCT p) AS p FROM (SELECT row, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > first) GROUP BY row
), kept AS (
  SELECT row, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT row, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d) LEFT JOIN gone USING (row)
  WHERE p IS NULL OR NOT list_contains(p, i) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (row) LEFT JOIN kept USING (row)
"""


@query("op13_substring_dedup", _OP13)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of thirteen words or more that an earlier document has."""
    return repeats.drop_repeats(table(spark, sf_dir, "documents"), with_text=False)
