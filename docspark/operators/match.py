"""Title matching, asset matching, ranked retrieval and the request queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import broadcast_if_small, spread_if_few


def normalize_title(c: Column) -> Column:
    """Runs outside letters, digits and CJK become one underscore; lower case."""
    flat = F.regexp_replace(c, r"[^0-9A-Za-z\x{4e00}-\x{9fff}]+", "_")
    return F.lower(F.regexp_replace(F.regexp_replace(flat, r"_+", "_"), r"^_+|_+$", ""))


def leading_number(c: Column) -> Column:
    """Number at the start, after slide / page / p, or in the Chinese page form."""
    t = F.regexp_replace(c, r"^\s+", "")
    patterns = [r"^(\d{1,3})", r"(?i)^(?:slide|page|p)\s*[-_:]?\s*(\d{1,3})", r"^第\s*(\d{1,3})\s*[页张]"]
    hits = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*hits).cast("int")


def _unique(stems: DataFrame, key: str, out: str) -> DataFrame:
    """Keys that belong to exactly one stem."""
    return (
        stems.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("stem").alias(out))
        .where(F.col("_n") == 1).drop("_n")
    )


#: Characters of an index entry; shorter titles are looked up by entries of their own length.
GRAM = 4


def _entries(text: str, sizes: Column) -> Column:
    """array(struct(gram, at)): all pieces of the sizes in use, with their 0-based place; linear in the text."""
    none = F.array().cast("array<struct<gram:string,at:int>>")
    return F.flatten(F.array(*[
        F.when(F.array_contains(sizes, n), F.transform(
            F.regexp_extract_all(F.col(text), F.lit(f"(?=(.{{{n}}}))"), F.lit(1)),
            lambda g, i: F.struct(g.alias("gram"), i.alias("at")))).otherwise(none)
        for n in range(1, GRAM + 1)]))


def titles_inside(wanted: DataFrame, stems: DataFrame) -> DataFrame:
    """(sub, stem): each text of wanted(sub) with every stem of stems(stem, norm) whose norm contains it.

    An index of the stems' pieces of GRAM characters; a text is looked up by its rarest piece alone, and
    the places found are verified in the stem. A text that has a piece no stem has is dropped unseen. Index
    rows hold a hash of the stem instead of the stem, so they are as many as its characters and no wider.
    """
    size = F.least(F.length("sub"), F.lit(GRAM))
    sizes = wanted.agg(F.collect_set(size).alias("_sizes"))  # one row of at most GRAM numbers
    index = stems.join(F.broadcast(sizes), F.length("norm") > 0).select(
        F.xxhash64("stem").alias("_stem"), F.inline(_entries("norm", F.col("_sizes"))))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    asked = wanted.select("sub", F.inline(_entries("sub", F.array(size))).alias("gram", "_at"))
    anchors = (
        asked.join(often, "gram", "left").groupBy("sub")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_at").alias("at"), "gram")).alias("_a"))
        .where("_a.n > 0").select("sub", F.col("_a.at").alias("_at"), F.col("_a.gram").alias("gram"))
    )
    places = anchors.join(index, "gram").where("at >= _at").select("sub", "_stem", (F.col("at") - F.col("_at") + 1).alias("_from"))
    return places.join(stems.select("stem", "norm", F.xxhash64("stem").alias("_stem")), "_stem").where(
        F.substring(F.col("norm"), F.col("_from"), F.length("sub")) == F.col("sub")).select("sub", "stem").distinct()


def match_titles(titles: DataFrame, stems: DataFrame) -> DataFrame:
    """titles(title) to stems(stem): exact, unique normalised form, unique leading
    number, unique containment; a step with several hits falls through.

    Only titles left open by the first three steps are looked for inside stems.
    """
    stems = stems.select("stem").distinct().withColumns({
        "norm": F.nullif(normalize_title(F.col("stem")), F.lit("")), "num": leading_number(F.col("stem"))})
    asked = titles.select("title").distinct().withColumns({
        "_norm": normalize_title(F.col("title")), "_num": leading_number(F.col("title"))})
    steps = [
        (stems.select(F.col("stem").alias("_exact"), F.col("stem").alias("_k0")), F.col("title") == F.col("_k0")),
        (_unique(stems, "norm", "_by_norm"), F.col("_norm") == F.col("norm")),
        (_unique(stems, "num", "_by_num"), F.col("_num") == F.col("num")),
    ]
    for side, on in steps:
        asked = asked.join(broadcast_if_small(side), on, "left")
    asked = asked.select("title", "_norm", F.coalesce("_exact", "_by_norm", "_by_num").alias("_found"))
    wanted = asked.where(F.col("_found").isNull() & (F.col("_norm") != "")).select(F.col("_norm").alias("sub")).distinct()
    inside = _unique(titles_inside(wanted, stems.where(F.col("norm").isNotNull()).select("stem", "norm")), "sub", "_by_sub")
    return asked.join(inside, F.col("_found").isNull() & (F.col("_norm") == F.col("sub")), "left").select(
        "title", F.coalesce("_found", "_by_sub").alias("stem"))


# ---- assets and occurrences ----------------------------------------------


def match_occurrences(assets: DataFrame, occurrences: DataFrame) -> DataFrame:
    """assets(doc_id, idx, sha) to occurrences(doc_id, idx, sha), both 0-based.

    Equal hashes pair up in order first; what is left pairs by equal position.
    Numbering runs in ranges, so a hash shared by very many assets stays spread.
    """
    from ..ordering import number_within

    a = number_within(assets, ["doc_id", "sha"], ["idx"], "rn")
    o = number_within(occurrences.where(F.col("sha").isNotNull()), ["doc_id", "sha"], ["idx"], "rn")
    by_hash = a.join(o.select("doc_id", "sha", "rn", F.col("idx").alias("_o")), ["doc_id", "sha", "rn"], "left").select(
        "doc_id", "idx", "_o")
    used = by_hash.where(F.col("_o").isNotNull()).select("doc_id", F.col("_o").alias("idx"))
    free = occurrences.select("doc_id", "idx").join(used, ["doc_id", "idx"], "left_anti")
    free = free.select("doc_id", "idx", F.col("idx").alias("_p"))
    return by_hash.join(free, ["doc_id", "idx"], "left").select(
        "doc_id", "idx",
        F.coalesce("_o", "_p").alias("occurrence"),
        F.when(F.col("_o").isNotNull(), F.lit("hash")).when(F.col("_p").isNotNull(), F.lit("position")).alias("matched_by"),
    )


# ---- ranked retrieval ----------------------------------------------------

#: Tier of images that need no credit.
NO_ATTRIBUTION = "no-attribution"


def rank_candidates(
    requests: DataFrame, candidates: DataFrame, n: int = 4, strict_no_attribution: bool = False,
) -> DataFrame:
    """Best ``n`` candidates per request: (req_id, rank, cand_id, score).

    requests(req_id, query, orientation, min_width, min_height, required);
    candidates(req_id, cand_id, provider, title, author, url, license_name, license_url,
    width, height) belong to the request that fetched them. One join by request brings
    both together; a task keeps the first ``n`` of a request before the shuffle, so a
    request with very many candidates stays spread. ``strict_no_attribution`` keeps only
    candidates that need no credit. Equal scores (to six places) go by ``cand_id``.
    """
    from ..functions import licensing as L
    from ..functions import queries as Q

    asked = requests.select(
        "req_id", Q.query_tokens(F.col("query")).alias("_tokens"), Q.mentions_transit(F.lower("query")).alias("_transit"),
        F.coalesce("orientation", F.lit("")).alias("_wanted"), F.coalesce("min_width", F.lit(0)).alias("_wide"),
        F.coalesce("min_height", F.lit(0)).alias("_high"), F.coalesce("required", F.array().cast("array<string>")).alias("_required"),
    ).withColumn("_alts", Q.alternatives(F.col("_required")))
    pool = candidates.select(
        "req_id", "cand_id", "width", "height", Q.candidate_text(F.col("title"), F.col("author"), F.col("url")).alias("_text"),
        Q.compact(F.coalesce("title", F.lit(""))).alias("_title"),
        L.license_tier(F.col("license_name"), F.col("license_url"), F.col("provider")).alias("_tier"),
    ).where(F.col("_tier") == NO_ATTRIBUTION if strict_no_attribution else F.col("_tier").isNotNull())
    pool = pool.withColumn("_body", Q.compact(F.col("_text")))
    both = pool.join(broadcast_if_small(asked), "req_id")
    both = both.withColumn("_rel", Q.relevance(F.col("_tokens"), F.col("_text"))).where(
        Q.gate_passes(F.col("_alts"), F.col("_body")) & ((F.col("_rel") > 0) | (F.size("_required") > 0)))
    score = Q.rank_score(
        F.col("_rel"), Q.title_hits(F.col("_alts"), F.col("_title")), ~F.col("_transit") & Q.mentions_transit(F.col("_text")),
        F.col("width"), F.col("height"), F.col("_wanted"), F.col("_wide"), F.col("_high"), F.col("_tier"))
    w = Window.partitionBy("req_id").orderBy(F.col("score").desc(), "cand_id")
    return (
        both.select("req_id", "cand_id", F.round(score, 6).alias("score"))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        .select("req_id", F.col("rank").cast("long").alias("rank"), "cand_id", "score")
    )


# ---- layout choice -------------------------------------------------------

# Gap and smallest text area of the layout rule.
GAP, MIN_TEXT_HEIGHT, MIN_TEXT_WIDTH = 20, 150, 280


def layout_dimensions(ratio: Column, width: Column, height: Column, gap: int = GAP) -> Column:
    """struct(layout_type, image_w, image_h, text_w, text_h); halves round to even."""

    def r(x):
        return F.rint(x).cast("long")

    w, h = width.cast("long"), height.cast("long")
    top_h = r(w / ratio)
    left_w = r(h * ratio)
    narrow_w = r(w * F.lit(0.7))

    def out(kind, iw, ih, tw, th):
        return F.struct(F.lit(kind).alias("layout_type"), iw.alias("image_w"), ih.alias("image_h"),
                        tw.alias("text_w"), th.alias("text_h"))

    narrow = out("left-right", narrow_w, F.least(r(narrow_w / ratio), h),
                 F.greatest(w - narrow_w - gap, F.lit(MIN_TEXT_WIDTH).cast("long")), h)
    return (
        F.when((ratio > 1.5) & (h - top_h - gap >= MIN_TEXT_HEIGHT), out("top-bottom", w, top_h, w, h - top_h - gap))
        .when((ratio <= 1.5) & (w - left_w - gap >= MIN_TEXT_WIDTH), out("left-right", left_w, h, w - left_w - gap, h))
        .otherwise(narrow)
    )


# ---- request queue -------------------------------------------------------

# States of a queued request.
PENDING, SOURCED, FAILED, NEEDS_MANUAL = "Pending", "Sourced", "Failed", "Needs-Manual"


def queue_errors(items: DataFrame) -> DataFrame:
    """items(pos, filename, query, status): first broken rule per bad row."""

    def empty(c):
        return F.coalesce(~F.col(c).rlike(r"\S"), F.lit(True))

    error = F.lit(None).cast("string")
    for c in ("filename", "query", "status"):
        error = F.coalesce(error, F.when(empty(c), F.lit(f"field '{c}' must be a non-empty string")))
    error = F.coalesce(error, F.when(
        ~F.col("status").isin(PENDING, SOURCED, FAILED, NEEDS_MANUAL),
        F.concat(F.lit("status '"), "status", F.lit("' is invalid"))))
    repeated = (
        items.groupBy("filename").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
        .where(F.col("_n") > 1).drop("_n")
    )
    joined = items.join(broadcast_if_small(repeated), "filename", "left")
    error = F.coalesce(error, F.when(
        F.col("pos") > F.col("_first"), F.concat(F.lit("duplicate filename '"), "filename", F.lit("'"))))
    return joined.select("pos", error.alias("error")).where(F.col("error").isNotNull())


def run_queue(items: DataFrame, best: DataFrame) -> DataFrame:
    """New status per item; best(req_id, cand_id) holds the winner of each worked request."""
    won = best.select(F.col("req_id").alias("pos"), "cand_id")
    open_row = F.col("status").isin(PENDING, FAILED)
    done = items.join(won, "pos", "left")
    return done.select(
        "pos", "filename",
        F.when(open_row & F.col("cand_id").isNotNull(), F.lit(SOURCED)).when(open_row, F.lit(NEEDS_MANUAL))
        .otherwise(F.col("status")).alias("status"),
        F.when(open_row, F.col("cand_id")).alias("cand_id"),
        F.when(open_row & F.col("cand_id").isNull(), F.lit("search failed")).alias("last_error"),
        (~open_row).alias("skipped"),
    )


def queue_counts(done: DataFrame) -> DataFrame:
    worked = ~F.col("skipped")
    return done.agg(
        F.count_if(worked & (F.col("status") == SOURCED)).alias("sourced"),
        F.count_if(worked & (F.col("status") == NEEDS_MANUAL)).alias("needs_manual"),
        F.count_if(F.col("skipped")).alias("skipped"),
    )
