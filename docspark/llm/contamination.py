"""Benchmark decontamination: windows of test items looked up in every document, natively in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, lower_ascii, small, written

#: Everything up to "/", ":" to "`" and "{" to DEL stands between words (after lower-casing A-Z).
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 13


def words_of(text: Column) -> Column:
    """Words of a text in order; NULL has none."""
    text = F.coalesce(text, F.lit(""))
    # a text of ASCII only, told by its length, has no other capitals, and lower() is many times faster there
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))
    # a gap at the front or the end leaves one empty string each, and only there
    return F.array_remove(F.split(folded, GAPS), "")


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """``(len, hash, words, items)``: the distinct windows of the items, with the ids of all items that hold one.

    A window is ``window`` consecutive words; an item of fewer, but not none, is one window.
    """
    tokens = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    n = F.size("w")
    cut = tokens.where(n > 0).select(
        "item",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.slice("w", i, window)
        )).alias("words"),
    )
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.size("words").alias("len"), F.xxhash64("words").alias("hash"), "words", "items"
    )


def _places(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows ``(_id, _text, n_words, at, n, items)`` of documents ``(_id, _text, _w)``: one with ``n`` = 0 for each
    document, one for each place where a window of ``n`` words occurs.

    No step needs a lambda, so beside small windows all of it is one generated loop over the words of a text, and
    a place is no row of its own before it hits.
    """
    last = F.size("_w") - F.col("n") + 1
    starts = F.when(F.col("n") == 0, F.array(F.lit(1))).when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    held = F.slice("_w", F.col("at"), F.col("n"))
    places = (
        docs.select("_id", "_text", "_w", F.explode(F.array(*map(F.lit, [0, *lengths]))).alias("n"))
        .select("_id", "_text", "_w", "n", F.explode(starts).alias("at"))
        # the document's own row has another key for each text, so that no task gets all of them if both sides are shuffled
        .select("_id", "_text", F.size("_w").cast("long").alias("n_words"), "at", "n",
                F.when(F.col("n") == 0, F.col("_text")).otherwise(F.xxhash64(held)).alias("_key"), held.alias("_held"))
    )
    # one number is the join key (coalesce keeps the length out of it); the words of a place are taken out only where it is met
    met = places.join(windows, (F.col("_key") == F.col("hash")) & F.coalesce(F.col("n") == F.col("len"), F.lit(False)), "left")
    return met.where("n = 0 OR hash IS NOT NULL").where("n = 0 OR _held = words").select("_id", "_text", "n_words", "at", "n", "items")


def covered(hits: Column) -> Column:
    """How many positions the places ``(at, len)`` cover, in an array sorted by ``at``."""
    return F.aggregate(
        hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, h: F.struct(
            F.greatest(acc["end"], h["at"] + h["len"]).alias("end"),
            (acc["total"] + F.greatest(F.lit(0), h["at"] + h["len"] - F.greatest(acc["end"], h["at"]))).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20,
) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``,
    ``items_sha256`` (of the sorted, comma-joined ids of those items), ``contaminated`` and ``spans``
    (the places ``(at, len)`` in words, from 1, in order).

    ``contaminated``: some word is hit and ``share * n_hit >= n_words``. The windows are a
    table of their own; they are broadcast only when the files of that table prove them
    small, else both sides shuffle. Each place of a document is one hash and its own words; beside
    small windows only places that hit are shuffled, with one row for each document, and brought
    together by the id and a hash of the text, so repeated rows have equal results.

    NULL texts and texts without words have no words and no hits; NULL item texts are no
    items; without items nothing is hit; an item id that is NULL is ignored. Other columns
    are ignored. Of one id with several texts every row has its own result.
    """
    check_columns(docs, id_col, text_col)
    check_columns(items, item_col, item_text_col)
    if window < 1 or share < 1:
        raise ValueError("window and share must be positive")
    windows = written(item_windows(items.where(F.col(item_col).isNotNull()), item_col, item_text_col, window))
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most `window` numbers
    raw = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
        words_of(F.col(text_col)).alias("_w"),
    )
    hit = F.col("n") > 0
    out = (
        _places(raw, small(windows), lengths)
        .groupBy("_id", "_text")
        .agg(
            F.max("n_words").alias("n_words"), F.count_if(~hit).alias("rows"),
            F.collect_set(F.when(hit, F.struct("at", F.col("n").alias("len")))).alias("spans"), F.collect_set("items").alias("ids"),
        )
        .select(
            "_id", "_text", "n_words", F.when(F.size("spans") > 0, F.array_sort("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten("ids"))).alias("ids"), F.explode(F.sequence(F.lit(1), "rows")),
        )
    )
    ids = F.col("ids")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    return out.select(
        F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "spans", F.col("_text").alias("text_hash"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = written(
        contamination(docs.select(id_col, text_col), items, id_col, text_col, **options).where("contaminated")
        .select(F.col(id_col).alias("_bad"), F.col("text_hash").alias("_bad_text")).distinct()
    )
    same = F.col(f"_d.{id_col}").eqNullSafe(F.col("_bad")) & (F.xxhash64(F.coalesce(F.col(f"_d.{text_col}"), F.lit(""))) == F.col("_bad_text"))
    return docs.alias("_d").join(small(bad), same, "left_anti").select(*[F.col(f"_d.`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of the spans of ``found`` (of :func:`contamination`) taken out.

    The rest of the words stay in order, joined by single spaces; documents without hits
    keep their text as it is.
    """
    hit = found.where("n_hit > 0").select(F.col(id_col).alias("_fid"), F.col("text_hash").alias("_ft"), F.col("spans").alias("_spans")).distinct()
    text = F.coalesce(F.col(f"_d.`{text_col}`"), F.lit(""))
    joined = docs.alias("_d").join(
        hit, F.col(f"_d.`{id_col}`").eqNullSafe(F.col("_fid")) & (F.xxhash64(text) == F.col("_ft")), "left"
    )
    # words as written: the gaps of the lower-cased text are those of the text, but for capitals
    gone = F.flatten(F.transform("_spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))
    left = lambda w: F.transform(F.array_except(F.sequence(F.lit(1), F.size(w)), gone), lambda i: F.get(w, i - 1))
    kept = F.array_join(F.flatten(F.transform(F.array(words_cased(text)), left)), " ")
    return joined.select(*[
        F.when(F.col("_spans").isNotNull(), kept).otherwise(F.col(f"_d.`{c}`")).alias(c) if c == text_col else F.col(f"_d.`{c}`")
        for c in docs.columns
    ])


def words_cased(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != "")
