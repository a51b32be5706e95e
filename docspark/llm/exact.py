"""Exact duplicates by most-significant-digit radix partitioning of the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, small, written

#: Bytes read in the first round; every later round reads GROWTH times as many.
FIRST_BYTES, GROWTH = 64, 32


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    first_bytes: int = FIRST_BYTES, growth: int = GROWTH,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    The length of a text is its first digit, its bytes are the next ones. A round
    counts the rows of every (group, next bytes), numbers the parts that hold two
    rows or more, and only their rows go on with the rest of their bytes; a row
    that is alone in its part, or whose text has ended, is settled. Equality is
    thus shown by the bytes themselves. Counts combine before the shuffle, the
    part table is joined back by key (broadcast where its files are small, else
    sorted, hot parts split by AQE), so no group meets in one task.

    NULL text counts as empty, and empty texts are equal. Of a group the largest id
    stays; a NULL id is below all others; of repeated rows with that id one stays.
    An empty table gives an empty result. Other columns are ignored; the result has the id under its own name.
    """
    check_columns(docs, id_col, text_col)
    if first_bytes < 1 or growth < 1:
        raise ValueError("first_bytes and growth must be positive")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("_id"), F.sha2(raw, 256).alias("_sha"), raw.alias("_rest"),
        F.octet_length(raw).cast("long").alias("_gid"),
    )
    done: list[DataFrame] = []
    width, first = first_bytes, True
    while True:
        rows, parts = _split(rows, width, first)
        done.append(rows.where(F.col("_part").isNull() | F.col("_ended")).select(
            "_id", "_sha", F.col("_part").alias("_gid"), F.lit(len(done)).alias("_round"), "_tag"
        ))
        if parts.isEmpty():
            break
        rows = rows.where(F.col("_part").isNotNull() & ~F.col("_ended")).select(
            "_id", "_sha", "_rest", F.col("_part").alias("_gid"), "_tag"
        )
        if rows.isEmpty():
            break
        width, first = width * growth, False
    settled = reduce(DataFrame.unionByName, done)
    whole = written(settled.where("_gid IS NOT NULL").groupBy("_round", "_gid").agg(
        F.max(F.struct("_id", "_tag")).alias("_best"), F.count(F.lit(1)).alias("_n")
    ))
    out = settled.join(small(whole), ["_round", "_gid"], "left")
    alone = F.col("_n").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_best._id")).alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).alias("group_size"),
        (alone | (F.col("_tag") == F.col("_best._tag"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _head(width: int) -> Column:
    return F.substring(F.col("_rest"), 1, width)


def _split(rows: DataFrame, width: int, first: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their part (NULL: alone), what is left of their bytes, and the parts.

    Both are written, so the numbers hold whatever happens to the tasks that made them.
    """
    keyed = rows.withColumn("_head", _head(width))
    parts = written(
        keyed.groupBy("_gid", "_head").count().where("count > 1")
        .select("_gid", "_head", F.monotonically_increasing_id().alias("_part"))
    )
    left = keyed.join(small(parts), ["_gid", "_head"], "left")
    tag = F.monotonically_increasing_id() if first else F.col("_tag")
    on = F.col("_part").isNotNull()
    ended = F.octet_length("_rest") <= width
    out = left.select(
        "_id", "_sha", "_part", tag.alias("_tag"), ended.alias("_ended"),
        F.when(on & ~ended, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
    )
    return written(out), parts


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows to drop are known by id and digest, so the rows that stay are not shuffled where
    that table is small. Of repeated rows (one id, one text) one stays.
    """
    found = written(exact_groups(docs.select(id_col, text_col), id_col, text_col).select(
        F.col(id_col).alias("_gid"), F.col("text_sha256").alias("_gsha"), "kept", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("_best")))
    gone = written(found.where("NOT _best").select("_gid", "_gsha").distinct())
    twice = written(found.where("_best AND NOT kept").select("_gid", "_gsha").distinct())
    sha = F.sha2(F.coalesce(F.col(f"_d.`{text_col}`"), F.lit("")).cast("binary"), 256)
    mine = [F.col(f"_d.`{c}`") for c in docs.columns]
    same = F.col(f"_d.`{id_col}`").eqNullSafe(F.col("_gid")) & (sha == F.col("_gsha"))
    stay = docs.alias("_d").join(small(gone), same, "left_anti")
    if twice.isEmpty():
        return stay.select(*mine)
    once = stay.join(small(twice), same, "left_anti").select(*mine)
    pairs = stay.join(small(twice), same, "left_semi").select(*[c.alias(f"_c{i}") for i, c in enumerate(mine)], sha.alias("_s"))
    first = pairs.dropDuplicates([f"_c{docs.columns.index(id_col)}", "_s"]).drop("_s")
    return once.unionByName(first.toDF(*docs.columns))
