"""N-gram Jaccard join with set relations: prefix index lists skipped by size and position, answers derived from a similar set's."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import check_columns, components, discard, small, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shingle hashes are counted in so many buckets (leading bits); one table of this size orders all shingles.
BUCKET_BITS, RANGE = 18, 256
#: Text worked on at once: a byte of it stands for many in the arrays made from it.
BLOCK_BYTES = 1_000_000


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of fewer rows while wide rows go to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shingles(batch: pa.RecordBatch, column: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and how many each text has."""
    raw, offsets = arrays.flat(batch.column(column))
    raw = arrays.LOWER[raw]
    starts, ends, counts = arrays.spans(raw, offsets, arrays.BLANKS)
    return arrays.unique_rows(*arrays.grams(arrays.hashes(raw, starts, ends), counts, words))


def bucket_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many (text, shingle) pairs fall into each bucket, over all texts; a table of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in arrays.pieces_of(batches, "_text", BLOCK_BYTES):
            found, _ = shingles(batch, "_text", words)
            total += np.bincount((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        parts = total.reshape(-1, RANGE)
        yield pa.RecordBatch.from_pydict(
            {"range": range(len(parts)), "counts": [p.tobytes() for p in parts]}, schema=pa.schema([("range", pa.int32()), ("counts", pa.binary())])
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.mapInArrow(run, "range int, counts binary").groupBy("range").applyInArrow(add, "range int, counts binary").collect()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows:
        out[r["range"] * RANGE : (r["range"] + 1) * RANGE] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out


def _sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``_id, n, d1, d2, prefix``: size, digest and rarest shingles of every text's set.

    Two sets that are similar enough share a shingle among the first ``n - ceil(t n) + 1`` of
    each, whatever the order; shingles in rarer buckets come first, so that what many texts
    share is last.
    """
    counts = bucket_counts(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces_of(batches, "_text", BLOCK_BYTES):
            found, each = shingles(batch, "_text", words)
            first = np.cumsum(each) - each
            full = each > 0
            digests = np.zeros((2, len(each)), np.uint64)
            if full.any():
                for i, x in enumerate((arrays.mix(found), arrays.mix(found ^ np.uint64(0xA5A5A5A55A5A5A5A)))):
                    digests[i, full] = np.add.reduceat(x, first[full])
            text = np.repeat(np.arange(len(each)), each)
            order = np.lexsort((found, counts[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], text))
            size = np.where(full, each - -(-num * each // den) + 1, 0)
            prefix = found[order][arrays.ragged(first, size)]
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array(each, pa.int64()), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                arrays.list_column(pa.array(prefix.view(np.int64)), size),
            ], names=["_id", "n", "d1", "d2", "prefix"])

    return docs.mapInArrow(run, "_id long, n long, d1 long, d2 long, prefix array<long>")


def overlaps(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``a, b, common, na, nb`` for pairs of ids: exact sizes from the whole sets of both texts."""
    spark = docs.sparkSession
    pairs = written(pairs.select("a", "b").distinct())
    ids = written(pairs.select(F.col("a").alias("_i")).union(pairs.select("b")).distinct())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces_of(batches, "_text", BLOCK_BYTES):
            found, each = shingles(batch, "_text", words)
            ends = np.cumsum(each).tolist()
            blobs = [found[e - n : e].tobytes() for e, n in zip(ends, each.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(blobs, pa.binary())], names=["_id", "_set"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            last, left = None, None
            for x, y in zip(batch.column("_sa"), batch.column("_sb"), strict=True):
                if last is None or not x.equals(last):
                    last, left = x, np.frombuffer(x.as_buffer(), np.uint64)
                right = np.frombuffer(y.as_buffer(), np.uint64)
                short, long_ = (left, right) if len(left) <= len(right) else (right, left)
                at = np.minimum(np.searchsorted(long_, short), max(len(long_) - 1, 0))
                rows.append((int((long_[at] == short).sum()) if len(long_) else 0, len(left), len(right)))
            common, na, nb = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)) if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), common, na, nb], names=["a", "b", "common", "na", "nb"])

    wanted = docs.join(small(ids), F.col("_id") == F.col("_i"), "left_semi")
    with batch_rows(spark, 500):
        sets = written(wanted.mapInArrow(make, "_id long, _set binary"))
        both = pairs.join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_sa")), "a").join(
            sets.select(F.col("_id").alias("b"), F.col("_set").alias("_sb")), "b")
        found = written(both.select("a", "b", "_sa", "_sb").mapInArrow(meet, "a long, b long, common long, na long, nb long"))
    discard(sets, ids, pairs)
    return found


def _least(n1: Column, n2: Column, num: int, den: int) -> Column:
    """Smallest overlap of two linked sets."""
    return F.ceil(num * (n1 + n2) / F.lit(num + den) - F.lit(1e-9))


def _sizes(num: int, den: int) -> Column:
    """Two sets of sizes that can link."""
    return den * F.least("zn", "yn") >= num * F.greatest("zn", "yn")


def _first(num: int, den: int) -> Column:
    """Whether a common list entry may be the first common prefix shingle of two linked sets: enough must follow it in both."""
    n1, n2 = F.col("zn"), F.col("yn")
    return F.least(n1 - F.col("zpos"), n2 - F.col("ypos")) >= _least(n1, n2, num, den)


def _pairs(met: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` of the pairs met in an entry that may be their first common one, and whose prefixes have enough in common.

    Two linked sets always meet in such an entry, so no other entry of their lists is joined. The common
    prefix shingles, counted from both prefixes, with all that can follow behind a prefix must reach the
    smallest overlap. Sizes are keys, since rows that share an id can have sets of several sizes.
    """
    pairs = met.select("zid", "zn", "yid", "yn").distinct()
    for side in "zy":
        pairs = pairs.join(prefixes.select(F.col("id").alias(f"{side}id"), F.col("n").alias(f"{side}n"), F.col("prefix").alias(f"{side}prefix")), [f"{side}id", f"{side}n"])
    left = [F.col(f"{s}n") - F.size(f"{s}prefix") for s in "zy"]
    shared = F.size(F.array_intersect("zprefix", "yprefix"))
    return pairs.where(shared + F.greatest(*left) >= _least(F.col("zn"), F.col("yn"), num, den)).select(
        F.col("zid").alias("a"), F.col("yid").alias("b")).distinct()


def near_groups(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Texts link when ``den * intersection >= num * union`` of their sets of ``words``-word
    shingles (lower-case A-Z; a text of fewer words is one shingle). Equal sets are one class,
    of which the smallest id stands for all. Of every index list the set with the fewest rarer shingles before
    the entry is proposed as leader of the others; each set is tested against the leader it met most often, and linked
    sets form groups. What is left to decide lies between groups: sets without a group are
    paired directly; a set and a group are first decided by the leader, whose tested distance
    to its members (Jaccard distance is a metric) gives the members that can still link, and
    only these are tested. Every decision is an exact overlap of whole sets.

    Empty and NULL texts and texts without words have size 0 and link with nothing; a NULL id
    has no component and links nothing; rows that share an id are one document with all their
    texts; an empty table gives an empty result; other columns are ignored.
    """
    check_columns(docs, id_col, text_col)
    if words < 1 or not 0 < num <= den:
        raise ValueError("words must be positive and the threshold between 0 and 1")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sets = written(_sets(texts, words, num, den))
    classes = written(
        sets.where("n > 0 AND _id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("_id").alias("rep"))
    )
    known = texts.where("_id IS NOT NULL")
    joined = sets.where("_id IS NOT NULL").join(small(classes), ["d1", "d2", "n"])
    prefixes = written(joined.where("_id = rep").dropDuplicates(["rep", "d1", "d2"]).select(F.col("rep").alias("id"), "n", "prefix"))
    lists = prefixes.select("id", "n", F.size("prefix").alias("k"), F.posexplode("prefix").alias("pos", "token"))
    # the head of a list has the fewest rarer shingles before the entry: of near copies the one with the fewest changes
    shared = lists.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("pos", "id")).alias("h")).where("c > 1").select("token", F.col("h.id").alias("head"))
    lists = written(lists.join(small(written(shared)), "token"))

    linked = lambda df: df.where(den * F.col("common") >= num * (F.col("na") + F.col("nb") - F.col("common")))
    far = 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))

    # leaders: the list head a set met most often; one met by chance, in a few lists of many, is not worth a test
    needed = _least(F.col("n"), F.col("n"), num, den) - (F.col("n") - F.col("k"))
    met = (
        lists.where("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("k").alias("k"))
        .where(4 * F.col("c") >= needed)
    )
    proposed = met.groupBy("id").agg(F.max(F.struct("c", -F.col("head"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.col2")).alias("b"))
    first = linked(overlaps(known, proposed, words)).withColumn("dist", far)
    leaders = written(first.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("leader"), F.min("dist").alias("dist")))
    roots = written(components(leaders.select(F.col("id").alias("a"), F.col("leader").alias("b"))))
    placed = written(
        lists.drop("head").join(small(roots), "id", "left").join(small(leaders), "id", "left").select(
            "token", "id", "n", "k", "pos", F.coalesce("root", "id").alias("comp"), F.coalesce("leader", "id").alias("leader"),
            F.coalesce("dist", F.lit(0.0)).alias("dist"), F.col("root").isNull().alias("alone"),
        )
    )
    open_lists = written(placed.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("token"))
    entries = written(placed.join(small(open_lists), "token", "left_semi"))
    discard(placed)
    z = entries.select("token", *[F.col(c).alias(f"z{c}") for c in ("id", "n", "k", "pos", "comp", "alone")])
    y = entries.select("token", *[F.col(c).alias(f"y{c}") for c in ("id", "n", "k", "pos", "comp", "leader", "dist", "alone")])
    may = _first(num, den) & _sizes(num, den)
    direct = _pairs(
        z.where("zalone").join(y.where("yalone").withColumnRenamed("token", "_t"), (F.col("token") == F.col("_t")) & (F.col("zid") > F.col("yid")) & may),
        prefixes, num, den)
    second = linked(overlaps(known, direct, words))

    # a set and a group: the leader decides first
    groups = y.where("NOT yalone").groupBy("token", "yleader", "ycomp").agg(F.min("yn").alias("lo"), F.max("yn").alias("hi"))
    other = (F.col("zcomp") != F.col("ycomp")) & (F.col("zalone") | (F.col("zcomp") > F.col("ycomp")))
    fits = (den * F.col("hi") >= num * F.col("zn")) & (den * F.col("zn") >= num * F.col("lo"))
    via = z.join(groups, "token").where(other & fits & (F.col("zid") != F.col("yleader"))).select(F.col("zid").alias("a"), F.col("yleader").alias("b")).distinct()
    tested = overlaps(known, via, words).withColumn("far", far)
    third = linked(tested)
    rest = tested.join(third.select("a", "b"), ["a", "b"], "left_anti").select(F.col("a").alias("zid"), F.col("b").alias("yleader"), "far")
    asked = z.join(small(written(rest)), "zid").withColumnsRenamed({"token": "_t", "yleader": "_l"})
    members = _pairs(
        asked.join(
            y.where("NOT yalone"),
            (F.col("token") == F.col("_t")) & (F.col("yleader") == F.col("_l")) & other & (F.col("yid") != F.col("yleader"))
            & (F.col("far") - F.col("ydist") <= 1 - num / den + 1e-9) & may),
        prefixes, num, den,
    )
    fourth = linked(overlaps(known, members, words))

    links = leaders.select(F.col("id").alias("a"), F.col("leader").alias("b"))
    for more in (second, third, fourth):
        links = links.unionByName(more.select("a", "b"))
    final = written(components(links.unionByName(joined.where("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b")))))
    discard(classes, prefixes, lists, leaders, roots, entries, open_lists)
    return sets.join(small(final), F.col("_id") == F.col("id"), "left").select(
        F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("root", "_id").alias("component_id"),
    )


def drop_near(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Documents without words and rows with a NULL id all stay. Rows that share an id stay or
    go together.
    """
    found = near_groups(docs.select(id_col, text_col), words, num, den, id_col, text_col)
    gone = written(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct())
    return docs.alias("_d").join(small(gone), F.col(f"_d.`{id_col}`") == F.col("_gone"), "left_anti").select(*[F.col(f"_d.`{c}`") for c in docs.columns])
