"""Vector best-fit packing of token sequences into fixed-length training sequences."""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, tokens
from .common import check_columns, small, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "piece int, start long, length long, ids_crc32 long, _part int, _rank long"


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document; only the first may be shorter than ``size``."""
    first = total - (math.ceil(total / size) - 1) * size
    return [(0, first), *((s, size) for s in range(first, total, size))]


def pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with its task and its number among the task's pieces of that length."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), *T.StructType.fromDDL(PIECES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.Encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in arrays.pieces_of(batches, "_text"):
            ids, counts = tokens.with_end(*encoder.encode(*arrays.flat(batch.column("_text"))), end_id)
            base = (np.cumsum(counts) - counts).tolist()
            rows: list[tuple] = []
            for d, n in enumerate(counts.tolist()):
                for k, (start, length) in enumerate(cut(n, size)):
                    at = base[d] + start
                    rows.append((d, k, start, length, zlib.crc32(ids[at : at + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            which, *rest = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(which)), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]],
                names=[f.name for f in schema],
            )

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def best_fit(
    lengths: list[tuple[int, int]], capacity: int, max_docs: int, max_cost: int,
    rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Packs ``count`` items of each length into bins, longest first.

    An item of length n asks for n tokens, one document and n * n of attention cost; a bin
    has a capacity for each. Bins with the same content are one class, so the work follows the
    number of lengths and classes and never the number of items. An item goes to the class that
    can take it under all three capacities and has the smallest weighted norm of what is left
    after it (``norm``), or the largest weighted product of what is left and what it asks for
    (``dot``); a new class is opened only when none can. Returns runs
    ``(length, first item, items, first bin, items a bin, offset)`` and the number of bins.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    size = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights, float)
    left = np.zeros((0, 3), np.int64)  # of every open class
    bins = np.zeros((0, 2), np.int64)  # first bin and how many
    runs, used = [], 0
    for n, count in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        item, rest = 0, count
        while rest:
            can = np.flatnonzero((left >= need).all(1))
            if not len(can):
                # room for all that is left of this length, each bin as full as it can be
                fits = int(min(capacity // n, max_docs, max_cost // (n * n)))
                opened = -(-rest // fits)
                left = np.vstack([left, [[capacity, max_docs, max_cost]]])
                bins = np.vstack([bins, [[used, opened]]])
                used += opened
                can = np.array([len(left) - 1])
            after = (left[can] - need) / size if rule == "norm" else left[can] / size * (need / size)
            k = int(can[np.argmin((after * after * w).sum(1)) if rule == "norm" else np.argmax((after * w).sum(1))])
            each = int(min((left[k] // need).min(), rest))
            first, have = (int(x) for x in bins[k])
            take = min(have, rest // each)
            runs.append((n, item, take * each, first, each, capacity - int(left[k, 0])))
            if take < have:  # the class splits
                left = np.vstack([left, left[k]])
                bins = np.vstack([bins, [[first + take, have - take]]])
            bins[k] = (first, take)
            left[k] = left[k] - need * each
            item += take * each
            rest -= take * each
        open_ = (left >= 1).all(1)
        left, bins = left[open_], bins[open_]
    return runs, used


def _assign(runs: list[tuple], id_field: T.StructField):
    """Puts every piece into its run by the number it has among the pieces of its length."""
    table = np.array(sorted((r[0], r[1], *r[2:]) for r in runs), np.int64).reshape(-1, 6)
    edges = {int(n): np.searchsorted(table[:, 0], [n, n + 1]) for n in np.unique(table[:, 0])}
    schema = T.StructType([id_field, *T.StructType.fromDDL(
        "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = (np.asarray(batch.column(c), np.int64) for c in ("length", "_number"))
            row = np.zeros(len(n), np.int64)
            for length in np.unique(n):
                lo, hi = edges[int(length)]
                mine = n == length
                row[mine] = lo + np.searchsorted(table[lo:hi, 1], number[mine], side="right") - 1
            at = table[row]
            within = number - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(at[:, 3] + within // np.maximum(at[:, 4], 1)), pa.array(at[:, 5] + within % np.maximum(at[:, 4], 1) * n)],
                names=[f.name for f in schema],
            )

    return run, schema


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, max_docs: int | None = None, max_cost: int | None = None,
    end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> DataFrame:
    """Packed pieces: id, ``piece, start, length, ids_crc32, sequence_id, offset``.

    ``path`` is the tokenizer's file on every machine. ``max_docs`` and ``max_cost`` (sum of
    squared lengths) default to values that never bind. Tokens are made once, in the row; the
    pieces (no ids) are written below the shared folder. Only how many pieces each length has
    goes to the driver, at most ``capacity`` numbers, and the plan made from it comes back as
    runs; a piece finds its place by its number among all pieces of its length, which is its
    number in its task plus the pieces of the tasks before. So no group of documents meets in
    a task, whatever repeats.

    NULL and empty texts are the end id alone. Documents longer than a sequence are cut, the
    first piece is the shorter one. Repeated rows are packed once each; an empty table gives
    an empty result; ids may be NULL; other columns are ignored.
    """
    check_columns(docs, id_col, text_col)
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    size = min(capacity, math.isqrt(max_cost))
    if min(capacity, max_docs, size) < 1:
        raise ValueError("capacities must be positive")
    cut_up = written(pieces(docs, path, size, end_id, id_col, text_col))
    shares = written(cut_up.groupBy("_part", "length").count())
    counts = shares.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most `capacity` rows
    runs, _ = best_fit([(r["length"], r["n"]) for r in counts], capacity, max_docs, max_cost, rule, weights)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(shares.select(
        F.col("_part").alias("_p"), F.col("length").alias("_l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    ))
    numbered = cut_up.join(small(bases), (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_l"))).select(
        "_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_base")).alias("_number")
    )
    run, schema = _assign(runs, T.StructField("_id", docs.schema[id_col].dataType))
    return numbered.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
