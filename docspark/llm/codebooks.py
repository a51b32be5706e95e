"""Vector codes by part: k-means codebooks in whole numbers, with adaptive distance bounds kept for every part of every vector."""

from __future__ import annotations

import hashlib
import json
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import check_columns, discard, small, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors worked on at once.
ROWS = 4096
#: Share by which float bounds are widened, so that rounding never decides.
SLACK = 1e-9


@dataclass
class Codebooks:
    """Entries of every part position: ``entries[part][entry]`` are whole numbers."""

    entries: list[list[list[int]]]

    def arrays(self, kind) -> list[np.ndarray]:
        return [np.array(part, dtype=kind) for part in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def whole_numbers(values: np.ndarray, scale: int, kind) -> np.ndarray:
    """``floor(scale x)``, exact: a float64 times a power of two is exact, and large values are scaled as Python integers."""
    if kind is not object:
        return np.floor(values.astype(np.float64) * scale).astype(np.int64)
    return np.array([int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in values.ravel().tolist()], object).reshape(values.shape)


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to paired entries, or to all entries where those have one dimension less."""
    if entries.ndim == 2:
        return np.stack([((parts - e) ** 2).sum(1) for e in entries], 1)
    return ((parts[:, None, :] - entries) ** 2).sum(2)


class Bounds:
    """Drake-Hamerly bounds of one part of a block of vectors.

    ``order`` holds the own entry and the ``b`` entries that were nearest after it, ``lower`` their lower
    bounds in that order, ``outer`` one bound for all other entries, ``upper`` one for the own entry. Bounds
    move with the entries; the first place in the order whose bound (or the outer one) is above ``upper`` ends
    the entries that are looked at, and only these are measured, in whole numbers.
    """

    def __init__(self, order: np.ndarray, lower: np.ndarray, outer: np.ndarray, upper: np.ndarray):
        self.order, self.lower, self.outer, self.upper = order, lower, outer, upper

    @classmethod
    def fresh(cls, parts: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
        far = squared(parts, entries)
        order = np.argsort(far, axis=1, kind="stable")[:, : b + 2]  # equal distances: the lower index first
        near = np.take_along_axis(far, order, 1)
        near = root(near)
        outer = near[:, b + 1] * (1 - SLACK) if near.shape[1] > b + 1 else np.full(len(near), np.inf)
        return cls(order[:, : b + 1].astype(np.uint8), near[:, 1 : b + 1] * (1 - SLACK), outer, near[:, 0] * (1 + SLACK))

    def move(self, moved: np.ndarray) -> None:
        """Entries moved by these distances: what was near may be so much farther, what was far so much nearer."""
        self.upper = (self.upper + moved[self.order[:, 0]]) * (1 + SLACK)
        self.lower = np.maximum(self.lower - moved[self.order[:, 1:]], 0) * (1 - SLACK)
        self.outer = np.maximum(self.outer - moved.max(), 0) * (1 - SLACK)

    def assign(self, parts: np.ndarray, entries: np.ndarray, b: int) -> int:
        """Finds each row's nearest entry again, keeps ``b`` bounds, and returns the largest number of bounds a row needed.

        A bound of place ``j`` stands for that entry alone, so those behind it count through the smallest of them.
        """
        held = self.lower.shape[1]
        behind = np.minimum.accumulate(np.concatenate([self.lower, self.outer[:, None]], 1)[:, ::-1], 1)[:, ::-1]
        sure = behind > self.upper[:, None]
        needed = np.where(sure.any(1), sure.argmax(1), held + 1)  # entries beside the own one to look at; more than held: all
        for n in np.unique(needed).tolist():
            rows = np.flatnonzero(needed == n)
            if n == 0:
                continue  # the own entry stays, its bounds too
            if n > held:
                new = Bounds.fresh(parts[rows], entries, held)
                self.order[rows], self.lower[rows], self.outer[rows], self.upper[rows] = new.order, new.lower, new.outer, new.upper
                continue
            seen = np.sort(self.order[rows, : n + 1], 1)  # by index, so that a stable sort gives ties to the lower one
            far = squared(parts[rows], entries[seen])
            rank = np.argsort(far, axis=1, kind="stable")
            self.order[rows, : n + 1] = np.take_along_axis(seen, rank, 1)
            near = root(np.take_along_axis(far, rank, 1))
            self.upper[rows] = near[:, 0] * (1 + SLACK)
            self.lower[rows, :n] = near[:, 1:] * (1 - SLACK)
        if b < held:  # fewer bounds: what they held joins the outer one
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(1))
            self.order, self.lower = self.order[:, : b + 1], self.lower[:, :b]
        some = needed[needed <= held]
        return int(some.max()) if len(some) else 0


def root(far: np.ndarray) -> np.ndarray:
    """Square roots; of Python integers of any size up to the largest double."""
    if far.dtype != object:
        return np.sqrt(far.astype(np.float64))
    return np.array([float(min(math.isqrt(x), int(1e308))) if x >= 1 << 100 else math.sqrt(x) for x in far.ravel()], np.float64).reshape(far.shape)


def movements(old: Codebooks, new: Codebooks) -> list[np.ndarray]:
    """Distances, rounded up, by which the entries of every part moved."""
    return [
        root(np.array([sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for a, b in zip(p, q, strict=True)], object)) * (1 + SLACK)
        for p, q in zip(old.entries, new.entries, strict=True)
    ]


def _bytes_of(batch: pa.RecordBatch, name: str, kind: str, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, width).copy()


def _blobs(values: np.ndarray) -> pa.Array:
    width = values.shape[1] * values.itemsize
    return pa.array([b""] * len(values), pa.binary()) if not width else pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


@dataclass
class Coder:
    """Assigns batches of vectors: entries of this round, how they moved, bounds held before and kept after."""

    books: Codebooks
    moved: list[np.ndarray] | None
    held: list[int]
    keep: list[int]
    dims: int
    scale: int
    big: bool

    def batches(self, source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[Bounds], list[np.ndarray], list[int]]]:
        """Rows, their whole numbers, new bounds, entries before (none in the first round) and the bounds needed, part by part."""
        kind, parts = object if self.big else np.int64, len(self.books.entries)
        tables, width = self.books.arrays(kind), self.dims // parts
        for whole in source:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                values = np.asarray(batch.column("_vector").flatten()).reshape(batch.num_rows, self.dims)
                numbers = whole_numbers(values, self.scale, kind)
                all_bounds, before, needed, at, place = [], [], [], 0, 0
                if self.moved is not None:
                    orders = _bytes_of(batch, "_order", "u1", sum(h + 1 for h in self.held))
                    floats = _bytes_of(batch, "_bounds", "<f8", sum(h + 2 for h in self.held))
                for p, table in enumerate(tables):
                    part, b = numbers[:, p * width : (p + 1) * width], self.held[p]
                    if self.moved is None:
                        all_bounds.append(Bounds.fresh(part, table, self.keep[p]))
                        continue
                    f = floats[:, place : place + b + 2]
                    bounds = Bounds(orders[:, at : at + b + 1], f[:, :b], f[:, b], f[:, b + 1])
                    at, place = at + b + 1, place + b + 2
                    before.append(bounds.order[:, 0].copy())
                    bounds.move(self.moved[p])
                    needed.append(bounds.assign(part, table, self.keep[p]))
                    all_bounds.append(bounds)
                yield batch, numbers, all_bounds, before, needed


def _round(state: DataFrame, coder: Coder) -> DataFrame:
    """Vectors with their bounds; each task adds one row a part with what changed in counts and sums (``_change``).

    A part that keeps its entry adds nothing after the first round.
    """
    new = T.StructType([T.StructField("_order", T.BinaryType()), T.StructField("_bounds", T.BinaryType()),
                        T.StructField("_part", T.IntegerType()), T.StructField("_change", T.StringType()), T.StructField("_need", T.IntegerType())])
    carried = ["_id", "_vector", "_label"]
    schema = T.StructType([state.schema[c] for c in carried] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, width, rows = coder.books.entries, coder.dims // len(coder.books.entries), None
        sums = [[[0] * (width + 1) for _ in t] for t in tables]  # count, then sums, of each entry
        need = [0] * len(tables)
        for batch, numbers, bounds, before, needed in coder.batches(batches):
            rows = batch.slice(0, 0)
            need = [max(a, b) for a, b in zip(need, needed, strict=True)] if needed else need
            for p, found in enumerate(bounds):
                now, part = found.order[:, 0], numbers[:, p * width : (p + 1) * width]
                changed = np.flatnonzero(now != before[p]) if before else np.arange(len(now))
                for sign, code in ((1, now[changed]), (-1, before[p][changed] if before else now[:0])):
                    for e in np.unique(code).tolist():
                        mine = changed[code == e]
                        for i, x in enumerate([len(mine), *part[mine].sum(0).tolist()]):
                            sums[p][e][i] += sign * x
            orders = np.concatenate([b.order for b in bounds], 1)
            floats = np.concatenate([np.concatenate([b.lower, b.outer[:, None], b.upper[:, None]], 1) for b in bounds], 1).astype("<f8")
            yield _rows(schema, batch, carried, _order=_blobs(orders), _bounds=_blobs(floats))
        if rows is not None:
            n = len(tables)
            yield _rows(schema, None, carried, n, _part=pa.array(range(n), pa.int32()), _change=pa.array([json.dumps(x) for x in sums]), _need=pa.array(need, pa.int32()))

    return written(state.mapInArrow(run, schema))


def _rows(schema: T.StructType, batch: pa.RecordBatch | None, carried: list[str], size: int = 0, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of ``schema``: carried columns of ``batch``, the given ones, NULL in all others."""
    kinds = to_arrow_schema(schema)
    size = size if batch is None else batch.num_rows
    return pa.RecordBatch.from_arrays([
        columns[f.name] if f.name in columns else batch.column(f.name) if batch is not None and f.name in carried else pa.nulls(size, kinds.field(f.name).type)
        for f in schema.fields], names=schema.names)


def _changes(state: DataFrame) -> tuple[list[list[list[int]]], list[int]]:
    """Changes of counts and sums over all tasks, part by part, and the most bounds that a vector needed; as large as the codebooks."""
    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, need = None, 0
        for batch in batches:
            need = max(need, *batch.column("_need").to_pylist())
            for change in map(json.loads, batch.column("_change").to_pylist()):
                total = change if total is None else [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(total, change, strict=True)]
        yield pa.RecordBatch.from_pydict({"_part": [key[0].as_py()], "_change": [json.dumps(total)], "_need": [need]},
                                         schema=pa.schema([("_part", pa.int32()), ("_change", pa.string()), ("_need", pa.int32())]))

    rows = state.where("_part IS NOT NULL").select("_part", "_change", "_need").groupBy("_part").applyInArrow(add, "_part int, _change string, _need int").collect()
    rows.sort(key=lambda r: r["_part"])
    return [json.loads(r["_change"]) for r in rows], [r["_need"] for r in rows]


def _coded(state: DataFrame, coder: Coder) -> DataFrame:
    """``_id, _label, code, error`` by the final codebooks."""
    schema = T.StructType([state.schema["_id"], state.schema["_label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, width = coder.books.arrays(object if coder.big else np.int64), coder.dims // len(coder.books.entries)
        for batch, numbers, bounds, _, _ in coder.batches(batches):
            codes = np.stack([b.order[:, 0] for b in bounds], 1)
            error = sum(((numbers[:, p * width : (p + 1) * width] - table[codes[:, p]]) ** 2).sum(1) for p, table in enumerate(tables))
            yield _rows(schema, batch, ["_id", "_label"], code=pa.array([row.tobytes().hex() for row in codes]),
                        error=pa.array([int(x) if x < 1 << 63 else None for x in error.tolist()], pa.int64()))

    return state.mapInArrow(run, schema)


def encode(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """``id, code, error, label_error, codebooks_sha256`` of every kept vector, and the codebooks.

    Components become ``floor(scale x)``; vectors are cut into ``parts`` equal parts, each with a codebook of
    ``entries`` whole-number entries that start as the parts of the smallest ids. A round gives every part its
    nearest entry (ties to the lower index), then every entry the floored mean of its parts; an unused one
    stays. ``code`` has two hex digits a part, ``error`` is the sum of the squared distances, ``label_error``
    its sum over rows of one label.

    Between rounds each vector keeps, part by part, the ``b`` entries nearest to it with lower bounds and one
    bound for the rest; only what the bounds leave open is measured again, always in whole numbers. ``b`` starts
    at a quarter of the entries and falls to what the last round needed, an eighth at least. The state is written
    each round, and only changed parts add to the sums; entries alone reach the driver.

    Vectors that are NULL or hold NULL or non-finite components are dropped, and so are those of another
    length than the kept vector of the smallest id (of equal ids the smallest vector counts; NULL ids are last);
    a length that ``parts`` does not divide is an error. Fewer vectors than ``entries`` give as many entries;
    repeated rows count each. Components too large for 64-bit sums are worked on as Python integers, and an
    error beyond a long is NULL. An empty table gives an empty result; other columns are ignored.
    """
    check_columns(vectors, id_col, vector_col, label_col)
    if parts < 1 or not 1 <= entries <= 256 or rounds < 0 or scale < 1 or scale & (scale - 1):
        raise ValueError("positive parts, 1 to 256 entries, rounds of 0 or more and a scale that is a power of two are needed")
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("_id"), vector.alias("_vector"), F.col(label_col).alias("_label"))
    rows = rows.where(F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    order = [F.col("_id").asc_nulls_last(), "_vector"]
    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), *[
        T.StructField(n, t) for n, t in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))]])
    first = rows.orderBy(*order).limit(1).collect()  # one row
    if not first:
        return vectors.sparkSession.createDataFrame([], schema), Codebooks([[] for _ in range(parts)])
    dims = len(first[0]["_vector"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("_vector") == dims)
    start = [r["_vector"] for r in rows.orderBy(*order).limit(entries).collect()]  # as many rows as entries
    top = rows.agg(F.max(F.array_max(F.transform("_vector", F.abs)))).first()[0] or 0.0
    big = 4 * dims * (scale * int(top) + scale) ** 2 >= 1 << 62
    width, size = dims // parts, len(start)
    numbers = whole_numbers(np.array(start, float).reshape(size, dims), scale, object).tolist()
    books = Codebooks([[v[p * width : (p + 1) * width] for v in numbers] for p in range(parts)])

    fewest = min(max(1, size // 8), size - 1)
    keep = [min(max(fewest, size // 4), size - 1)] * parts
    state, table, held, moved, totals = rows, None, keep, None, None
    for _ in range(rounds):
        made = _round(state, Coder(books, moved, held, keep, dims, scale, big))
        if table is not None:
            discard(table)
        change, need = _changes(made)
        totals = change if totals is None else [
            [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(p, q, strict=True)] for p, q in zip(totals, change, strict=True)]
        new = Codebooks([[[x // t[0] for x in t[1:]] if t[0] else old for t, old in zip(sums, part, strict=True)]
                         for sums, part in zip(totals, books.entries, strict=True)])
        held, keep = keep, keep if moved is None else [max(fewest, min(k, n)) for k, n in zip(keep, need, strict=True)]
        moved, books, table = movements(books, new), new, made
        state = made.where("_part IS NULL")
    coded = written(_coded(state, Coder(books, moved, held, keep, dims, scale, big)))
    if table is not None:
        discard(table)
    all_whole = F.count("error") == F.count(F.lit(1))
    sums = written(coded.groupBy(F.col("_label").alias("_l")).agg(
        F.when(all_whole, F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)")).alias("label_error")))
    out = coded.join(small(sums), F.col("_label").eqNullSafe(F.col("_l"))).select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
    return out, books
