"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

The arrays are files below the shared folder, cut into shards of equal hash ranges; workers
map them into memory. Word ids are ranks of the word's hash; a bigram's key is a reversible
mix of both ids, so different bigrams never share one.
"""

from __future__ import annotations

import json
import sys
import tempfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from . import arrays
from .common import check_columns, stored_bytes, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
#: Hash of the end token; words are hashed from bytes, the end is not a word.
END = 0x5EED0FE2D0C5A9D1
#: Tokens counted in a task before they are sent on.
HELD_TOKENS = 3_000_000
#: Input bytes for each shard of the arrays.
SHARD_BYTES = 24_000_000
BLOBS = "shard int, keys binary, counts binary"


@dataclass
class Model:
    folder: str
    shards: int
    vocab: list[int]  # words of each shard
    tokens: int
    words: int
    bigrams: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_rest: float


def held_out(id_col: str = "doc_id", folds: int = 7, fold_no: int = 2) -> Column:
    """Rows not learned from: crc32 of the id as text modulo ``folds``; a NULL id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold_no, F.lit(False))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(int(x), 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1))


def discount(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *by))[np.minimum(counts, 3)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _by_shard(keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row of sorted keys and their counts for each shard: equal ranges of the 64-bit keys."""
    edges = np.searchsorted(keys, [U64((i << 64) // shards) for i in range(shards)] if len(keys) else [0] * shards).tolist() + [len(keys)]
    rows = [(i, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_pydict(
        {"shard": [r[0] for r in rows], "keys": [r[1] for r in rows], "counts": [r[2] for r in rows]},
        schema=pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]),
    )


def token_hashes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of every text (words and one end) and how many each text has."""
    raw, offsets = arrays.flat(batch.column(column))
    raw = arrays.LOWER[raw]
    starts, ends, counts = arrays.spans(raw, offsets, arrays.BLANKS)
    out = np.full(len(starts) + len(counts), END, U64)
    first = np.cumsum(counts + 1) - (counts + 1)
    out[arrays.ragged(first, counts)] = arrays.hashes(raw, starts, ends)
    return out, counts + 1


class Arrays:
    """Sorted hash arrays of a folder, mapped into memory shard by shard."""

    def __init__(self, folder: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.open: dict[str, np.ndarray] = {}
        self.kept: list = []

    def get(self, name: str, kind: str) -> np.ndarray:
        if name not in self.open:
            path = f"{self.root}/{name}"
            if not isinstance(self.store, fs.LocalFileSystem):  # a store that can't be mapped: one copy, gone with the task
                copy = tempfile.NamedTemporaryFile()
                with self.store.open_input_stream(path) as source:
                    while block := source.read(1 << 24):
                        copy.write(block)
                copy.flush()
                self.kept.append(copy)
                path = copy.name
            size = self.store.get_file_info(f"{self.root}/{name}").size
            self.open[name] = np.memmap(path, kind, "r") if size else np.zeros(0, kind)
        return self.open[name]


def _write(folder: str, name: str, values: np.ndarray) -> None:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    temporary = f"{root}/{name}.{id(values)}.{np.random.default_rng().integers(1 << 60)}"
    with store.open_output_stream(temporary) as out:
        out.write(values.tobytes())
    store.move(temporary, f"{root}/{name}")  # a task that runs again writes the same bytes


def find(keys: np.ndarray, mapped: Arrays, name: str, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of every (sorted) key in its shard, -1 where it isn't there, and the shard's bounds in ``keys``."""
    edges = np.append(np.searchsorted(keys, np.array([(i << 64) // shards for i in range(shards)], U64)), len(keys))
    out = np.full(len(keys), -1, np.int64)
    for i in range(shards):
        a, b = edges[i], edges[i + 1]
        if b > a:
            have = mapped.get(f"{name}-{i}.keys", "<u8")
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
                out[a:b] = np.where(have[at] == keys[a:b], at, -1)
    return out, edges


class Lookup:
    """Ids and numbers of words and bigrams of a model."""

    def __init__(self, model: Model):
        self.model, self.arrays = model, Arrays(model.folder)
        self.base = np.concatenate([[0], np.cumsum(model.vocab)]).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and training count of every token."""
        keys, inverse = np.unique(hashes, return_inverse=True)
        at, edges = find(keys, self.arrays, "word", self.model.shards)
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for i in range(self.model.shards):
            part = slice(edges[i], edges[i + 1])
            known = at[part] >= 0
            if known.any():
                ids[part][known] = at[part][known] + self.base[i]
                counts[part][known] = self.arrays.get(f"word-{i}.counts", "<u4")[at[part][known]]
        return ids[inverse], counts[inverse]

    def numbers(self, name: str, kind: str, ids: np.ndarray) -> np.ndarray:
        """Values of a dense array over ids; the start context is the last id."""
        out = np.zeros(len(ids), kind)
        shard = np.searchsorted(self.base[1:], ids, side="right")
        shard = np.minimum(shard, self.model.shards - 1)
        for i in np.unique(shard):
            mine = shard == i
            out[mine] = self.arrays.get(f"{name}-{i}.values", kind)[ids[mine] - self.base[i]]
        return out

    def bigrams(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, inverse = np.unique(pair(left, right), return_inverse=True)
        at, edges = find(keys, self.arrays, "pair", self.model.shards)
        counts = np.zeros(len(keys), np.int64)
        for i in range(self.model.shards):
            part = slice(edges[i], edges[i + 1])
            known = at[part] >= 0
            if known.any():
                counts[part][known] = self.arrays.get(f"pair-{i}.counts", "<u4")[at[part][known]]
        return counts[inverse]


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return arrays.mix((left.astype(U64) << U64(32)) | right.astype(U64))


def unpair(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Undoes :func:`pair`: every step of the mix can be reversed."""
    x = keys.astype(U64, copy=True)
    x ^= (x >> U64(31)) ^ (x >> U64(62))
    x *= U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> U64(27)) ^ (x >> U64(54))
    x *= U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> U64(30)) ^ (x >> U64(60))
    x -= U64(0x9E3779B97F4A7C15)
    return (x >> U64(32)).astype(np.int64), (x & U64(0xFFFFFFFF)).astype(np.int64)


def contexts(ids: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """The token before each token; ``start`` before the first of a text."""
    before = np.concatenate([[start], ids[:-1]])
    before[np.cumsum(counts) - counts] = start
    return before


def _counted(docs: DataFrame, shards: int, keys_of) -> DataFrame:
    """Rows of sorted keys and counts per shard; what a task holds is summed before it is sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, size = keys_of(), [], 0
        for batch in arrays.pieces_of(batches, "_text"):
            keys = make(batch)
            held.append(_summed(keys, np.ones(len(keys), np.int64)))
            size += len(held[-1][0])
            if size > HELD_TOKENS:
                yield _by_shard(*_summed(*map(np.concatenate, zip(*held, strict=True))), shards)
                held, size = [], 0
        if held:
            yield _by_shard(*_summed(*map(np.concatenate, zip(*held, strict=True))), shards)

    return docs.mapInArrow(run, BLOBS)


def _merge(table: pa.Table, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(b, kind) for b in table.column("keys").to_pylist()]
    counts = [np.frombuffer(b, "<u4").astype(np.int64) for b in table.column("counts").to_pylist()]
    return _summed(np.concatenate(keys), np.concatenate(counts))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts ``docs`` and writes the model below the shared folder.

    Three jobs: words, bigrams, and numbers of contexts and continuations. Keys are hashes,
    so every shard holds an equal part whatever word or text repeats. An empty table gives
    a model in which every token is unknown.
    """
    check_columns(docs, text_col)
    folder = f"{shared_dir(docs.sparkSession)}/model"
    shards = max(8, -(-stored_bytes(docs) // SHARD_BYTES)) if stored_bytes(docs) < 1 << 60 else 8
    texts = docs.select(F.col(text_col).alias("_text"))

    def words(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = _merge(table)
        _write(folder, f"word-{shard}.keys", keys.astype("<u8"))
        _write(folder, f"word-{shard}.counts", np.minimum(counts, 0xFFFFFFFF).astype("<u4"))
        return pa.table({"shard": [shard], "words": [len(keys)], "tokens": [int(counts.sum())]})

    found = {r["shard"]: r for r in written(
        _counted(texts, shards, lambda: lambda batch: token_hashes(batch, "_text")[0])
        .groupBy("shard").applyInArrow(words, "shard long, words long, tokens long")
    ).collect()}  # one row a shard
    vocab = [found[i]["words"] if i in found else 0 for i in range(shards)]
    for i in range(shards):
        if i not in found:
            for part, kind in (("keys", "<u8"), ("counts", "<u4")):
                _write(folder, f"word-{i}.{part}", np.zeros(0, kind))
    model = Model(folder, shards, vocab, sum(r["tokens"] for r in found.values()), sum(vocab), 0, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 1.0)
    start = model.words
    base = np.concatenate([[0], np.cumsum(vocab)])

    def pairs_of():
        lookup = Lookup(model)

        def make(batch: pa.RecordBatch) -> np.ndarray:
            hashes, counts = token_hashes(batch, "_text")
            ids, _ = lookup.ids(hashes)
            return pair(contexts(ids, counts, start), ids)

        return make

    def ranged(kind: int, ids: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
        """Sums for ids as rows for the shards of the dense arrays; ``ids`` ascend."""
        edges = np.searchsorted(ids, base[:-1]).tolist() + [len(ids)]
        return [
            (kind, i, ids[a:b].astype("<u8").tobytes(), b"".join(c[a:b].astype("<u4").tobytes() for c in columns))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a
        ]

    def bigrams(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = _merge(table)
        _write(folder, f"pair-{shard}.keys", keys.astype("<u8"))
        _write(folder, f"pair-{shard}.counts", np.minimum(counts, 0xFFFFFFFF).astype("<u4"))
        left, right = unpair(keys)
        order = np.argsort(left, kind="stable")
        l, c = left[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1]]))
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)]
        after, distinct = np.unique(right, return_counts=True)
        rows = ranged(0, l[first], sums) + ranged(1, after, [distinct])
        of_counts = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()
        rows.append((2, 0, json.dumps([len(keys), *of_counts]).encode(), b""))
        return pa.table({n: [r[i] for r in rows] for i, n in enumerate(("kind", "range", "ids", "sums"))}, schema=pa.schema(
            [("kind", pa.int32()), ("range", pa.int32()), ("ids", pa.binary()), ("sums", pa.binary())]))

    sums = written(_counted(texts, shards, pairs_of).groupBy("shard").applyInArrow(
        bigrams, "kind int, range int, ids binary, sums binary"
    ))
    marks = np.array([json.loads(bytes(r["ids"])) for r in sums.where("kind = 2").select("ids").collect()] or [[0] * 5]).sum(0)  # one row a shard
    for i in range(shards):
        if not fs.FileSystem.from_uri(folder)[0].get_file_info(f"{fs.FileSystem.from_uri(folder)[1]}/pair-{i}.keys").is_file:
            for part, kind in (("keys", "<u8"), ("counts", "<u4")):
                _write(folder, f"pair-{i}.{part}", np.zeros(0, kind))
    model.bigrams = int(marks[0])
    model.discounts = discounts(marks[1:].tolist())
    high = model.discounts

    def dense(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        size = vocab[i] + (1 if i == shards - 1 else 0)  # the start context is the last id
        total = np.zeros((4, size), np.int64)
        follows = np.zeros(size, np.int64)
        for kind, ids, values in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "sums")), strict=True):
            at = np.frombuffer(ids, "<u8").astype(np.int64) - base[i]
            if kind == 0:
                total[:, at] += np.frombuffer(values, "<u4").reshape(4, -1)
            else:
                follows[at] += np.frombuffer(values, "<u4")
        c = np.maximum(total[0], 1)
        _write(folder, f"total-{i}.values", total[0].astype("<u8"))
        _write(folder, f"rest-{i}.values", ((high[0] * total[1] + high[1] * total[2] + high[2] * total[3]) / c).astype("<f4"))
        _write(folder, f"follows-{i}.values", follows.astype("<u4"))
        counts = np.bincount(np.minimum(follows, 5), minlength=6)
        return pa.table({"n1": [int(counts[1])], "n2": [int(counts[2])], "n3": [int(counts[3])], "n4": [int(counts[4])], "more": [int((follows >= 3).sum())]})

    spark = docs.sparkSession
    every = spark.range(shards).select(F.lit(3).alias("kind"), F.col("id").cast("int").alias("range"), F.lit(b"").alias("ids"), F.lit(b"").alias("sums"))
    low = written(sums.where("kind < 2").unionByName(every).groupBy("range").applyInArrow(
        lambda key, table: dense(key, table.filter(pa.compute.less(table.column("kind"), 2))), "n1 long, n2 long, n3 long, n4 long, more long"
    )).agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "more")]).first()
    n1, n2, n3, n4, more = (int(x or 0) for x in low)
    d = model.low_discounts = discounts([n1, n2, n3, n4])
    model.low_rest = (d[0] * n1 + d[1] * n2 + d[2] * more) / model.bigrams if model.bigrams else 1.0
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    ``score`` is the log10 probability of the text's tokens, the end included. A text without
    words (empty, NULL or blanks) is the end alone. Repeated rows score alike; a NULL id is
    kept; an empty table gives an empty result; other columns are ignored.
    """
    check_columns(docs, id_col, text_col)
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(
        "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for batch in arrays.pieces_of(batches, "_text"):
            hashes, counts = token_hashes(batch, "_text")
            ids, seen = lookup.ids(hashes)
            known = ids >= 0
            base = np.log10((seen + 1) / (model.tokens + model.words + 1))
            low = np.full(len(ids), model.low_rest / (model.words + 1))
            follows = lookup.numbers("follows", "<u4", ids[known]).astype(np.int64)
            if model.bigrams:
                low[known] += np.maximum(follows - discount(follows, model.low_discounts), 0) / model.bigrams
            before = contexts(ids, counts, model.words)
            p = low.copy()
            has = np.flatnonzero(before >= 0)
            total = lookup.numbers("total", "<u8", before[has]).astype(np.int64)
            has, total = has[total > 0], total[total > 0]
            p[has] *= lookup.numbers("rest", "<f4", before[has])
            both = known[has]
            have, total = has[both], total[both]
            c = lookup.bigrams(before[have], ids[have])
            p[have] += np.maximum(c - discount(c, model.discounts), 0) / total
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array(counts), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                pa.array(np.full(len(counts), model.tokens)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first)),
            ], names=schema.names)

    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("_id", id_col)
    )


def describe(model: Model) -> dict:
    return asdict(model)
