"""Repeated passages: merged count-min sketches leave the windows that may repeat, a second pass groups exactly those."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from . import arrays, kneser_ney
from .common import check_columns, discard, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
#: Rows of the sketch, windows a task holds before it sends its sketch.
DEPTH, HELD = 2, 4_000_000
#: Bits of the cells of one part of the sketch, at least and at most; in between, there are as many parts as PART_BITS says.
LEAST_BITS, MOST_BITS, PART_BITS = 22, 26, 7
#: Windows estimated repeated that a task holds before it sends them.
HELD_FOUND = 2_000_000
#: Text worked on at once.
BLOCK_BYTES = 1_000_000
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NONE = np.zeros(0, U64)


def windows(words: np.ndarray, counts: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every run of ``size`` words inside a text and the place of its first word.

    A polynomial of the word hashes, put together from runs of 1, 2, 4, .. words.
    """
    total = len(words)
    if total < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    run, power, length = words.copy(), step, 1  # hash of ``length`` words from each place, step ** length
    out, done = np.zeros(total, U64), 0
    left = size
    while left:
        if left & 1:  # words done .. done + length follow what is there
            out = out[: total - done - length + 1] * U64(power) + run[done : total - length + 1]
            done += length
        left >>= 1
        if left:
            run = run[: len(run) - length] * U64(power) + run[length:]
            power, length = power * power % (1 << 64), 2 * length
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(text[size - 1 :] == text[: total - size + 1])
    return arrays.mix(out[at]), at


class Words:
    """Words of a batch of texts as places and hashes."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = arrays.flat(texts)
        self.starts, self.ends, self.counts = arrays.spans(self.raw, self.offsets, arrays.BLANKS)
        self.hash = arrays.hashes(self.raw, self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return windows(self.hash, self.counts, size, _STEPS[0])

    def text(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def second(self, size: int) -> np.ndarray:
        """Other 64 bits of every window, in the same order."""
        return windows(arrays.mix(self.hash ^ U64(0x5851F42D4C957F2D)), self.counts, size, _STEPS[1])[0]

    def repeated(self, size: int, layout: Layout, mapped: kneser_ney.Arrays, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes, in order of the first, and the first words' places of the windows estimated repeated."""
        keys, at = self.windows(size)
        order = np.argsort(keys)
        keys = keys[order]
        hit = estimated_repeated(keys, layout, mapped, there)
        order = order[hit]
        return keys[hit], self.second(size)[order] if len(hit) else _NONE, at[order]

    def kept(self, keep: np.ndarray) -> list[bytes]:
        """Each text's words that stay, joined by one blank."""
        stops = np.minimum(self.ends + 1, np.repeat(self.offsets[1:], self.counts))  # a word takes the blank behind it along, if it has one
        change = np.zeros(len(self.raw) + 1, np.int8)
        change[self.starts[keep]] += 1
        change[stops[keep]] -= 1
        data = self.raw[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
        upto = np.concatenate([[0], np.cumsum(np.where(keep, stops - self.starts, 0))])
        data[upto[1:][keep & (stops > self.ends)] - 1] = 0x20
        whole, edges = data.tobytes(), upto[np.concatenate([[0], np.cumsum(self.counts)])].tolist()
        return [whole[a:b].removesuffix(b" ") for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Layout(NamedTuple):
    """Parts of the sketch and of the repeated windows, and cells of a part. A window's part are the leading bits of its hash."""

    part_bits: int
    cell_bits: int

    @classmethod
    def of(cls, cells: int) -> Layout:
        """For so many cells or more in a row of the sketch."""
        bits = max(cells.bit_length(), LEAST_BITS)
        cell_bits = min(max(bits - PART_BITS, LEAST_BITS), MOST_BITS)
        return cls(bits - cell_bits, cell_bits)

    @property
    def parts(self) -> int:
        return 1 << self.part_bits

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.part_bits)).astype(np.int64) if self.part_bits else np.zeros(len(keys), np.int64)

    def cell(self, keys: np.ndarray, row: int) -> np.ndarray:
        """Cell of each window in its part: for the first row the bits that follow those of the part, for the second the lowest."""
        first = keys >> U64(64 - self.part_bits - self.cell_bits) if row == 0 else keys
        return (first & U64((1 << self.cell_bits) - 1)).astype(np.int64)


def sketch(texts: DataFrame, size: int, layout: Layout, folder: str) -> np.ndarray:
    """Writes for every part of the sketch which cells were met twice or more, one bit a cell; returns which parts there are.

    A task's sketch holds its cells (at most twice each, since more makes no difference) as 16-bit
    places in ranges of 65,536 cells; the part's task adds them up, whatever the number of tasks.
    """
    ranges = 1 << (layout.cell_bits - 16)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, rows = np.concatenate(held), []
        part = layout.part(keys) << layout.cell_bits
        for row in range(DEPTH):
            at = np.sort(part | layout.cell(keys, row))
            at = at[np.concatenate([np.ones(min(len(at), 2), bool), at[2:] != at[:-2]])]
            edges = np.searchsorted(at, np.arange(layout.parts + 1) << layout.cell_bits)
            for p in np.flatnonzero(np.diff(edges)).tolist():
                mine = at[edges[p] : edges[p + 1]] - (p << layout.cell_bits)
                rows.append((row * layout.parts + p, np.bincount(mine >> 16, minlength=ranges).astype("<u4").tobytes(), (mine & 0xFFFF).astype("<u2").tobytes()))
        return pa.RecordBatch.from_pydict(
            {c: [r[i] for r in rows] for i, c in enumerate(("part", "sizes", "places"))},
            schema=pa.schema([("part", pa.int32()), ("sizes", pa.binary()), ("places", pa.binary())]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for batch in arrays.pieces_of(batches, "_text", BLOCK_BYTES):
            held.append(Words(batch.column("_text")).windows(size)[0])
            have += len(held[-1])
            if have >= HELD:
                yield sent(held)
                held, have = [], 0
        if have:
            yield sent(held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << layout.cell_bits, bool), np.zeros(1 << layout.cell_bits, bool)
        for batch in batches:
            for sizes, places in zip(batch.column("sizes").to_pylist(), batch.column("places").to_pylist(), strict=True):
                at = np.frombuffer(places, "<u2").astype(np.int64) + np.repeat(np.arange(ranges) << 16, np.frombuffer(sizes, "<u4"))
                twice[at[once[at]]] = True
                twice[at[1:][at[1:] == at[:-1]]] = True
                once[at] = True
        kneser_ney._write(folder, f"cells-{key[0].as_py()}.bits", np.packbits(twice, bitorder="little"))
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()]}, schema=pa.schema([("part", pa.int32())]))

    return _parts(texts.mapInArrow(run, "part int, sizes binary, places binary").groupBy("part").applyInArrow(merge, "part int"), DEPTH * layout.parts)


def _parts(made: DataFrame, size: int) -> np.ndarray:
    """Runs a job that writes files and returns which of their numbers there are (one row a file)."""
    made, there = written(made), np.zeros(size, bool)
    there[[r["part"] for r in made.collect()]] = True
    discard(made)
    return there


def estimated_repeated(keys: np.ndarray, layout: Layout, mapped: kneser_ney.Arrays, there: np.ndarray) -> np.ndarray:
    """Places of the windows, in order, that every row of the sketch has twice or more: all repeated ones and a few others."""
    edges, left = np.searchsorted(layout.part(keys), np.arange(layout.parts + 1)), [_NONE.astype(np.int64)]
    for p in np.flatnonzero(np.diff(edges) * np.logical_and.reduce(there.reshape(DEPTH, layout.parts))).tolist():
        mine = np.arange(edges[p], edges[p + 1])
        for row in range(DEPTH):
            at = layout.cell(keys[mine], row)
            bits = np.asarray(mapped.get(f"cells-{row * layout.parts + p}.bits", "u1"))
            mine = mine[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)]
        left.append(mine)
    return np.concatenate(left)


def _first_docs(k1: np.ndarray, k2: np.ndarray, low: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each window, sorted: its smallest document, and whether more than one document has it."""
    order = np.argsort(k1)
    same = k1[order[1:]] == k1[order[:-1]]
    if (k2[order[1:]] != k2[order[:-1]])[same].any():  # the first hash hardly ever leaves anything to the second, a slower sort
        order = np.lexsort((k2, k1))
    k1, k2, low, several = k1[order], k2[order], low[order], several[order]
    if not len(k1):
        return k1, k2, low, several
    first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
    least = np.minimum.reduceat(low, first)
    return k1[first], k2[first], least, np.logical_or.reduceat(several, first) | (least != np.maximum.reduceat(low, first))


def repeated_windows(texts: DataFrame, size: int, layout: Layout, there: np.ndarray, folder: str) -> np.ndarray:
    """Writes the windows that more than one document has, with the smallest document of each, as sorted arrays.

    A task sends one entry for each window it holds, so a passage of all documents is one entry a task.
    """
    kinds = (("k1", "<u8"), ("k2", "<u8"), ("low", "<i8"), ("several", "?"))

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        entries = _first_docs(*map(np.concatenate, zip(*held, strict=True)))
        edges = np.searchsorted(layout.part(entries[0]), np.arange(layout.parts + 1))
        rows = [(p, *(x[edges[p] : edges[p + 1]].tobytes() for x in entries)) for p in np.flatnonzero(np.diff(edges)).tolist()]
        return pa.RecordBatch.from_pydict(
            {c: [r[i] for r in rows] for i, c in enumerate(("part", *(k for k, _ in kinds)))},
            schema=pa.schema([("part", pa.int32()), *((k, pa.binary()) for k, _ in kinds)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped, held, have = kneser_ney.Arrays(folder), [], 0
        for batch in arrays.pieces_of(batches, "_text", BLOCK_BYTES):
            words = Words(batch.column("_text"))
            k1, k2, at = words.repeated(size, layout, mapped, there)
            if len(k1):
                held.append((k1, k2, np.asarray(batch.column("_doc"))[words.text()[at]], np.zeros(len(k1), bool)))
                have += len(k1)
            if have >= HELD_FOUND:
                yield sent(held)
                held, have = [], 0
        if have:
            yield sent(held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held, have = [np.zeros(0, kind) for _, kind in kinds], [], 0
        for batch in batches:
            for blobs in zip(*(batch.column(k).to_pylist() for k, _ in kinds), strict=True):
                held.append([np.frombuffer(b, kind) for b, (_, kind) in zip(blobs, kinds, strict=True)])
                have += len(held[-1][0])
                if have > max(len(whole[0]), 1 << 18):
                    whole, held, have = _first_docs(*map(np.concatenate, zip(whole, *held, strict=True))), [], 0
        k1, k2, low, several = _first_docs(*map(np.concatenate, zip(whole, *held, strict=True)))
        for name, values in (("k1", k1), ("k2", k2), ("low", low)):
            kneser_ney._write(folder, f"windows-{key[0].as_py()}.{name}", values[several])
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()] * bool(several.any())}, schema=pa.schema([("part", pa.int32())]))

    schema = "part int, k1 binary, k2 binary, low binary, several binary"
    return _parts(texts.mapInArrow(run, schema).groupBy("part").applyInArrow(merge, "part int"), layout.parts)


def first_docs(k1: np.ndarray, k2: np.ndarray, mapped: kneser_ney.Arrays, there: np.ndarray) -> np.ndarray:
    """Smallest document that has each window; the largest number where only one has it. There is a power of two of parts."""
    layout = Layout(len(there).bit_length() - 1, LEAST_BITS)
    out = np.full(len(k1), np.iinfo(np.int64).max)
    order = np.argsort(k1)
    edges = np.searchsorted(layout.part(k1[order]), np.arange(len(there) + 1))
    for p in np.flatnonzero(np.diff(edges) * there).tolist():
        mine = order[edges[p] : edges[p + 1]]
        have, second, low = (np.asarray(mapped.get(f"windows-{p}.{name}", kind)) for name, kind in (("k1", "<u8"), ("k2", "<u8"), ("low", "<i8")))
        at = np.searchsorted(have, k1[mine])
        while len(mine):  # entries with one first half follow each other
            inside = at < len(have)
            mine, at = mine[inside], at[inside]
            same = have[at] == k1[mine]
            mine, at = mine[same], at[same]
            hit = second[at] == k2[mine]
            out[mine[hit]] = low[at[hit]]
            mine, at = mine[~hit], at[~hit] + 1
    return out


def drop_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept_sha256`` and, ``with_text``, ``kept`` (the words that stay).

    Words are runs of bytes other than blank and 0x09-0x0D, unchanged. A word goes when a window of ``size``
    consecutive words of its document covers it whose words also start in a document with a smaller id;
    windows are judged on the input. What stays is joined by one blank.

    Three passes. A count-min sketch over all windows, one part of it a task, is merged from all tasks and never
    counts too little, so no repeated window is lost. Only the windows it has twice or more are grouped, by two
    independent 64-bit hashes of their words (128 bits), and those that several documents have are kept with the
    smallest of them. The last pass looks its windows up in these arrays, mapped into memory, and writes the
    result of each row; no text is shuffled and no group of occurrences is brought together.

    NULL and empty texts have no words. A NULL id neither removes nor is removed. Rows that share an id don't
    remove each other and each gets its own result. Texts may be of any length; an empty table gives an
    empty result; other columns are ignored.
    """
    check_columns(docs, id_col, text_col)
    if size < 1:
        raise ValueError("a window has at least one word")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    texts = rows.where("_doc IS NOT NULL").select("_doc", "_text")
    letters = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    layout = Layout.of(int(letters // 2))  # cells for each two bytes: more than windows, whatever the words
    folder = f"{shared_dir(docs.sparkSession)}/windows"
    cells_there = sketch(texts.select("_text"), size, layout, folder)
    there = repeated_windows(texts, size, layout, cells_there, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = kneser_ney.Arrays(folder)
        for batch in arrays.pieces_of(batches, "_text", BLOCK_BYTES):
            words = Words(batch.column("_text"))
            k1, k2, at = words.repeated(size, layout, mapped, cells_there)
            own = np.asarray(batch.column("_doc").fill_null(np.iinfo(np.int64).min))[words.text()[at]]
            at = at[first_docs(k1, k2, mapped, there) < own]
            cover = np.zeros(len(words.starts) + 1, np.int32)
            cover[at] += 1  # a window begins at a word, so no place is met twice
            cover[at + size] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            texts = words.kept(keep)
            upto = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(words.counts)])]
            columns = [
                batch.column("_id"), pa.array(words.counts, pa.int64()), pa.array(words.counts - np.diff(upto), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            ]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    done = rows.mapInArrow(run, f"_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return done.withColumnRenamed("_id", id_col)
