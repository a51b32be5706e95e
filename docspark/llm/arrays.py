"""Word boundaries, word hashes and ragged arrays over Arrow string batches, with numpy only.

All functions work on the flat UTF-8 bytes of a batch of texts, so their cost is per
byte and not per Python object.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
#: Bytes of text worked on at once.
CHUNK_BYTES = 4_000_000
#: Bytes that are hashed at once.
SLICE_BYTES = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Space and 0x09-0x0D.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter generator: spreads every input bit."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(256, dtype=U64))
_STEP = U64(0x9E3779B97F4A7C15) | U64(1)
_EMPTY = np.zeros(0, U64)


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def spans(raw: np.ndarray, offsets: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than ``seps`` and how many each text has."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~np.take(seps, raw)
    first, last = word.copy(), word.copy()
    np.greater(word[1:], word[:-1], out=first[1:])
    np.greater(word[:-1], word[1:], out=last[:-1])
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _powers(step: int, n: int) -> np.ndarray:
    """``step`` to the powers 0 .. n - 1."""
    out = np.full(n, step, U64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run ``[start, end)``; runs are in order and don't overlap.

    A polynomial of the run's bytes. It is the difference of two running sums over a slice of the bytes,
    divided by the power at which the run begins; a slice is small enough to stay in the processor's cache.
    """
    if not len(starts):
        return _EMPTY
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1] + 1, SLICE_BYTES)), len(starts)))
    longest = int((ends[cuts[1:] - 1] - starts[cuts[:-1]]).max())
    up, down = _powers(int(_STEP), longest), _powers(pow(int(_STEP), -1, 1 << 64), longest)
    sums, upto = np.empty(len(starts), U64), np.zeros(longest + 1, U64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        values = np.take(_BYTE, raw[starts[a] : ends[b - 1]])
        values *= up[: len(values)]
        np.cumsum(values, out=upto[1 : len(values) + 1])
        first = starts[a:b] - starts[a]
        sums[a:b] = (upto[ends[a:b] - starts[a]] - upto[first]) * down[first]
    return mix(sums + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each text, and how many each text has.

    A text of fewer words, but not none, has one window: all its words.
    """
    total = len(words)
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.arange(int(each.sum()), dtype=np.int64) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    have = np.repeat(np.minimum(counts, n), each)
    out = np.zeros(len(at), U64)
    for k in range(n):
        inside = k < have
        out += np.where(inside, mix(words[np.minimum(at + k, max(total - 1, 0))] + U64(k + 1)) * U64(2 * k + 3), U64(0)) if total else U64(0)
    return mix(out + have.astype(U64)), each


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length`` of each run, one after the other."""
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def unique_rows(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending, and how many each text has."""
    if not len(values):
        return values, counts.copy()
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.bincount(text[new], minlength=len(counts))


def list_column(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
