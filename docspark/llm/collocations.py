"""Phrase collocations: Misra-Gries summaries per hash partition find the phrases worth counting, a second pass counts them exactly."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from . import arrays, kneser_ney
from .common import check_columns, discard, small, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
#: Bytes between pieces: . , ; : ! ? and 0x0A-0x0D.
BREAKS = arrays.separators((0x2E, 0x2E), (0x2C, 0x2C), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
#: Bytes between words: those and blank and tab.
SPACES = BREAKS | arrays.separators((0x20, 0x20), (0x09, 0x09))
#: Text worked on at once, phrases held by a task before they are sent, bytes of text for a hash partition.
BLOCK_BYTES, HELD, SHARD_BYTES = 1_000_000, 4_000_000, 30_000_000
#: Counters of a summary for each one that the guarantee needs: fewer phrases survive that are not frequent.
SLACK = 2
SUMMARY = "shard int, keys binary, counts binary, error long"


class Summary:
    """Misra-Gries counters: a key's count is at most ``error`` below the truth, and never above.

    With more than ``mass / threshold`` counters the error stays below the threshold, so every key
    that occurs as often as the threshold keeps a counter. Summaries merge: counters add up, then
    all lose the largest count that has no place, and that loss adds to the error.
    """

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        self.held.append((keys, counts))
        self.waiting += len(keys)
        self.error += error
        if self.waiting >= max(self.capacity, 1 << 16):
            self.shrink()

    def shrink(self) -> None:
        if self.held:
            keys, counts = zip((self.keys, self.counts), *self.held, strict=True)
            self.keys, self.counts = kneser_ney._summed(np.concatenate(keys), np.concatenate(counts))
            self.held, self.waiting = [], 0
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            less = int(np.partition(self.counts, at)[at])
            stay = self.counts > less
            self.keys, self.counts, self.error = self.keys[stay], self.counts[stay] - less, self.error + less

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys that may occur ``threshold`` times: all that do are among them."""
        self.shrink()
        return self.keys[self.counts + self.error >= threshold]


def capacities(mass: np.ndarray, threshold: int) -> np.ndarray:
    """Counters of each hash partition: more than its mass divided by the threshold."""
    return SLACK * (mass // threshold) + 1


def segments(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """``bytes, offsets, langs`` of blocks of about ``size`` bytes; a long text is cut between pieces, which cuts no phrase."""
    for batch in arrays.pieces_of(batches, "_text", size):
        raw, offsets = arrays.flat(batch.column("_text"))
        raw, langs = arrays.LOWER[raw], batch.column("_lang").to_pylist()
        if len(raw) <= 2 * size:
            yield raw, offsets, langs
            continue
        for lang, a, b in zip(langs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            spots = np.flatnonzero(BREAKS[raw[a:b]]) + a
            while b - a > size and (at := np.searchsorted(spots, a + size)) < len(spots):
                cut = int(spots[at])
                yield raw[a:cut], np.array([0, cut - a]), [lang]
                a = cut
            yield raw[a:b], np.array([0, b - a]), [lang]


class Block:
    """Words of a block as exact ids, with the piece and the text that each belongs to."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: list):
        starts, ends, counts = arrays.spans(raw, offsets, SPACES)
        sizes = ends - starts
        letters = raw[arrays.ragged(starts, sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = column.dictionary_encode()
        self.words = coded.dictionary
        self.ids = np.asarray(coded.indices, np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        breaks = np.cumsum(BREAKS[raw], dtype=np.int64)
        self.piece = breaks[starts] + text if len(starts) else text  # only grows within a text, and by one more with each text
        numbers: dict[str, int] = {}
        of_text = np.array([numbers.setdefault(x, len(numbers)) for x in langs], np.int64)
        self.langs = list(numbers)
        self.lang = of_text[text]
        self.lang_words = np.bincount(self.lang, minlength=len(self.langs))
        data, at = arrays.flat(self.words.cast(pa.large_string()))
        hashed = arrays.hashes(data, at[:-1], at[1:])
        seeds = arrays.hashes(*_packed([x.encode() for x in self.langs]))
        self.hash = hashed[self.ids]
        self.seed = seeds[self.lang] if len(self.lang) else np.zeros(0, U64)

    def starts(self, n: int) -> np.ndarray:
        """Places where a phrase of ``n`` words begins that lies in one piece."""
        if n == 1:
            return np.arange(len(self.ids))
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: 1 - n]) if len(self.ids) >= n else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """A 64-bit hash of language and words of each phrase."""
        out = self.seed[at] + U64(n)
        for k in range(n):
            out *= U64(0xD1342543DE82EF95)
            out += self.hash[at + k]
        return arrays.mix(out)

    def distinct(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A place and the number of occurrences of each distinct (language, phrase) among ``at``: by word ids, not by hashes."""
        code = self.lang[at]
        for k in range(n):
            code = code * max(len(self.words), 1) + self.ids[at + k]
            _, first, code, counts = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        return at[first], counts


def _packed(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values one after the other; every value gets a byte in front, so none is empty."""
    sizes = np.array([len(v) + 1 for v in values], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(b"\1" + v for v in values), np.uint8), ends - sizes, ends


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"))


def masses(texts: DataFrame, longest: int, shards: int) -> tuple[np.ndarray, DataFrame]:
    """Phrase occurrences of each hash partition (a table of fixed size), and the words of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(shards, np.int64), {}
        for raw, offsets, langs in segments(batches):
            block = Block(raw, offsets, langs)
            for lang, n in zip(block.langs, block.lang_words.tolist(), strict=True):
                words[lang] = words.get(lang, 0) + n
            for n in range(1, longest + 1):
                total += np.bincount(_shard(block.keys(block.starts(n), n), shards), minlength=shards)
        rows = [(None, i, int(n)) for i, n in enumerate(total) if n] + [(x, None, n) for x, n in words.items()]
        yield pa.RecordBatch.from_pydict(
            {"lang": [r[0] for r in rows], "shard": [r[1] for r in rows], "n": [r[2] for r in rows]},
            schema=pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64())]),
        )

    found = written(texts.mapInArrow(run, "lang string, shard int, n long").groupBy("lang", "shard").agg(F.sum("n").alias("n")))
    out = np.zeros(shards, np.int64)
    for r in found.where("shard IS NOT NULL").collect():  # one row a shard
        out[r["shard"]] = r["n"]
    return out, found.where("lang IS NOT NULL").select("lang", "n")


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Partition of each key by its leading bits; there are 2, 4, 8 .. partitions."""
    return (keys >> U64(65 - shards.bit_length())).astype(np.int64)


def survivors(texts: DataFrame, longest: int, threshold: int, mass: np.ndarray, folder: str) -> None:
    """Writes the sorted hashes of all phrases that may be frequent, one file a hash partition.

    Tasks make a summary of their own for each partition, the partition's task merges them as
    they come; it holds as many counters as its capacity and one part more, whatever the number
    of phrases.
    """
    room, shards = capacities(mass, threshold), len(mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for raw, offsets, langs in segments(batches):
            block = Block(raw, offsets, langs)
            for n in range(1, longest + 1):
                keys = block.keys(block.starts(n), n)
                held.append(keys)
                size += len(keys)
            if size >= HELD:
                yield _summaries(held, room)
                held, size = [], 0
        if held:
            yield _summaries(held, room)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        whole = Summary(int(room[shard]))
        for batch in batches:
            for keys, counts, error in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "error")), strict=True):
                whole.add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64), error)
        found = whole.frequent(threshold)
        kneser_ney._write(folder, f"phrase-{shard}.keys", found.astype("<u8"))
        yield pa.RecordBatch.from_pydict({"n": [len(found)]}, schema=pa.schema([("n", pa.int64())]))

    parts = texts.mapInArrow(run, SUMMARY)
    made = written(parts.groupBy("shard").applyInArrow(merge, "n long"))
    discard(made)


def _summaries(held: list[np.ndarray], room: np.ndarray) -> pa.RecordBatch:
    keys = np.sort(np.concatenate(held))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    edges = np.searchsorted(_shard(keys, len(room)), np.arange(len(room) + 1))
    rows = []
    for i in np.flatnonzero(np.diff(edges)).tolist():
        part = Summary(int(room[i]))
        part.add(keys[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]])
        part.shrink()
        rows.append((i, part.keys.tobytes(), part.counts.astype("<u4").tobytes(), part.error))
    return pa.RecordBatch.from_pydict(
        {c: [r[i] for r in rows] for i, c in enumerate(("shard", "keys", "counts", "error"))},
        schema=pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("error", pa.int64())]),
    )


def _found(keys: np.ndarray, mapped: kneser_ney.Arrays, full: np.ndarray) -> np.ndarray:
    """Which keys are in the files of the survivors."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys)
    ranked = keys[order]
    edges = np.searchsorted(_shard(ranked, len(full)), np.arange(len(full) + 1))
    for i in np.flatnonzero(np.diff(edges) * full).tolist():
        have, mine = mapped.get(f"phrase-{i}.keys", "<u8"), ranked[edges[i] : edges[i + 1]]
        if len(have):
            out[order[edges[i] : edges[i + 1]]] = have[np.minimum(np.searchsorted(have, mine), len(have) - 1)] == mine
    return out


def counted(texts: DataFrame, longest: int, threshold: int, mass: np.ndarray, folder: str) -> DataFrame:
    """``lang, phrase, words, f`` of every phrase of 1 to ``longest`` words that occurs ``threshold`` times or more."""
    full = (mass >= threshold).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = kneser_ney.Arrays(folder)
        for raw, offsets, langs in segments(batches, 4 * BLOCK_BYTES):
            block = Block(raw, offsets, langs)
            for n in range(1, longest + 1):
                at = block.starts(n)
                at = at[_found(block.keys(at, n), mapped, full)]
                if not len(at):
                    continue
                at, counts = block.distinct(at, n)
                words = [block.words.take(pa.array(block.ids[at + k])).cast(pa.large_string()) for k in range(n)]
                phrase = pa.compute.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if n > 1 else words[0]
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.langs, pa.string()).take(pa.array(block.lang[at])), phrase.cast(pa.string()),
                    pa.array(np.full(len(at), n), pa.int32()), pa.array(counts, pa.int64()),
                ], names=["lang", "phrase", "words", "f"])

    found = texts.mapInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)


def _part(first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice("_w", first, size), " ")


def collocations(
    docs: DataFrame, shortest: int = 2, longest: int = 3, threshold: int = 10, inside: tuple[int, int] = (50, 100), top: int = 2000,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases whose words belong together most.

    Texts (A-Z lower-cased) are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks
    and tabs. All numbers are of one language: ``a`` counts a phrase of ``shortest`` to ``longest`` words, ``l``
    and ``r`` the parts of its weakest cut, ``n`` all words. The score is ``floor(1000000 a a / (l r))`` by whole
    numbers of 38 digits; the lowest of all cuts counts, ties to the shortest first part. A phrase that lies in a
    longer one with at least ``inside`` of its own count goes. Each language's first ``top`` by score, count and
    phrase are ranked from 1.

    Three passes: mass of every hash partition, Misra-Gries summaries with more than mass / threshold
    counters each, exact counts of what survives. Part counts come from the same table, since a part occurs
    at least as often as its phrase. NULL texts are empty, a NULL language is ``und``; repeated rows
    count each; texts may be of any length; an empty table gives no rows; other columns are ignored.
    """
    check_columns(docs, text_col, lang_col)
    if not 2 <= shortest <= longest or threshold < 1 or top < 1 or inside[0] < 0 or inside[1] < 1:
        raise ValueError("2 <= shortest <= longest, positive threshold and top, and a share of an inner phrase are needed")
    texts = _texts(docs, text_col, lang_col)
    letters = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = 1 << max(3, int(letters // SHARD_BYTES).bit_length())
    folder = f"{shared_dir(docs.sparkSession)}/phrases"
    mass, words = masses(texts, longest, shards)
    survivors(texts, longest, threshold, mass, folder)
    counts = written(counted(texts, longest, threshold, mass, folder))

    phrases = counts.where(F.col("words") >= shortest).select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = phrases.select("lang", "phrase", "words", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "words", "a", "k", _part(1, F.col("k")).alias("_l"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_r"))
    sides = [small(counts.where(F.col("words") < longest).select("lang", F.col("phrase").alias(f"_{s}"), F.col("f").alias(s))) for s in "lr"]
    whole = lambda c: F.col(c).cast(T.DecimalType(19, 0))
    score = F.expr("cast(1000000 AS decimal(7,0))") * (whole("a") * whole("a"))
    scored = cuts.join(sides[0], ["lang", "_l"]).join(sides[1], ["lang", "_r"]).withColumn("_p", whole("l") * whole("r")).withColumn("_s", score)
    scored = scored.withColumn("score", F.expr("cast(_s AS decimal(38,0)) div cast(_p AS decimal(38,0))"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b")).select(
        "lang", "phrase", "words", "a", "_b.l", "_b.r", "_b.score")

    inner = phrases.where(F.col("words") > shortest).select(
        "lang", "a", "words", "_w", F.explode(F.sequence(F.lit(shortest), F.col("words") - 1)).alias("m")
    ).select("lang", "a", "_w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i")).select(
        "lang", _part(F.col("i"), F.col("m")).alias("phrase"), "a"
    ).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.coalesce(inside[1] * F.col("_longer").cast("decimal(20,0)") < inside[0] * F.col("a").cast("decimal(20,0)"), F.lit(True)))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(256))).orderBy(*order)  # a large language is ranked in parts first
    near = kept.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= top).drop("_n")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(small(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
