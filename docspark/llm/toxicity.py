"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton after folding disguises."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .common import check_columns, discard, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ѐ": "e", "ё": "e", "ї": "i",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "ց": "g",
}
# Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
# Harmless phrases that hold words often found in lexicons.
EXCEPTIONS = (
    "class clown", "clown fish", "circus clown", "trash can", "trash bin", "trash bag", "sore loser", "pond scum", "soap scum",
    "idiot proof", "village idiot", "stupid simple",
)

_HOMOGLYPH = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_FOREIGN = str.maketrans(HOMOGLYPHS)
_RARE = re.compile("[ -￿]")
_DISGUISE = re.compile(r"(?:(?<=[^\W\d_])[0134578 9]+(?=[^\W\d_])|[0-9@$!|€£]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9]+)".replace(" ", ""))
_PLAIN = str.maketrans(DIGITS | SIGNS)
_TO_BLANK = str.maketrans({chr(c): " " for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0xC0))})

#: Text worked on at once, and entries that a task counts before it sends them on.
BLOCK_BYTES, HELD_ENTRIES = 1_000_000, 300_000
#: Orders of shingles whose first ones must all agree before two texts count as near copies.
ORDERS = (0x0, 0x9E37, 0x79B9, 0x7F4A)


def fold(text: str) -> str:
    """Lower case, look-alike letters as Latin ones, digits and signs inside words as letters, other signs as blanks.

    Every word of the result follows one blank or more; digits next to a letter count as
    letters, a sign only before one.
    """
    text = text.lower()
    if not text.isascii():
        if _RARE.search(text):
            text = unicodedata.normalize("NFKC", text)
        if _HOMOGLYPH.search(text):
            text = text.translate(_FOREIGN)
    if _DISGUISE.search(text):
        text = _DISGUISE.sub(lambda m: m[0].translate(_PLAIN), text)
    return f" {text.translate(_TO_BLANK)} "


@dataclass
class Model:
    """``lexicon``: entries (" stem" matches words that begin so, " word " whole words) and their weights."""

    lexicon: dict[str, float]
    coefficients: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    """Sum of weights, hits and words of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            key = fold(phrase)
            if key not in lexicon:
                self.automaton.add_word(key, (len(key), None))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def measure(self, text: str) -> tuple[float, int, int]:
        folded = fold(text)
        words = len(folded.split())
        if not self.any:
            return 0.0, 0, words
        found = [(end - length + 1, end, weight) for end, (length, weight) in self.automaton.iter(folded)]
        if not found:
            return 0.0, 0, words
        harmless = [(a, b) for a, b, w in found if w is None]
        best: dict[int, float] = {}  # a word counts once, by its heaviest entry
        for a, b, w in found:
            if w is not None and not any(x <= a and b - 1 <= y for x, y in harmless):
                best[a] = max(w, best.get(a, 0.0))
        return sum(best.values()), len(best), words


def _measured(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with ``_weight``, ``_hits`` and ``_words``."""
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("_weight double, _hits long, _words long").fields])
    lexicon, exceptions = model.lexicon, model.exceptions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in arrays.pieces_of(batches, text_col, BLOCK_BYTES):
            rows = [matcher.measure(t or "") for t in batch.column(text_col).to_pylist()]
            weight, hits, words = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(weight, pa.float64()), pa.array(hits, pa.int64()), pa.array(words, pa.int64())], names=schema.names
            )

    return docs.mapInArrow(run, schema)


def _inputs(weight, words):
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100.0 * weight / (words + 20.0))], axis=1)


def score_column(model: Model, weight: Column, words: Column) -> Column:
    a, b, c = model.coefficients
    z = F.lit(a) + F.lit(b) * F.log1p(weight) + F.lit(c) * F.log1p(100.0 * weight / (words + 20.0))
    return 1.0 / (1.0 + F.exp(-z))


def held_out(id_col: str = "doc_id", folds: int = 3, fold_no: int = 1) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold_no, F.lit(False))


def _unlike(sample: DataFrame) -> DataFrame:
    """``_text, _toxic`` of the sample, of near copies one.

    Texts of one label are near copies when their first three-word shingles are the same in each of several
    orders; one passage in common is not enough for that.
    """
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces_of(batches, "_text", BLOCK_BYTES):
            raw, offsets = arrays.flat(batch.column("_text"))
            starts, ends, counts = arrays.spans(arrays.LOWER[raw], offsets, arrays.BLANKS)
            grams, each = arrays.grams(arrays.hashes(arrays.LOWER[raw], starts, ends), counts, 3)
            full = each > 0
            least = np.zeros(len(each), np.uint64)
            for order in ORDERS if full.any() else ():
                firsts = np.minimum.reduceat(arrays.mix(grams ^ np.uint64(order)), (np.cumsum(each) - each)[full])
                least[full] = arrays.mix(least[full] ^ firsts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_text"), batch.column("_toxic"), pa.array(least.view(np.int64))], names=["_text", "_toxic", "_sketch"]
            )

    return sample.mapInArrow(sketch, "_text string, _toxic int, _sketch long").groupBy("_toxic", "_sketch").agg(F.max("_text").alias("_text")).select("_text", "_toxic")


def _features(texts: DataFrame, shortest: int, longest: int) -> DataFrame:
    """How many toxic and clean texts hold a whole word, or a word that begins with a stem."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())],
                names=["entry", "toxic", "clean"],
            )

        for batch in arrays.pieces_of(batches, "_text", BLOCK_BYTES):
            for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                entries = set()
                for word in set(fold(text or "").split()):
                    entries.add(f" {word} ")
                    entries.update(f" {word[:n]}" for n in range(shortest, min(longest, len(word)) + 1))
                seen[toxic].update(entries)
                if len(seen[0]) + len(seen[1]) > HELD_ENTRIES:
                    yield out()
                    seen = (Counter(), Counter())
        yield out()

    return texts.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _critical(level: float, tests: int) -> float:
    """What a likelihood ratio (twice its logarithm, one degree of freedom) passes in one of so many tests by chance, at that level."""
    return NormalDist().inv_cdf(level / max(tests, 1) / 2) ** 2


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = 30_000, shortest: int = 4, longest: int = 8, entries: int = 2_000, level: float = 0.01,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """Lexicon, weights and calibration from labelled rows outside the held-out third.

    At most about ``sample_rows`` labelled rows are used (all, when there are fewer), chosen by
    a hash of the id; the lexicon holds at most ``entries`` entries, the ones with the most
    evidence. An entry is a whole word or a stem; its weight is the logarithm of the odds of toxic
    against clean texts that hold it, and it is taken when the likelihood ratio of its counts is
    significant at ``level`` over all entries seen, however many labels there are. Of nested stems the longest that stands in nearly all texts of the shorter
    ones is taken. Rows with
    NULL id or label are not used. Without toxic or clean rows the lexicon is empty.
    """
    check_columns(docs, id_col, text_col)
    check_columns(labels, id_col, label_col)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(
        F.col(id_col).alias("_lid")).agg(F.max(label_col).cast("int").alias("_toxic"))
    parts = 1_000_000
    total = usable.count()
    share = parts if total <= sample_rows else sample_rows * parts // total
    chosen = usable.where(F.pmod(F.xxhash64("_lid"), F.lit(parts)) < share)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("_lid")  # bounded by sample_rows
    ).select("_text", "_toxic").persist()
    texts = written(_unlike(sample))
    sizes = {r["_toxic"]: r["count"] for r in texts.groupBy("_toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        sample.unpersist()
        discard(texts)
        return Model({}, (-4.0, 0.0, 0.0), exceptions)
    counts = written(_features(texts, shortest, longest))
    least = _critical(level, counts.count())
    t, c = F.col("toxic"), F.col("clean")
    base = bad / (bad + good)
    odds = F.log((t + 0.5) / (bad + 1.0)) - F.log((c + 0.5) / (good + 1.0))
    rate = t / (t + c)
    term = lambda n, p, q: F.when(n > 0, n * F.log(p / q)).otherwise(0.0)
    ratio = 2 * (term(t, rate, F.lit(base)) + term(c, 1 - rate, F.lit(1 - base)))
    found = (
        counts.withColumn("weight", odds).withColumn("evidence", ratio)
        .where((F.col("evidence") >= least) & (F.col("weight") >= 2.5))
        .orderBy(F.desc("evidence"), "entry").limit(entries).collect()
    )
    lexicon = _closed({r["entry"]: (r["toxic"], r["weight"]) for r in found}, shortest)
    model = Model(lexicon, (-4.0, 0.0, 0.0), exceptions)
    # at most sample_rows rows of three numbers
    rows = _measured(sample, model, "_text").select("_weight", "_words", "_toxic").toPandas()
    sample.unpersist()
    discard(texts, counts)
    model.coefficients = _logistic(_inputs(rows["_weight"].to_numpy(float), rows["_words"].to_numpy(float)), rows["_toxic"].to_numpy(float))
    return model


def _closed(found: dict[str, tuple[int, float]], shortest: int) -> dict[str, float]:
    """Weights without the stems that a longer entry replaces, and without entries that add little to a stem.

    A longer entry replaces its stem when it stands in nine of ten of the stem's toxic texts:
    of "idio", "idiot" and the word itself only the word is left.
    """
    stems = lambda e: [e.rstrip()[:n] for n in range(shortest + 1, len(e)) if e.rstrip()[:n] != e]
    replaced = {s for e, (toxic, _) in found.items() for s in stems(e) if s in found and toxic >= 0.9 * found[s][0]}
    lexicon: dict[str, float] = {}
    for entry in sorted(found.keys() - replaced, key=lambda e: (len(e), e)):
        weight = found[entry][1]
        if not any(lexicon.get(s, 0.0) >= weight - 1.0 for s in stems(entry) if s in lexicon):
            lexicon[entry] = weight
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> tuple[float, float, float]:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= threshold), ``hits`` and ``n_words``.

    Only the text makes the score. NULL and empty texts have no hits and a low score; whole
    texts are read; repeated rows score alike; a NULL id is not held out; an empty table gives
    an empty result; other columns are ignored.
    """
    check_columns(docs, id_col, text_col)
    rows = _measured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    s = score_column(model, F.col("_weight"), F.col("_words"))
    return rows.select(
        F.col("_id").alias(id_col), held_out("_id").alias("held_out"), s.alias("score"),
        (s >= threshold).cast("int").alias("predicted"), F.col("_hits").alias("hits"), F.col("_words").alias("n_words"),
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one pass without a shuffle."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # columns of docs may have any name
    plain = docs.toDF(*names)
    kept = _measured(plain, model, names[docs.columns.index(text_col)]).where(
        score_column(model, F.col("_weight"), F.col("_words")) < threshold
    )
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
