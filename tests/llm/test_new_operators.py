"""Collocations, vector codes and repeated passages against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docspark.llm import arrays, codebooks, collocations, repeats

# ---- collocations --------------------------------------------------------


def plain_collocations(rows, threshold, longest, top):
    f, n, found = Counter(), Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    for key, a in f.items():
        if a >= threshold and len(key) > 2:
            lang, words = key[0], key[1:]
            cuts = [((1_000_000 * a * a) // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            longer = [b for other, b in f.items() if b >= threshold and other[0] == lang and len(other) > len(key)
                      and any(other[i : i + len(words)] == words for i in range(1, len(other) - len(words) + 1))]
            if not any(100 * b >= 50 * a for b in longer):
                found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s)
                  for lang, each in found.items() for i, (s, a, p, left, right) in enumerate(sorted(each)[:top], 1))


def test_collocations_against_plain_counts(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["a", "b", "Cé", "d1", "e", "日本", "ff", "G", "h", "x-y"]
    rows = [(" ".join(rng.choices(vocabulary, weights=[9, 7, 5, 3, 2, 2, 1, 1, 1, 1], k=rng.randrange(0, 60))).replace(" e ", ". ").replace(" h ", "\t\tH\n"),
             rng.choice(["en", "de", None, ""])) for _ in range(300)]
    rows += [(None, "en"), ("", "fr"), (" .,;\n", "fr"), ("one", "fr")] + [("New York City hall. new york city hall", "en")] * 12
    rows += [(" ".join(["long piece of words"] * 400) + "! " + "p q. " * 3000, "long")]
    frame = spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "lang", "1 AS n", "2 AS phrase")
    for longest, top, block in ((3, 2000, 1_000_000), (3, 7, 500), (4, 2000, 1_000_000)):
        monkeypatch.setattr(collocations, "HELD", 2_000)
        monkeypatch.setattr(collocations.segments, "__defaults__", (block,))
        got = sorted(map(tuple, collocations.collocations(frame, longest=longest, top=top).collect()))
        assert got == plain_collocations(rows, 10, longest, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], "text string, lang string"), shortest=1)


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.integers(0, 5_000, 30_000), np.repeat(np.arange(10_000, 10_050), 40)]).astype(np.uint64)
    rng.shuffle(keys)
    truth, threshold = Counter(keys.tolist()), 20
    capacity = len(keys) // threshold + 1
    parts = []
    for piece in np.array_split(keys, 7):  # summaries of their own, then merged
        part = collocations.Summary(capacity)
        for few in np.array_split(piece, 5):
            k, c = np.unique(few, return_counts=True)
            part.add(k, c)
        part.shrink()
        parts.append(part)
    whole = collocations.Summary(capacity)
    for part in parts:
        whole.add(part.keys, part.counts, part.error)
    found = set(whole.frequent(threshold).tolist())
    assert whole.error < threshold and len(whole.keys) <= capacity
    assert {k for k, n in truth.items() if n >= threshold} <= found
    assert all(truth[k] - whole.error <= n <= truth[k] for k, n in zip(whole.keys.tolist(), whole.counts.tolist(), strict=True))


# ---- vector codes --------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[[math.floor(int(x) * 4096 if abs(x) > 2**52 else x * 4096) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(c[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), d, by_label[label], sha) for (i, _, label), f, d in zip(kept, found, errors, strict=True)), key=str)


def vectors(seed, n, dims, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(9)]
    return [(i, [rng.choice(c) if rng.random() < 0.1 else x + rng.gauss(0, spread / 9) for x in c], rng.choice([1, 2, None]))
            for i in range(n) for c in [rng.choice(centres)]]


@pytest.mark.parametrize("rows", [
    vectors(1, 400, 16) + [(None, [0.5] * 16, 3), (3, [0.25] * 16, 1), (900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] * 16, 1),
                           (903, [float("inf")] * 16, 2), (904, [1.0] * 8, 2), (905, [], 2)],
    [(i, [float((i * 7 + k) % 3) for k in range(8)], i % 2) for i in range(120)],  # ties everywhere
    vectors(2, 7, 8), vectors(3, 1, 8), vectors(4, 60, 8, 3e12), [(i, [0.5] * 8, None) for i in range(40)],
])
def test_codes_against_plain_rounds(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "1 AS error")
    got, _ = codebooks.encode(frame.repartition(3))
    want = plain_codes(rows)
    if any(w[2] >= 1 << 63 or w[3] >= 1 << 63 for w in want):  # errors beyond a long
        fits = lambda x: x if x < 1 << 63 else None
        want = [(i, c, fits(e), None, s) for i, c, e, _, s in want]
        assert sorted(map(lambda r: (r[0], r[1], r[2], None, r[4]), got.collect()), key=str) == sorted(want, key=str)
    else:
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_codes_of_nothing_and_of_odd_lengths(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codebooks.encode(spark.createDataFrame([], schema))[0].count() == 0
    assert codebooks.encode(spark.createDataFrame([(1, None, 1)], schema))[0].count() == 0
    with pytest.raises(ValueError):
        codebooks.encode(spark.createDataFrame([(1, [1.0] * 9, 1)], schema))


def test_bounds_spare_most_distances():
    """After the first round the bounds settle most parts, and what they keep never loses the nearest entry."""
    rng = np.random.default_rng(0)
    parts, table = rng.integers(-3000, 3000, (2000, 8)), rng.integers(-3000, 3000, (16, 8))
    bounds = codebooks.Bounds.fresh(parts, table, 4)
    for keep in (4, 4, 3, 2):
        new = table + rng.integers(-40, 40, table.shape)
        bounds.move(np.sqrt(((new - table) ** 2).sum(1).astype(float)) * (1 + codebooks.SLACK))
        table = new
        bounds.assign(parts, table, keep)
        assert (bounds.order[:, 0] == codebooks.squared(parts, table).argmin(1)).all() and bounds.lower.shape[1] == keep
    far = np.sqrt(codebooks.squared(parts, table))
    assert (np.take_along_axis(far, bounds.order[:, 1:].astype(int), 1) >= bounds.lower - 1e-6).all()


# ---- repeated passages ---------------------------------------------------


def plain_repeats(rows, size):
    words = [(i, [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - size + 1) for j in range(size) if i is not None and first[tuple(w[k : k + size])] < i}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 2, 5, 13])
def test_repeats_against_all_windows(spark, monkeypatch, size):
    rng = random.Random(size)
    base = [" ".join(rng.choices(["alpha", "b", "Ünï", "日本", "dd", "e"], k=rng.randrange(0, 90))) for _ in range(40)]
    rows = [(i, rng.choice(base)[: rng.randrange(5, 400)] + "\n\t" + rng.choice(base)) for i in range(120)]
    rows += [(5, base[0]), (5, base[0]), (5, base[1]), (None, base[0]), (None, None), (-7, base[2] + " " + base[2]), (200, None), (201, ""), (202, " \n ")]
    rows += [(300 + i, "one passage that every document has " * 4) for i in range(30)] + [(999, "w " * 3000), (1000, "w " * 4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS _text")
    monkeypatch.setattr(repeats, "HELD", 1500)
    monkeypatch.setattr(repeats, "HELD_FOUND", 700)
    got = sorted(map(tuple, repeats.drop_repeats(frame.repartition(4), size=size).collect()), key=str)
    assert got == plain_repeats(rows, size)


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.drop_repeats(empty).count() == 0
    only = spark.createDataFrame([(1, None), (None, "a b")], "doc_id int, text string")
    assert sorted(map(tuple, repeats.drop_repeats(only, with_text=False).select("doc_id", "n_words", "n_removed").collect()), key=str) == [(1, 0, 0), (None, 2, 0)]
    with pytest.raises(ValueError):
        repeats.drop_repeats(empty, size=0)


def test_repeats_in_several_parts(spark, monkeypatch):
    """Windows dealt over parts of the sketch, whose two rows lie in one part; cells that many windows share lose nothing."""
    rng = random.Random(4)
    base = [" ".join(rng.choices(["alpha", "b", "Ünï", "dd", "e", "ff"], k=60)) for _ in range(30)]
    rows = [(i, rng.choice(base)[: rng.randrange(5, 300)] + " \t" + " ".join(rng.choices("uvwxyz", k=rng.randrange(200)))) for i in range(150)]
    monkeypatch.setattr(repeats.Layout, "of", classmethod(lambda cls, cells: cls(5, 16)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, repeats.drop_repeats(frame.repartition(3), size=4).collect()), key=str)
    assert got == plain_repeats(rows, 4)


def test_parts_do_not_grow_with_the_corpus():
    """A pass goes over the parts in each block of text, so a corpus of ten times the size has larger parts, not ten times as many."""
    for cells in (0, 1 << 20, 1 << 28, 1 << 29, 5 << 30, 1 << 33, 1 << 40):
        layout = repeats.Layout.of(cells)
        assert layout.part_bits + layout.cell_bits >= cells.bit_length() and 22 <= layout.cell_bits <= 26
        assert layout.parts <= 128 or layout.cell_bits == 26
    keys = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    layout = repeats.Layout(5, 22)
    assert np.array_equal(layout.part(keys), [int(k) >> 59 for k in keys])
    assert [layout.cell(keys[7:8], row)[0] for row in (0, 1)] == [int(keys[7]) >> 37 & 0x3FFFFF, int(keys[7]) & 0x3FFFFF]


def test_hashes_of_runs_in_any_slice():
    """A run's hash is that of its bytes, wherever it stands and whichever slice it begins in."""
    runs = [b"a", b"x" * 70_000, b"bc", b"", b"a", "é".encode() * 40_000, b"bc", b"x" * 70_000, b"a"]
    raw = np.frombuffer(b" ".join(runs), np.uint8)
    sizes = np.array([len(r) for r in runs])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    whole = arrays.hashes(raw, starts, starts + sizes).tolist()
    alone = [arrays.hashes(np.frombuffer(r, np.uint8), np.array([0]), np.array([len(r)]))[0] for r in runs if r]
    assert [h for h, r in zip(whole, runs, strict=True) if r] == alone and len(set(whole)) == 5


def test_first_halves_that_agree_are_sorted_by_the_second():
    made = repeats._first_docs(*(np.array(x, kind) for x, kind in (
        ([7, 5, 7, 7, 5], np.uint64), ([2, 1, 1, 2, 1], np.uint64), ([30, 4, 9, 20, 4], np.int64), ([0, 0, 0, 0, 0], bool))))
    assert [x.tolist() for x in made] == [[5, 7, 7], [1, 1, 2], [4, 9, 20], [False, False, True]]


def test_windows_of_different_halves_are_apart():
    """Entries that share the first half of their key are told apart by the second."""
    class Mapped:
        def get(self, name, kind):
            return {"k1": np.array([5, 7, 7, 7, 9], np.uint64), "k2": np.array([1, 2, 3, 4, 1], np.uint64), "low": np.array([10, 20, 30, 40, 50])}[name.split(".")[1]]

    asked = np.array([7, 9, 7, 7, 5, 8], np.uint64), np.array([3, 2, 4, 9, 1, 1], np.uint64)
    none = np.iinfo(np.int64).max
    assert repeats.first_docs(*asked, Mapped(), np.array([True])).tolist() == [30, none, 40, none, 10, none]
