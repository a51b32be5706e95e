"""Every pipeline stage against a plain version, on the same rows it was given."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from docspark.llm import toxicity as X
from docspark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        result = P.written(stage(spark, docs, SF))
        out.append((docs.collect(), result.collect(), result.columns))
        docs = result
    return out


def words(text, gap):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(gap, low) if w]


def test_stage_columns(steps):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]
    for _, _, columns in steps[:-1]:
        assert columns == COLUMNS


def test_rows_are_unchanged(steps):
    for before, after, _ in steps[:-1]:
        assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_toxicity(spark, steps):
    before, after, _ = steps[0]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = X.learn(docs, labels)
    matcher = X.Matcher(model.lexicon, model.exceptions)
    a, b, c = model.coefficients
    keep = set()
    for r in before:
        weight, _, n = matcher.measure(r.text or "")
        if 1 / (1 + np.exp(-(a + b * np.log1p(weight) + c * np.log1p(100 * weight / (n + 20))))) < 0.7:
            keep.add(r.doc_id)
    assert {r.doc_id for r in after} == keep


def test_toxicity_against_a_plain_learner(spark, tmp_path):
    """Planted, partly disguised words: lexicon, weights, calibration and the stage's decisions from plain counts."""
    rng = random.Random(6)
    rows = []
    for d in range(600):
        plain = [f"word{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('rstuv')}" for _ in range(rng.choice([8, 40, 300]))]
        if d % 5 == 0:
            for _ in range(rng.choice([2, 3, 4])):
                plain.insert(rng.randrange(len(plain)), rng.choice(["vileone", "grubbish"]))
        text = [w if rng.random() < 0.5 else w.replace("vileone", "V1lеone").replace("grubbish", "grubbi$h") for w in plain]
        rows.append((d, plain, " ".join(text), int(d % 5 == 0)))
    docs = spark.createDataFrame([(d, t) for d, _, t, _ in rows], "doc_id long, text string")
    spark.createDataFrame([(d, y) for d, _, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    learned = [(set(p), p, y) for d, p, _, y in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    bad = sum(y for _, _, y in learned)
    good = len(learned) - bad
    weights = {}
    for w in set().union(*[s for s, _, _ in learned]):
        t, c = sum(w in s for s, _, y in learned if y), sum(w in s for s, _, y in learned if not y)
        weight = math.log((t + 0.5) / (bad + 1)) - math.log((c + 0.5) / (good + 1))
        if weight >= 2.5:
            weights[w] = weight
    model = X.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert set(weights) == {"vileone", "grubbish"} and {k.strip(): v for k, v in model.lexicon.items()} == pytest.approx(weights)

    def features(words):
        total = sum(weights.get(w, 0) for w in words)
        return np.array([1, math.log(1 + total), math.log(1 + 100 * total / (len(words) + 20))])

    chance = lambda words: 1 / (1 + math.exp(-float(features(words) @ np.array(model.coefficients))))
    slope = sum((chance(p) - y) * features(p) for _, p, y in learned) + 0.01 * np.array(model.coefficients)
    assert np.abs(slope).max() < 1e-3 * len(learned)
    kept = {r.doc_id for r in P.toxicity(spark, docs, str(tmp_path)).collect()}
    assert kept == {d for d, p, _, _ in rows if chance(p) < 0.7} == {d for d, _, _, y in rows if not y}


def test_exact(steps):
    before, after, _ = steps[1]
    last = {}
    for r in before:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    assert {r.doc_id for r in after} == set(last.values())


def components(sets, num):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, links = defaultdict(list), set()
    for d, s in sets.items():
        for g in s:
            links.update((e, d) for e in holders[g])
            holders[g].append(d)
    for a, b in links:
        i = len(sets[a] & sets[b])
        if 100 * i >= num * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def shingles(text, n):
    w = words(text, "[ \t-\r]+")
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def test_near(steps):
    before, after, _ = steps[2]
    found = components({r.doc_id: shingles(r.text, 5) for r in before}, 80)
    assert {r.doc_id for r in after} == {d for d, root in found.items() if d == root}


def test_decontamination(spark, steps):
    before, after, _ = steps[3]
    gap = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
    items = [words(r.text, gap) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items if w for i in range(max(len(w) - 12, 1))}
    keep = set()
    for r in before:
        w, hit = words(r.text, gap), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            keep.add(r.doc_id)
    assert {r.doc_id for r in after} == keep


def test_packing(steps):
    before, after, _ = steps[4]
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    total = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before}
    have, sequences = defaultdict(int), defaultdict(list)
    for r in after:
        have[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == total
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(total.values()) // 2048) + 1


def test_whole_run(spark, steps):
    out = P.run(spark, SF)
    assert out.columns == steps[-1][2]
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, out.collect())) == sorted(map(key, steps[-1][1]))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows(spark):
    """NULL texts and ids, repeated rows and columns with clashing names pass every stage but the last with their columns."""
    rows = [(1, None, 5, "x"), (None, "some words stand here", 6, None), (2, "", 7, "y"), (3, " ", 8, "z"), (3, " ", 8, "z"), (4, "one two three", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long, `_id` string")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "kept", "_id"], name
    got = sorted(map(tuple, docs.collect()), key=str)
    # the empty texts are equal: the largest id stays; so does one of the repeated rows
    assert got == sorted([(2, "", 7, "y"), (None, "some words stand here", 6, None), (3, " ", 8, "z"), (4, "one two three", None, None)], key=str)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(packed) == 4 and len({r.sequence_id for r in packed}) == 1
