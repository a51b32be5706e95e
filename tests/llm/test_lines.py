"""Line duplicates against a plain comparison of all lines."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docspark.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def expected(rows, k=2, chars=10):
    """Dropped line numbers of each (id, text)."""
    stand = [(d, n, x) for d, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    texts = sorted({x for _, _, x in stand})
    parent = {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if abs(len(a) - len(b)) <= k and max(len(a), len(b)) >= chars:
            d = distance(a, b)
            if d <= k and chars * d <= max(len(a), len(b)):
                parent[find(a)] = find(b)
    first, dropped = {}, {}
    for d, n, x in sorted(stand, key=lambda s: (s[0] is None, s[0] or 0, s[1])):
        c = find(x)
        if first.setdefault(c, (d, n)) != (d, n):
            dropped.setdefault(d, []).append(n)
    return dropped


def mutated(rng, line, edits):
    for _ in range(edits):
        i = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        line = line[:i] + ("" if kind == 0 else rng.choice("abcé ")) + line[i + (kind != 1) :]
    return line


def test_distance_within_band(spark):
    rng = random.Random(3)
    pairs = [(a := "".join(rng.choice("abé") for _ in range(rng.randrange(0, 12))), mutated(rng, a, rng.randrange(5))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        got = df.select("a", "b", L.edit_distance_within(F.col("a"), F.col("b"), k).alias("d")).collect()
        for r in got:
            assert r.d == min(distance(r.a, r.b), k + 1), (r, k)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([4, 9, 10, 12, 19, 20, 33, 60]))) for _ in range(40)]
    rows = []
    for d in range(120):
        picked = [mutated(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randrange(0, 6))]
        rows.append((d, "\n".join(picked)))
    rows += [(500, None), (501, ""), (502, "\n \n"), (503, "x" * 900), (504, "x" * 899 + "y")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, dropped int")
    want = expected(rows)
    for r in L.repeated_lines(docs).collect():
        assert list(r.dropped) == sorted(want.get(r.doc_id, [])), r
    clean = {r.doc_id: r for r in L.drop_lines(docs, L.repeated_lines(docs)).collect()}
    for d, t in rows:
        left = [x for n, x in enumerate((t or "").split("\n")) if n not in want.get(d, [])]
        assert (clean[d].text or "") == "\n".join(left) and clean[d].dropped == 1


def test_edges(spark):
    line = "a line that is long enough to be compared"
    rows = [(None, line), (3, line), (3, line), (4, line + "!\n\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id): list(r.dropped) for r in L.repeated_lines(docs).collect()}
    assert got == {None: [0], 3: [], 4: [0, 2]}
    assert L.repeated_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.repeated_lines(docs, k=0)
    with pytest.raises(ValueError):
        L.repeated_lines(docs.drop("text"))
