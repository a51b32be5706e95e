"""Dyadic intervals and the cell operators that stand on them, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.functions import intervals as IV
from docspark.operators import cells as C

CELLS = "sheet STRING, row LONG, col LONG, value STRING, num DOUBLE, type STRING"


def test_cover_is_the_range_and_short(spark):
    rng = random.Random(1)
    pairs = [(a, a + rng.choice([-1, 0, 1, 5, 100, 5000])) for a in [*range(9), *(rng.randrange(1 << 20) for _ in range(60))]] + [(1, 1_048_576), (0, (1 << 40) - 1)]
    rows = spark.createDataFrame(pairs, "lo long, hi long").select("lo", "hi", IV.cover(F.col("lo"), F.col("hi")).alias("c")).collect()
    for r in rows:
        spans = sorted((p["at"] << p["level"], (p["at"] + 1) << p["level"]) for p in r.c)
        assert len(spans) <= 2 * max(r.hi - r.lo + 1, 1).bit_length()
        if r.hi < r.lo:
            assert not spans
        else:
            assert spans[0][0] == r.lo and spans[-1][1] == r.hi + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def grid(seed, n):
    rng = random.Random(seed)
    spots = sorted({(rng.choice("ab"), rng.randrange(1, 60), rng.randrange(1, 9)) for _ in range(n)})
    return [(s, r, c, rng.choice(["v", "", " ", None, f"{r}-{c}"]), None, "str") for s, r, c in spots]


@pytest.mark.parametrize("few", [2, 64])
def test_rules_of_crowded_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_RULES", few)
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)
    rng, cells = random.Random(3), grid(2, 300)
    rules = [(i, rng.choice("abc"), r, c, r + rng.choice([0, 3, 30, 1_048_575]), c + rng.randrange(3), f"t{i % 4}")
             for i in range(40) for r, c in [(rng.randrange(1, 60), rng.randrange(1, 9))]]
    frame = spark.createDataFrame(rules, "rule_no long, sheet string, r0 long, c0 long, r1 long, c1 long, validation_type string")
    got = sorted((r.sheet, r.row, r.col, r.rule_no, r.validation_type) for r in C.validation_for_cells(spark.createDataFrame(cells, CELLS), frame).collect())

    def first(s, r, c):
        hit = [x for x in rules if x[1] == s and x[2] <= r <= x[4] and x[3] <= c <= x[5]]
        return (hit[0][0], hit[0][6]) if hit else (None, None)

    assert got == sorted((s, r, c, *first(s, r, c)) for s, r, c, *_ in cells)


def test_merged_ranges_are_filled(spark):
    cells = grid(5, 250)
    merges = [("a", 3, 2, 7, 4), ("a", 10, 1, 10, 8), ("b", 1, 1, 40, 1), ("b", 50, 3, 59, 8), ("c", 1, 1, 2, 2), ("a", 20, 5, 20, 5)]
    have = {(s, r, c): v for s, r, c, v, _, _ in cells}
    want = dict(have)
    blank = lambda v: v is None or not v.strip()
    for s, r0, c0, r1, c1 in merges:
        if not blank(have.get((s, r0, c0))):
            want |= {(s, r, c): have[s, r0, c0] for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if blank(have.get((s, r, c)))}
    got = C.fill_merged(spark.createDataFrame(cells, CELLS), spark.createDataFrame(merges, "sheet string, r0 long, c0 long, r1 long, c1 long")).collect()
    assert sorted((r.sheet, r.row, r.col, r.value or "") for r in got) == sorted((*k, v or "") for k, v in want.items())
