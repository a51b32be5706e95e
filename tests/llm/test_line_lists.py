"""Line duplicates: keys that lose no link, and lists of lines that share a part only."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.llm import lines as L

from .test_lines import distance, expected, mutated


@pytest.mark.parametrize(("k", "chars"), [(1, 10), (2, 10), (2, 1), (3, 5), (4, 8)])
def test_linked_lines_share_a_longer_key(spark, k, chars):
    rng = random.Random(k * 100 + chars)
    pairs = []
    for _ in range(1500):
        # lengths of every bucket and of its edges, edits anywhere and close together
        n = rng.choice([rng.randrange(1, 3 * k * chars + 3), rng.randrange(18, 70), rng.choice([63, 64, 65, 79, 80, 81, 127, 128, 160, 200])])
        a = "".join(rng.choice("abé") for _ in range(n))
        if rng.random() < 0.3:
            at = rng.randrange(n)
            b = a[:at] + mutated(rng, a[at : at + 6], rng.randrange(1, k + 1)) + a[at + 6 :]
        else:
            b = mutated(rng, a, rng.randrange(1, k + 1))
        d = distance(a, b)
        if a != b and d <= k and chars * d <= max(len(a), len(b)):
            pairs.append((len(pairs), a, b))
    assert len(pairs) > 300
    df = spark.createDataFrame(pairs, "id int, a string, b string")

    def keys(c):
        lines = df.select("id", F.col(c).alias("line"), F.length(c).alias("n"))
        return L._second_keys(L._first_keys(lines, k, chars), k).select("id", "key").distinct()

    met = {r.id for r in keys("a").join(keys("b"), ["id", "key"]).collect()}
    assert [p for p in pairs if p[0] not in met] == []


def test_lines_of_one_part_are_not_paired(spark, monkeypatch):
    rng = random.Random(8)
    start = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rest = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = [(d, start + rest(60)) for d in range(150)] + [(200 + d, rest(40) + start[:50] + rest(40)) for d in range(150)]
    rows += [(900, mutated(rng, rows[3][1], 2)), (901, mutated(rng, rows[160][1], 1))]
    paired, written = [], L.written

    def counted(df):
        table = written(df)
        if df.columns == ["a", "b"]:
            paired.append(table.count())
        return table

    monkeypatch.setattr(L, "written", counted)
    got = {r.doc_id: list(r.dropped) for r in L.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the others differ in 60 random letters and more
    assert {d for d, x in got.items() if x} == {900, 901}
    # 150 lines of one part make 11,175 pairs
    assert max(paired) < 1000


def test_other_edits_against_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([5, 6, 9, 11, 12, 15, 17, 18, 31, 32, 33, 64]))) for _ in range(25)]
    rows = [(d, "\n".join(mutated(rng, rng.choice(base), rng.randrange(5)) for _ in range(rng.randrange(1, 6)))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows, 3, 6)
    for r in L.repeated_lines(docs, k=3, chars_an_edit=6).collect():
        assert list(r.dropped) == sorted(want.get(r.doc_id, [])), r
