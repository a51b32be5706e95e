"""Components of the Jaccard join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from docspark.llm import arrays
from docspark.llm import jaccard as J

from .test_pipeline import components, shingles


def near(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randrange(50)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_against_all_pairs(spark, n, num):
    rng = random.Random(n)
    rows, d = [], 0
    for _ in range(12):  # groups of near copies of many strengths, one of them large
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 9, 10, 11, 40, 120]))]
        for _ in range(rng.choice([2, 5, 40])):
            rows.append((d, " ".join(near(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05])))))
            d += 1
    common = [f"p{i}" for i in range(60)]
    for _ in range(30):  # unlike texts that share one passage
        rows.append((d, " ".join([f"u{rng.randrange(10**6)}" for _ in range(20)] + common)))
        d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, " \n\t"), (d + 3, "one"), (d + 4, "ONE"), (d + 5, "one two"), (d + 6, "y " * 20_000), (None, "one"), (d + 7, "éa éb éc")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n long")
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    want = components(sets, num)
    got = J.near_groups(docs, n, num).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r


def changed(words, places, mark):
    return [f"{mark}{i}" if i in places else w for i, w in enumerate(words)]


def families(n, rare, footer, edits):
    """Families whose smallest id links to none of the rest, or to a member of which a further set links only, and footers alone."""
    rows, end = [], [f"f{i}" for i in range(footer)]
    for f in range(6):
        base = [f"r{f}_{i}" for i in range(rare)]
        whole = base + end
        rows += [base, changed(whole, {20 + f}, f"y{f}_"), changed(whole, {90 + f}, f"z{f}_")]
    for f in range(6):
        base = [f"s{f}_{i}" for i in range(rare)] + end
        member = changed(base, edits[0], f"m{f}_")
        rows += [base, member, changed(member, edits[1], f"l{f}_")]
    rows += [[f"o{i}_{j}" for j in range(30)] + end for i in range(40)]
    return [(d, " ".join(w)) for d, w in enumerate(rows)]


@pytest.mark.parametrize(
    ("n", "num", "rare", "footer", "edits"),
    [(3, 90, 178, 24, ({30, 60}, {100, 130})), (5, 80, 154, 50, ({20, 50, 80}, {35, 65, 100}))],
)
def test_links_beside_the_smallest_id(spark, n, num, rare, footer, edits):
    rows = families(n, rare, footer, edits)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingles(t, n) for d, t in rows}
    want = components(sets, num)
    for f in range(0, 18, 3):
        assert [want[d] - f for d in (f, f + 1, f + 2)] == [0, 1, 1]
        assert 100 * len(sets[f + 18] & sets[f + 20]) < num * len(sets[f + 18] | sets[f + 20]) and want[f + 20] == f + 18
    assert {r.doc_id: r.component_id for r in J.near_groups(docs, n, num).collect()} == want
    assert {r.doc_id for r in J.drop_near(docs, n, num).collect()} == {d for d, root in want.items() if d == root}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v")], "doc_id long, text string")
    assert {r.component_id for r in J.near_groups(docs).collect()} == {1}
    assert sorted(r.doc_id for r in J.drop_near(docs).collect()) == [1, 1]
    assert J.near_groups(docs.limit(0)).count() == 0
    for bad in ({"words": 0}, {"num": 0}, {"num": 101}):
        with pytest.raises(ValueError):
            J.near_groups(docs, **bad)


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["ab c", "c ab", None, "", "  ab\tab ", "é ü", "abc"]
    raw, offsets = arrays.flat(pa.array(texts))
    starts, ends, counts = arrays.spans(raw, offsets, arrays.BLANKS)
    assert counts.tolist() == [len((t or "").split()) for t in texts]
    seen = defaultdict(set)
    words = [w for t in texts for w in (t or "").split()]
    for w, h in zip(words, arrays.hashes(raw, starts, ends).tolist(), strict=True):
        seen[w].add(h)
    assert all(len(h) == 1 for h in seen.values()) and len({h for s in seen.values() for h in s}) == len(seen)
    grams, each = arrays.grams(arrays.hashes(raw, starts, ends), counts, 2)
    assert each.tolist() == [1, 1, 0, 0, 1, 1, 1] and len(np.unique(grams)) == len(grams)
