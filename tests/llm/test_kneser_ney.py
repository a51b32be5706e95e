"""Language model against a plain count of the same texts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docspark.llm import kneser_ney as K

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[ \t-\r]+", low) if w] + [None]


class Plain:
    def __init__(self, texts):
        self.count = Counter(t for x in texts for t in tokens(x))
        self.pairs = Counter(p for x in texts for p in zip(["<s>", *tokens(x)], tokens(x)))
        self.total, self.after, self.before = Counter(), defaultdict(Counter), Counter()
        for (a, b), c in self.pairs.items():
            self.total[a] += c
            self.after[a][min(c, 3)] += 1
            self.before[b] += 1
        of = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        self.d = (0, *K.discounts(of(list(self.pairs.values()))))
        self.e = (0, *K.discounts(of(list(self.before.values()))))
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.rest = sum(self.e[min(c, 3)] for c in self.before.values()) / len(self.pairs)

    def low(self, w):
        t = len(self.pairs)
        return max(self.before[w] - self.e[min(self.before[w], 3)], 0) / t + self.rest / (self.v + 1)

    def p(self, a, w):
        if not self.total[a]:
            return self.low(w)
        rest = sum(self.d[k] * n for k, n in self.after[a].items()) / self.total[a]
        c = self.pairs[a, w]
        return max(c - self.d[min(c, 3)], 0) / self.total[a] + rest * self.low(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(a, w)) for a, w in zip(["<s>", *t], t))

    def base(self, text):
        return sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))


def test_query_against_plain_count(spark):
    from docspark.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r for r in QUERIES["op2_lm_scoring"](spark, SF).collect()}
    assert out.keys() == docs.keys()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    plain = Plain([t for d, t in docs.items() if not held[d]])
    for d, text in docs.items():
        r = out[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(tokens(text)), plain.n)
        assert r.n_known == sum(plain.count[t] > 0 for t in tokens(text))
        assert r.base_score == pytest.approx(plain.base(text), rel=1e-9)
        assert r.score == pytest.approx(plain.score(text), rel=1e-5)
    known = [r for r in out.values() if not r.held_out]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_probabilities_sum_to_one():
    plain = Plain(["a b a c", "b a", "c c d e f a b", ""])
    for a in ["<s>", "a", "c", "f", "unseen"]:
        assert sum(plain.p(a, w) for w in [*plain.count, "unseen"]) == pytest.approx(1.0)


def test_pair_keys_can_be_undone():
    left, right = np.array([0, 1, 7, 2**32 - 1]), np.array([5, 0, 2**31, 3])
    a, b = K.unpair(K.pair(left, right))
    assert (a == left).all() and (b == right).all()


def test_edge_cases(spark):
    rows = [(1, "A b  a\n b"), (1, "A b  a\n b"), (2, None), (3, ""), (None, "a zz"), (4, " \t "), (5, "x" * 5000 + " y" * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    model = K.train(docs.where("doc_id < 5"))
    got = K.score(docs, model).collect()
    assert len(got) == len(rows)
    plain = Plain([t for d, t in rows if d is not None and d < 5])
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id)
        assert r.score == pytest.approx(plain.score(text), rel=1e-5)
    assert K.score(docs.limit(0), model).count() == 0
    empty = K.train(docs.limit(0))
    assert all(r.n_known == 0 and r.score < 0.0001 for r in K.score(docs, empty).collect())
    with pytest.raises(ValueError):
        K.train(docs.drop("text"))
