"""Radix partitioning against grouping by the text itself."""

import hashlib
import random

import pytest

from docspark.llm import exact as E


def test_groups_and_edges(spark):
    rng = random.Random(2)
    base = ["", "a", "é" * 40, "b" * 70, "b" * 69 + "c", "long " * 9000, "long " * 8999 + "lang "]
    texts = [rng.choice(base) for _ in range(200)] + [None, None, "x" * 64, "x" * 65, "x" * 64 + "y"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "kept") for i, t in zip(ids, texts)] + [(None, "a", "n"), (None, "alone", "n"), (7000, "same", "r"), (7000, "same", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for first, growth in ((1, 3), (64, 32)):
        got = E.exact_groups(docs, first_bytes=first, growth=growth).collect()
        groups = {}
        for i, t, _ in rows:
            groups.setdefault(t or "", []).append(i)
        assert len(got) == len(rows)
        by_sha = {}
        for r in got:
            by_sha.setdefault(r.text_sha256, []).append(r)
        for t, members in groups.items():
            mine = by_sha.pop(hashlib.sha256(t.encode()).hexdigest())
            best = max((i for i in members if i is not None), default=None)
            assert {r.keep_id for r in mine} == {best} and {r.group_size for r in mine} == {len(members)}
            assert [r.doc_id for r in mine if r.kept] == [best]
        assert not by_sha
    kept = E.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert E.exact_groups(docs.limit(0)).count() == 0
    assert E.exact_groups(docs.where("doc_id IS NULL")).count() == 2
    with pytest.raises(ValueError):
        E.exact_groups(docs.drop("text"))
