"""Rectangle operators on crowded pages against all pairs."""

import random

import pytest

from docspark.operators import layout

SCHEMA = "doc_id long, page_no long, pos long, x0 double, y0 double, x1 double, y1 double"


def area(r):
    return max(r[5] - r[3], 0) * max(r[6] - r[4], 0) if r[5] > r[3] and r[6] > r[4] else 0.0


def overlap(r, k):
    w, h = min(r[5], k[5]) - max(r[3], k[3]), min(r[6], k[6]) - max(r[4], k[4])
    return w * h if w > 0 and h > 0 else 0.0


def boxes(seed, n, extent, pages=2, sizes=(0.01, 0.1, 1, 7, 40, 200)):
    rng, out = random.Random(seed), []
    for i in range(n):
        s = rng.choice(sizes)
        x, y = rng.uniform(-extent, extent), rng.uniform(-extent, extent)
        out.append((1, rng.randrange(pages), i, x, y, x + s * rng.uniform(0, 2), y + s * rng.uniform(-0.1, 2)))
        if rng.random() < 0.4:  # mostly inside an earlier one
            _, p, _, a, b, c, d = rng.choice(out)
            out.append((1, p, i + 10_000, a + (c - a) * 0.05 * rng.random(), b, c, d - (d - b) * rng.choice([0, 0.02, 0.06, 0.5])))
    return [*out, out[0], (1, 0, -1, None, 0.0, 5.0, 5.0), (1, 0, -2, 0.0, 0.0, 0.0, 9.0), (2, None, 0, 0.0, 0.0, 9.0, 9.0)]


def greedy(rows, share):
    kept = []
    for r in sorted(rows, key=lambda r: (-area(r) if None not in r[3:] else -1e300, r[2], *[x or 0 for x in r[3:]])):
        if None in r[3:] or not area(r) or not any(None not in k[3:] and k[1] == r[1] and k[0] == r[0] and overlap(r, k) / area(r) >= share for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("share", [0.9, 0.4])
def test_rounds_keep_what_the_greedy_choice_keeps(spark, monkeypatch, share):
    monkeypatch.setattr(layout, "FEW", 40)
    rows = [r for r in boxes(1, 150, 90) if r[1] is not None]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, layout.suppress_contained(frame, share).collect()), key=str)  # both pages are crowded
    assert got == sorted(greedy(rows, share), key=str)
    chain = [(1, 0, i, i * 0.4, 0.0, i * 0.4 + 10 - i * 1e-6, 10.0) for i in range(100)]
    assert sorted(map(tuple, layout.suppress_contained(spark.createDataFrame(chain, SCHEMA), share).collect())) == sorted(greedy(chain, share))


def test_one_page_of_nested_rectangles(spark):
    rows = [(1, 0, i, i * 0.01, i * 0.01, 900 - i * 0.01, 900 - i * 0.01) for i in range(20_000)]
    assert [r.pos for r in layout.suppress_contained(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


@pytest.mark.parametrize("few", [0, 10_000])
def test_tables_by_tiles_and_by_pages(spark, monkeypatch, few):
    monkeypatch.setattr(layout, "FEW", few)
    rows, grids = boxes(3, 200, 100), boxes(4, 150, 100, sizes=(0.5, 3, 30, 90))
    df = lambda r: spark.createDataFrame(r, SCHEMA)
    clean = [t for t in grids if None not in t]

    def plain(test):
        return sorted((r for r in rows if not any(None not in r and t[:2] == r[:2] and test(r, t) for t in clean)), key=str)

    for share in (0.6, 0.05):
        got = sorted(map(tuple, layout.drop_blocks_in_tables(df(rows), df(grids), share).collect()), key=str)
        assert got == plain(lambda r, t: overlap(r, t) > share * area(r))
    monkeypatch.setattr(layout, "PADDING", 0)
    monkeypatch.setattr(layout, "MIN_WIDTH", -1e9)
    monkeypatch.setattr(layout, "MIN_HEIGHT", -1e9)
    monkeypatch.setattr(layout, "MIN_AREA", 0)
    monkeypatch.setattr(layout, "MAX_ASPECT", 1e9)
    inside = [r for r in rows if None not in r and r[3] >= 0 and r[4] >= 0]
    got = layout.figure_candidates(df(inside).selectExpr("*", "1e9 AS page_w", "1e9 AS page_h"), df(grids)).select(*SCHEMA.replace(",", "").split()[::2])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        (r for r in inside if not any(t[:2] == r[:2] and overlap(r, t) > 0.5 * min(area(r), area(t)) for t in clean)), key=str)
