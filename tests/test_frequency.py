"""Most frequent values: the bound of the fullest buckets against a plain count."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from docspark.operators import rollup


def ranked(df, value, limit, **options):
    return [(r["value"], r["count"]) for r in rollup.frequency_rank(df, value, limit, **options).collect()]


def plain(values, limit):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:limit]


@pytest.mark.parametrize("buckets", [1, 3, 16, 1 << 16])
@pytest.mark.parametrize("limit", [1, 4, 9, 500])
def test_rank_equals_a_plain_count(spark, buckets, limit):
    # one hot value, many ties, some NULLs; few buckets put rare values beside frequent ones
    values = ["hot"] * 400 + [f"v{i % 37}" for i in range(370)] + [f"r{i}" for i in range(90)] + [None] * 50 + ["", "", " "]
    df = spark.createDataFrame([(v, "x") for v in values], "v STRING, count STRING").repartition(5)
    assert ranked(df, F.col("v"), limit, buckets=buckets) == plain(values, limit)


def test_frequent_values_in_thin_buckets_are_found(spark):
    # the fullest buckets are full of rare values only
    home = {i: (spark.range(1).select(F.pmod(F.xxhash64(F.lit(i)), F.lit(8))).first()[0]) for i in range(60)}
    crowd = max(set(home.values()), key=list(home.values()).count)
    values = [i for i in home if home[i] == crowd for _ in range(9)] + [i for i in home if home[i] != crowd for _ in range(10 + i % 3)]
    df = spark.createDataFrame([(v,) for v in values], "v INT")
    assert ranked(df, F.col("v"), 1, buckets=8) == plain(values, 1)
    assert ranked(df, F.col("v"), 25, buckets=8) == plain(values, 25)


def test_empty_and_floating_values(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,)], "v DOUBLE")
    assert ranked(df, F.col("v"), 3) == [(0.0, 2), (1.5, 1)]
    assert ranked(df.limit(0), F.col("v"), 3) == []
    with pytest.raises(ValueError):
        rollup.frequency_rank(df, F.col("v"), 0)


def test_nothing_is_read_for_buckets_below_the_bound(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 10).otherwise(F.col("id")).alias("v"))
    out = rollup.frequency_rank(rows, F.col("v"), 5)
    assert [(r["value"], r["count"]) for r in out.collect()] == [(i, 20_000) for i in (0, 2, 4, 6, 8)]
    final = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "Union" not in final and final.count("Range (") == 2
