"""Recursion without limits, row changes of stored tables, cross-tab with values of its own."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from docspark.operators import cells as C
from docspark.operators import sqlops as S


def test_fixpoint_beyond_a_million_rows(spark):
    start = spark.range(1, 2).select("id")
    both = lambda n: n.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("id")).where(F.col("id") < 1_100_000)
    got = S.fixpoint(start, both, distinct=False)
    assert got.agg(F.count("id"), F.countDistinct("id"), F.max("id")).first() == (1_099_999, 1_099_999, 1_099_999)


def test_fixpoint_ends_on_a_cycle_and_knows_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None), (None, 4), (9, 10)], "a int, b int")
    got = S.run_recursive_sql(spark, {"edges": edges}, "reach", "SELECT 1 AS n", "SELECT b FROM reach JOIN edges ON a = n",
                              "SELECT n FROM reach WHERE n IS NULL OR n < ?", params=[9])
    assert sorted((r.n for r in got.collect()), key=str) == [1, 2, 3, None]
    assert S.fixpoint(edges.limit(0), lambda n: n).count() == 0
    with pytest.raises(ValueError):
        S.run_recursive_sql(spark, {"edges": edges}, "edges", "SELECT 1", "SELECT 1", "SELECT 1")


def files(path):
    return {os.path.basename(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_changes_touch_only_partitions_with_matches(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(i, "xyz"[i % 3] if i % 4 else None, i * 1.5) for i in range(60)]
    spark.createDataFrame(rows, "k int, part string, v double").write.partitionBy("part").parquet(path)
    held = lambda p: files(f"{path}/part={p}")
    read = lambda: sorted(((r.k, r.part, r.v) for r in spark.read.parquet(path).collect()), key=str)
    before = {p: held(p) for p in ("x", "y", "z", "__HIVE_DEFAULT_PARTITION__")}

    changes = S.update_stored(spark, path, ["part"], (F.col("k") % 3 == 1) & F.col("part").isNotNull(), {"v": F.col("v") + F.col("k")})
    rows = [(k, p, v + k if k % 3 == 1 and p else v) for k, p, v in rows]
    assert read() == sorted(rows, key=str) and changes.first().changes == sum(k % 3 == 1 and p is not None for k, p, _ in rows)
    assert held("x") == before["x"] and held("z") == before["z"] and held("y") != before["y"]

    gone = lambda k, p: p == "x" or p is None and k % 8 == 0
    changes = S.delete_stored(spark, path, ["part"], (F.col("part") == "x") | (F.col("part").isNull() & (F.col("k") % 8 == 0)))
    assert changes.first().changes == sum(gone(k, p) for k, p, _ in rows)
    rows = [r for r in rows if not gone(r[0], r[1])]
    assert read() == sorted(rows, key=str) and not held("x") and held("z") == before["z"]

    kept = files(path)
    assert S.insert_stored(spark, path, ["part"], spark.createDataFrame([("x", 7, 0.5), ("q", 8, 1.5)], "part string, k int, v double")).first().changes == 2
    assert read() == sorted([*rows, (7, "x", 0.5), (8, "q", 1.5)], key=str) and kept < files(path)
    assert S.delete_stored(spark, path, ["part"], F.col("k") > 1000).first().changes == 0
    with pytest.raises(ValueError):
        S.update_stored(spark, path, ["part"], F.col("k") > 0, {"part": F.lit("x")})
    with pytest.raises(ValueError):
        S.update_stored(spark, path, ["part"], F.col("k") > 0, {"other": F.lit("x")})


def test_cross_tab_finds_its_values(spark):
    rows = [("a", "x", 1.0), ("a", "x", 2.0), ("a", None, 5.0), ("b", "y", None), ("b", "x", 4.0), (None, "z", 1.0)]
    df = spark.createDataFrame(rows, "g string, k string, v double")
    got = {r.g: r["values"] for r in C.cross_tab_map(df, ["G"], "k", "v").collect()}
    assert got == {"a": {"null": 5.0, "x": 3.0, "y": 0.0, "z": 0.0}, "b": {"null": 0.0, "x": 4.0, "y": 0.0, "z": 0.0},
                   None: {"null": 0.0, "x": 0.0, "y": 0.0, "z": 1.0}}
    assert C.cross_tab_map(df.limit(0), ["g"], "k", "v").count() == 0


def test_charsets_are_read_in_the_jvm(spark):
    from docspark.sources import decode

    texts = {"shift_jis": "日本語", "euc_kr": "한국어", "windows-1251": "привет", "iso-8859-2": "žluťoučký", "big5": "繁體中文", "koi8-r": "мир", "utf-16": "wide é", "x-unknown": "plain"}
    rows = [(n, t, t.encode("utf-8" if n == "x-unknown" else n), f'text/html; charset="{n}"') for n, t in texts.items()]
    rows += [("page", "中", "中".encode("gbk") + b'<meta charset="GBK">', "charset=nope"), ("late", "é", "é".encode("cp1252"), None), ("bad", None, b"\x81\x81\x81 \xff", "charset=gbk")]
    df = spark.createDataFrame(rows, "n string, t string, raw binary, head string")
    got = {r.n: r.r for r in df.select("n", decode.decode_bytes(F.col("raw"), F.col("head"), guesses=("utf-8", "cp1252")).alias("r")).collect()}
    for n, t in texts.items():
        assert got[n].text == t, n
    assert got["shift_jis"].encoding == "shift_jis" and got["x-unknown"].encoding == "utf-8" and got["iso-8859-2"].encoding == "iso8859-2"
    assert got["page"].text.startswith("中<meta") and got["page"].encoding == "gbk" and got["late"] == ("é", "cp1252")
    assert got["bad"].encoding == "utf-8/replace"
    back = df.where("n in ('shift_jis', 'late')").select("t", decode.encode_text(F.col("t"), "shift_jis").alias("b")).collect()
    assert {r.t: r.b for r in back} == {"日本語": bytearray("日本語".encode("shift_jis")), "é": None}
    plan = df.select(decode.decode_bytes(F.col("raw"), F.col("head")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
