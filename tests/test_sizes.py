"""Joins and plans whose cost must not grow faster than the tables."""

from __future__ import annotations

import pathlib
import random
import re
import time

import duckdb
import pyarrow as pa
from pyspark.sql import types

from docspark.functions import html as H
from docspark.operators import cells as C
from docspark.operators import sqlops as S
from docspark.operators import text as E
from docspark.ordering import number_within
from docspark.plans import assemble as A
from docspark.plans import load_all
from docspark.sources import tables as T

QUERIES, ORACLES = load_all()


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_a_range_are_never_broadcast(spark, tmp_path):
    """The file is small, the cells made of it need not be: only AQE or a proven size may broadcast them."""
    path = str(tmp_path / "rows")
    spark.range(50).selectExpr("id AS k", "id * 2 AS v").write.parquet(path)
    rows = spark.read.parquet(path)
    cells = C.from_table(rows, "s", rows["k"] + 2, ["k", "v"])
    got = C.read_range_with_metadata(cells, "s", "A1")
    assert not re.search(r"Broadcast(HashJoin|NestedLoopJoin) .*row#", executed(got))
    assert got.count() == 102
    assert {(r.address, r.value) for r in got.where("row = 11").collect()} == {("A11", "9"), ("B11", "18")}


def test_title_references_without_semicolon(spark, tmp_path):
    """The SQL of d02_page_title states HTML's rule, which the parser keeps: ``&amp`` is a reference as well."""
    titles = ["a &amp; b", "a &amp", "x &lt;y&gt z", "&quot q", "&amp;lt;", "&am &a & &quo", "&ampgt", "p &amp - y"]
    html = [(i, "http://h.example.org/", f"<html><head><title>{t}</title></head><body><p>x</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(html, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {tuple(r) for r in con.execute(ORACLES["d02_page_title"]).fetchall()}
    got = {tuple(r) for r in QUERIES["d02_page_title"](spark, str(tmp_path)).collect()}
    assert got == want


def test_items_of_lines_are_trimmed_after_their_markers_merge(spark, tmp_path):
    """The SQL of i03_line_assembly states the rule of ``list_item``: items are trimmed and bullets become dashes."""
    # some lines begin with an unmarked "1) " and end with stars that merge with those of their last span
    texts = ["\n\n\n1) a. b. c. d**"] * 20 + ["• dot", "-  dash. x", "* star", "1) x", "plain\n• code\n– y\n*  z"] * 12
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = con.execute(ORACLES["i03_line_assembly"])
    names = [c[0] for c in result.description]
    want = {tuple(r) for r in result.fetchall()}
    got = {tuple(r) for r in QUERIES["i03_line_assembly"](spark, str(tmp_path)).select(*names).collect()}
    assert got == want
    assert any(r[names.index("content")].startswith("- ") for r in want)


def test_texts_are_written_into_folders_of_bounded_size(spark, tmp_path):
    """Neither the driver's list of files nor the number of tasks may grow with the texts."""
    texts = [None, "", "a", "b\n", "\n\n", "ü\r\n x"] + [f"text {i}" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    path = f"{tmp_path}/t"
    T.write_texts(df, "text", path, folder_files=40)
    folders = list(pathlib.Path(path).glob("parts/folder=*"))
    assert len(folders) >= 8 and all(len(list(f.iterdir())) <= 40 for f in folders)
    for read in (T.read_whole_texts(spark, path), T.read_directory(spark, path, "*.txt")):
        assert sorted(r.text for r in T.written_text(read).collect()) == sorted(t or "" for t in texts)
        assert len({r.path for r in read.collect()}) == len(texts)
    plain = tmp_path / "plain"
    plain.mkdir()
    for i in range(2000):
        (plain / f"{i}.txt").write_text(str(i))
    read = T.read_whole_texts(spark, str(plain))
    assert read.count() == 2000
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_no_texts_are_written_and_read(spark, tmp_path):
    T.write_texts(spark.createDataFrame([], "text string"), "text", f"{tmp_path}/t")
    assert T.read_whole_texts(spark, f"{tmp_path}/t").count() == 0


def test_numbers_and_noise_shuffle_no_texts(spark):
    """Rows are dealt and written once; what is joined to them is proven small by its files."""
    rows = [(i % 3 if i % 7 else None, i, f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, t string")
    got = number_within(df, ["k"], ["i"], "n")
    assert "Exchange hashpartitioning" not in executed(got)
    want = {}
    for k, i, _ in rows:
        want.setdefault(k, []).append(i)
    assert {(r.k, r.i): r.n for r in got.collect()} == {(k, i): n + 1 for k, v in want.items() for n, i in enumerate(v)}
    noise = spark.createDataFrame([(1, "a")], "doc_id int, text string").union(spark.range(3).selectExpr("explode(array(1, 2))", "'b'"))
    lines = spark.createDataFrame([(1, " a "), (1, "b"), (1, "c"), (2, "a"), (None, "b")], "doc_id int, text string")
    left = E.remove_noise(lines, noise)
    assert "Exchange hashpartitioning" not in executed(left)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "b"), (1, "c"), (2, "a")]


def test_list_spacing_by_lines_and_in_linear_time(spark):
    """Against a plain walk over lines; lines of a fenced block may be long."""
    rng = random.Random(5)
    kinds = ["- a", "* ", "2) b", " + c", "text", "  text", "\ttab", "", " ", "```", "~~~ x", "  ```", "10. x", "-", "---", "\x0b- v", "｜x", "1.", "é\r"]

    def spaced(text):
        if text is None:
            return None
        text = text.replace("｜", "|")
        lines, tokens = text.split("\n"), []
        while lines:  # a fenced block up to its closing line is one token
            n = 1
            if re.match(r"[^\S\n]*(```|~~~)", lines[0], re.A):
                n = next((i + 1 for i in range(1, len(lines)) if re.match(r"[^\S\n]*(```|~~~)", lines[i], re.A)), len(lines))
            tokens.append(lines[:n])
            lines = lines[n:]
        item = lambda x: bool(re.match(r"\s*(?:[-*+]|\d+[.)])\s+", x + "\n", re.A)) and bool(x.strip())
        ink = lambda x: bool(re.search(r"\S", x, re.A))
        out = []
        for i, tok in enumerate(tokens):
            out += tok
            if i + 1 < len(tokens):
                a, b = tok[-1], tokens[i + 1][0]
                if item(b) and ink(a) and not item(a) or len(tok) == 1 and item(a) and ink(b) and not item(b) and b[0] not in " \t":
                    out.append("")
        return "\n".join(out) + ("\n" if text.endswith("\n") else "")

    texts = [None, "", "\n"] + ["\n".join(rng.choices(kinds, k=rng.randrange(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in E.list_spacing(df).collect()}
    assert got == {i: spaced(t) for i, t in enumerate(texts)}
    long = "```\n" + "\n".join(["x" * 60_000] * 10) + "\n```\n- a"
    started = time.time()
    assert E.list_spacing(spark.createDataFrame([(1, long)], "doc_id int, text string")).first().text == spaced(long)
    assert time.time() - started < 5


def test_pages_are_parsed_in_groups_of_bounded_bytes(spark):
    """A worker holds the nodes of a few pages at a time, however long pages and batches are."""

    class Frame:
        schema = types.StructType().add("page_id", "long").add("html", "string")

        def mapInArrow(self, run, schema):
            return run

    html = [None, "", "<p>" * 40_000, *["<b>x</b>" * 5_000] * 90, *["<i>y</i>"] * 300]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "html": html})
    parts = list(H.with_nodes(Frame(), "html")(iter([batch])))
    assert [i for p in parts for i in p.column("page_id").to_pylist()] == list(range(len(html)))
    for p in parts:
        sizes = [len(t or "") for t in p.column("html").to_pylist()]
        assert len(sizes) <= 64 and sum(sizes[:-1]) < 256 * 1024
    assert [len(n) for p in parts for n in p.column("nodes")][:4] == [0, 0, 40_000, 10_000]


def test_page_specifications_stay_spread(spark, tmp_path):
    """A document's id is short and its pages are many: the ids may not be brought to one task."""
    turns = spark.range(3000).selectExpr("id % 1000 AS conv_id", "id % 3 AS turn", "'user' AS role", "'x' AS text")
    turns.repartition(64).write.parquet(f"{tmp_path}/conversations.parquet")
    got = A.specs(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.doc_id for r in got.collect()) == list(range(1000))


def test_rows_seen_before_are_not_broadcast(spark, monkeypatch):
    """A round of a fixpoint sends no earlier rows through the driver; NULLs are equal to each other."""
    plans = []
    counted = S._counted
    monkeypatch.setattr(S, "_counted", lambda df: (plans.append(executed(df)), counted(df))[1])
    start = spark.createDataFrame([(0, None), (0, None), (3, "x")], "k int, t string")
    rows = S.fixpoint(start, lambda df: df.selectExpr("(k + 1) % 5", "t"))
    assert sorted((r.k, r.t or "") for r in rows.collect()) == [(k, t) for k in range(5) for t in ("", "x")]
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
