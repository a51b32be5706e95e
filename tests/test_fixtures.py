"""Hand-worked fixtures, brute-force checks of ordered folds, and shape rules."""

import json
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from docspark import ordering
from docspark.functions import a1, html, pagespec
from docspark.functions import text as X
from docspark.operators import assemble, cells, layout, match, pages, rollup, sqlops
from docspark.operators import text as texts
from docspark.ordering import number_within, running_offsets
from docspark.sources import decode, tables

SF = "/root/testdata/sf0.001"


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def quarterly(spark):
    sheet = spark.createDataFrame(
        [(2, "East", 100, 120), (3, "West", 80, 90), (4, "East", 60, 70)], "row LONG, Region STRING, Q1 LONG, Q2 LONG")
    return sheet, cells.from_table(sheet, "Q", F.col("row"), ["Region", "Q1", "Q2"])


def test_summary_table_fixture(spark):
    sheet, _ = quarterly(spark)
    rows = {r[0]: (r[1], r[2]) for r in cells.summary_table(sheet, ["region"], ["Q1 (sum)", "q2"]).collect()}
    assert rows == {"East": (160.0, 190.0), "West": (80.0, 90.0)}


def test_summary_table_gives_zero_for_unseen_combinations(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), (None, "x", 3.0)], "p STRING, q STRING, v DOUBLE")
    rows = {(r.p, r.q): r["v (min)"] for r in cells.summary_table(df, ["p", "q"], ["v"], agg_func="min", every_combination=True).collect()}
    assert rows == {("a", "x"): 1.0, ("a", "y"): 0.0, ("b", "x"): 0.0, ("b", "y"): 2.0, ("None", "x"): 3.0, ("None", "y"): 0.0}


def test_bad_options_raise_while_planning(spark):
    sheet, grid = quarterly(spark)
    for call in (
        lambda: cells.summary_table(sheet, ["nope"], ["Q1"]), lambda: cells.summary_table(sheet, ["Region"], ["Q1"], agg_func="median"),
        lambda: cells.read_range(grid, "Q", "A0"), lambda: cells.delete_range(grid, "Q", "A1", "A2", "down"),
        lambda: cells.delete_rows(grid, "Q", 9), lambda: cells.insert_rows(grid, "Q", 0), lambda: cells.delete_sheet(grid, "Q"),
        lambda: cells.copy_sheet(grid, "x", "y"), lambda: cells.rename_sheet(grid, "Q", "Q"), lambda: cells.block_from_rows(spark, []),
        lambda: tables.capped_scan(sheet, ["row"], -1), lambda: sqlops.run_sql(spark, {}, "  "),
        lambda: rollup.replace_color(sheet, "Region", "red", "#fff"), lambda: cells.chart_series(sheet, "Region", ["Q1"], "radar"),
    ):
        with pytest.raises(ValueError):
            call()


def test_block_write_and_range_read(spark):
    _, grid = quarterly(spark)
    block = cells.block_from_rows(spark, [["North", 1], [None], ["x", True, 2.5]])
    out = cells.write_block(grid, block, "Q", "A4")
    got = {(r.row, r.col): r.value for r in cells.read_range(out, "Q", "A4").collect()}
    assert got == {(4, 1): "North", (4, 2): "1", (4, 3): "70", (6, 1): "x", (6, 2): "true", (6, 3): "2.5"}


def test_copy_range_repeats_when_it_overlaps_itself(spark):
    sheet = spark.createDataFrame([(i, f"v{i}") for i in range(2, 8)], "row LONG, a STRING")
    grid = cells.from_table(sheet, "S", F.col("row"), ["a"])
    model = {1: "a", **{i: f"v{i}" for i in range(2, 8)}}
    for r in range(1, 7):
        model[r + 2] = model.get(r)
    got = {r.row: r.value for r in cells.copy_range(grid, "S", "A1", "A6", "A3").collect()}
    assert got == {k: v for k, v in model.items() if v is not None}


def test_column_letters(spark):
    df = spark.createDataFrame([(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")], "n LONG, s STRING")
    assert all(r[0] == r[1] for r in df.select(a1.index_to_letters(F.col("n")), "s").collect())
    assert all(r[0] == r[1] for r in df.select(a1.letters_to_index(F.col("s")), "n").collect())


@pytest.mark.parametrize("x", [0.0, 1.5, 100.0, 123456.7, 1234567.0, 0.0001234567, 0.00001234, -2.50, 1e20, 999999.5])
def test_general_format(spark, x):
    assert one(spark, cells.general_format(F.lit(x))) == f"{x:g}"


@pytest.mark.parametrize("spec,pages,error", [
    ("1-5,10", [1, 2, 3, 4, 5, 10], None), ("3,1,2", [3, 1, 2], None), ("1,1-3", [1, 2, 3], None), ("", None, None),
    ("1e3", None, "Invalid"), ("5-2", None, "start > end"), ("0", None, "Invalid"), ("1,,2", None, "Invalid"), ("1-100001", None, "more than 100000"),
])
def test_page_spec_strict(spark, spec, pages, error):
    r = one(spark, pagespec.parse_strict(F.lit(spec), 100_000))
    assert r.pages == pages and (r.error is None if error is None else error in r.error)


@pytest.mark.parametrize("spec,total,pages,error", [
    ("1-3,5,7-9", 9, [0, 1, 2, 4, 6, 7, 8], None), ("1,99", 3, [0, 2], None), ("3-1", 5, None, "descending"), ("", 5, None, "empty segment"),
    ("x", 5, None, "cannot parse"), ("1", 0, None, "no pages"),
])
def test_page_spec_clamped(spark, spec, total, pages, error):
    r = one(spark, pagespec.parse_clamped(F.lit(spec), F.lit(total)))
    assert r.pages == pages and (r.error is None if error is None else error in r.error)


def test_text_and_json_segments_join_to_the_document(spark):
    df = spark.createDataFrame(
        [(1, 0, "one ", False), (1, 1, "", True), (1, 2, "three \n", False), (2, 0, "x", True)],
        "doc_id LONG, page_index LONG, markdown STRING, needs_ocr BOOLEAN").withColumn("text_items", F.array(F.lit("w")))

    def joined(seg, doc):
        return "".join(r.text for r in sorted(seg.where(F.col("doc_id") == doc).collect(), key=lambda r: (r.part, r.page_index)))

    assert joined(assemble.text_segments(df), 1) == (
        "[Page 1]\n\none \n\n--- Page Break ---\n\n[Page 2]\n\n(Page 2 flagged for OCR — text content may be unreliable)"
        "\n\n--- Page Break ---\n\n[Page 3]\n\nthree")
    assert joined(assemble.markdown_segments(df), 1) == (
        "<!-- OCR warning: 1 page(s) [2] flagged for OCR; native text may be incomplete. -->\n\none \n\n\n\nthree \n")
    doc = json.loads(joined(assemble.json_segments(df), 1))
    assert doc["pageCount"] == 3 and doc["pagesNeedingOcr"] == [1] and [p["pageIndex"] for p in doc["pages"]] == [0, 1, 2]
    assert json.loads(joined(assemble.json_segments(df), 2))["pages"][0]["textItems"] == ["w"]


def test_decode_prefers_declaration_then_least_damage(spark):
    late = " " * 9000 + '<meta charset="gb18030">'
    rows = [
        ("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é", "iso8859-1"), (b"\xef\xbb\xbfabc", None, "abc", "utf-8-sig"),
        (f"{late}中文".encode("gb18030"), None, f"{late}中文", "gb18030"), ("中文".encode("gb18030"), "text/html; charset=nope", "中文", "gb18030"),
        (b"\xff\xff\xff", None, "\ufffd" * 3, "utf-8/replace"), (None, None, None, None), (b"", "text/html", "", "utf-8"), ("中文é".encode(), 'x; charset="UTF-8"', "中文é", "utf-8"),
        ("中".encode(), "charset=big5; charset=utf-8", "中", "utf-8"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, raw BINARY, head STRING, text STRING, encoding STRING")
    got = df.select("i", "text", "encoding", decode.decode_bytes(F.col("raw"), F.col("head")).alias("r")).orderBy("i").collect()
    assert [(r.r.text, r.r.encoding) for r in got][:8] == [(r[2], r[3]) for r in rows][:8]


def test_page_ranges_are_not_unrolled(spark):
    got = one(spark, pagespec.parse_ranges(F.lit("5-9000000000,1-6,3,9000000001-9000000002")))
    assert [tuple(r) for r in got.ranges] == [(5, 9000000000, 0), (1, 4, 8999999996), (9000000001, 9000000002, 9000000000)]
    pages = spark.createDataFrame([(1, i) for i in range(1500)] + [(2, 0)], "doc_id INT, page_index LONG")
    specs = spark.createDataFrame([(1, ""), (2, "7-90000000")], "doc_id INT, spec STRING")
    assert assemble.select_pages(pages, specs).count() == 1500
    assert assemble.select_pages(pages, specs, 1000).count() == 1000
    assert assemble.selection_errors(pages, specs).first().error == (
        "PAGE_RANGE: Requested pages [6-89999999] are outside the document (1 page). Page numbers are 0-indexed.")


def test_numbering_of_hashed_ids_and_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.xxhash64("id").alias("h"))
    got = ordering.number_within(df, ["k"], ["h"], "n").collect()
    hot = sorted((r.h, r.n) for r in got if r.k == "hot")
    assert [n for _, n in hot] == list(range(1, 2001)) and all(r.n == 1 for r in got if r.k != "hot")
    counts = df.select("h", F.lit(2).cast("long").alias("c"))
    offsets = sorted((r.h, r.o) for r in ordering.running_offsets(counts, "h", "c", "o").collect())
    assert [o for _, o in offsets] == list(range(0, 6000, 2))


def test_broadcast_needs_a_proven_size(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    hinted = lambda d: "ResolvedHint" in ordering.broadcast_if_small(d)._jdf.queryExecution().analyzed().toString()
    assert hinted(stored) and hinted(stored.groupBy("id").count())
    assert not hinted(stored.select(F.explode(F.sequence(F.lit(0), "id")).alias("x")))
    assert not hinted(stored.crossJoin(stored.withColumnRenamed("id", "b")))
    assert not ordering.UNSOUND.search("Relation [id] parquet")


def test_texts_with_any_separator_survive_files(spark, tmp_path):
    texts = ["a\x1e\nb", "", "end\n", "\n\n", "é"]
    tables.write_texts(spark.createDataFrame([(t,) for t in texts], "text STRING"), "text", f"{tmp_path}/t")
    assert sorted(r.text for r in tables.written_text(tables.read_whole_texts(spark, f"{tmp_path}/t")).collect()) == sorted(texts)
    assert tables.read_whole_texts(spark, f"{tmp_path}/t").count() == len(texts)


PAGE = """<html><head><title>T - x 政府</title><meta name="Author" content="A"></head><body><nav><p>menu</p></nav>
<div class="x news-content"><h2>Head &amp; tail</h2><p>Some <b>bold</b> and <i>it</i> <a href="/u">link</a><a href="javascript:x">no</a>
<code>c</code></p><ul><li>one<li>two</ul><blockquote>q</blockquote><hr><pre> a  <b>b</b>
 c</pre><table><tr><th> H </th><td><b>v</b> w</td></tr></table><img src="/i.png" alt="z"><br>""" + "long text " * 30 + """</div>
<script>var s = "<p>";</script></body></html>"""


def test_page_markdown_of_a_made_page(spark):
    df = html.with_nodes(spark.createDataFrame([(1, "http://h/p", PAGE)], "page_id LONG, url STRING, html STRING"), "html")
    got = pages.page_markdown(pages.page_metadata(pages.main_content(df))).first()
    assert (got.title, got.author) == ("T", "A")
    assert got.markdown.startswith("## Head & tail\n\nSome **bold** and *it*[link](/u)no`c`\n\n- one\n- two\n> q\n\n---\n\n```\n a  b\n c\n```\n\n| H | vw |\n\n![z](/i.png)")
    assert "menu" not in got.markdown and "var s" not in got.markdown
    assert [r.line for r in pages.table_rows(df).collect()] == ["| H | vw |"]


def test_main_content_against_a_plain_walk(spark):
    """Best container by a direct reading of the rules on the parsed nodes."""
    df = html.with_nodes(spark.read.parquet(f"{SF}/pages.parquet"), "html")
    order = [("class~", c) for c in pages.CLASS_PARTS] + [("class", c) for c in pages.CLASSES] + [("id", i) for i in pages.IDS]
    order += [("class", c) for c in pages.LATE_CLASSES] + [("tag", t) for t in pages.TAGS]

    def meets(n, rule):
        kind, value = rule
        names = (n["attrs"].get("class") or "").split()
        return {"class~": any(value in c.lower() for c in names), "class": value in names,
                "id": n["attrs"].get("id") == value, "tag": n["tag"] == value}[kind]

    for row in pages.main_content(df).collect():
        nodes = [n.asDict() for n in row.nodes if not n.removed and n.tag != "#text"]
        best, top = None, 0
        for rule in order:
            for n in nodes:
                score = n["text_len"] + 2 * n["cjk"]
                if meets(n, rule) and n["text_len"] >= 100 and score > top:
                    best, top = n["node_id"], score
        if best is None or top < 200:
            for n in nodes:
                score = n["text_len"] + 2 * n["cjk"] + 50 * n["p_children"]
                if n["tag"] == "div" and n["text_len"] > 200 and n["p_children"] and score > top:
                    best, top = n["node_id"], score
        if best is None:
            best = next(n["node_id"] for n in nodes if n["tag"] == "body")
        assert row.root_id == best


def test_heading_merge_limits(spark):
    rows = [(1, 1, i, 0, c, True, False, False) for i, c in enumerate(
        ["# " + "a" * 30, "# " + "b" * 40, "# " + "c" * 5, "## d", "## " + "e" * 41, "## f"])]
    el = spark.createDataFrame(rows, "doc_id LONG, page_no LONG, pos LONG, kind INT, content STRING, is_heading BOOLEAN, is_list BOOLEAN, is_code BOOLEAN")
    got = [r.content for r in texts.merge_headings(el).orderBy("pos").collect()]
    assert got == ["# " + "a" * 30 + " " + "b" * 40, "# " + "c" * 5, "## d", "## " + "e" * 41 + " f"]


def test_contained_suppression_brute_force(spark):
    rects = spark.read.parquet(f"{SF}/documents.parquet")
    from docspark.plans.layout import rects as derived

    df = derived(spark, SF)
    got = {(r.doc_id, r.page_no, r.pos) for r in layout.suppress_contained(df).collect()}
    by_page = {}
    for r in df.collect():
        by_page.setdefault((r.doc_id, r.page_no), []).append(r)
    want = set()
    for page, items in by_page.items():
        kept = []
        for r in sorted(items, key=lambda r: (-(r.x1 - r.x0) * (r.y1 - r.y0), r.pos)):
            area = (r.x1 - r.x0) * (r.y1 - r.y0)

            def inside(k):
                w, h = min(r.x1, k.x1) - max(r.x0, k.x0), min(r.y1, k.y1) - max(r.y0, k.y0)
                return w > 0 and h > 0 and w * h / area >= 0.9

            if not any(inside(k) for k in kept):
                kept.append(r)
        want |= {(*page, r.pos) for r in kept}
    assert got == want and rects.count() > 0


def test_numbering_and_offsets_across_ranges(spark):
    df = spark.range(0, 1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("p"))
    got = number_within(df, ["k"], ["p"], "n")
    from pyspark.sql import Window

    want = df.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("p")))
    assert got.join(want, ["k", "p"]).where(F.col("n") != F.col("w")).count() == 0 and got.count() == 1000
    off = running_offsets(df.select("p", (F.col("p") % 4).alias("c")), "p", "c", "o").orderBy("p").collect()
    total = 0
    for r in off:
        assert r.o == total
        total += r.c


def test_ranking_against_every_pair(spark):
    """Top-n equals scoring every pair of a request and what it fetched by hand."""
    words = ["red ring", "old bus station", "blue rod", "the red-ring house", "hot", "nothing here", "redring", "cold plate red"]
    cands = [(i, "openverse", words[i % 8] + f" {i % 3}", "ann" if i % 2 else "", "", "CC0" if i % 3 else "cc by 4.0", "", i * 37 % 900, i * 91 % 700)
             for i in range(40)]
    reqs = [(0, "red ring", "landscape", 300, 0, []), (1, "old station", "", 0, 200, []), (2, "", "square", 0, 0, []),
            (3, "blue", "", 0, 0, ["red ring|zzz"]), (4, "hot red", "portrait", 100, 100, ["|"]), (5, "Red ring", "landscape", 0, 0, [])]
    c = spark.createDataFrame([(q[0], *k) for q in reqs for k in cands], "req_id LONG, cand_id LONG, provider STRING, title STRING, author STRING, url STRING, license_name STRING, license_url STRING, width LONG, height LONG")
    r = spark.createDataFrame(reqs, "req_id LONG, query STRING, orientation STRING, min_width INT, min_height INT, required ARRAY<STRING>")
    transit = ["station", "subway", "metro", "rail", "transit", "airport", "bus"]

    def squeeze(t):
        return re.sub(r"[\s\-_./:;,'\"()\[\]{}]+", "", t.lower())

    def score(q, k):
        _, query, wanted, min_w, min_h, required = q
        cid, _, title, author, _, lic, _, w, h = k
        text = " ".join(t for t in (title, author) if t).lower()
        toks = [t for t in query.lower().split() if len(t) > 2]
        rel = sum(t in text for t in toks) / len(toks) if toks else 1.0
        groups = [[squeeze(a) for a in g.split("|") if squeeze(a)] for g in required]
        if any(g and not any(a in squeeze(text) for a in g) for g in groups) or (rel == 0 and not required):
            return None
        s = rel * 10000 + 1500 * sum(any(a in squeeze(title) for a in g) for g in groups)
        if not any(t in query.lower() for t in transit) and any(t in text for t in transit):
            s -= 5000
        shape = "unknown" if w <= 0 or h <= 0 else "landscape" if w > h else "portrait" if h > w else "square"
        s += 0 if not wanted else 1000 if shape == wanted else -250
        s -= 500 * (min_w > 0 and w < min_w) + 500 * (min_h > 0 and h < min_h)
        return s + (250 if lic == "CC0" else 0) + min(w * h / 1000, 1500)

    def wanted(kept):
        out = set()
        for q in reqs:
            ranked = sorted(((-s, k[0]) for k in kept if (s := score(q, k)) is not None))[:3]
            out |= {(q[0], i + 1, cid, round(-s, 3)) for i, (s, cid) in enumerate(ranked)}
        return out

    def ranked(**options):
        return {(x.req_id, x["rank"], x.cand_id, round(x.score, 3)) for x in match.rank_candidates(r, c, 3, **options).collect()}

    assert ranked() == wanted(cands)
    assert ranked(strict_no_attribution=True) == wanted([k for k in cands if k[5] == "CC0"])


def test_table_catalog(spark):
    names = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("region", "nation")}
    rows = [tuple(r) for r in sqlops.table_catalog(spark, names).collect()]
    assert rows == [("nation", "CREATE TABLE nation (n_nationkey INT, n_name STRING, n_regionkey INT)"),
                    ("region", "CREATE TABLE region (r_regionkey INT, r_name STRING)")]


def test_visual_width_matches_the_character_table(spark):
    import unicodedata

    for s in ["abc", "山水 x", "Ω±é°", "ﾊﾝ ＡＢ", "😀 ½", "　 x"]:
        bare = re.sub(r"[ \t\n\r\f\v]+", "", s)
        want = sum({"F": 2, "W": 2, "A": 1.5}.get(unicodedata.east_asian_width(c), 1) for c in bare)
        assert float(one(spark, X.visual_width(F.lit(s)))) == want


def test_operators_do_not_collect():
    """No operator or query brings rows or counts to the driver while it is planned."""
    root = pathlib.Path(__file__).resolve().parent.parent / "docspark"
    hits = []
    for f in root.rglob("*.py"):
        for line in [] if "llm" in f.parts else f.read_text().splitlines():
            if re.search(r"\.collect\(\)|toPandas|localCheckpoint|\.rdd\b", line):
                hits.append((f.name, line.strip()))
    assert not hits, hits


def test_tables_from_csv_and_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a, b"), (2, None)], "k INT, v STRING")
    rows.write.option("header", True).csv(f"{tmp_path}/c")
    rows.write.json(f"{tmp_path}/j")
    assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/c", "csv").collect())) == [("1", "a, b"), ("2", None)]
    assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/c", "csv", "k INT, v STRING").collect())) == [(1, "a, b"), (2, None)]
    assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/j", "json").collect())) == [(1, "a, b"), (2, None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/c", "xml")


def test_two_values_at_one_address_and_a_whole_column_merge(spark):
    grid = spark.createDataFrame(
        [("s", 1, 1, "a", None, "str"), ("s", 1, 2, "b", None, "str"), ("s", 2, 1, "x", None, "str"), ("s", 2, 1, "y", None, "str")],
        "sheet STRING, row LONG, col LONG, value STRING, num DOUBLE, type STRING")
    lines = [r.line for r in cells.markdown_table(grid).orderBy("line_no").collect()]
    assert lines == ["| a | b |", "| --- | --- |", "| y |  |"]
    merges = spark.createDataFrame([("s", 1, 2, 200_000, 2)], "sheet STRING, r0 LONG, c0 LONG, r1 LONG, c1 LONG")
    assert cells.merged_cells(grid, merges).count() == 200_000


def test_statement_leaves_the_views_of_the_session_alone(spark):
    spark.range(3).createOrReplaceTempView("mine")
    got = sqlops.run_sql(spark, {"mine": spark.range(5), "other": spark.range(7)}, "SELECT count(*) AS n FROM mine, other WHERE other.id > ?", [5])
    assert got.first().n == 5
    assert spark.table("mine").count() == 3 and not spark.catalog.tableExists("other")
