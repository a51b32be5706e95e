"""Titles inside stems against all pairs, and sections cut in a document's row."""

import random

from pyspark.sql import functions as F

from docspark.operators import match as M
from docspark.operators import text as E


def test_titles_inside_stems_against_all_pairs(spark):
    rng = random.Random(4)
    letters = "aab中b_文0"
    stems = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(150)})
    wanted = sorted({s[i : i + rng.randrange(1, 12)] for s in stems for i in [rng.randrange(len(s))]} | {"zz", "a" * 40, "中文中文", "b"})
    got = M.titles_inside(
        spark.createDataFrame([(w,) for w in wanted], "sub string"),
        spark.createDataFrame([(f"stem {s}", s) for s in stems], "stem string, norm string"),
    ).collect()
    assert sorted((r.sub, r.stem) for r in got) == sorted((w, f"stem {s}") for w in wanted for s in stems if w in s)


def test_titles_fall_through_the_steps(spark):
    stems = ["01_intro", "02_our plan", "03_plan b", "ending", "Ending!"]
    titles = ["01_intro", "OUR   PLAN", "plan", "Slide 3 x", "ending", "ENDING", "tro", "", "nothing"]
    got = {r.title: r.stem for r in M.match_titles(
        spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame([(s,) for s in stems], "stem string")).collect()}
    assert got == {"01_intro": "01_intro", "OUR   PLAN": "02_our plan", "plan": None, "Slide 3 x": "03_plan b", "ending": "ending",
                   "ENDING": None, "tro": "01_intro", "": None, "nothing": None}
    none = spark.createDataFrame([], "stem string")
    assert M.match_titles(spark.createDataFrame([("a",)], "title string"), none).collect() == [("a", None)]


def test_section_notes_of_a_long_document(spark):
    stems = spark.createDataFrame([("alpha",), ("beta part",), ("gamma",)], "stem string")
    text = "lost\n# Alpha\nfirst\n\n---\n## unknown\nkept\n# beta part\n\n# alpha\nagain\n#gamma"
    many = "\n".join(f"# {'alpha' if i % 2 else 'gamma'}\nline {i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, many), (3, None), (4, "no heading"), (5, "# nowhere\nx")], "doc_id int, text string")
    got = {(r.doc_id, r.stem): r.notes for r in E.section_notes(docs, stems).collect()}
    assert {k: v for k, v in got.items() if k[0] != 2} == {
        (1, "alpha"): "first\n\n## unknown\nkept\n\nagain", (1, "beta part"): "", (1, "gamma"): ""}
    assert got[2, "alpha"] == "\n\n".join(f"line {i}" for i in range(1, 3000, 2)) and got[2, "gamma"].count("line") == 1500
    assert E.section_notes(docs.where(F.col("doc_id") > 2), stems).count() == 0
