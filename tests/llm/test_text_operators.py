"""Contamination, toxicity, licences and URL lists: edges and plain versions on small fixtures."""

import hashlib
import random

import pytest

from docspark.llm import contamination as C
from docspark.llm import licences as L
from docspark.llm import toxicity as X
from docspark.llm import urls as U


def test_contamination_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame(
        [(10, "Alpha, beta gamma"), (9, "alpha beta gamma"), (2, long), (3, None), (4, "  "), (None, "zz"), (5, "short")], "item_id long, text string"
    )
    rows = [
        (1, "x ALPHA beta-gamma y alpha beta gamma"), (2, None), (3, ""), (4, "..."), (5, long + " more " + long), (6, " ".join(long.split()[:12])),
        (7, "short " * 10 + "z " * 200), (8, "short " + "z " * 30), (None, "short"), (1, "other text"), (1, "other text"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = C.contamination(docs, items).collect()
    assert len(got) == len(rows)
    of = {(r.doc_id, r.n_words): r for r in got}
    r = of[1, 8]
    assert (r.n_hit, r.n_items, r.contaminated) == (6, 2, True)
    assert r.items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    assert (of[5, 61].n_hit, of[5, 61].n_items) == (60, 1)
    assert of[6, 12].n_hit == 0 and of[2, 0].n_hit == of[3, 0].n_hit == of[4, 0].n_hit == 0
    assert (of[7, 210].n_hit, of[7, 210].contaminated) == (10, False)
    assert (of[8, 31].n_hit, of[8, 31].contaminated) == (1, False)
    assert (of[None, 1].n_hit, of[None, 1].contaminated) == (1, True)
    assert of[1, 2].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = C.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted((x.doc_id for x in kept.collect()), key=str) == sorted([2, 3, 4, 6, 7, 8, 1, 1], key=str)
    cleaned = {x.doc_id: x.text for x in C.remove_spans(docs.where("doc_id IN (5, 6, 8)"), C.contamination(docs, items)).collect()}
    assert cleaned[5] == "more" and cleaned[6] == rows[5][1] and cleaned[8].split() == ["z"] * 30
    assert C.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert C.contamination(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        C.contamination(docs, items, window=0)


def test_documents_are_read_once(spark, tmp_path, monkeypatch):
    """Documents are scanned and cut into words once, and their places are looked up without a lambda; equal rows
    stay equal rows, whether the windows are broadcast or both sides are shuffled."""
    rows = [(1, "A b, c D e"), (1, "A b, c D e"), (1, "other"), (None, "b c D"), (None, "b c D"), (None, None), (2, "\u00c9 B c d"), (3, "\u00e9 b c d"), (4, "\u212a b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    items = spark.createDataFrame([(7, "B c"), (8, "b c d"), (9, "\u00c9 b"), (10, "k b")], "item_id long, text string")
    found = C.contamination(docs, items, window=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("text:string>") == 1 and plan.count(" split(") + plan.count("(split(") == 1
    below = plan[plan.index("ObjectHashAggregate") :]
    assert "split(" in below and "lambda" not in below
    want = sorted([
        (1, 5, 3, 2, [(2, 2), (2, 3)]), (1, 5, 3, 2, [(2, 2), (2, 3)]), (1, 1, 0, 0, None), (None, 3, 3, 2, [(1, 2), (1, 3)]), (None, 3, 3, 2, [(1, 2), (1, 3)]),
        (None, 0, 0, 0, None), (2, 4, 4, 3, [(1, 2), (2, 2), (2, 3)]), (3, 4, 3, 2, [(2, 2), (2, 3)]), (4, 4, 3, 2, [(2, 2), (2, 3)]),
    ], key=str)
    seen = lambda found: sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.spans and [tuple(s) for s in r.spans]) for r in found.collect()), key=str)
    assert seen(found) == want
    monkeypatch.setattr(C, "small", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert seen(C.contamination(docs, items, window=3)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_of_a_long_text(spark):
    """Texts of many parts, windows of several lengths across their borders, against a plain search."""
    rng = random.Random(8)
    item = lambda n, mark: [f"{mark}{i}" for i in range(n)]
    items = [(1, item(40, "p")), (2, item(5, "q")), (3, item(1, "r")), (4, item(13, "s")), (5, item(2, "q"))]
    rows = []
    for d, n in enumerate((1, 255, 256, 257, 268, 269, 512, 3000, 9000)):
        w = [rng.choice("abcd") for _ in range(n)]
        for _ in range(n // 60):
            part = rng.choice(items)[1]
            cut = part[rng.randrange(0, max(len(part) - 13, 1)) :][: rng.choice([12, 13, 14, 40])]
            i = rng.choice([rng.randrange(n), 256 * rng.randrange(n // 256 + 1) - rng.randrange(14)])
            if 0 <= i <= n - len(cut):
                w[i : i + len(cut)] = cut
        rows.append((d, w))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    windows = {tuple(w[i : i + 13]) for _, w in items for i in range(max(len(w) - 12, 1))}
    found = C.contamination(docs, tests)
    got = {r.doc_id: r for r in found.collect()}
    clean = {r.doc_id: r.text for r in C.remove_spans(docs, found).collect()}
    total = 0
    for d, w in rows:
        places = sorted((i + 1, n) for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows)
        hit = {i + j for i, n in places for j in range(n)}
        assert [tuple(s) for s in got[d].spans or []] == places and got[d].n_hit == len(hit)
        assert clean[d] == " ".join(x for i, x in enumerate(w, 1) if i not in hit)
        total += len(places)
    assert total > 200


def test_folding():
    assert X.fold("You 1d10t! ІDIOT m0r0n lo$er").split() == ["you", "idiot", "idiot", "moron", "loser"]
    assert X.fold("CC BY-NC 4.0, 12 $5").split() == ["cc", "by", "nc", "4", "0", "12", "5"]
    assert X.fold("").strip() == ""


def test_matching_and_exceptions():
    m = X.Matcher({" clown ": 2.0, " idio": 3.0}, ("class clown",))
    assert m.measure("the class clown") == (0.0, 0, 3)
    assert m.measure("a CL0WN, a class clown and 1di0ts") == (5.0, 2, 7)
    assert m.measure("") == (0.0, 0, 0)
    assert X.Matcher({}, ()).measure("clown") == (0.0, 0, 1)


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"word{rng.randrange(300)}" for _ in range(60)) + (" vileone vileone" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, ""), (None, "vileone"), (9003, "a " * 20_000 + " vileone")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = X.learn(docs, labels)
    assert " vileone " in model.lexicon
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert len(got) == 604
    truth = {r[0]: r[2] for r in rows}
    assert all(got[d].predicted == t for d, t in truth.items() if got[d].held_out)
    assert got[9001].predicted == got[9002].predicted == 0 and 0 <= got[9001].score < 0.5
    assert X.drop_toxic(docs.withColumn("_weight", docs.doc_id), model).columns == ["doc_id", "text", "_weight"]
    nothing = X.learn(docs, labels.where("toxic = 0"))
    assert nothing.lexicon == {} and X.score(docs, nothing).where("predicted = 1").count() == 0
    assert X.score(docs.limit(0), model).count() == 0


def test_near_copies_of_a_sample(spark):
    passage = [f"p{i}" for i in range(60)]
    apart = [(" ".join([f"u{d}_{i}" for i in range(240)] + passage), d % 2) for d in range(40)]
    same = [("one text that stands here many times", 1)] * 30
    got = X._unlike(spark.createDataFrame(apart + same + [("", 0), (None, 0), ("two", 0)], "_text string, _toxic int"))
    assert sorted(r._text for r in got.where("_text LIKE 'u%' OR _text LIKE 'one%'").collect()) == sorted([t for t, _ in apart] + [same[0][0]])


def test_critical_value():
    assert [round(X._critical(level, 1), 3) for level in (0.05, 0.01)] == [3.841, 6.635]
    assert X._critical(0.01, 100) == pytest.approx(X._critical(0.0001, 1))


def test_licences(spark):
    rows = [
        ("a/LICENSE", True, "Released under the MIT License."), ("a/b/x", False, "nothing here\nat all"), ("a/b/c/LICENSE", True, "some\nLicensed under CC BY-NC 4.0.\nmore"),
        ("a/b/c/d/y", False, None), ("z", False, ""), ("LICENSE", True, "Licensed under the Apache License, Version 2.0."), ("a/b/own", False, "licensed under the GNU General Public License, version 3"),
        (None, False, "text"), ("a/b/x", False, "nothing here\nat all"), ("q/r/s", False, "license " + "word " * 5000),
    ]
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, is_license_file boolean, text string")
    own = L.declared(files).select("doc_id", "license", "cosine")
    got = {r.doc_id: r for r in L.inherit(files.join(own, "doc_id")).collect()}
    assert [got[i].effective for i in range(10)] == [
        "MIT", "MIT", "CC-BY-NC-4.0", "CC-BY-NC-4.0", "Apache-2.0", "Apache-2.0", "GPL-3.0", None, "MIT", "Apache-2.0"
    ]
    assert got[3].inherited_from == "a/b/c" and got[4].inherited_from == "" and got[6].inherited_from is None
    assert L.declared(files.limit(0)).count() == 0


def test_licences_of_repeated_and_missing_ids(spark):
    rows = [(7, "a/LICENSE", True, "Released under the MIT License."), (7, "a/x", False, "text"), (7, "b/y", False, "text"), (None, "a/z", False, None), (None, None, False, "Released under the MIT License."), (7, "a/x", False, "text")]
    files = spark.createDataFrame(rows, "doc_id long, path string, is_license_file boolean, text string")
    got = L.inherit(L.declared(files, keep=("path", "is_license_file")))
    assert sorted(((r.doc_id, r.path, r.effective) for r in got.collect()), key=str) == sorted(
        [(7, "a/LICENSE", "MIT"), (7, "a/x", "MIT"), (7, "b/y", None), (None, "a/z", "MIT"), (None, None, "MIT"), (7, "a/x", "MIT")], key=str)


def test_url_keys(spark):
    rows = [("https://u:p@WWW.Ex.Example.org:80/a/b/?q=/x#f",), ("http://h",), ("/relative/a",), ("",), (None,), ("https://h.org./",)]
    got = spark.createDataFrame(rows, "url string").select(U.url_keys(U.F.col("url")).alias("k")).collect()
    assert [sorted(r.k) for r in got] == [
        sorted(["ex.example.org", "example.org", "org", "ex.example.org/a", "ex.example.org/a/b"]), ["h"], [], [], [], ["h.org", "org"]
    ]


def test_url_verdicts(spark):
    entries = [
        ("bad.org", 10, "block"), ("bad.org", 20, None), ("bad.org", 30, "block"), ("bad.org", 30, "block"), ("bad.org/ok", 12, "allow"),
        ("sub.bad.org", 5, "allow"), ("tie.org", 3, "block"), ("tie.org", 3, "allow"), (None, 1, "block"), ("no.day", None, "block"),
    ]
    rows = [
        ("http://bad.org/x", 9, "none"), ("http://bad.org/x", 10, "block"), ("http://bad.org/x", 19, "block"), ("http://bad.org/x", 20, "none"),
        ("http://bad.org/x", 400, "block"), ("http://bad.org/ok/z", 11, "block"), ("http://bad.org/ok/z", 12, "allow"), ("http://bad.org/okay", 12, "block"),
        ("http://a.sub.bad.org/", 15, "allow"), ("http://tie.org", 3, "allow"), ("http://no.day", 9, "none"), (None, 9, "none"), ("http://bad.org/x", None, "none"),
        ("http://bad.org/x", 10, "block"), ("http://notbad.org", 10, "none"),
    ]
    captures = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, day int, want string")
    lists = spark.createDataFrame(entries, "pattern string, day int, action string")
    got = U.url_verdicts(captures, lists).collect()
    assert len(got) == len(rows) and all(r.verdict == r.want for r in got), [r for r in got if r.verdict != r.want]
    assert {r.verdict for r in U.url_verdicts(captures, lists.limit(0)).collect()} == {"none"}
    assert U.url_verdicts(captures.limit(0), lists).count() == 0
