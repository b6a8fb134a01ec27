import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import loomdoc.llm.neighbours as nb
from loomdoc.llm.mainbody import main_blocks, main_body
from loomdoc.llm.scans import _hash, anagram_hash, corrections, edge_lines, repair_evidence, repair_text, repaired_pages

PAGE = """<html><head><title>T | Site</title><style>p{}</style></head><body>
<div id="nav"><ul><li><a href="/h">Home</a></li></ul></div>
<div><!-- x --><div><H1>An article</H1><div>By Al Bo, May 3</div>
<p>The first&nbsp;paragraph of <b>this</b> text says something that is long enough to count.</p>
<p>Advertisement</p><ul><li>Short item<li><a href="/ref/1">Linked item</a></ul>
<div>Read also: Another page of the site</div>
<table><tr><td>12 cells</td></tr></table><pre>convert a &gt; b</pre>
<hr><span>Print</span><hr></div><div><h3>Related</h3><ul><li><a href="/x">Other page</a></li></ul></div>
<div><h3>2 comments</h3><p>Al: The comment is a long sentence of the kind that is in the text as well.</p></div></div>
<div><p>© 2024 Site. All rights reserved.</p></div></body></html>"""


def test_main_blocks():
    assert main_blocks(PAGE) == ["An article", "The first paragraph of this text says something that is long enough to count.", "Short item", "Linked item", "12 cells", "convert a > b"]
    assert main_blocks(None) == main_blocks("") == main_blocks("<p>no heading at all</p>") == []
    assert main_blocks("<h1>Page not found</h1><p>The address you asked for does not exist on Papersite.</p>", "http://papersite.example/a") == []
    assert main_blocks("<h1>x</h1><p>" + "The words of the text are many and they go on. " * 20_000)[0] == "x"
    # text after a heading that other sites put over lists of links, and after an advertisement
    more = "<main><h1>Bees</h1><p>Bees are insects that live in a hive and make honey of it.</p><h2>More on bees</h2><p>Ad space</p><p>They dance for each other so that the way to the flowers is known.</p></main>"
    assert main_blocks(more)[2:] == ["More on bees", "They dance for each other so that the way to the flowers is known."]
    para = "<p>The sentence of this paragraph is one of many that are in the body of the page, and it is long enough to count as text that is read.</p>"
    bare = f"<nav><a href='/'>Home page of it</a></nav><div><div><h2>Part</h2>{para * 4}</div></div><div class='x'><p>We use small files that are kept on your device so that the visits of this site can be counted.</p></div>"
    assert len(main_blocks(bare)) == 5 and main_blocks(bare)[0] == "Part"
    about = "<h1>Members</h1><p>To read on, log in to Examplepress and then come back to the page.</p>"
    assert main_blocks(about, "https://www.examplepress.org/x") == [] and len(main_blocks(about, "https://other.org")) == 2
    assert main_blocks("<h1>broken <b>page</h1><p>An unclosed paragraph that goes on and is of the length of a sentence <a href=")


def test_main_body(spark):
    df = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, None), (None, PAGE), (3, "")], "page_id long, html string").withColumn("block", F.lit("x"))
    out = main_body(df, "page_id", "html")
    assert out.count() == 12 and out.distinct().count() == 6 and {r.page_id for r in out.collect()} == {1}
    assert main_body(df.limit(0), "page_id", "html").count() == 0


def test_edge_lines():
    page = "Title of the long report\nbody line that is wide enough to fill it all up\nand the second line of the very same text, yes\nthe end.\n~ .\nPage 3 of 9"
    assert edge_lines(page) == [True, False, False, False, True, True]
    assert edge_lines("body text goes on here and is wide as the others\nwith the rest of it being of the same width yes.") == [False, False]


def test_anagram_hash(spark):
    words = ["modern", "rnodern", "straße", "a"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", anagram_hash(F.col("w")).alias("h"))
    assert {r.w: r.h for r in df.collect()} == {w: _hash(w) for w in words}
    assert _hash("modern") - _hash("m") + _hash("r") + _hash("n") == _hash("rnodern")


def test_corrections(spark):
    words = [("modern", 50), ("rnodern", 2), ("office", 90), ("0ffice", 3), ("off!ce", 1), ("hidden", 40), ("bidden", 2), ("zz-1204", 1), ("bound", 30), ("hound", 25)]
    got = {r.word: r.fixed for r in corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"rnodern": "modern", "0ffice": "office", "off!ce": "office", "bidden": "hidden"}


def test_repair(spark):
    clean = "the modern office of the hidden compiler is single-column and the modern office stays hidden " * 4
    one = "The modern office of the hidden com-\npiler is here in a row that is wide and\nthe rnodern office has a single-\ncolumn and stays so for a long time, a\n1"
    two = "A heading of it\n\nwell known thing that is of this width, so\nit ends.\n2"
    rows = [(1, 1, one, True), (1, 1, one, True), (1, 2, two, True), (1, 3, clean, False), (2, 1, None, True), (2, 2, "", True), (None, 1, one, True)]
    df = spark.createDataFrame(rows, "pdf_id long, page int, text string, ocr_used boolean").withColumn("kind", F.lit("x"))
    got = {tuple(r) for r in repair_evidence(df).collect()}
    assert got == {(1, 1, 1, "join", "compiler"), (1, 1, 3, "char", "modern"), (1, 1, 3, "join", "single-column"), (1, 1, 5, "drop", ""), (1, 2, 1, "drop", ""), (1, 2, 5, "drop", "")}
    assert repair_evidence(df.limit(0)).count() == 0
    text = {(r.pdf_id, r.page): r.text for r in repaired_pages(df).collect()}
    assert text[1, 1] == "The modern office of the hidden compiler is here in a row that is wide and the modern office has a single-column and stays so for a long time, a"
    assert text[1, 2] == "well known thing that is of this width, so it ends." and text[1, 3] == clean
    assert repair_text("a b\n\nc", []) == "a b\n\nc"


def test_repair_every_place(spark):
    """Two equal misreadings on one line, and a word divided over two pages."""
    clean = "the modern office of the hidden compiler is here and the modern office stays hidden with it " * 6
    one = "This line of the page is of the full width, so\nthe rnodern and rnodern office keeps the com-\n4"
    two = "piler, is here in a row that is wide and so\nit ends with a word or two of the kind.\n5"
    df = spark.createDataFrame([(1, 1, one, True), (1, 2, two, True), (1, 3, clean, False)], "pdf_id long, page int, text string, ocr_used boolean")
    text = {r.page: r.text for r in repaired_pages(df).collect()}
    assert text[1] == "This line of the page is of the full width, so the modern and modern office keeps the compiler,"
    assert text[2] == "is here in a row that is wide and so it ends with a word or two of the kind."
    assert {(r.line_no, r.kind, r.word) for r in repair_evidence(df).where("page = 1").collect()} == {(2, "char", "modern"), (2, "join", "compiler"), (3, "drop", "")}


def _voices(rng, n, dim=32):
    centres = rng.normal(size=(12, dim))
    x = centres[np.minimum(rng.geometric(0.3, n) - 1, 11)] + 0.3 * rng.normal(size=(n, dim))
    return x.astype(np.float32)


def _recall(got, x, asked):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    return sum(len(got[f"e{i:05d}"] & {f"e{j:05d}" for j in top[i]}) for i in asked) / (5 * len(asked))


def _found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, set()).add(r.neighbor_id)
    return got


@pytest.mark.parametrize(("n", "cell"), [(600, 4096), (600, 40), (2400, 300), (6000, 4096)])
def test_nearest_recall(spark, monkeypatch, n, cell):
    """Lists hold more rows than are reranked, so codes choose; the hot voice holds a third of all rows; small cells make many blocks."""
    monkeypatch.setattr(nb, "CELL", cell)
    rng = np.random.default_rng(1)
    x = _voices(rng, n)
    rows = [(f"e{i:05d}", [float(v) for v in x[i]]) for i in range(n)] + [("e00000", [float(v) for v in x[0]])] * 50 + [("n", None), ("z", [0.0] * 32), ("s", [1.0, 2.0]), (None, [1.0] * 32), ("q", [math.nan] * 32)]
    base = spark.createDataFrame(rows, "vec_id string, neighbor_id array<double>")
    extra = spark.createDataFrame([("c1", [float(v) for v in x[5]]), ("c2", None)], "id string, vec array<double>")
    got = _found(nb.nearest(base, "vec_id", "neighbor_id", extra=extra, dim=32, parts=8, k=5))
    assert set(got) == {f"e{i:05d}" for i in range(n)} | {"c1"} and all(len(v) == 5 for v in got.values())
    assert "e00005" in got["c1"] and all(f"e{i:05d}" not in got[f"e{i:05d}"] for i in range(n))
    assert _recall(got, x, range(n)) >= 0.9


def test_nearest_exact_and_two_levels(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = _voices(rng, 900)
    base = spark.createDataFrame([(f"e{i:05d}", [float(v) for v in x[i]]) for i in range(900)], "id string, v array<double>")
    monkeypatch.setattr(nb, "CELL", 200)
    assert _recall(_found(nb.nearest(base, "id", "v", dim=32, parts=8, exact=True)), x, range(900)) == 1.0
    q = nb.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 40, 8)
    monkeypatch.setattr(nb, "LISTS", 6)
    two = nb.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 40, 8)
    assert len(q) == 40 and len(two) == 42 and (two.nearest(x, 42)[0][:, 0] == two.nearest(x, 1)[0][:, 0]).mean() > 0.9
    assert _recall(_found(nb.nearest(base, "id", "v", dim=32, parts=8, lists=12)), x, range(900)) >= 0.9
    far = np.vstack([x[:300] * 0 + np.eye(32)[0] + 1e-3 * x[:300], np.eye(32)[1:4]])  # three rows alone in their lists
    few = spark.createDataFrame([(f"e{i:05d}", [float(v) for v in r]) for i, r in enumerate(far)], "id string, v array<double>")
    assert all(len(v) == 5 for v in _found(nb.nearest(few, "id", "v", dim=32, parts=8, lists=20, reach=1, probes=1)).values())
    y = x[:50] / np.linalg.norm(x[:50], axis=1, keepdims=True)
    assert np.abs(nb._long(nb._short(y) + [r.tobytes() for r in y], 32) - np.vstack([y, y])).max() < 5e-5


def test_nearest_of_few(spark):
    assert nb.nearest(spark.createDataFrame([], "a string, v array<float>"), "a", "v").count() == 0
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "a string, v array<double>")
    got = {(r.vec_id, r.neighbor_id) for r in nb.nearest(two, "a", "v", dim=2, parts=1).collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_llm_queries_run(spark, sf):
    from loomdoc.llm import PLANS

    for m in PLANS:
        for name, q in m.QUERIES.items():
            assert q(spark, sf).count() > 0, name
    random.seed(0)
