"""Small expected values of the conversions and catalog operators."""

import io
import json
import sqlite3
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import markup, meta, text
from loomdoc.operators import catalog, render, vectors
from loomdoc.sources import converters
from loomdoc.sources.sqlite import register
from loomdoc.streaming.live import sessions, watch_files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_cells(spark):
    assert one(spark, text.sanitize_cell(F.lit("a|b\r\nc\nd"), 80)) == "a\\|b c d"
    assert one(spark, text.sanitize_cell(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.render_cell(F.lit(None).cast("string"))) == ""
    assert one(spark, text.render_cell(F.lit("x" * 90))) == "x" * 80 + "…"
    assert one(spark, text.blob_cell(F.lit(b"\x00\x01"))) == "[BLOB: 2 bytes]"


def test_plain_text_chains(spark):
    """Literal results of each chain, whatever SQL is made of it."""
    plain = lambda t, chain: one(spark, text.apply(F.lit(t), chain))
    assert plain("# T\n\n```py\ncode\n```\n**b** and _i_ \n\n\n\n***x***", text.MARKDOWN_PLAIN) == "T\n\ncode\nb and i \n\nx"
    assert plain("## A\n![alt](u) [t](v)\n`c`", text.TEX_PLAIN) == "A\nalt t\n`c`"
    assert plain("### A\n~~gone~~ `c` **b** *i*\n```sql\nq\n```", text.ORG_PLAIN) == "A\ngone c b i\nq"
    assert plain("## `t`\n\n| a | b |\nx `y`", text.DB_PLAIN) == "t\n\n a | b \nx y"
    assert plain("<p class='x'>a <b>c</b></p>", text.TAGS) == "a c"
    assert plain("{\\i1}a{\\i0} <b>c</b>{\\an8}<font>", text.SUBTITLE_MARKDOWN) == "*a* **c**"
    assert plain("[[u][t]] [[v]]", text.ORG_LINKS) == "[t](u) <v>"


def test_paths_and_dates(spark):
    assert one(spark, meta.detect_converter(F.lit("https://youtu.be/dQw4w9WgXcQ"))) == "yt"
    assert one(spark, meta.detect_converter(F.lit("a/b/c.Tar.SRT"))) == "sub"
    assert one(spark, meta.detect_converter(F.lit("dQw4w9WgXcQ"))) == "yt"
    assert one(spark, meta.detect_converter(F.lit("file.unknown"))) == ""
    assert one(spark, meta.video_id(F.lit("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1"))) == "dQw4w9WgXcQ"
    assert one(spark, meta.page_range(F.lit("1-3,8,2,10-12"), F.lit(10))) == [0, 1, 2, 7, 9]
    assert one(spark, meta.detect_converter(F.lit("some/folder"), F.lit(True))) == "repo"
    assert one(spark, meta.input_kind(F.lit("notes of the day.wav"), F.lit(True))) == "file" and one(spark, meta.input_kind(F.lit("https://youtu.be/dQw4w9WgXcQ"), F.lit(True))) == "youtube"
    page = F.lit("<meta property='og:title' content=' Shared '><meta content=\"By Al\" data-x='1' name=\"author\"><title>Own</title>")
    got = one(spark, meta.page_fields(page, F.lit("https://www.a.org/x")))
    assert (got.title, got.description, got.author, got.sitename) == ("Shared", None, "By Al", "a.org")
    assert one(spark, meta.pdf_date(F.lit("D:20240131120000Z"))) == "2024-01-31"
    assert one(spark, meta.clock(F.lit(3725.9))) == "01:02:05"
    assert one(spark, meta.clock_srt(F.lit(3725042).cast("long"))) == "01:02:05,042"
    assert one(spark, text.stem(F.lit("https://a.b/c d/é?x=1"), url=True)) == "a_b_c_d_é_x_1"


def test_frontmatter(spark):
    f = meta.frontmatter({"zz": (F.lit("plain"), "string"), "title": (F.lit('a "b": c'), "string"), "n": (F.lit(3), "int"), "tags": (F.array(F.lit("x"), F.lit("y-z")), "list"), "none": (F.lit(None).cast("string"), "string"), "empty": (F.lit(""), "string")})
    assert one(spark, f) == '---\ntitle: "a \\"b\\": c"\ntags: [x, "y-z"]\nzz: plain\nn: 3\n---'


def test_tables(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None), (3, "c")], "id int, v string")
    r = render.render_table(df, ["id", "v"], ["id"], max_rows=2).first()
    assert r.content == "| id  | v    |\n| --- | ---- |\n| 1   | a\\|b |\n| 2   |      |\n\n> **Note:** Table truncated to 2 of 3 rows."
    s = render.table_section(df.limit(0), "t", ["id"]).first()
    assert s.section.endswith("### Data (0 rows)\n\n_No rows._\n")


def test_dialogue(spark):
    df = spark.createDataFrame([("c", 0, 1500, "A", "hi"), ("c", 1500, 61_000, "B", "yo")], "c string, s long, e long, p string, t string")
    assert render.segments_srt(df, "c", ["s"], "s", "e", "t", "p").first().content == "1\n00:00:00,000 --> 00:00:01,500\n[A] hi\n\n2\n00:00:01,500 --> 00:01:01,000\n[B] yo"
    assert render.segments_text(df, "c", ["s"], "t", "p").first().content == "A: hi\n\nB: yo"


def test_markup():
    md, m = markup.org("#+TITLE: T\n#+AUTHOR: Me\n* TODO Buy :a:b:\n** Sub\n[[u][x]] [[v]] =code= +gone+\n:PROPERTIES:\n:ID: 1\n:END:\n#+BEGIN_QUOTE\nq\n#+END_QUOTE\n| a | b |\n|---+---|\n| 1 | 2 |\n# note")
    assert m == {"title": "T", "author": "Me", "tags": ["a", "b"]}
    assert md == "- [ ] Buy\n## Sub\n[x](u) <v> `code` ~~gone~~\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    md, m = markup.man('.TH LS 1 "2024" "GNU" "User"\n.SH NAME\nls \\- list\n.TP\n.B \\-a\nall\nfiles\n.nf\nx\n.fi')
    assert m["name"] == "LS" and md == "## NAME\n\nls - list\n\n**-a**\n:   all files\n\n```\nx\n```"
    md, m = markup.tex(r"\documentclass{a}\title{T}\begin{document}\section{S}\emph{x} $a_b$ \begin{enumerate}" + "\n\\item p\n\\item[q] r\n" + r"\end{enumerate}\cite[p. 2]{k}\end{document}")
    assert m == {"title": "T"} and md == "## S\n*x* $a_b$ \n\n1. p\n2. **q** r\n\n[k, p. 2]".replace("$ \n", "$\n")
    md, m = markup.rst("T\n=\n\n:Author: A\n\nS\n-\n\n.. code-block:: py\n\n   x = 1\n\nend ``c`` `t <u>`_\n".replace("T\n=", "Tit\n===").replace("S\n-", "Sub\n---"))
    assert m == {"title": "Tit", "author": "A"} and md == "# Tit\n\n## Sub\n\n```py\nx = 1\n```\n\nend `c` [t](u)"
    nb = {"cells": [{"cell_type": "markdown", "source": ["# N\n", "t"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"output_type": "execute_result", "data": {"text/plain": "2"}}]}], "metadata": {}}
    md, m = markup.notebook(json.dumps(nb))
    assert md == "# N\nt\n\n```python\n1+1\n```\n\n```result\n2\n```" and m["title"] == "N" and m["code_cell_count"] == 1
    raw = "From: A B <a@x>\nTo: c@y\nSubject: =?utf-8?b?w6k=?=\nDate: Mon, 1 Jan 2024 10:00:00 +0100\nContent-Type: text/html\n\n<h1>T</h1><p>x <a href=\"u\">y</a></p>"
    body, m = markup.mail(raw)
    assert m["subject"] == "é" and m["date"] == "2024-01-01T09:00:00Z" and body == "# T\n\nx [y](u)"
    assert markup.subtitles("1\n00:00:01,000 --> 00:00:02,500\n<i>x</i>\n\n2\n00:00:03,000 --> 00:00:04,000\ny")[1] == (3000, 4000, "", "y")
    assert markup.subtitles("[Script Info]\nDialogue: 0,0:00:01.00,0:00:02.50,D,Al,0,0,0,,a, b\\Nc")[0] == (1000, 2500, "Al", "a, b\nc")


def test_data():
    assert converters.render_data({"a": 1, "b": None}) == "- **a**: 1\n- **b**: None"
    assert converters.strategy([{"a": 1}, {"b": 1}]) == "code_block" and converters.strategy({}) == "key_value"
    assert converters.depth({"a": {"b": [1, {}]}}) == 3
    assert converters.sniff_delimiter("a;b;c\n1;2;3\n") == ";" and converters.parse_csv('a,b\n"x\ny",2') == [["a", "b"], ["xy", "2"]]
    with pytest.raises(ValueError):
        converters.load_data("{", "json")


def test_csv_rows(spark):
    text = "a,b,a\n" + "".join(f"{i},x|{i},z{i}\n" for i in range(599)) + "599," + "w" * 90
    df = spark.createDataFrame([("table-number-1.csv", text.encode())], "source string, content binary")

    def lines(**limits):
        r = converters.convert(df, **limits).first()
        assert json.loads(r.frontmatter) == {"rows": 600, "columns": 3, "column_names": ["a", "b", "a"], "delimiter": "comma", "file_size": len(text)}
        return r.content.split("\n")

    whole = lines(max_rows=0)
    assert len(whole) == 602 and whole[0].split() == ["|", "a", "|", "b", "|", "a", "|"]
    assert [x.split(" | ")[0].strip("| ") for x in whole[2:]] == [str(i) for i in range(600)]
    assert [x.strip() for x in whole[300].strip("|").split(" | ")] == ["298", "x\\|298", "z298"] and "w" * 90 in whole[601]
    some = lines()
    assert len(some) == 504 and some[501].split(" | ")[2] == "z499 |" and some[503] == "> **Note:** Table truncated to 500 of 600 rows."
    assert "w" * 79 + "… |" in lines(max_rows=0, max_col_width=80)[601]
    assert converters.csv_table([["a"]]) == "| a   |\n| --- |" and converters.csv_table([]) == ""


def _office(kind):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:title>T</dc:title><dc:creator>Me</dc:creator></c>')
        if kind == "docx":
            z.writestr("word/document.xml", '<d xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></d>')
        else:
            ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
            z.writestr("xl/workbook.xml", f'<w {ns}><sheets><sheet name="S"/></sheets></w>')
            z.writestr("xl/worksheets/sheet1.xml", f'<w {ns}><row><c t="inlineStr"><is><t>Name</t></is></c></row><row><c><v>5</v></c></row></w>')
    return b.getvalue()


def test_convert_files(spark, tmp_path):
    (tmp_path / "notes-of-the-day.org").write_text("* H\n*b*")
    (tmp_path / "letter-number-1.docx").write_bytes(_office("docx"))
    (tmp_path / "sheet-number-1.xlsx").write_bytes(_office("xlsx"))
    (tmp_path / "broken-number-1.json").write_text("{")
    w = io.BytesIO()
    with wave.open(w, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes(b"\0\0" * 8000)
    (tmp_path / "sound-number-1.wav").write_bytes(w.getvalue())
    (tmp_path / "photo-number-1.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (3).to_bytes(4, "big") + (2).to_bytes(4, "big"))
    got = {r.source.rsplit("/", 1)[1].rsplit(".", 1)[1]: r for r in converters.convert(converters.files(spark, str(tmp_path))).collect()}
    assert got["org"].content == "# H\n**b**" and got["docx"].content == "one\n\ntwo"
    assert json.loads(got["docx"].frontmatter) == {"title": "T", "author": "Me"}
    assert got["xlsx"].content == "## S\n\n| Name |\n| --- |\n| 5 |"
    assert json.loads(got["json"].error)["code"] == "CONVERSION_FAILED" and got["json"].content is None
    assert json.loads(got["wav"].frontmatter)["duration"] == 1.0 and json.loads(got["png"].frontmatter)["width"] == 3
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    watch_files(spark, str(tmp_path), out, ck, pattern="*.org").awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "a.db")
    with sqlite3.connect(p) as c:
        c.execute("CREATE TABLE t (id INT, b BLOB)")
        c.execute("INSERT INTO t VALUES (1, x'00'), (2, NULL)")
        c.execute("CREATE VIEW v AS SELECT id FROM t")
    register(spark)
    cat = {r.name: (r.type, r.columns, r.n_rows) for r in spark.read.format("sqlite_file").option("path", p).load().collect()}
    assert cat == {"t": ("table", ["id", "b"], 2), "v": ("view", ["id"], 2)}
    rows = spark.read.format("sqlite_file").option("path", p).option("rows", "true").load().where("name = 't'").orderBy("row_no").collect()
    assert json.loads(rows[0].row) == {"id": 1, "b": "[BLOB: 1 bytes]"}


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 0.0, 1.0), ("a", [0.0, 1.0], 0.0, 10.0), ("b", None, 0.0, 1.0), ("c", [0.0, 0.0], 0.0, 1.0)], "k string, v array<double>, s double, e double")
    got = {r.k: r.centroid for r in vectors.weighted_mean(df, "k", "v", "s", "e").collect()}
    n = (1 + 100) ** 0.5
    assert list(got) == ["a"] and got["a"] == pytest.approx([1 / n, 10 / n])
    c = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "name string, centroid array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.1]), (2, [-1.0, -1.0])], "q int, v array<double>")
    got = {r.q: r.name for r in vectors.nearest_centroid(q, "q", "v", c, "name").collect()}
    assert got == {1: "x", 2: None}


def test_match_speaker(spark, monkeypatch):
    """A voice is matched with enrollments, the filter before the five nearest; centroids only where no enrollment compares."""
    s = spark.createDataFrame([("A", "Al", [0.0, 0.0, 1.0], 7), ("B", "Bo", [0.0, 0.0, 0.0], 2), ("C", "Cy", [0.0, 1.0], 1)], "id string, name string, centroid array<double>, enrollment_count int")
    near = [(f"a{i}", "A", [1.0, 0.01 * i, 0.0]) for i in range(6)]
    rows = [*near, ("b0", "B", [1.0, 0.3, 0.0]), ("b0", "B", [1.0, 0.3, 0.0]), ("b1", "B", [0.0, 0.0, 0.0]), ("b2", "B", None), ("x", "gone", [1.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "enrollment_id string, speaker_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, -1.0]), (3, [0.1, 1.0]), (4, None), (5, [0.0, 0.0, 0.0])], "q long, v array<double>")
    for cell in (4096, 2):
        monkeypatch.setattr(vectors, "CELL", cell)
        top = vectors.nearest_enrollments(q.where("q = 1"), "q", "v", e, s).orderBy("rank").collect()
        assert [(r.rank, r.enrollment_id) for r in top] == [(i + 1, f"a{i}") for i in range(5)]
        got = {r.q: (r.name, r.enrollment_id) for r in vectors.match_speaker(q, "q", "v", e, s).collect()}
        assert got == {1: ("Al", "a0"), 2: (None, None), 3: ("Cy", None), 4: (None, None), 5: (None, None)}
        only = vectors.match_speaker(q.where("q = 1"), "q", "v", e, s.where("name = 'Bo'")).first()
        assert (only.name, only.enrollment_id) == ("Bo", "b0") and only.distance == pytest.approx(1 - 1 / 1.09**0.5)


def test_catalog(spark):
    s = spark.createDataFrame([("1", "Al"), ("2", "Bo"), ("3", "Unknown_4")], "id string, name string")
    e = spark.createDataFrame([("e1", "1"), ("e2", "2")], "id string, speaker_id string")
    g = spark.createDataFrame([("g", "team"), ("h", "none")], "id string, name string")
    m = spark.createDataFrame([("g", "2"), ("g", "1")], "group_id string, speaker_id string")
    assert catalog.next_unknown(s).first().name == "Unknown_5"
    assert {r.name: r.member_count for r in catalog.group_counts(g, m).collect()} == {"team": 2, "none": 0}
    t = spark.createDataFrame([("Zed, @team, Al",)], "names string")
    assert [r.name for r in catalog.resolve_names(t, g, m, s).orderBy("pos").collect()] == ["Zed", "Al", "Bo"]
    merges = spark.createDataFrame([], catalog.SCHEMAS["speaker_merges"])
    s2, e2, m2 = catalog.merge_speakers(s, e, merges, "Al", "Bo", reason=None, merged_at="now")
    assert s2.count() == 2 and {r.speaker_id for r in e2.collect()} == {"2"} and m2.first().from_speaker == "1"
    s3, e3, m3 = catalog.delete_speaker(s, e, m, "Bo")
    assert (s3.count(), e3.count(), m3.count()) == (2, 1, 1)
    assert catalog.add_rows(s, spark.createDataFrame([("9", "Al"), ("8", "Cy")], "id string, name string"), ["name"]).count() == 4


def test_whole_catalog(spark, tmp_path):
    """The catalog from its first speaker on: enrolment, centroids, groups, merge, pruning, migration, what is refused."""
    at = "2024-01-01T00:00:00Z"
    c = catalog.Catalog.empty(spark).add_speaker("Al", at, "1").add_speaker("Bo", at, "2").add_speaker("Cy", at, "3")
    with pytest.raises(ValueError):
        c.add_speaker("Al", at, "9")
    e = spark.createDataFrame([(f"e{i}", "1" if i < 3 else "2", [1.0, 0.1 * i], f"2024-01-0{i + 1}") for i in range(6)] + [("x", "none", [1.0, 0.0], at)], "id string, speaker_id string, embedding array<double>, created_at string")
    c = c.enroll(e.withColumn("embedding", F.col("embedding").cast("array<float>")), at)
    got = {r.name: (r.enrollment_count, r.centroid) for r in c.speakers().collect()}
    assert got["Al"][0] == got["Bo"][0] == 3 and got["Cy"] == (0, None) and c.frames["enrollments"].count() == 6
    assert sum(x * x for x in got["Al"][1]) == pytest.approx(1.0)
    c.save(str(tmp_path / "one"))
    c = catalog.Catalog.open(spark, str(tmp_path / "one"))
    assert c.version() == catalog.VERSION and c.speakers().count() == 3 and catalog.Catalog.open(spark, str(tmp_path / "nothing")).speakers().count() == 0
    old = catalog.Catalog(c.frames | {"speakers": c.frames["speakers"].drop("mean_distance", "std_distance"), "schema_version": spark.createDataFrame([(1,)], "version int")}).migrated()
    assert old.version() == catalog.VERSION and "std_distance" in old.frames["speakers"].columns
    g = c.create_group("team", at, "g").add_member("team", "Al", at).add_member("team", "Al", at).add_member("team", "Bo", at)
    assert [r.name for r in g.members("team").collect()] == ["Al", "Bo"] and [r.name for r in g.named("Zed,@team").orderBy("pos").collect()] == ["Zed", "Al", "Bo"]
    assert [r.name for r in g.remove_member("team", "Bo").members("team").collect()] == ["Al"] and g.delete_group("team").groups().count() == 0
    for wrong in (lambda: g.create_group("team", at, "h"), lambda: g.delete_group("no"), lambda: g.remove_member("team", "Cy"), lambda: g.named("@no"), lambda: g.merge("Al", "Al", at), lambda: g.remove_speaker("no")):
        with pytest.raises(ValueError):
            wrong()
    m = g.merge("Al", "Bo", at)
    assert [(r.name, r.enrollment_count) for r in m.speakers().collect()] == [("Bo", 6), ("Cy", 0)] and [r.name for r in m.members("team").collect()] == ["Bo"]
    assert m.pruned(at, keep=2).speaker("Bo").first().enrollment_count == 2 and {r.id for r in m.pruned(at, keep=2).frames["enrollments"].collect()} == {"e4", "e5"}
    assert m.seen(["2"], "later").speaker("Bo").first().meeting_count == 1
    seg = spark.createDataFrame([("m", 0, [1.0, 0.4], 0.0, 9.0), ("m", 1, [-1.0, 0.0], 0.0, 1.0), ("m", 2, None, 0.0, 1.0)], "meeting string, label int, v array<double>, s double, e double")
    found = catalog.identify(seg, "meeting", "label", "v", "s", "e", m)
    got = {r.label: (r.name, r.matched, r.high_conf) for r in found.collect()}
    assert got == {0: ("Bo", True, True), 1: ("1", False, False), 2: ("2", False, False)}
    assert {r.name for r in catalog.identify(seg, "meeting", "label", "v", "s", "e", m, names=["Cy"]).collect()} == {"Unknown"}
    after = catalog.learn(m, found, "meeting", "later")
    assert after.speaker("Bo").first().enrollment_count == 7 and after.speaker("Bo").first().meeting_count == 1
    want = spark.createDataFrame([("Bo",), ("Cy",)], "name string")
    assert {tuple(r) for r in catalog.expected_report(found, want).collect()} == {("Bo", "identified"), ("Cy", "missing"), ("1", "unidentified"), ("2", "unidentified")}
    assert one(spark, catalog.from_blob(catalog.to_blob(F.array(F.lit(0.5), F.lit(-2.0))))) == [0.5, -2.0]
    assert render.fixed_table(c.speakers(), ["name", "enrollment_count"], ["name"]).first().content.split("\n")[0] == "name  enrollment_count"


def test_documents_of_files(spark, tmp_path):
    p = str(tmp_path / "shop.db")
    with sqlite3.connect(p) as c:
        c.execute("CREATE TABLE t (id INT, b BLOB)")
        c.execute("INSERT INTO t VALUES (1, x'00'), (2, NULL)")
        c.execute("CREATE VIEW v AS SELECT id FROM t WHERE id > 5")
    box = b"From a@x Mon\nSubject: one\n\nbody\n\nFrom b@x Tue\nSubject: two\n\nThe text\nFrom here says it\n"
    df = spark.createDataFrame([(p, open(p, "rb").read()), ("mails-of-may.mbox", box), ("none-of-it.mbox", b""), ("bad-file-1.db", b"no database")], "source string, content binary")
    got = {r.source: r for r in converters.convert(df, style="md", fetched_at="now").collect()}
    text = got[p].content
    assert "# shop.db\n\n## `t`\n\n### Schema\n\n```sql\nCREATE TABLE t (id INT, b BLOB)\n```\n\n### Data (2 rows)\n\n| id | b |\n| --- | --- |\n| 1 | [BLOB: 1 bytes] |\n| 2 |  |\n\n_2 rows._\n" in text
    assert "## `v` _(view)_" in text and "_No rows._" in text and "table_count: 2\ntotal_rows: 2" in text
    assert {s for s in got if "mbox" not in s and s.startswith("mails")} == {"mails-of-may_001.eml", "mails-of-may_002.eml"}
    assert got["mails-of-may_002.eml"].content.endswith("# two\n\nThe text\nFrom here says it") and got["bad-file-1.db"].error
    plain = converters.convert(df.where("source like '%shop.db'"), style="txt").first().content
    assert "|" not in plain.split("Data (2 rows)")[1].split("_")[0].replace(" | ", "")


def test_write_files(spark, tmp_path):
    from loomdoc.sources.sinks import write_files

    df = spark.createDataFrame([("a/b.md", "x\ny"), ("c.md", None), (None, "z")], "n string, t string")
    write_files(df, str(tmp_path / "out"), "n", "t")
    assert (tmp_path / "out/a/b.md").read_text() == "x\ny" and (tmp_path / "out/c.md").read_text() == ""


def test_sessions_batch(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:30:00"), ("u", "2024-01-01 03:00:00")], "u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n_rows for r in sessions(df, "u", "t").collect()) == [1, 2]


def test_all_queries_run(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, q in entry.queries().items():
        if not name[0] == "p" or not name[1].isdigit():
            q(spark, sf).limit(1).collect()
    assert entry.entry(spark).count() >= 0


def test_plans_keep_out_of_python(spark, sf):
    """Text chains, runs and timestamps are planned without a Python worker, and scans read only what they need."""
    import __spark_entry__ as entry

    for name in ("markdown_to_plain", "p1_found", "p4_found", "run_merge", "overlap_assign"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInPandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_command_line(spark, tmp_path, capsys):
    from loomdoc.cli import main, picked

    (tmp_path / "in").mkdir()
    (tmp_path / "in/notes-of-may.org").write_text("#+TITLE: T\n* H\n*b*")
    (tmp_path / "in/rows-of-may.csv").write_text("a,b\n1,2\n")
    out = tmp_path / "out"
    assert main(["convert", str(tmp_path / "in"), "-o", str(out), "--fetched-at", "now"], spark) == 0
    assert (out / "notes-of-may.md").read_text().endswith("\n\n# H\n**b**") and sorted(p.name for p in out.glob("*.md")) == ["notes-of-may.md", "rows-of-may.md"]
    assert main(["convert", str(tmp_path / "in"), "--tool", "org", "--json", "--fields", "frontmatter.title,converter,none"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"frontmatter": {"title": "T"}, "converter": "org", "none": None}
    assert picked('{"a": 1}', None) == '{"a": 1}'
    one_, two = str(tmp_path / "cat"), str(tmp_path / "cat2")
    assert main(["speaker", "add", "Al", "--catalog", one_, "--out", two, "--at", "2024-01-01T00:00:00Z"], spark) == 0
    assert main(["speaker", "list", "--catalog", two], spark) == 0
    assert capsys.readouterr().out.split("\n")[2].split() == ["Al", "0", "0", "-"]
    assert main(["speaker", "remove", "Bo", "--catalog", two, "--out", one_], spark) == 1 and "not found" in capsys.readouterr().err
    assert main(["deps"]) == main(["completion", "bash"]) == main(["models", "--json"]) == 0 and main(["front", '{"title": "a: b"}']) == 0
    assert capsys.readouterr().out.endswith('---\ntitle: "a: b"\n---\n')
