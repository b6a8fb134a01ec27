"""One query for each file format: a file of every customer is written, converted, and held against the document it must become.

``CASES`` has the file and the document as literals; ``{k}``, ``{n}`` and ``{s}`` are the customer's key, name and segment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.session import table
from loomdoc.sources.converters import convert

AT = "2024-01-01T00:00:00Z"

#: Name: suffix, style, file, document.
CASES = {
    "org_document": (
        "org", "md",
        "#+TITLE: {n}\n* TODO Call {n} :{s}:\n** Part {k}\nA *bold* word, /slanted/, =code {k}=, a_b_c, [[http://x/{k}][{n}]] and [[y]].\n| key | name |\n|-----+------|\n| {k} | {n} |\n#+BEGIN_QUOTE\nsaid {k}\n#+END_QUOTE\n# hidden\n:DRAWER:\nx\n:END:\n#+BEGIN_SRC sql\nselect *{k}*\n#+END_SRC\n",
        '---\ntitle: "{n}"\ntags: [{s}]\nfetched_at: "2024-01-01T00:00:00Z"\nsource: "file-{k}.org"\n---\n\n- [ ] Call {n}\n## Part {k}\nA **bold** word, *slanted*, `code {k}`, a_b_c, [{n}](http://x/{k}) and <y>.\n| key | name |\n|-----|------|\n| {k} | {n} |\n\n> said {k}\n\n```sql\nselect *{k}*\n```',
    ),
    "org_plain_document": ("org", "txt", "* Head {k}\nA *bold* word and ~code~, +gone+.\n** Sub\n- item {n}\n", "Head {k}\nA bold word and code, gone.\nSub\n- item {n}"),
    "man_document": (
        "1", "md",
        '.TH {n} 1 "May 2024" "Pack {k}"\n.\\" hidden\n.SH NAME\n{n} \\- a \\fBcustomer\\fR of \\fI{s}\\fP\n.TP\n.B \\-k\nthe key\n{k}\n.PP\n.nf\nraw\\e{k}\n.fi\n',
        '---\nfetched_at: "2024-01-01T00:00:00Z"\nname: "{n}"\nsection: 1\ndate: May 2024\nsource: Pack {k}\nsource_file: "file-{k}.1"\n---\n\n## NAME\n\n{n} - a **customer** of *{s}*\n\n**-k**\n:   the key {k}\n\n```\nraw\\{k}\n```',
    ),
    "tex_document": (
        "tex", "md",
        "\\documentclass[a4]{article}\n\\title{On \\emph{{s}}}\n\\begin{document}\n\\maketitle\n\\begin{abstract}Short {k}.\\end{abstract}\n\\section{Part {k}}\nA \\textbf{bold \\emph{both}} word, $x_{{k}}$ and ``quoted'' -- see \\cite[p. 2]{c{k}}.\n\\begin{enumerate}\n\\item first\n\\item second {k}\n\\end{enumerate}\n\\begin{verbatim}\na & b_{k}\n\\end{verbatim}\n\\href{http://x/{k}}{link}\\footnote{note}\n\\end{document}\n",
        '---\ntitle: On {s}\nfetched_at: "2024-01-01T00:00:00Z"\nsource: "file-{k}.tex"\n---\n\n> **Abstract.** Short {k}.\n\n## Part {k}\n\nA **bold *both*** word, $x_{{k}}$ and “quoted” – see [c{k}, p. 2].\n\n1. first\n2. second {k}\n\n```\na & b_{k}\n```\n\n[link](http://x/{k}) (note)',
    ),
    "rst_document": (
        "rst", "md",
        "{s} of {k}\n=========================\n\n:Author: Al\n\nPart\n----\n\nSome ``code`` and `link <u>`_ here::\n\n   raw {k}\n\nend\n",
        '---\ntitle: {s} of {k}\nfetched_at: "2024-01-01T00:00:00Z"\nauthor: Al\nsource: "file-{k}.rst"\n---\n\n# {s} of {k}\n\n## Part\n\nSome `code` and [link](u) here:\n\n```\nraw {k}\n```\n\nend',
    ),
    "notebook_document": (
        "ipynb", "md",
        '{"metadata": {"kernelspec": {"language": "python"}}, "cells": [{"cell_type": "markdown", "source": ["# {s}\\n", "text {k}"]}, {"cell_type": "code", "source": "print({k})", "outputs": [{"output_type": "stream", "text": ["{k}\\n"]}, {"output_type": "display_data", "data": {"image/png": "x"}}, {"output_type": "execute_result", "data": {"text/plain": "{k}"}}]}]}',
        '---\ntitle: {s}\nfetched_at: "2024-01-01T00:00:00Z"\nkernel_language: python\ncell_count: 2\ncode_cell_count: 1\nmarkdown_cell_count: 1\nsource: "file-{k}.ipynb"\n---\n\n# {s}\ntext {k}\n\n```python\nprint({k})\n```\n\n```output\n{k}\n```\n\n[image output omitted]\n\n```result\n{k}\n```',
    ),
    "subtitle_document": (
        "srt", "md",
        "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> {k}\n\n2\n01:00:03,000 --> 01:00:04,000\n{\\b1}{s}{\\b0} <font color='x'>end</font>\n",
        '---\nduration: 3604.0\nfetched_at: "2024-01-01T00:00:00Z"\nsubtitle_count: 2\nformat: srt\nsource: "file-{k}.srt"\n---\n\n**[00:01]** *Hello* {k}\n\n**[01:00:03]** **{s}** end\n',
    ),
    "subtitle_speakers": (
        "ass", "md",
        "[Script Info]\n[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,D,Al,0,0,0,,Hi, {k}\nDialogue: 0,0:00:02.00,0:00:03.00,D,Al,0,0,0,,more\nDialogue: 0,0:00:04.00,0:00:05.50,D,Bo,0,0,0,,{s}\n",
        '---\nduration: 5.5\nfetched_at: "2024-01-01T00:00:00Z"\nsubtitle_count: 3\nformat: ass\nspeakers: [Al, Bo]\nsource: "file-{k}.ass"\n---\n\n**Al** [00:01]\n\nHi, {k} more\n\n**Bo** [00:04]\n\n{s}\n',
    ),
    "subtitle_plain": ("srt", "txt", "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> {k}\n\n2\n00:00:03,000 --> 00:00:04,000\n{s}\n", "*Hello* {k}\n{s}"),
    "csv_document": (
        "csv", "md", "key,name,name\n{k},{n},a|b\n7\n",
        '---\nfetched_at: "2024-01-01T00:00:00Z"\nrows: 2\ncolumns: 3\ncolumn_names: [key, name, name]\ndelimiter: comma\nfile_size: {z}\nsource: "file-{k}.csv"\n---\n\n| {pk} | name               | name |\n| {dk} | ------------------ | ---- |\n| {k:} | {n} | a\\|b |\n| {p7} |                    |      |',
    ),
    "data_document": (
        "json", "md", '{"name": "{n}", "key": {k}, "none": null}',
        '---\nfetched_at: "2024-01-01T00:00:00Z"\nformat: json\nfile_size: {z}\ntop_level_type: object\nkey_count: 3\nnesting_depth: 1\nsource: "file-{k}.json"\n---\n\n- **name**: {n}\n- **key**: {k}\n- **none**: None',
    ),
    "data_table_document": ("jsonl", "body", '{"a": {k}, "b": "x|y"}\n\n{"a": 2, "b": "{s}"}\n', "| a | b |\n| --- | --- |\n| {k} | x\\|y |\n| 2 | {s} |"),
    "data_nested_document": ("json", "body", '{"a": {"b": [{k}, {}]}}', '```json\n{\n  "a": {\n    "b": [\n      {k},\n      {}\n    ]\n  }\n}\n```'),
    "data_plain_table": ("json", "txt", '[{"a": {k}, "b": "{s}"}, {"a": 2, "b": null}]', "a\tb\n{k}\t{s}\n2\tNone"),
    "data_plain_keys": ("json", "txt", '{"a": {k}, "b": "{s}"}', "a: {k}\nb: {s}"),
    "mail_document": (
        "eml", "md",
        "From: Al Bo <al@x>\nTo: c@y\nSubject: About {k}\nDate: Mon, 1 Jan 2024 10:00:00 +0100\nMessage-ID: <{k}@x>\nContent-Type: text/html\n\n<h1>T {k}</h1><p>x <a href=\"u\">{s}</a> &amp; <b>y</b></p>",
        '---\nfetched_at: "2024-01-01T00:00:00Z"\nsubject: About {k}\nfrom: "Al Bo <al@x>"\nto: "c@y"\ndate: "2024-01-01T09:00:00Z"\nmessage_id: "<{k}@x>"\ncontent_type: text/html\nsource: "file-{k}.eml"\n---\n\n# About {k}\n\n# T {k}\n\nx [{s}](u) & **y**',
    ),
    "mail_plain": ("eml", "txt", "Subject: Hi {k}\nContent-Type: text/plain\n\nbody {s}\n", "Hi {k}\n{eq}\n\nbody {s}"),
    "html_document": ("html", "body", "<html><body><h2>A <b>{k}</b></h2><ul><li>x <i>{s}</i></li><li>y</li></ul>a<br>b<hr><pre>c  d</pre><p>open <strong>end</strong></body></html>", "## A {k}\n\n- x *{s}*\n- y\n\na\nb\n---\n\n```\nc  d\n```\nopen **end**"),
}


def _query(name: str):
    suffix, style, file, _ = CASES[name]

    def run(spark, sf):
        text = F.lit(file)
        for mark, col in (("{k}", F.col("c_custkey").cast("string")), ("{n}", F.col("c_name")), ("{s}", F.col("c_mktsegment"))):
            text = F.replace(text, F.lit(mark), col)
        rows = table(spark, sf, "customer").select(F.concat(F.lit("file-"), F.col("c_custkey").cast("string"), F.lit(f".{suffix}")).alias("source"), F.encode(text, "UTF-8").alias("content"))
        return convert(rows, style=style, fetched_at=AT).select("source", "content", "error")

    run.__name__ = name
    return run


def _sql(name: str) -> str:
    """The document as a literal with the customer's values put in; ``{z}`` is the file's size, ``{eq}`` the rule under a mail's subject, the rest pads a CSV column."""
    suffix, _, file, document = CASES[name]
    lit = lambda t: "'" + t.replace("'", "''") + "'"
    key = "CAST(c_custkey AS VARCHAR)"
    values = {"{k}": key, "{n}": "c_name", "{s}": "c_mktsegment"}
    wide = f"greatest(3, length({key}))"
    size = f"strlen(replace(replace(replace({lit(file)}, '{{k}}', {key}), '{{n}}', c_name), '{{s}}', c_mktsegment))"
    more = {
        "{z}": f"CAST({size} AS VARCHAR)", "{eq}": f"repeat('=', CAST(3 + length({key}) AS INT))", "{pk}": f"rpad('key', CAST({wide} AS INT), ' ')", "{dk}": f"repeat('-', CAST({wide} AS INT))",
        "{k:}": f"rpad({key}, CAST({wide} AS INT), ' ')", "{p7}": f"rpad('7', CAST({wide} AS INT), ' ')",
    }
    text = lit(document)
    for mark, col in (values | more).items():
        text = f"replace({text}, '{mark}', {col})"
    return f"SELECT 'file-' || c_custkey || '.{suffix}' AS source, {text} AS content, CAST(NULL AS VARCHAR) AS error FROM customer"


QUERIES = {name: _query(name) for name in CASES}
SQL = {name: _sql(name) for name in CASES}
