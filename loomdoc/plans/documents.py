"""Queries of text, metadata and rendering operators over web pages, documents and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import markup, meta, text
from loomdoc.functions.text import S
from loomdoc.operators import render
from loomdoc.session import table

PINNED = "2024-01-01T00:00:00Z"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_pages").select("page_id", "url", "html").where("html is not null")


def html_title(spark, sf):
    return _pages(spark, sf).select("page_id", meta.html_title(F.col("html")).alias("title"))


def html_meta(spark, sf):
    return _pages(spark, sf).select("page_id", meta.html_meta(F.col("html"), "description").alias("description"))


def html_strip_tags(spark, sf):
    return _pages(spark, sf).select("page_id", text.apply(F.col("html"), text.TAGS).alias("plain"))


def html_to_markdown(spark, sf):
    return _pages(spark, sf).select("page_id", text.marked_up(F.col("html"), markup.html_markdown).alias("markdown"))


def html_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a[^>]+href=["']([^"']*)["']"""), 1)
    return _pages(spark, sf).select("page_id", F.posexplode(found).alias("pos", "href"))


def url_stem(spark, sf):
    return table(spark, sf, "web_pages").select("page_id", text.stem(F.col("url"), url=True).alias("stem"))


def url_sitename(spark, sf):
    return table(spark, sf, "web_pages").select("page_id", meta.sitename(F.col("url")).alias("sitename"))


def detect_converter(spark, sf):
    docs = table(spark, sf, "documents").where("source is not null").select("doc_id", F.concat_ws(".", "source", "converter").alias("path"))
    return docs.select("doc_id", meta.detect_converter(F.col("path")).alias("tool"))


def markdown_to_plain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.apply(F.col("text"), text.MARKDOWN_PLAIN).alias("plain"))


def org_to_plain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.apply(F.col("text"), text.ORG_PLAIN).alias("plain"))


def tex_to_plain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.apply(F.col("text"), text.TEX_PLAIN).alias("plain"))


def db_to_plain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.apply(F.col("text"), text.DB_PLAIN).alias("plain"))


def org_links(spark, sf):
    made = F.concat(F.lit("[["), F.col("url"), F.lit("]["), F.coalesce(meta.html_title(F.col("html")), F.lit("x")), F.lit("]] [["), F.col("url"), F.lit("]]"))
    return _pages(spark, sf).select("page_id", text.apply(made, text.ORG_LINKS).alias("markdown"))


def subtitle_tags(spark, sf):
    made = F.concat(F.lit("<b>"), F.coalesce("speaker", F.lit("?")), F.lit("</b> {\\i1}"), F.col("text"), F.lit("{\\i0}<font>"))
    return table(spark, sf, "transcript_segments").select("seg_id", "clip_id", text.apply(made, text.SUBTITLE_MARKDOWN).alias("markdown"))


def frontmatter_scalar(spark, sf):
    return _pages(spark, sf).select("page_id", meta.yaml_scalar(meta.html_title(F.col("html"))).alias("scalar"))


def page_document(spark, sf):
    fields = {
        "title": (meta.html_title(F.col("html")), "string"), "url": (F.col("url"), "string"), "description": (meta.html_meta(F.col("html"), "description"), "string"),
        "sitename": (meta.sitename(F.col("url")), "string"), "fetched_at": (F.lit(PINNED), "string"),
    }
    return _pages(spark, sf).select("page_id", meta.document(meta.frontmatter(fields), text.apply(F.col("html"), text.TAGS)).alias("content"))


def email_frontmatter(spark, sf):
    fields = {"subject": (F.col("subject"), "string"), "from": (F.col("msg_from"), "string"), "attachments": (F.filter("attachments", lambda x: x.isNotNull()), "list")}
    return table(spark, sf, "emails").select("email_id", meta.frontmatter(fields).alias("front"))


def sanitize_cells(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.sanitize_cell(F.col("text"), 60).alias("cell"), text.render_cell(F.col("text"), 60).alias("db_cell"), text.escape_md_cell(F.col("text")).alias("md_cell"))


def table_markdown(spark, sf):
    return render.render_table(table(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])


def table_plain(spark, sf):
    return render.render_table(table(spark, sf, "region"), ["r_regionkey", "r_name"], ["r_regionkey"], style="plain")


def table_truncated(spark, sf):
    return render.render_table(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"], max_rows=20)


def db_sections(spark, sf):
    parts = [render.table_section(table(spark, sf, n), n, [k]) for n, k in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("mailboxes", "source"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Tables that the profile counts.
PROFILED = "region nation customer supplier part orders lineitem events documents embeddings emails web_pages diarized_segments transcript_segments pdf_pages enrollments speakers mailboxes clip_speakers eval_items".split()


def db_profile(spark, sf):
    out = None
    for n in PROFILED:
        t = table(spark, sf, n)
        one = t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(t.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def pages_markdown(spark, sf):
    p = table(spark, sf, "pdf_pages").groupBy("pdf_id", "page").agg(F.min("text").alias("text"), F.max("is_thin").alias("is_thin"))
    return render.pages_markdown(p, "pdf_id", "page", "text", "is_thin")


def pages_text(spark, sf):
    p = table(spark, sf, "pdf_pages").groupBy("pdf_id", "page").agg(F.min("text").alias("text"))
    return render.pages_text(p, "pdf_id", "page", "text")


def json_profile(spark, sf):
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", F.size(keys).cast("int").alias("key_count"), F.array_join(keys, ",").alias("keys"), F.octet_length("props").cast("int").alias("n_bytes"))


def json_key_value(spark, sf):
    """Every key and value of each event's properties as a list."""
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    lines = F.transform(pairs, lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), F.coalesce(e["value"], F.lit("None"))))
    return table(spark, sf, "events").where("props is not null").select("event_id", F.array_join(lines, "\n").alias("lines"))


def fields_projection(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.struct("lang", F.struct("source", "converter").alias("origin")).alias("frontmatter"), F.col("text").alias("content"))
    out = meta.project_fields("frontmatter.origin.source,frontmatter.lang,frontmatter.none", {"frontmatter": {"lang": None, "origin": {"source": None, "converter": None}}, "content": None})
    return d.select("doc_id", out.alias("o")).select("doc_id", F.col("o.frontmatter.origin.source").alias("source"), F.col("o.frontmatter.lang").alias("lang"), F.col("o.frontmatter.none").alias("none"))


def envelope_rows(spark, sf):
    """What each part of the envelope holds, read back from its JSON."""
    e = table(spark, sf, "documents").select("doc_id", meta.envelope(F.struct("lang", "n_chars"), F.col("text"), F.col("source"), "data").alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return e.select("doc_id", at("$.frontmatter.lang").alias("lang"), at("$.frontmatter.n_chars").cast("long").alias("n_chars"), F.md5(at("$.content")).alias("content_md5"), at("$.source").alias("source"), at("$.converter").alias("converter"))


QUERIES = {f.__name__: f for f in (
    html_title, html_meta, html_strip_tags, html_to_markdown, html_links, url_stem, url_sitename, detect_converter, markdown_to_plain, org_to_plain, tex_to_plain, db_to_plain, org_links,
    subtitle_tags, frontmatter_scalar, page_document, email_frontmatter, sanitize_cells, table_markdown, table_plain, table_truncated, db_sections, db_profile, pages_markdown, pages_text,
    json_profile, json_key_value, fields_projection, envelope_rows,
)}

_T = "nullif(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '" + S + "+', ' ', 'g'), '^" + S + "+|" + S + "+$', '', 'g'), '')"
_M = lambda a: "nullif(regexp_replace(regexp_extract(html, '" + a.replace("'", "''") + "', 1), '^" + S + "+|" + S + "+$', '', 'g'), '')"
_D = "coalesce(" + _M(r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""") + ", " + _M(r"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]+name=["']description["']""") + ")"
_SITE = r"nullif(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1), '')"
_P = "web_pages WHERE html IS NOT NULL"


def _scalar(x: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, '[:#{{}}\[\]&*?|\->!%@`"'',\n]') OR {x} IN ('true','false','null','yes','no') THEN '"' || replace(replace({x}, '\', '\\'), '"', '\"') || '"' ELSE {x} END"""


def _table(name: str, cols: list[str], order: str, limit: int, plain: bool = False) -> str:
    """SQL of the padded table."""
    cell = lambda c: rf"coalesce(regexp_replace(replace(regexp_replace(CAST({c} AS VARCHAR), '\r\n|\r|\n', ' ', 'g'), '|', '\|'), '^$', ''), '')"
    sel = ", ".join(f"{cell(c)} AS c{i}" for i, c in enumerate(cols))
    wid = ", ".join(f"greatest(3, {len(c)}, coalesce(max(length(c{i})), 0)) AS w{i}" for i, c in enumerate(cols))
    sep = "'  '" if plain else "' | '"
    row = f" || {sep} || ".join(f"rpad(c{i}, CAST(w{i} AS INT), ' ')" for i in range(len(cols)))
    head = f" || {sep} || ".join(f"rpad('{c}', CAST(w{i} AS INT), ' ')" for i, c in enumerate(cols))
    dash = f" || {sep} || ".join(f"repeat('-', CAST(w{i} AS INT))" for i in range(len(cols)))
    if plain:
        row, head = f"rtrim({row})", f"rtrim({head})"
    else:
        row, head, dash = (f"'| ' || {x} || ' |'" for x in (row, head, dash))
    note = (
        "chr(10) || chr(10) || '(Table truncated to ' || k || ' of ' || n || ' rows.)'" if plain else "chr(10) || chr(10) || '> **Note:** Table truncated to ' || k || ' of ' || n || ' rows.'"
    )
    return f"""
WITH s AS (SELECT row_number() OVER (ORDER BY {order}) AS o, {sel} FROM {name} ORDER BY {order} LIMIT {limit}),
w AS (SELECT {wid} FROM s), t AS (SELECT count(*) AS n FROM {name}),
b AS (SELECT string_agg({row}, chr(10) ORDER BY o) AS body, count(*) AS k FROM s, w)
SELECT {head} || chr(10) || {dash} || chr(10) || body || CASE WHEN n > k THEN {note} ELSE '' END AS content, n AS n_rows, n > k AS truncated FROM w, b, t"""


def _section(name: str, cols: list[str], order: str) -> str:
    row = " || ' | ' || ".join(f"coalesce(translate(replace(CASE WHEN length(CAST({c} AS VARCHAR)) > 80 THEN substr(CAST({c} AS VARCHAR), 1, 80) || '…' ELSE CAST({c} AS VARCHAR) END, '|', '\\|'), chr(10) || chr(13), '  '), '')" for c in cols)
    head = "| " + " | ".join(cols) + " |"
    dash = "| " + " | ".join(["---"] * len(cols)) + " |"
    return f"""
SELECT '{name}' AS name, n AS n_rows, '## `{name}`' || chr(10) || chr(10) || '### Schema' || chr(10) || chr(10) || '_No schema available._' || chr(10) || chr(10) || '### Data (' || n || ' row' || CASE WHEN n = 1 THEN '' ELSE 's' END || ')' || chr(10) || chr(10)
 || '{head}' || chr(10) || '{dash}' || chr(10) || b || chr(10) || CASE WHEN n > 10 THEN chr(10) || '_Showing 10 of ' || n || ' rows._' || chr(10) ELSE chr(10) || '_' || n || ' row' || CASE WHEN n = 1 THEN '' ELSE 's' END || '._' || chr(10) END AS section
FROM (SELECT count(*) AS n FROM {name}), (SELECT string_agg('| ' || {row} || ' |', chr(10) ORDER BY {order}) AS b FROM (SELECT * FROM {name} ORDER BY {order} LIMIT 10))"""


_CONV = "CASE lower(regexp_extract(path, '[^/.][^/]*\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in meta.CONVERTERS.items()) + " ELSE '' END"

SQL = {
    "html_title": f"SELECT page_id, {_T} AS title FROM {_P}",
    "html_meta": f"SELECT page_id, {_D} AS description FROM {_P}",
    "html_strip_tags": f"SELECT page_id, {text.apply_sql('html', text.TAGS)} AS plain FROM {_P}",
    "html_links": "SELECT page_id, pos, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]+href=[\"'']([^\"'']*)[\"'']', 1) AS h FROM web_pages WHERE html IS NOT NULL))",
    "url_stem": f"SELECT page_id, coalesce(nullif(substr({text.apply_sql(chr(117), text.STEM)}, 1, 80), ''), 'output') AS stem FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM web_pages)",
    "url_sitename": f"SELECT page_id, {_SITE} AS sitename FROM web_pages",
    "detect_converter": f"SELECT doc_id, CASE WHEN regexp_matches(path, '^[A-Za-z0-9_-]{{11}}$') THEN 'yt' ELSE {_CONV} END AS tool FROM (SELECT doc_id, concat_ws('.', source, converter) AS path FROM documents WHERE source IS NOT NULL)",
    "markdown_to_plain": f"SELECT doc_id, {text.apply_sql('text', text.MARKDOWN_PLAIN)} AS plain FROM documents",
    "org_to_plain": f"SELECT doc_id, {text.apply_sql('text', text.ORG_PLAIN)} AS plain FROM documents",
    "tex_to_plain": f"SELECT doc_id, {text.apply_sql('text', text.TEX_PLAIN)} AS plain FROM documents",
    "db_to_plain": f"SELECT doc_id, {text.apply_sql('text', text.DB_PLAIN)} AS plain FROM documents",
    "org_links": f"SELECT page_id, {text.apply_sql('t', text.ORG_LINKS)} AS markdown FROM (SELECT page_id, '[[' || url || '][' || coalesce({_T}, 'x') || ']] [[' || url || ']]' AS t FROM {_P})",
    "subtitle_tags": f"SELECT seg_id, clip_id, {text.apply_sql('t', text.SUBTITLE_MARKDOWN)} AS markdown FROM (SELECT seg_id, clip_id, '<b>' || coalesce(speaker, '?') || '</b> {{\\i1}}' || text || '{{\\i0}}<font>' AS t FROM transcript_segments)",
    "frontmatter_scalar": f"SELECT page_id, {_scalar('t')} AS scalar FROM (SELECT page_id, {_T} AS t FROM {_P})",
    "page_document": f"""SELECT page_id, concat_ws(chr(10), '---', 'title: ' || {_scalar('t')}, 'url: ' || {_scalar('url')}, 'description: |' || chr(10) || '  ' || replace(replace(d, '\\', '\\\\'), chr(10), chr(10) || '  '),
 'fetched_at: ' || {_scalar(chr(39) + PINNED + chr(39))}, 'sitename: ' || {_scalar('s')}, '---') || chr(10) || chr(10) || {text.apply_sql('html', text.TAGS)} AS content
 FROM (SELECT page_id, url, html, {_T} AS t, {_D} AS d, {_SITE} AS s FROM {_P})""",
    "email_frontmatter": f"""SELECT email_id, concat_ws(chr(10), '---', 'subject: ' || {_scalar("nullif(subject, '')")}, 'from: ' || {_scalar("nullif(msg_from, '')")},
 CASE WHEN len(a) > 10 THEN 'attachments:' || chr(10) || array_to_string(list_transform(a, lambda x: '  - ' || {_scalar('x')}), chr(10)) WHEN len(a) > 0 THEN 'attachments: [' || array_to_string(list_transform(a, lambda x: {_scalar('x')}), ', ') || ']' END, '---') AS front
 FROM (SELECT email_id, subject, msg_from, list_filter(attachments, lambda x: x IS NOT NULL) AS a FROM emails)""",
    "sanitize_cells": r"""SELECT doc_id, CASE WHEN length(v) > 60 THEN substr(v, 1, 59) || '…' ELSE v END AS cell,
 coalesce(translate(replace(CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END, '|', '\|'), chr(10) || chr(13), '  '), '') AS db_cell, replace(replace(text, '|', '\|'), chr(10), ' ') AS md_cell
 FROM (SELECT doc_id, text, replace(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'), '|', '\|') AS v FROM documents)""",
    "table_markdown": _table("nation", ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey", 500),
    "table_plain": _table("region", ["r_regionkey", "r_name"], "r_regionkey", 500, plain=True),
    "table_truncated": _table("customer", ["c_custkey", "c_name", "c_mktsegment"], "c_custkey", 20),
    "db_sections": " UNION ALL ".join(_section(n, c, c[0]) for n, c in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"]), ("mailboxes", ["source", "host_zone"]))),
    "db_profile": " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS n_rows, (SELECT CAST(count(*) AS INT) FROM (DESCRIBE {n})) AS n_columns" for n in PROFILED),
    "pages_markdown": """SELECT pdf_id, string_agg('## Page ' || page || chr(10) || chr(10) || CASE WHEN coalesce(t, '') = '' AND thin THEN '*[This page appears to be image-only — no extractable text]*' ELSE coalesce(t, '') END || chr(10), chr(10) ORDER BY page) AS content
 FROM (SELECT pdf_id, page, min(text) AS t, bool_or(is_thin) AS thin FROM pdf_pages GROUP BY ALL) GROUP BY pdf_id""",
    "pages_text": "SELECT pdf_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS content FROM (SELECT pdf_id, page, min(text) AS t FROM pdf_pages GROUP BY ALL) WHERE t <> '' GROUP BY pdf_id",
    "json_profile": "SELECT event_id, CAST(len(k) AS INT) AS key_count, array_to_string(k, ',') AS keys, CAST(strlen(props) AS INT) AS n_bytes FROM (SELECT event_id, props, json_keys(props) AS k FROM events)",
    "json_key_value": "SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: '- **' || k || '**: ' || coalesce(json_extract_string(props, '$.\"' || k || '\"'), 'None')), chr(10)) AS lines FROM events WHERE props IS NOT NULL",
    "fields_projection": "SELECT doc_id, source, lang, CAST(NULL AS VARCHAR) AS none FROM documents",
    "envelope_rows": "SELECT doc_id, lang, n_chars, md5(text) AS content_md5, source, 'data' AS converter FROM documents",
}
