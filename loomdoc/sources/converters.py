"""Whole files to document rows: scans of one row a file and Arrow-batched converters."""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import wave
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import markup, text
from loomdoc.functions.front import whole
from loomdoc.functions.meta import detect_converter

DOCUMENT = "source string, converter string, frontmatter string, content string, error string"
MIME = {"w": "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "a": "{http://schemas.openxmlformats.org/drawingml/2006/main}", "s": "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"}
#: Width up to which columns of CSV tables are padded where cells are not cut.
PADDED = 80


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``source, length, modified, content`` (bytes), one row a file; also for streams of new files."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    r = r.option("pathGlobFilter", pattern) if pattern else r
    return r.load(path).select(F.col("path").alias("source"), "length", F.col("modificationTime").alias("modified"), "content")


def _xml(z: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(z.read(name))
    except (KeyError, ElementTree.ParseError):
        return None


def _core(z: zipfile.ZipFile) -> dict:
    root = _xml(z, "docProps/core.xml")
    got = {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() for e in root} if root is not None else {}
    return {k: got[v] for k, v in {"title": "title", "author": "creator", "subject": "subject", "keywords": "keywords", "created": "created", "modified": "modified"}.items() if got.get(v)}


def office(data: bytes, kind: str) -> tuple[str, dict]:
    """Text and properties of zipped XML documents (DOCX, PPTX, XLSX, EPUB, ODT)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        meta, names = _core(z), z.namelist()
        if kind == "docx":
            root = _xml(z, "word/document.xml")
            paras = ["".join(t.text or "" for t in p.iter(MIME["w"] + "t")) for p in (root.iter(MIME["w"] + "p") if root is not None else ())]
            return "\n\n".join(p for p in paras if p.strip()), meta
        if kind == "pptx":
            slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
            body = []
            for i, n in enumerate(slides, 1):
                root = _xml(z, n)
                texts = ["".join(t.text or "" for t in p.iter(MIME["a"] + "t")) for p in (root.iter(MIME["a"] + "p") if root is not None else ())]
                body.append(f"## Slide {i}\n\n" + "\n\n".join(t for t in texts if t.strip()))
            return "\n\n".join(body), meta | {"slides": len(slides)}
        if kind == "xlsx":
            shared = _xml(z, "xl/sharedStrings.xml")
            strings = ["".join(t.text or "" for t in s.iter(MIME["s"] + "t")) for s in shared] if shared is not None else []
            book = _xml(z, "xl/workbook.xml")
            sheets = [s.get("name", "") for s in book.iter(MIME["s"] + "sheet")] if book is not None else []
            body = []
            for i, name in enumerate(sheets, 1):
                root = _xml(z, f"xl/worksheets/sheet{i}.xml")
                rows = []
                for r in root.iter(MIME["s"] + "row") if root is not None else ():
                    cells = []
                    for c in r.iter(MIME["s"] + "c"):
                        v = c.find(MIME["s"] + "v")
                        inline = "".join(t.text or "" for t in c.iter(MIME["s"] + "t"))
                        cells.append(strings[int(v.text)] if c.get("t") == "s" and v is not None else (v.text if v is not None else inline))
                    rows.append(cells)
                if rows:
                    lines = ["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |", *("| " + " | ".join(x) + " |" for x in rows[1:])]
                    body.append(f"## {name}\n\n" + "\n".join(lines))
            return "\n\n".join(body), meta | {"sheets": sheets}
        parts = [n for n in names if n.endswith((".xhtml", ".html", ".htm"))] or [n for n in names if n == "content.xml"]
        return "\n\n".join(markup.html_markdown(z.read(n).decode("utf-8", "replace")) for n in parts).strip(), meta


def rtf(text: str) -> str:
    """Text of an RTF file: groups of tables and pictures dropped, control words resolved."""
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|pict|\*)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\\[a-z]+-?\d* ?|[{}]|\\\*", "", text).strip()


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of PNG, GIF, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        return struct.unpack("<ii", data[18:26])
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                return None
            if data[i + 1] in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return w, h
            i += 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    return None


def wav_seconds(data: bytes) -> float:
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.getnframes() / float(w.getframerate())
    except (wave.Error, EOFError):
        return 0.0


def sniff_delimiter(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:4096], delimiters=",\t;|:").delimiter
    except csv.Error:
        return ","


def parse_csv(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of a CSV text, all cells strings; a quoted line end inside a cell joins its two pieces."""
    return list(csv.reader(text.splitlines(), delimiter=delimiter or sniff_delimiter(text)))


# Names of delimiters.
DELIMITERS = {",": "comma", "\t": "tab", ";": "semicolon", "|": "pipe", ":": "colon"}


def csv_table(rows: list[list[str]], max_rows: int = 500, max_col_width: int = 0, plain: bool = False) -> str:
    """Rows (the first is the header) as a padded pipe table of ``max_rows`` data rows, cells cut to ``max_col_width``; 0 is no limit.

    ``plain`` sets columns apart by blanks alone.

    Cells are taken by position, so equal header names stay columns of their own.  Short rows are filled, what a
    row has beyond the header is dropped.  Where cells have no limit, columns are padded to ``PADDED`` at most.
    """
    if not rows or not rows[0]:
        return ""

    def cell(v: str) -> str:
        v = v.replace("\r\n", " ").replace("\r", " ").replace("\n", " ").replace("|", "\\|")
        return v[: max_col_width - 1] + "…" if 0 < max_col_width < len(v) else v

    n, body = len(rows[0]), rows[1:] if max_rows <= 0 else rows[1 : max_rows + 1]
    cells = [[cell(v) for v in [*r, *[""] * (n - len(r))][:n]] for r in (rows[0], *body)]
    most = max_col_width if max_col_width > 0 else PADDED
    widths = [max(3, min(most, max(len(r[i]) for r in cells))) for i in range(n)]
    padded = [[v.ljust(w) for v, w in zip(r, widths, strict=True)] for r in cells]
    padded.insert(1, ["-" * w for w in widths])
    lines = ["  ".join(r).rstrip() for r in padded] if plain else ["| " + " | ".join(r) + " |" for r in padded]
    if plain:
        return "\n".join([*lines, *(["", f"(Table truncated to {len(body)} of {len(rows) - 1} rows.)"] if len(body) < len(rows) - 1 else [])])
    return "\n".join([*lines, *(["", f"> **Note:** Table truncated to {len(body)} of {len(rows) - 1} rows."] if len(body) < len(rows) - 1 else [])])


def load_data(text: str, kind: str) -> object:
    """The value of JSON, JSON lines or YAML text."""
    if kind == "json":
        return json.loads(text)
    if kind == "jsonl":
        return [json.loads(x) for x in text.splitlines() if x.strip()]
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML needs PyYAML") from e
    return yaml.safe_load(text)


def depth(x: object, at: int = 0) -> int:
    """Nesting depth; scalars and empty containers add none, cut off at 64."""
    inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    return at if at > 64 or not inner else max(depth(v, at + 1) for v in inner)


def strategy(x: object, max_items: int = 100) -> str:
    """``table`` for rows with equal keys, ``key_value`` for a small flat object, else ``code_block``."""
    if isinstance(x, list) and x and all(isinstance(r, dict) for r in x[:max_items]) and len({frozenset(r) for r in x[:max_items]}) == 1:
        return "table"
    return "key_value" if isinstance(x, dict) and len(x) <= 20 and not any(isinstance(v, dict | list) for v in x.values()) else "code_block"


def render_data(x: object, kind: str = "json", max_items: int = 100) -> str:
    how = strategy(x, max_items)
    if how == "table":
        cell = lambda v: (v if isinstance(v, str) else str(v)).replace("|", "\\|").replace("\n", " ")
        heads = list(x[0])
        lines = ["| " + " | ".join(heads) + " |", "| " + " | ".join("---" for _ in heads) + " |", *("| " + " | ".join(cell(r.get(h, "")) for h in heads) + " |" for r in x[:max_items])]
        return "\n".join([*lines, *(["", f"*Showing {max_items} of {len(x)} items. Use --max-items to adjust.*"] if len(x) > max_items else [])])
    if how == "key_value":
        return "\n".join(f"- **{k}**: {v}" for k, v in x.items())
    if kind == "yaml":
        try:
            import yaml

            return f"```yaml\n{yaml.dump(x, default_flow_style=False, allow_unicode=True).rstrip()}\n```"
        except ImportError:
            pass
    return f"```json\n{json.dumps(x, indent=2, ensure_ascii=False, default=str)}\n```"


def data_plain(x: object, max_items: int = 100) -> str:
    """Data without markup: rows set apart by tabs, ``key: value`` lines, or JSON."""
    how = strategy(x, max_items)
    if how == "table":
        heads = list(x[0])
        lines = ["\t".join(map(str, heads)), *("\t".join(str(r.get(h, "")) for h in heads) for r in x[:max_items])]
        return "\n".join([*lines, *([f"(Showing {max_items} of {len(x)} items)"] if len(x) > max_items else [])])
    return "\n".join(f"{k}: {v}" for k, v in x.items()) if how == "key_value" else json.dumps(x, indent=2, ensure_ascii=False, default=str)


def database(data: bytes, max_rows: int = 10, max_tables: int = 50) -> tuple[str, dict]:
    """Sections of the tables and views of a SQLite file: schema, row count, a sample; and the totals."""
    import sqlite3

    cell = lambda v: "" if v is None else f"[BLOB: {len(v)} bytes]" if isinstance(v, bytes) else str(v)
    clip = lambda t: (t[:80] + "…" if len(t) > 80 else t).replace("|", "\\|").replace("\n", " ").replace("\r", " ")
    parts, total = [], 0
    with sqlite3.connect(":memory:") as c:
        c.deserialize(data)
        named = c.execute("SELECT type, name, sql FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY type, name").fetchall()
        for kind, name, sql in named[:max_tables]:
            quoted = '"' + name.replace('"', '""') + '"'
            n = c.execute(f"SELECT count(*) FROM {quoted}").fetchone()[0]
            cur = c.execute(f"SELECT * FROM {quoted} LIMIT {int(max_rows)}")
            heads, rows = [d[0] for d in cur.description], cur.fetchall()
            total += n
            count = f"{n} row{'' if n == 1 else 's'}"
            lines = ["| " + " | ".join(heads) + " |", "| " + " | ".join(["---"] * len(heads)) + " |", *("| " + " | ".join(clip(cell(v)) for v in r) + " |" for r in rows)]
            note = f"_Showing {max_rows} of {n} rows._" if n > max_rows else f"_{count}._"
            sample = "\n".join(lines) + f"\n\n{note}\n" if rows else "_No rows._\n"
            schema = f"```sql\n{sql.strip()}\n```\n" if sql else "_No schema available._\n"
            parts.append(f"## `{name}`{' _(view)_' if kind == 'view' else ''}\n\n### Schema\n\n{schema}\n### Data ({count})\n\n{sample}")
    return "\n\n---\n\n".join(parts), {"file_size": len(data), "table_count": len(parts), "total_rows": total}


def _clock(ms: int) -> str:
    h, m, s = ms // 3_600_000, ms // 60_000 % 60, ms // 1000 % 60
    return f"{h:02d}:{m:02d}:{s:02d}" if h else f"{m:02d}:{s:02d}"


def _convert(name: str, tool: str, data: bytes, max_rows: int = 500, max_col_width: int = 0, plain: bool = False) -> tuple[str, dict]:
    ext = name.rsplit(".", 1)[-1].lower()
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    text = lambda: data.decode("utf-8", "replace")
    simple = {"org": markup.org, "tex": markup.tex, "man": markup.man, "rst": markup.rst}
    if tool in simple:
        return simple[tool](text())
    if tool == "nb":
        return markup.notebook(text(), name=stem)
    if tool == "eml":
        body, meta = markup.mail(data)
        subject = meta.get("subject") or "Email"
        return (f"{subject}\n{'=' * len(subject)}\n\n{body}".strip() if plain else body), meta
    if tool == "html":
        return markup.html_markdown(text()), {}
    if tool == "sub":
        events = markup.subtitles(text())
        said = markup.speech(events)
        named = any(n for _, n, _ in said)
        if plain:
            body = "\n".join(f"{n}: {t}" if n else t for _, n, t in said)
        elif named:
            body = "\n".join(f"{f'**{n}** [{_clock(a)}]' if n else f'**[{_clock(a)}]**'}\n\n{t}\n" for a, n, t in said)
        else:
            body = "\n".join(f"**[{_clock(a)}]** {t}\n" for a, _, t in said)
        meta = {"subtitle_count": len(events), "format": ext, **({"duration": round(max(b for _, b, _, _ in events) / 1000, 3)} if events else {})}
        return body, meta | ({"speakers": list(dict.fromkeys(n for _, _, n, _ in events if n))} if named else {})
    if tool == "csv":
        raw = text()
        delimiter = sniff_delimiter(raw)
        rows = parse_csv(raw, delimiter)
        heads = rows[0] if rows else []
        return csv_table(rows, max_rows, max_col_width, plain), {"rows": max(0, len(rows) - 1), "columns": len(heads), "column_names": heads, "delimiter": DELIMITERS.get(delimiter, repr(delimiter)), "file_size": len(data)}
    if tool == "data":
        kind = {"yml": "yaml"}.get(ext, ext)
        v = load_data(text(), kind)
        top = ({"top_level_type": "object", "key_count": len(v)} if isinstance(v, dict) else {"top_level_type": "array", "item_count": len(v)} if isinstance(v, list) else {"top_level_type": type(v).__name__})
        return (data_plain(v) if plain else render_data(v, kind)), {"format": kind, "file_size": len(data), **top, "nesting_depth": depth(v)}
    if tool == "db":
        return database(data)
    if tool == "doc":
        return (rtf(text()), {}) if ext == "rtf" else office(data, ext)
    if tool == "img":
        size = image_size(data)
        return "", {"format": ext, "file_size_bytes": len(data), **({"width": size[0], "height": size[1]} if size else {})}
    if tool == "yt" and ext == "wav":
        return "", {"duration": wav_seconds(data)}
    raise ValueError(f"no converter for {name}")


def mbox_messages(data: bytes) -> list[bytes]:
    """The messages of a mailbox file: each begins with a line ``From `` at its start or behind an empty line."""
    starts = [m.start() for m in re.finditer(rb"(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n", data)]
    return [data[a:z].partition(b"\n")[2].rstrip(b"\r\n") for a, z in zip(starts, [*starts, len(data)][1:], strict=True)]


def convert(df: DataFrame, source: str = "source", content: str = "content", *, style: str = "body", max_rows: int = 500, max_col_width: int = 0, fetched_at: str | None = None) -> DataFrame:
    """Document rows ``source, converter, frontmatter (JSON), content, error`` of file rows; a file that cannot be read is an error row, the others go on.

    ``style`` is ``body`` (the converted text alone), ``md`` (frontmatter, title and body) or ``txt`` (plain text).  A mailbox file
    gives a row for each message, ``name_001`` and so on.  ``max_rows`` and ``max_col_width`` limit the rows and cells of CSV
    tables, 0 is no limit; a note under a table says how many rows it lacks.
    """
    if style not in ("body", "md", "txt"):
        raise ValueError(f"style {style}")
    use = df.where(F.col(source).isNotNull() & F.col(content).isNotNull()).select(F.col(source).alias("s"), detect_converter(F.col(source)).alias("t"), F.col(content).cast("binary").alias("c"))

    def one(s: str, t: str, c: bytes, path: str) -> tuple:
        try:
            body, meta = _convert(s, t, c, max_rows, max_col_width, style == "txt")
            if style != "body":
                own = "source_file" if t == "man" else "source"
                meta = {**meta, own: path, "fetched_at": fetched_at}
            if style == "md":
                body = whole(t, body, meta, path.rsplit("/", 1)[-1])
            return s, t, json.dumps({k: v for k, v in meta.items() if v is not None}, ensure_ascii=False, default=str), body, None
        except Exception as e:  # noqa: BLE001
            return s, t, None, None, json.dumps({"code": "CONVERSION_FAILED", "message": str(e), "recoverable": False})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, t, c in zip(b["s"].tolist(), b["t"].tolist(), b["c"].tolist(), strict=True):
                if s.lower().endswith(".mbox"):
                    mails = mbox_messages(bytes(c))
                    width = max(3, len(str(len(mails))))
                    rows += [one(f"{s[:-5]}_{str(i).zfill(width)}.eml", t, m, s) for i, m in enumerate(mails, 1)]
                else:
                    rows.append(one(s, t, bytes(c), s))
            yield pd.DataFrame(rows, columns=["source", "converter", "frontmatter", "content", "error"])

    out = use.mapInPandas(run, DOCUMENT)
    if style != "txt":
        return out
    t = F.col("converter")
    plain = F.when(t == "org", text.apply(F.col("content"), text.ORG_PLAIN)).when(t == "tex", text.apply(F.col("content"), text.TEX_PLAIN)).when(t == "db", text.apply(F.col("content"), text.DB_PLAIN))
    plain = plain.when(t.isin("man", "rst", "nb"), text.apply(F.col("content"), text.MARKDOWN_PLAIN)).otherwise(F.col("content"))
    return out.withColumn("content", plain)


def split_mbox(df: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """One row a message: ``source, message_no, raw``."""
    text = F.make_valid_utf8(F.col(content).cast("string")) if hasattr(F, "make_valid_utf8") else F.col(content).cast("string")
    parts = F.split(text, r"(?m)^From (?=\S+@?\S* )")
    each = df.select(F.col(source).alias("source"), F.posexplode(parts).alias("message_no", "raw")).where("trim(raw) != ''")
    return each.withColumn("raw", F.regexp_replace("raw", r"^[^\n]*\n", ""))
