"""Metadata as column expressions: frontmatter, page heads, paths, dates, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.text import STRIP, S, apply

# The order in which frontmatter keys come first.
KEY_ORDER = (
    "title", "video_id", "url", "channel", "channel_url", "uploader", "upload_date", "duration", "duration_human", "language", "location", "availability", "live_status",
    "view_count", "like_count", "comment_count", "channel_follower_count", "thumbnail", "categories", "tags", "subtitles", "auto_captions", "chapters", "description", "fetched_at",
)
SPECIAL = r"""[:#{}\[\]&*?|\->!%@`"',\n]"""
# Converter of each file suffix.
CONVERTERS = {
    "pdf": "pdf", "png": "img", "jpg": "img", "jpeg": "img", "gif": "img", "webp": "img", "bmp": "img", "tiff": "img", "tif": "img", "heic": "img", "html": "html", "htm": "html",
    "docx": "doc", "pptx": "doc", "xlsx": "doc", "epub": "doc", "odt": "doc", "rtf": "doc", "rst": "rst", "rest": "rst", "csv": "csv", "tsv": "csv", "db": "db", "sqlite": "db", "sqlite3": "db",
    "srt": "sub", "vtt": "sub", "ass": "sub", "ssa": "sub", "ipynb": "nb", "eml": "eml", "mbox": "eml", "org": "org", "tex": "tex", "json": "data", "jsonl": "data",
    "yaml": "data", "yml": "data", "mp3": "yt", "wav": "yt", "m4a": "yt", "mp4": "yt", "mkv": "yt", "webm": "yt", "flac": "yt", "ogg": "yt", "aac": "yt", "mov": "yt", "avi": "yt",
    **{str(n): "man" for n in range(1, 10)},
}
# Fixed value: where a video id stands in a URL.
_VIDEO_URL = r"(?:youtube\.com/(?:[^/\n\s]+/\S+/|(?:v|e(?:mbed)?)/|\S*?[?&]v=)|youtu\.be/)([a-zA-Z0-9_-]{11})"


def yaml_scalar(v: Column, kind: str = "string") -> Column:
    """A frontmatter value as text: booleans and numbers bare, strings quoted where they hold a special character or are a reserved word."""
    s = v.cast("string")
    if kind != "string":
        return s
    quoted = F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(s.rlike(SPECIAL) | s.isin("true", "false", "null", "yes", "no"), quoted).otherwise(s)


def frontmatter(fields: dict[str, tuple[Column, str]]) -> Column:
    """YAML frontmatter of (column, kind) by key; kinds ``string``, ``int``, ``double``, ``boolean``, ``list``, ``chapters``.

    Known keys first, then the others as given.  Null and empty values are left out.  Lists of up to ten
    strings are inline; ``description`` is a block.
    """
    lines = [F.lit("---")]
    for key in [*(k for k in KEY_ORDER if k in fields), *(k for k in fields if k not in KEY_ORDER)]:
        col, kind = fields[key]
        if kind == "list":
            items = F.transform(col, lambda x: yaml_scalar(x))
            inline = F.concat(F.lit(f"{key}: ["), F.array_join(items, ", "), F.lit("]"))
            block = F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n"))
            line = F.when(F.size(col) > 10, block).when(F.size(col) > 0, inline)
        elif kind == "chapters":
            rows = F.transform(col, lambda c: F.concat(F.lit("  - time: "), yaml_scalar(c["time"]), F.lit("\n    title: "), yaml_scalar(c["title"])))
            line = F.when(F.size(col) > 0, F.concat(F.lit(f"{key}:\n"), F.array_join(rows, "\n")))
        elif key == "description":
            text = F.replace(col, F.lit("\\"), F.lit("\\\\"))
            line = F.when(col != "", F.concat(F.lit("description: |\n  "), F.replace(text, F.lit("\n"), F.lit("\n  "))))
        else:
            text = yaml_scalar(col, kind)
            line = F.when(col.isNotNull() & (col.cast("string") != ""), F.concat(F.lit(f"{key}: "), text))
        lines.append(line)
    return F.concat_ws("\n", *lines, F.lit("---"))


def document(front: Column, body: Column) -> Column:
    """Frontmatter, blank line, body."""
    return F.concat(front, F.lit("\n\n"), body)


def html_title(page: Column) -> Column:
    return F.nullif(apply(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), rf"{S}+", " "), STRIP), F.lit(""))


def html_meta(page: Column, name: str) -> Column:
    """Content of a meta tag in either order of its attributes; the first that is not empty."""
    a = rf"""(?is)<meta[^>]+name=["']{name}["'][^>]+content=["']([^"']*)["']"""
    b = rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]+name=["']{name}["']"""
    one = lambda p: F.nullif(apply(F.regexp_extract(page, p, 1), STRIP), F.lit(""))
    return F.coalesce(one(a), one(b))


def page_meta(page: Column, name: str) -> Column:
    """Content of the meta tag ``name`` as pages for sharing write it: ``name`` or ``property``, with or without ``og:``, either order of attributes.

    The kinds are tried in that order; the first tag of a kind counts, even if its content is empty.
    """
    quote, some = "[\"']", "([^\"']*)"
    tag = lambda first, second: rf"(?i)<meta{S}+{first}{second}"
    kinds = []
    for attribute, prefix in (("name", "(?:og:)?"), ("property", "og:")):
        named, content = f"{attribute}={quote}{prefix}{name}{quote}", f"content={quote}{some}{quote}"
        kinds += [tag(named, f"{S}+{content}"), tag(content, f"[^>]*{named}")]
    return F.coalesce(*[F.when(page.rlike(k), apply(F.regexp_extract(page, k, 1), STRIP)) for k in kinds])


def page_fields(page: Column, url: Column) -> Column:
    """Title (shared title before the page's own), description, author and site name of a page; empty ones null."""
    title = apply(F.regexp_extract(page, r"(?i)<title[^>]*>([^<]+)</title>", 1), STRIP)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        F.coalesce(some(page_meta(page, "title")), some(title)).alias("title"), some(page_meta(page, "description")).alias("description"),
        some(page_meta(page, "author")).alias("author"), sitename(url).alias("sitename"),
    )


def input_kind(path: Column, exists: Column) -> Column:
    """``youtube`` for video addresses, eleven-character ids and whatever is no file; else ``file``."""
    video = path.rlike(_VIDEO_URL.replace("([a-zA-Z0-9_-]{11})", "")) | path.rlike(r"^[A-Za-z0-9_-]{11}$")
    return F.when(video | ~F.coalesce(exists, F.lit(False)), "youtube").otherwise("file")


def sitename(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1), F.lit(""))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def detect_converter(path: Column, has_git: Column | None = None) -> Column:
    """Which converter a path or URL is for; an empty string if none.  An eleven-character id is a video id before its suffix counts.

    ``has_git`` tells which paths are folders with a ``.git`` in them: those are ``repo``.
    """
    table = F.create_map(*[F.lit(x) for kv in CONVERTERS.items() for x in kv])
    url = F.when(path.rlike(_VIDEO_URL), "yt").otherwise("web")
    repo = F.lit(False) if has_git is None else F.coalesce(has_git, F.lit(False))
    return F.when(repo, "repo").when(path.rlike(r"(?i)^https?://"), url).when(path.rlike(r"^[A-Za-z0-9_-]{11}$"), "yt").otherwise(F.coalesce(F.try_element_at(table, suffix(path)), F.lit("")))


def video_id(url: Column) -> Column:
    """The eleven-character id in a URL or given bare, else null."""
    return F.when(url.rlike(r"^[A-Za-z0-9_-]{11}$"), url).otherwise(F.nullif(F.regexp_extract(url, _VIDEO_URL, 1), F.lit("")))


def page_range(text: Column, total: Column) -> Column:
    """``'1-5,8'`` as sorted distinct pages counted from 0 and clamped to the number of pages."""
    part = F.transform(F.split(text, ","), lambda x: F.trim(x))
    one = lambda p: F.split(p, "-")
    low = lambda p: F.greatest(F.get(one(p), F.lit(0)).try_cast("int"), F.lit(1))
    high = lambda p: F.least(F.coalesce(F.get(one(p), F.lit(1)).try_cast("int"), F.get(one(p), F.lit(0)).try_cast("int")), total)
    spans = F.transform(F.filter(part, lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$")), lambda p: F.when(low(p) <= high(p), F.sequence(low(p) - 1, high(p) - 1)).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDD…`` as an ISO date; anything else as it is."""
    s = F.regexp_replace(text, r"^[D:]+", "")
    return F.coalesce(F.try_to_date(F.substring(s, 1, 8), "yyyyMMdd").cast("string"), text) if hasattr(F, "try_to_date") else F.coalesce(
        F.to_date(F.try_to_timestamp(F.substring(s, 1, 8), F.lit("yyyyMMdd"))).cast("string"), text)


def two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def clock(seconds: Column) -> Column:
    """``HH:MM:SS`` from an hour on, else ``MM:SS``; fractions are cut off."""
    t = F.floor(seconds).cast("long")
    h, m, s = F.expr("0").cast("long") + F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    hours = F.when(h < 100, two(h)).otherwise(h.cast("string"))
    return F.when(h > 0, F.concat(hours, F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(two(m), F.lit(":"), two(s)))


def clock_srt(millis: Column) -> Column:
    """``HH:MM:SS,mmm`` of whole milliseconds."""
    t = F.floor(millis / 1000)
    h = F.floor(t / 3600)
    hours = F.when(h < 100, two(h)).otherwise(h.cast("string"))
    return F.concat(hours, F.lit(":"), two(F.floor(t % 3600 / 60)), F.lit(":"), two(t % 60), F.lit(","), F.lpad((millis % 1000).cast("string"), 3, "0"))


def project_fields(fields: str, schema: dict) -> Column:
    """A struct of the dotted paths asked for; siblings share their parent, a missing path is null.

    ``schema`` is the nested field tree of the frame: names to ``None`` (leaf) or a tree.
    """
    tree: dict = {}
    for path in (p.strip() for p in fields.split(",")):
        at = tree
        *parents, last = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at.setdefault(last, None)

    def build(node: dict, prefix: list[str]) -> Column:
        cols = []
        for name, sub in node.items():
            path = [*prefix, name]
            if sub is None:
                at = schema
                for p in path:
                    at = at.get(p) if isinstance(at, dict) and p in at else "missing"
                cols.append((F.lit(None).cast("string") if at == "missing" else F.col(".".join(f"`{p}`" for p in path))).alias(name))
            else:
                cols.append(build(sub, path).alias(name))
        return F.struct(*cols)

    return build(tree, [])


def envelope(front: Column, content: Column, source: Column, converter: str) -> Column:
    """The JSON envelope of one converted document; nulls are kept."""
    return F.to_json(F.struct(front.alias("frontmatter"), content.alias("content"), source.alias("source"), F.lit(converter).alias("converter")), {"ignoreNullFields": "false"})


# Error codes of the side output.
ERROR_CODES = ("FILE_NOT_FOUND", "INVALID_INPUT", "MISSING_DEPENDENCY", "MODEL_LOAD_FAILED", "CONVERSION_FAILED", "REPOMIX_ERROR")


def error_row(code: Column, message: Column, recoverable: bool = False) -> Column:
    return F.to_json(F.struct(code.alias("code"), message.alias("message"), F.lit(recoverable).alias("recoverable")))
