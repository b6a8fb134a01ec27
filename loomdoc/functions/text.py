"""Text clean-up as column expressions: ordered chains of pattern replacements, all in the JVM.

A chain is data, so the same list also yields the SQL with which the results are checked.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the converters understand it (all Unicode spaces), usable inside [].
WS = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
S = f"[{WS}]"

Chain = list[tuple[str, str]]
"""(pattern, replacement) with ``\\1`` for groups; ``(?m)`` means line feeds only."""

STRIP: Chain = [(rf"^{S}+|{S}+$", "")]
BLANKS: Chain = [(r"\n{3,}", r"\n\n")]
HEADINGS: Chain = [(rf"(?m)^#{{1,6}}{S}+", "")]
FENCES: Chain = [(r"(?m)^```[^\n]*\n", ""), (rf"(?m)^```{S}*$", "")]
TAGS: Chain = [(r"<[^>]+>", "")]

# What each converter removes from its own Markdown for plain-text output.
MARKDOWN_PLAIN: Chain = [*HEADINGS, *FENCES, (r"\*{1,3}([^*]+)\*{1,3}", r"\1"), (r"_{1,2}([^_]+)_{1,2}", r"\1"), *BLANKS, *STRIP]
ORG_PLAIN: Chain = [*HEADINGS, (r"(?m)^```[^\n]*\n?", ""), (r"\*{2}([^*]+)\*{2}", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"~~([^~]+)~~", r"\1"), (r"`([^`]+)`", r"\1"), *BLANKS, *STRIP]
TEX_PLAIN: Chain = [
    *HEADINGS, *FENCES, (r"\*{1,3}([^*]+)\*{1,3}", r"\1"), (r"_{1,2}([^_]+)_{1,2}", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), *BLANKS, *STRIP,
]
DB_PLAIN: Chain = [
    *HEADINGS, *FENCES, (r"(?m)^\|(.+)\|$", r"\1"), (rf"(?m)^[{WS}\-|]+$", ""), (r"\*{1,2}([^*]+)\*{1,2}", r"\1"),
    (r"_{1,2}([^_]+)_{1,2}", r"\1"), (r"`([^`]+)`", r"\1"), *BLANKS, *STRIP,
]
STEM: Chain = [(r"[^\p{L}\p{N}_-]", "_"), (r"_+", "_"), (r"^_+|_+$", "")]
ORG_LINKS: Chain = [(r"\[\[([^\]]+)\]\[([^\]]+)\]\]", r"[\2](\1)"), (r"\[\[([^\]]+)\]\]", r"<\1>")]
SUBTITLE_MARKDOWN: Chain = [
    (r"(?is)\{\\b1\}(.*?)\{\\b0\}", r"**\1**"), (r"(?is)\{\\i1\}(.*?)\{\\i0\}", r"*\1*"), (r"(?is)<b>(.*?)</b>", r"**\1**"), (r"(?is)<i>(.*?)</i>", r"*\1*"),
    (r"\{[^}]*\}", ""), *TAGS,
]
SUBTITLE_PLAIN: Chain = [(r"\{[^}]*\}", ""), *TAGS]


def apply(text: Column, chain: Chain) -> Column:
    """The chain as one JVM expression."""
    for pattern, new in chain:
        new = new.replace("\\\\", "\0").replace("$", "\\$").replace("\\1", "$1").replace("\\2", "$2").replace("\\n", "\n").replace("\0", "\\\\")
        text = F.regexp_replace(text, pattern.replace("(?m)", "(?md)"), new)
    return text


def apply_sql(text: str, chain: Chain) -> str:
    """The chain as SQL for the checking engine."""
    for pattern, new in chain:
        new = new.replace("\\n", "\n").replace("'", "''")
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"
    return text


def stem(name: Column, *, url: bool = False, default: str = "output") -> Column:
    """A safe file stem of at most 80 characters; of a URL without its scheme."""
    base = F.regexp_replace(name, r"^https?://", "") if url else F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.substring(apply(base, STEM), 1, 80), F.lit("")), F.lit(default))


def sanitize_cell(value: Column, width: int = 80) -> Column:
    """A table cell: line ends are spaces, pipes escaped, then cut to ``width`` with an ellipsis."""
    v = F.replace(F.regexp_replace(value, r"\r\n|\r|\n", " "), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(v) > width, F.concat(F.substring(v, 1, width - 1), F.lit("…"))).otherwise(v)


def render_cell(value: Column, limit: int = 80) -> Column:
    """A database cell: null is empty, cut first, then escaped; each line-end character is a space."""
    v = value.cast("string")
    v = F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit), F.lit("…"))).otherwise(v)
    return F.coalesce(F.translate(F.replace(v, F.lit("|"), F.lit("\\|")), "\n\r", "  "), F.lit(""))


def blob_cell(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("[BLOB: "), F.octet_length(value).cast("string"), F.lit(" bytes]")), F.lit(""))


def escape_md_cell(value: Column) -> Column:
    return F.replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def marked_up(text: Column, read: Callable[[str], str]) -> Column:
    """A scanner of ``loomdoc.functions.markup`` (``html_markdown``, ``org_inline``, ``troff``) over a column, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else read(t))

    return run(text)
