"""Whole documents of one converted file: frontmatter, title, body; plain text where a format has its own."""

from __future__ import annotations

from collections.abc import Mapping

from loomdoc.functions.meta import KEY_ORDER

# Characters and words that make a YAML value need quotes.
SPECIAL = frozenset(":#{}[]&*?|->!%@`\"',\n")
WORDS = frozenset(("true", "false", "null", "yes", "no"))
RANK = {k: i for i, k in enumerate(KEY_ORDER)}


def scalar(v: object) -> str:
    """One value as YAML writes it: booleans and numbers bare, texts in quotes where they need them."""
    if isinstance(v, bool):
        return str(v).lower()
    text = str(v)
    if isinstance(v, int | float) or not (text in WORDS or SPECIAL.intersection(text)):
        return text
    for c in "\\\"":
        text = text.replace(c, "\\" + c)
    return f'"{text}"'


def _field(key: str, v: object) -> str:
    if key == "description":
        return f"{key}: |\n  " + str(v).replace("\\", "\\\\").replace("\n", "\n  ")
    if not isinstance(v, list):
        return f"{key}: {scalar(v)}"
    if key == "chapters":
        return "\n".join([f"{key}:", *(f"  - time: {scalar(c['time'])}\n    title: {scalar(c['title'])}" for c in v)])
    if len(v) <= 10 and all(isinstance(x, str) for x in v):
        return f"{key}: [{', '.join(map(scalar, v))}]"
    return "\n".join([f"{key}:", *(f"  - {scalar(x)}" for x in v)])


def front(meta: Mapping) -> str:
    """YAML frontmatter: known keys in their order, the others as they come; nulls and empty values left out."""
    held = [k for k, v in meta.items() if v is not None and v != "" and v != []]
    held.sort(key=lambda k: RANK.get(k, len(RANK)))
    return "\n".join(["---", *(_field(k, meta[k]) for k in held), "---"])


def whole(tool: str, body: str, meta: Mapping, name: str) -> str:
    """The Markdown document of one converter: frontmatter, then the title of mails, data, office files and databases, then the body.

    The abstract of a LaTeX text is a quotation before its body.
    """
    fields = dict(meta)
    lead = []
    if tool == "tex" and (abstract := fields.pop("abstract", "")):
        lead = [f"> **Abstract.** {abstract.replace(chr(10), ' ')}", ""]
    elif tool == "eml":
        lead = [f"# {meta.get('subject') or 'Email'}", ""]
    elif tool == "db":
        lead = [f"# {name}", ""]
    elif tool in ("data", "doc") and meta.get("title"):
        lead = [f"# {meta['title']}", ""]
    return "\n".join([front(fields), "", *lead, body]) + ("\n" if tool == "img" else "")
