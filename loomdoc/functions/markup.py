"""Markup read by its own grammar: Org, man pages, LaTeX, HTML, RST, notebooks, mail, subtitles.

Each language has a scanner that cuts a text into marks and plain stretches and a writer that says what every
mark becomes in Markdown.  Plain functions of one text; ``loomdoc.sources.converters`` runs them over columns in
Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from email import message_from_bytes, message_from_string, policy
from email.header import decode_header
from email.utils import parseaddr, parsedate_to_datetime

_GAPS = re.compile(r"\n{3,}")


def _tidy(text: str) -> str:
    return _GAPS.sub("\n\n", text).strip()


def _rules(text: str, rules: Iterable[tuple]) -> str:
    for pattern, new in rules:
        text = re.sub(pattern, new, text)
    return text


# ---- Org -------------------------------------------------------------------------------------------

# Org's paired marks and what stands on either side of the text in Markdown; the first two hold plain text.
ORG_MARKS = {"~": "`", "=": "`", "+": "~~", "_": "*", "/": "*", "*": "**"}
ORG_META = ("title", "author", "date", "language", "email", "description")
_ORG_LINK = re.compile(r"\[\[([^\]]+)\](?:\[([^\]]+)\])?\]")


def _org_close(s: str, i: int, stop: int) -> int:
    """Where the mark at ``i`` is closed before ``stop``, -1 if it opens nothing."""
    c = s[i]
    word = c not in "~="  # code may touch words
    before = s[i - 1] if i else " "
    if word and (before.isalnum() or before == "_" or before == c) or i + 2 >= stop or s[i + 1].isspace():
        return -1
    j = s.find(c, i + 2, stop)
    while j >= 0:
        after = s[j + 1] if j + 1 < len(s) else " "
        if not s[j - 1].isspace() and not (word and (after.isalnum() or after == "_" or after == c)):
            return j
        j = s.find(c, j + 1, stop)
    return -1


def org_inline(s: str, at: int = 0, stop: int | None = None) -> str:
    """Links and emphasis of one line of Org, marks inside of marks too."""
    stop = len(s) if stop is None else stop
    out, plain = [], at
    while at < stop:
        c = s[at]
        if c == "[" and (m := _ORG_LINK.match(s, at, stop)):
            out += [s[plain:at], f"[{org_inline(m[2])}]({m[1]})" if m[2] else f"<{m[1]}>"]
            at = plain = m.end()
        elif c in ORG_MARKS and (end := _org_close(s, at, stop)) >= 0:
            inner = s[at + 1 : end] if c in "~=" else org_inline(s, at + 1, end)
            out += [s[plain:at], ORG_MARKS[c], inner, ORG_MARKS[c]]
            at = plain = end + 1
        else:
            at += 1
    return "".join([*out, s[plain:stop]])


def _org_rows(rows: list[list[str]]) -> Iterator[str]:
    """A table of cells; the head is followed by a rule in any case."""
    for i, cells in enumerate(rows):
        yield "|" + "|".join(cells) + "|"
        if i == 0 and len(rows) > 1 and not _rule("|".join(cells)) and not _rule("|".join(rows[1])):
            yield "|" + "|".join([" --- "] * len(cells)) + "|"
    yield ""


def _org_cells(line: str) -> list[str]:
    inner = line.strip().removeprefix("|").removesuffix("|")
    return [*re.split(r"[+|]", inner)] if _rule(inner) else inner.split("|")


def _rule(inner: str) -> bool:
    return "-" in inner and set(inner) <= set("-+|: ")


def org(text: str) -> tuple[str, dict]:
    """Markdown and metadata of an Org text: keywords, tags, headings, TODO boxes, blocks, tables, drawers, links, emphasis."""
    out: list[str] = []
    meta: dict = {}
    tags: dict[str, None] = {}
    rows = iter([*text.splitlines(), ""])
    held: list[list[str]] = []
    for line in rows:
        bare = line.strip()
        if bare.startswith("|"):
            held.append(_org_cells(line))
            continue
        if held:
            out += _org_rows(held)
            held = []
        directive, _, rest = bare[2:].partition(":") if bare.startswith("#+") else ("", "", "")
        opening = bare[2:].split() if bare[:8].upper() == "#+BEGIN_" else []
        if opening:
            kind = opening[0][6:].upper()
            end = f"#+END_{kind}"
            body = []
            for x in rows:
                if x.strip().upper().startswith(end):
                    break
                body.append(x)
            quote = kind == "QUOTE"
            out += [*([] if quote else ["```" + (opening[1] if kind == "SRC" and len(opening) > 1 else "")]), *(("> " + x.strip()).rstrip() if quote else x for x in body), "" if quote else "```"]
        elif bare.startswith("#+"):
            if directive.lower() in ORG_META and rest.strip():
                meta[directive.lower()] = rest.strip()
        elif bare == "#" or bare.startswith("# "):
            continue
        elif len(bare) > 2 and bare[0] == bare[-1] == ":" and bare[1:-1].replace("_", "").isalpha():
            for x in rows:  # a drawer
                if x.strip().upper() == ":END:":
                    break
        elif line.startswith("*") and (title := line.lstrip("*"))[:1].isspace():
            depth, words = len(line) - len(title), title.split()
            if len(words) > 1 and len(words[-1]) > 2 and words[-1][0] == words[-1][-1] == ":":
                tags |= dict.fromkeys(t for t in words.pop().split(":") if t)
            state = words[0].upper() if len(words) > 1 else ""
            if state in ("TODO", "DONE"):
                out.append(f"- [{' ' if state == 'TODO' else 'x'}] {' '.join(words[1:])}")
            else:
                out.append(f"{'#' * min(depth, 6)} {' '.join(words)}")
        else:
            out.append(org_inline(line))
    if held:
        out += _org_rows(held)
    return _tidy("\n".join(out)), meta | ({"tags": list(tags)} if tags else {})


# ---- man pages -------------------------------------------------------------------------------------

# Characters behind a backslash, founts and their marks, requests by what they do.
TROFF_CHARS = {"-": "-", "e": "\\", "&": "", "~": " ", "(co": "©"}
FOUNTS = {"B": "**", "I": "*"}
MAN_HEAD = ("name", "section", "date", "source", "manual")


def troff(s: str) -> str:
    """Escapes of one line: characters, and founts that are set and set back."""
    out: list[str] = []
    mark, since = "", 0  # the fount in force and where in ``out`` it began
    i = 0
    while i < len(s):
        if s[i] != "\\":
            j = s.find("\\", i)
            out.append(s[i:] if j < 0 else s[i:j])
            i = len(s) if j < 0 else j
        elif s[i + 1 : i + 2] == "f" and s[i + 2 : i + 3] in "BIRP":
            if mark and s[i + 2 : i + 3] in "RP":
                out[since:] = [mark, "".join(out[since:]), mark]
            mark, since = FOUNTS.get(s[i + 2 : i + 3], ""), len(out)
            i += 3
        else:
            key = next((k for k in TROFF_CHARS if s.startswith(k, i + 1)), None)
            out.append("\\" if key is None else TROFF_CHARS[key])
            i += 1 + len(key or "")
    return "".join(out)


def man_words(s: str) -> list[str]:
    """Arguments of a request: set apart by blanks, blanks inside of double quotes belong to one."""
    return [a if a or not b else b for a, b in re.findall(r'"([^"]*)"?|([^\s"]+)', s)]


def man(text: str) -> tuple[str, dict]:
    """Markdown and metadata of a man page source; a ``.TP`` takes the next line as its term and plain lines as its text."""
    out: list[str] = []
    meta: dict = {}
    literal = False
    term: list[str] | None = None  # lines of a definition: the term is the first

    def styled(request: str, rest: str) -> str:
        mark = FOUNTS[request[0]]
        return f"{mark}{troff(rest.strip())}{mark}"

    def finish() -> None:
        nonlocal term
        if term is not None and len(term) > 1 and (body := " ".join(x.strip() for x in term[1:] if x.strip())):
            out.append(f":   {body}\n")
        term = None

    for line in text.split("\n"):
        request, _, rest = line[1:].partition(" ") if line[:1] == "." else ("", "", "")
        if line[:3] == '.\\"' or request[:1] in ("'", '"'):
            continue
        if term == []:
            term = [styled(request, rest) if request in ("B", "BR", "I", "IR") else troff(line.strip())]
            out.append(f"\n{term[0]}" if term[0] else "")
            continue
        if term is not None and not request:
            term.append(troff(line))
            continue
        finish()
        if not request:
            out.append(troff(line))
        elif request == "TH":
            meta = {k: v for k, v in zip(MAN_HEAD, (w.strip() for w in man_words(rest)), strict=False) if v}
        elif request in ("nf", "fi"):
            literal = request == "nf"
            out.append("\n```" if literal else "```\n")
        elif literal:
            out.append(troff(line))
        elif request in ("SH", "SS"):
            out.append(f"\n{'##' if request == 'SH' else '###'} {rest.strip().strip(chr(34))}\n")
        elif request in ("B", "BR", "I", "IR") and rest.strip():
            out.append(styled(request, rest))
        elif request == "TP":
            term = []
        elif request in ("PP", "P", "LP"):
            out.append("\n")
    finish()
    if literal:
        out.append("```\n")
    return _tidy("\n".join(out)), meta


# ---- LaTeX -----------------------------------------------------------------------------------------

# Names of commands and environments by what they are.
TEX_LEVELS = ("chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
TEX_STYLES = {"textbf": "**", "textit": "*", "emph": "*", "texttt": "`", "caption": "*"}
TEX_MATH = frozenset("equation align aligned gather multline eqnarray flalign alignat".split())
TEX_CODE = frozenset("verbatim Verbatim lstlisting minted".split())
TEX_HEAD = ("title", "author", "date")
TEX_SILENT = {"documentclass": 1, "usepackage": 1, "RequirePackage": 1, "label": 1, "vspace": 1, "hspace": 1, "cline": 1, "bibliographystyle": 1, "bibliography": 1}
TEX_LISTS = {"itemize": "- ", "enumerate": "", "description": "- "}
TEX_LETTERS = {"LaTeX": "LaTeX", "TeX": "TeX", "newline": "\n", "linebreak": "\n"}
TEX_QUOTES = {"``": "“", "''": "”", "---": "—", "--": "–", "~": " ", "&": " | "}

_TEX_TOKEN = re.compile(r"\\([a-zA-Z]+)\*?|\\(.)|[{}]|\$\$|\$|``|''|---|--|~|&", re.S)


class _Tex:
    """Reads a LaTeX text from left to right; what is written goes through :meth:`run`, arguments through :meth:`group`."""

    def __init__(self, text: str):
        self.s, self.i, self.meta, self.kept = text, 0, {}, []
        self.bare = False  # in titles: no marks of style
        self.lists: list[list] = []

    def keep(self, text: str) -> str:
        """A stretch that nothing may change any more, as a place holder."""
        self.kept.append(text)
        return f"\0{len(self.kept) - 1}\0"

    def raw_group(self, a: str = "{", z: str = "}") -> str | None:
        """The text of a balanced group if one begins here, after white space."""
        j = self.i
        while j < len(self.s) and self.s[j] in " \t\n":
            j += 1
        if j >= len(self.s) or self.s[j] != a:
            return None
        depth, k = 0, j
        while k < len(self.s):
            c = self.s[k]
            depth += (c == a) - (c == z)
            if not depth:
                self.i = k + 1
                return self.s[j + 1 : k]
            k += 1
        return None

    def group(self) -> str | None:
        inner = self.raw_group()
        return None if inner is None else self.sub(inner)

    def sub(self, text: str) -> str:
        outer = self.s, self.i
        self.s, self.i = text, 0
        out = self.run()
        self.s, self.i = outer
        return out

    def until(self, end: str) -> str:
        """The text up to ``end``, or all that is left."""
        j = self.s.find(end, self.i)
        out = self.s[self.i : j if j >= 0 else len(self.s)]
        self.i = j + len(end) if j >= 0 else len(self.s)
        return out

    def blank(self) -> None:
        """Over the white space behind what leaves nothing, up to and with one line end."""
        while self.s[self.i : self.i + 1] in (" ", "\t"):
            self.i += 1
        if self.s[self.i : self.i + 1] == "\n":
            self.i += 1

    def run(self) -> str:
        out: list[str] = []
        while self.i < len(self.s):
            m = _TEX_TOKEN.search(self.s, self.i)
            if m is None:
                out.append(self.s[self.i :])
                self.i = len(self.s)
                break
            out.append(self.s[self.i : m.start()])
            self.i = m.end()
            t = m[0]
            if m[1]:
                out.append(self.command(m[1], m.start()))
            elif m[2]:
                out.append(self.symbol(m[2]))
            elif t in ("$", "$$"):
                j = self.s.find(t, self.i)
                if j < 0 or t == "$" and "\n" in self.s[self.i : j]:
                    out.append(t)
                else:
                    out.append(self.keep(t + self.until(t) + t))
            else:
                out.append(TEX_QUOTES.get(t, ""))
        return "".join(out)

    def symbol(self, c: str) -> str:
        if c in "[(":
            z = "\\]" if c == "[" else "\\)"
            return self.keep("\\" + c + self.until(z) + z)
        if c == "~":
            return "~" if self.raw_group() is not None else ""
        return "\n" if c == "\\" else "" if c in "{}" else f"\\{c}"

    def command(self, name: str, start: int) -> str:
        if name == "begin":
            return self.environment(start)
        if name == "end":
            self.raw_group()
            return ""
        if name in TEX_HEAD:
            self.bare = True
            v = self.group()
            self.bare = False
            if v is not None and v.strip():
                self.meta.setdefault(name, " ".join(v.split()))
            self.blank()
            return ""
        if name in TEX_LEVELS:
            title = self.group()
            return "" if title is None else f"\n{'#' * (TEX_LEVELS.index(name) + 1)} {title}\n"
        if name in TEX_STYLES:
            v = self.group()
            if v is None or self.bare:
                return v or ""
            return self.keep(f"`{v}`") if name == "texttt" else f"{TEX_STYLES[name]}{v}{TEX_STYLES[name]}"
        if name == "verb":
            end = self.s[self.i : self.i + 1]
            self.i += 1
            return self.keep(f"`{self.until(end)}`")
        if name in ("cite", "citep", "citet", "citealt", "citealp", "citenum", "citeyear", "citeauthor"):
            note, key = self.raw_group("[", "]"), self.raw_group() or ""
            return f"[{key}, {note}]" if note else f"[{key}]"
        if name in ("ref", "eqref", "pageref"):
            key = self.raw_group() or ""
            return {"ref": f"[{key}]", "eqref": f"[({key})]", "pageref": f"[p. {key}]"}[name]
        if name == "href":
            to, shown = self.raw_group() or "", self.group() or ""
            return f"[{shown}]({to})"
        if name == "url":
            return f"<{self.raw_group() or ''}>"
        if name == "includegraphics":
            self.raw_group("[", "]")
            return f"![]({self.raw_group() or ''})"
        if name == "footnote":
            return f" ({self.group() or ''})"
        if name == "item":
            label = self.raw_group("[", "]")
            self.s = self.s[: self.i] + self.s[self.i :].lstrip(" \t\n")
            mark = "- "
            if self.lists and self.lists[-1][0] == "enumerate":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. "
            return mark + (f"**{self.sub(label)}** " if label is not None else "")
        if name in TEX_LETTERS:
            return TEX_LETTERS[name]
        if name == "maketitle":
            self.blank()
            return ""
        if name in TEX_SILENT:
            self.raw_group("[", "]")
            self.raw_group()
            if name in ("documentclass", "usepackage", "RequirePackage"):
                self.blank()
            return ""
        if self.s[self.i : self.i + 1] == "{":  # any other command is what it is given
            return self.group() or ""
        return ""

    def environment(self, start: int) -> str:
        name = self.raw_group() or ""
        base, end = name.rstrip("*"), f"\\end{{{name}}}"
        if base in TEX_MATH:
            self.until(end)
            return self.keep(self.s[start : self.i])
        if base in TEX_CODE:
            option = self.raw_group("[", "]") or ""
            lang = re.search(r"language=(\w+)", option)
            lang = (self.raw_group() or "") if base == "minted" else lang[1].lower() if lang else ""
            body = self.until(end)
            return "\n" + self.keep(f"```{lang}\n{body[1:] if body[:1] == chr(10) else body}```") + "\n"
        if base == "abstract":
            self.meta["abstract"] = self.until(end).strip()
            self.blank()
            return ""
        if base == "document":
            self.blank()
            return ""
        depth_end = self.matching(name)
        inner = self.s[self.i : depth_end]
        self.i = min(len(self.s), depth_end + len(end))
        if base in TEX_LISTS:
            inner = re.sub(r"^\[[^\]]*\]", "", inner)
            self.lists.append([base, 0])
            body = self.sub(inner)
            self.lists.pop()
            return f"\n{body}\n"
        inner = re.sub(r"^(?:\[[^\]]*\])?(?:\{[^{}]*\})?" if base in ("table", "tabular", "tabularx", "longtable", "figure", "subfigure", "wrapfigure") else r"^(?!)", "", inner)
        return f"\n{self.sub(inner)}\n"

    def matching(self, name: str) -> int:
        """Where the environment that is open ends, others of its name inside of it left out."""
        depth, at = 1, self.i
        for m in re.finditer(rf"\\(begin|end)\{{{re.escape(name)}\}}", self.s[self.i :]):
            depth += 1 if m[1] == "begin" else -1
            if not depth:
                return at + m.start()
        return len(self.s)


def tex(text: str) -> tuple[str, dict]:
    """Markdown and metadata (title, author, date, abstract) of a LaTeX text; mathematics and code pass untouched."""
    t = _Tex(text)
    body = re.sub(r"[ \t]+$", "", t.run(), flags=re.M)
    back = lambda s: re.sub("\0(\\d+)\0", lambda m: back(t.kept[int(m[1])]), s)
    return _tidy(back(_GAPS.sub("\n\n", body))), {k: back(v) for k, v in t.meta.items()}


# ---- HTML ------------------------------------------------------------------------------------------

# What stands on either side of an element's text, elements whose own marks are taken off, entities.
HTML_AROUND = {"strong": ("**", "**"), "b": ("**", "**"), "em": ("*", "*"), "i": ("*", "*"), "code": ("`", "`")}
HTML_BLOCKS = {"p": ("\n", "\n"), "li": ("- ", "\n"), **{f"h{n}": (f"\n{'#' * n} ", "\n") for n in range(1, 7)}}
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}

_HTML_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|<[^>]+>", re.S)
_HREF = re.compile(r"""(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
_ENTITY = re.compile("|".join(map(re.escape, ENTITIES)))


def html_markdown(page: str) -> str:
    """Markdown of HTML: elements are opened on a stack and written when they are closed.

    Headings hold plain text, code that is preformatted stays as it is, paragraphs, items and headings are trimmed; an element
    that is never closed leaves only its text, a closing tag that opens nothing leaves nothing.
    """
    low = page.lower()
    a = low.find("<body")
    if a >= 0 and (a := page.find(">", a) + 1):
        z = low.find("</body", a)
        page = page[a : z if z >= 0 else len(page)]
    stack: list[tuple[str, str, list[str]]] = [("", "", [])]
    at = 0

    def inside(*names: str) -> bool:
        return any(n in names for n, _, _ in stack)

    def say(text: str) -> None:
        stack[-1][2].append(text)

    for m in _HTML_TAG.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name == "br":
            say("\n")
        elif name == "hr":
            say("\n---\n")
        elif name in ("ul", "ol"):
            say("\n")
        elif name in HTML_AROUND or name in HTML_BLOCKS or name in ("a", "pre"):
            if not m[1]:
                href = _HREF.search(m[3] or "") if name == "a" else None
                if name != "a" or href:
                    stack.append((name, (href[1] or href[2] or "") if href else "", []))
            elif inside(name):
                while True:
                    n, to, text = stack.pop()
                    body = "".join(text)
                    if n == name:
                        break
                    say(body)  # was never closed
                heading = inside(*(f"h{k}" for k in range(1, 7)))
                if name in HTML_AROUND:
                    before, after = ("", "") if heading or inside("pre") else HTML_AROUND[name]
                    say(before + body + after)
                elif name == "a":
                    say(body if heading else f"[{body}]({to})")
                elif name == "pre":
                    say(f"\n```\n{body}\n```\n")
                else:
                    before, after = HTML_BLOCKS[name]
                    say(before + body.strip() + after)
    say(page[at:])
    while len(stack) > 1:
        _, _, text = stack.pop()
        say("".join(text))
    return _tidy(_ENTITY.sub(lambda m: ENTITIES[m[0]], "".join(stack[0][2])))


# ---- reStructuredText ------------------------------------------------------------------------------

_ADORN = re.compile(r"^([=\-~^\"'`#*+.:_<>])\1{2,}\s*$")


def rst(text: str) -> tuple[str, dict]:
    """Markdown and metadata of an RST text by line rules: adorned headings in order of first use, docinfo, literal blocks, directives of code, inline marks."""
    lines, out, meta, order = text.splitlines(), [], {}, []
    i, code = 0, None
    while i < len(lines):
        line = lines[i]
        if code is not None:
            if line.strip() and not line.startswith((" ", "\t")):
                while out and not out[-1].strip():
                    out.pop()
                out.append("```\n")
                code = None
            else:
                out.append(line[code:] if line.strip() else "")
                i += 1
                continue
        over = _ADORN.match(line) and i + 2 < len(lines) and _ADORN.match(lines[i + 2] or "") and lines[i + 1].strip()
        under = line.strip() and i + 1 < len(lines) and (m := _ADORN.match(lines[i + 1])) and len(lines[i + 1].rstrip()) >= len(line.strip())
        if over or under:
            kind = (line[0] + line[0]) if over else m[1]
            title = lines[i + 1].strip() if over else line.strip()
            if kind not in order:
                order.append(kind)
            meta.setdefault("title", title)
            out += [f"{'#' * min(6, order.index(kind) + 1)} {title}", ""]
            i += 3 if over else 2
            continue
        if f := re.match(r"^:([A-Za-z][\w ]*):\s+(.*)$", line):
            if f[1].lower() in ("author", "authors", "date", "version", "status", "copyright", "organization", "contact"):
                meta[f[1].lower()] = f[2].strip()
            i += 1
            continue
        if d := re.match(r"^\.\. (?:code-block|code|sourcecode)::\s*(\S*)", line):
            out.append(f"```{d[1]}")
            i += 1
            while i < len(lines) and (not lines[i].strip() or re.match(r"^\s+:\w+:", lines[i])):
                i += 1
            code = len(lines[i]) - len(lines[i].lstrip()) if i < len(lines) else 0
            continue
        if line.startswith(".. ") or line.strip() == "..":
            i += 1
            continue
        literal = line.rstrip().endswith("::")
        line = _rules(line[:-1] if literal else line, [(r"``([^`]+)``", r"`\1`"), (r"`([^`<]+?)\s*<([^>]+)>`_+", r"[\1](\2)"), (r":\w+:`([^`]+)`", r"`\1`"), (r"\|([^|]+)\|", r"\1")])
        out.append(line)
        i += 1
        if literal:
            while i < len(lines) and not lines[i].strip():
                i += 1
            out += ["", "```"]
            code = len(lines[i]) - len(lines[i].lstrip()) if i < len(lines) else 0
    if code is not None:
        out.append("```")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip(), meta


# ---- notebooks -------------------------------------------------------------------------------------


def _source(x: object) -> str:
    return "".join(x) if isinstance(x, list) else (x or "")


def _outputs(outputs: list) -> list[str]:
    out = []
    for o in outputs:
        kind, data = o.get("output_type", ""), o.get("data", {})
        if kind == "stream":
            label, body = "output", _source(o.get("text", ""))
        elif kind == "error":
            label, body = "output", "\n".join(re.sub(r"\x1b\[[0-9;]*m", "", t) for t in o.get("traceback", []))
        elif kind in ("execute_result", "display_data"):
            if any(k.startswith("image/") for k in data):
                out.append("[image output omitted]")
                continue
            label, body = "result", _source(data.get("text/plain", ""))
        else:
            continue
        if body.strip():
            out.append(f"```{label}\n{body.rstrip()}\n```")
    return out


def notebook(text: str, outputs: bool = True, name: str = "") -> tuple[str, dict]:
    nb = json.loads(text)
    cells, m = nb.get("cells", []), nb.get("metadata", {})
    lang = m.get("kernelspec", {}).get("language") or m.get("language_info", {}).get("name") or "python"
    parts: list[str] = []
    for c in cells:
        body = _source(c.get("source", ""))
        if c.get("cell_type") == "code":
            if body.strip():
                parts.append(f"```{lang}\n{body.rstrip()}\n```")
            if outputs and (shown := _outputs(c.get("outputs", []))):
                parts.append("\n\n".join(shown))
        elif c.get("cell_type") in ("markdown", "raw") and body.strip():
            parts.append(body.rstrip())
    kinds = [c.get("cell_type") for c in cells]
    title = next((t[1].strip() for c in cells if c.get("cell_type") == "markdown" and (t := re.search(r"^#\s+(.+)$", _source(c.get("source", "")), re.M))), name)
    return "\n\n".join(parts), {"title": title, "kernel_language": lang, "cell_count": len(kinds), "code_cell_count": kinds.count("code"), "markdown_cell_count": kinds.count("markdown")}


# ---- mail ------------------------------------------------------------------------------------------


def _header(raw: object) -> str:
    if not raw:
        return ""
    try:
        return " ".join(b.decode(c or "utf-8", "replace") if isinstance(b, bytes) else b for b, c in decode_header(str(raw))).strip()
    except (LookupError, ValueError):
        return str(raw)


def _address(raw: str) -> str:
    name, addr = parseaddr(raw)
    return f"{name} <{addr}>" if name and addr else addr or raw


def _when(raw: str) -> str:
    try:
        from datetime import UTC

        d = parsedate_to_datetime(raw)
        return (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (TypeError, ValueError):
        return raw


def _payload(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return data.decode("latin-1")


def mail(raw: bytes | str) -> tuple[str, dict]:
    """Body (HTML before plain text) and metadata with the names of attachments."""
    msg = message_from_bytes(raw, policy=policy.compat32) if isinstance(raw, bytes) else message_from_string(raw, policy=policy.compat32)
    plain = rich = None
    files = []
    for part in msg.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name or "attachment" in str(part.get("Content-Disposition", "")).lower():
            files.append(_header(name) if name else "unnamed")
        elif part.get_content_type() == "text/html" and rich is None:
            rich = _payload(part)
        elif part.get_content_type() == "text/plain" and plain is None:
            plain = _payload(part)
    body = html_markdown(rich) if rich is not None else (plain or "").strip()
    g = lambda k: _header(msg.get(k))
    meta = {
        "subject": g("Subject"), "from": _address(g("From")), "to": g("To"), "cc": g("Cc"), "date": _when(g("Date")) if msg.get("Date") else "", "message_id": g("Message-ID"),
        "in_reply_to": g("In-Reply-To"), "content_type": msg.get_content_type(), "attachments": files,
    }
    return body, {k: v for k, v in meta.items() if v}


# ---- subtitles -------------------------------------------------------------------------------------

_CUE = re.compile(r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})")


def _ms(h: str | None, m: str, s: str, f: str) -> int:
    return (int(h or 0) * 3600 + int(m) * 60 + int(s)) * 1000 + int(f.ljust(3, "0"))


def subtitles(text: str) -> list[tuple[int, int, str, str]]:
    """Events (start ms, end ms, name, text) of SRT, VTT or ASS/SSA."""
    out = []
    if re.search(r"^\[Script Info\]|^Dialogue:", text, re.M):
        for line in text.splitlines():
            if line.startswith("Dialogue:"):
                f = line[9:].split(",", 9)
                if len(f) == 10:
                    a, b = (re.match(r"\s*(\d+):(\d+):(\d+)\.(\d+)", x) for x in f[1:3])
                    if a and b:
                        out.append((_ms(*a.groups()), _ms(*b.groups()), f[4].strip(), f[9].replace("\\N", "\n").replace("\\n", "\n")))
        return out
    for chunk in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        rows = chunk.strip("\n").split("\n")
        for i, r in enumerate(rows):
            if m := _CUE.match(r):
                out.append((_ms(*m.groups()[:4]), _ms(*m.groups()[4:]), "", "\n".join(rows[i + 1 :]).strip()))
                break
    return out


def speech(events: list[tuple[int, int, str, str]]) -> list[tuple[int, str, str]]:
    """Start, speaker and text of events: if any has a name, successive events of one name are one."""
    out: list[tuple[int, str, str]] = []
    named = any(n for _, _, n, _ in events)
    for a, _, n, t in events:
        t = subtitle_markdown(t).strip()
        if t and named and out and out[-1][1] == n:
            out[-1] = out[-1][0], n, f"{out[-1][2]} {t}"
        elif t:
            out.append((a, n, t))
    return out


_SUB_MARK = re.compile(r"(?is)\{\\(b|i)1\}(.*?)\{\\\1 ?0\}|<(b|i)>(.*?)</\3>")


def subtitle_markdown(t: str) -> str:
    """Bold and italic of subtitle tags as Markdown, other tags and override codes gone."""
    t = _SUB_MARK.sub(lambda m: ("**" if (m[1] or m[3]).lower() == "b" else "*").join(("", m[2] or m[4] or "", "")), t)
    return re.sub(r"\{[^}]*\}|<[^>]+>", "", t)
