"""The main body of web pages, block by block.

Two passes over the blocks of one page, nothing shuffled: the first decides blocks by stop-word
density, length, link density and by where they stand (outside of the flow, between rules, a paragraph that is no
sentence, a sentence about the site itself); the second lets short undecided blocks (headings, list items, table
cells) inherit the label of the nearest decided neighbours.  No rule knows a phrase of any language.  A page is
judged by its own markup and address only, so the work is one scan, whatever the number and size of sites.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of five languages.
STOP = frozenset(
    """a an and are as at be been but by can each every few for from had has have he her his how if in into is it its just may more most no nobody nor not of on once only or our over says she should so some than that the their them then there these they this those to took until up version was we were what when where which while who whose why will with without you your
    aber alle alles als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer eines er es für hat hatte ich im in ist kann laut mehr mit nach nicht noch nur ob oder ohne sagt sein seit sich sie sind so über und uns unter vom von vor wann war was weder wenn wer wie wir wird zu zum zur
    au aux avec ce ces cette dans de depuis des du elle en est et il ils je la le les leur lui mais ne ni nous on ou où par pas plus pour quand que qui sa sans se selon ses seulement son sont sur un une vos votre vous à
    al como con cuando de del desde el ella en entre es esta este la las lo los más mi ni no o para pero por que se según sin sobre solo su sus también un una y ya
    а без был в вы для до его если же за и из или как когда ли на не но о он она они от по при с то только у что это я""".split()
)

_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
_SILENT = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_INLINE = re.compile(r"<(/?)(a|b|strong|em|i|code|span|small)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>", re.I)
_BREAK = re.compile(r"<br\b[^<>]*>", re.I)
_TAG = re.compile(r"(<[/!?]?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>|<[/!?]?[a-zA-Z][^<>]*$)")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[^\W\d_]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://")
_TITLE = re.compile(r"<title[^>]*>([^<]*)", re.I)
_BAR = re.compile(r"\s*[|·—–]\s*|\s-\s")
_HOLD = frozenset("div table article main section aside nav header footer form td body".split())
_OUTSIDE = frozenset("nav header footer aside form button select noscript head title label".split())
#: Tags whose text may be short in an article: headings, items, cells, code, quotations, captions.
_SHORT = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption pre code blockquote q figcaption cite summary".split())
#: Least text, in blocks and characters, that makes a main body without a heading of first order.
BARE_BLOCKS, BARE_CHARS = 3, 500
_OPEN, _CLOSE = "", ""  # where links begin and end, kept out of the text


class Block:
    __slots__ = ("label", "linked", "path", "tag", "text", "words")

    def __init__(self, text: str, linked: int, tag: str, path: tuple[int, ...]):
        self.text, self.tag, self.path = text, tag, path
        self.linked = linked / len(text)
        self.words = _TOKEN.findall(text.lower())
        self.label = ""

    @property
    def stops(self) -> float:
        return sum(w in STOP for w in self.words) / len(self.words) if self.words else 0.0


def blocks(page: str) -> list[Block]:
    """All blocks in order; see ``main_blocks`` for what a block is."""
    page = _COMMENT.sub("", page)
    page = _SILENT.sub("<script>", page)
    page = _INLINE.sub(lambda m: (_CLOSE if m[1] else _OPEN) if m[2] in "aA" else "", page)
    page = _BREAK.sub(" ", page)
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    tag, serial, inside = "", 0, False
    for i, part in enumerate(_TAG.split(page)):
        if i % 2:
            m = _NAME.match(part)
            name = m[1].lower() if m else ""
            if part[1] == "/":
                if name in _HOLD and any(n == name for n, _ in stack):
                    while stack.pop()[0] != name:
                        pass
                tag = "/" + name
            else:
                if name in _HOLD:
                    serial += 1
                    stack.append((name, serial))
                tag = name
            continue
        if not part or part.isspace():
            continue
        chars, linked = [], 0
        for piece in re.split(f"([{_OPEN}{_CLOSE}])", part):
            if piece == _OPEN:
                inside = True
            elif piece == _CLOSE:
                inside = False
            elif piece:
                chars.append(piece)
                linked += len(piece.strip()) * inside
        text = _SPACE.sub(" ", html.unescape("".join(chars))).strip()
        if text:
            owner = next((n for n, _ in reversed(stack) if n in _OUTSIDE), "")
            out.append(Block(text, min(linked, len(text)), tag if tag in _OUTSIDE or not owner else owner, tuple(s for _, s in stack)))
    return out


def _names(page: str, url: str | None) -> frozenset[str]:
    """What the site calls itself: the labels of its host but for the last, and the last part of the page's title."""
    out = {x for x in _HOST.sub("", (url or "").lower()).partition("/")[0].partition(":")[0].split(".")[:-1] if x != "www"}
    m = _TITLE.search(page)
    parts = _BAR.split(html.unescape(m[1])) if m else []
    if len(parts) > 1:
        out.add("".join(_TOKEN.findall(parts[-1].lower())))
    return frozenset(x.replace("-", "") for x in out if len(x) >= 4)


def _decide(b: Block, names: frozenset[str]) -> str:
    """First pass, of a block by itself: ``good``, ``bad``, ``insert`` (bad, says nothing of its neighbours) or undecided."""
    t = b.text
    if b.tag in _OUTSIDE:
        return "bad"
    if len(t) < 140 and not names.isdisjoint(b.words) and b.tag not in _SHORT:
        return "insert"  # a sentence about the site itself
    if b.tag in ("hr", "/hr") and len(t) < 40 and len(b.words) <= 6:
        return "insert"
    if b.tag not in _SHORT and len(b.words) < 12 and t[-1] not in ".!?:;,…\"”»)":
        return "insert"  # a paragraph that is no sentence: by-line, advertisement, pointer to another page
    if len(t) >= 45 and len(b.words) >= 6 and b.stops >= 0.12 and (b.linked < 0.6 or len(t) >= 60 and t[-1] in ".!?:"):
        return "good"
    if b.linked > 0.6 and len(t) < 60 and b.tag not in ("li", "p", "td", "th", "h2", "h3", "h4", "h5", "h6"):
        return "bad"
    return ""


def _bare_start(bs: list[Block]) -> tuple[int, tuple[int, ...]] | None:
    """Where the body begins on a page without a heading of first order: the innermost container of most of its good text."""
    good = [b for b in bs if b.label == "good" and b.linked < 0.3]
    total = sum(len(b.text) for b in good)
    if len(good) < BARE_BLOCKS or total < BARE_CHARS:
        return None
    mass: dict[tuple[int, ...], list[int]] = {}
    for b in good:
        for k in range(len(b.path) + 1):
            m = mass.setdefault(b.path[:k], [0, 0])
            m[0] += len(b.text)
            m[1] += 1
    home = max((k for k, m in mass.items() if m[0] >= 0.6 * total and m[1] >= BARE_BLOCKS), key=len, default=None)
    if home is None:
        return None
    first = next(i for i, b in enumerate(bs) if b.label == "good" and b.path[: len(home)] == home)
    while first and bs[first - 1].tag in _SHORT and bs[first - 1].path[: len(home)] == home and bs[first - 1].label == "":
        first -= 1
    return first, home


def main_blocks(page: str | None, url: str | None = None) -> list[str]:
    """The text of each block of the page's main body, in order.

    A block is the text between two neighbouring tags: comments and the inline tags a, b, strong, em, i,
    code, span and small do not cut, br is a space, script and style have no text, entities are decoded,
    white space is collapsed and trimmed, empty blocks do not count.  The body begins with the heading of first
    order and holds what lies in that heading's container; without such a heading it is the innermost container of
    most of the text, if there are at least ``BARE_BLOCKS`` blocks and ``BARE_CHARS`` characters of it.  Null and empty pages
    and pages without any text in sentences (refusals, errors, lists of links) have no main body.
    """
    if not page:
        return []
    bs, names = blocks(page), _names(page, url)
    for b in bs:
        b.label = _decide(b, names)
    first = next((i for i, b in enumerate(bs) if b.tag == "h1"), None)
    if first is not None:
        bs[first].label, home = "good", bs[first].path
    else:
        bare = _bare_start(bs)
        if bare is None:
            return []
        first, home = bare
    run = [b for b in bs[first:] if b.path[: len(home)] == home]
    # second pass: short blocks take the label of the nearest decided neighbours, the one before counting first
    before, labels = "good", []
    for b in run:
        if b.label in ("good", "bad"):
            before = b.label
        labels.append(before)
    after, nexts = "", [""] * len(run)
    for i in range(len(run) - 1, -1, -1):
        if run[i].label in ("good", "bad"):
            after = run[i].label
        nexts[i] = after
    keep = [b.label == "good" or b.label == "" and (labels[i] == "good" or nexts[i] == "good") for i, b in enumerate(run)]
    if not any(b.label == "good" for b in run[1:]) and not any(k and len(b.words) > 3 for b, k in zip(run[1:], keep[1:], strict=True)):
        return []
    return [b.text for b, k in zip(run, keep, strict=True) if k]


def main_body(df: DataFrame, key: str, page: str, url: str | None = None) -> DataFrame:
    """``*key, block_no, block, block_md5`` of the main body of each page; see :func:`main_blocks`.

    Rows without a key are left out; repeated rows repeat their blocks; pages of any length are read
    whole; a null ``url`` only leaves the site's name to the title.  One scan and one Arrow pass, no shuffle.
    """
    kind = dict(df.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = zip(b["k"].tolist(), b["h"].tolist(), b["u"].tolist(), strict=True)
            rows = [(k, i, t, md5(t.encode("utf-8", "replace")).hexdigest()) for k, h, u in pages for i, t in enumerate(main_blocks(h, u))]
            yield pd.DataFrame(rows, columns=["k", "block_no", "block", "block_md5"])

    at = F.lit(None).cast("string") if url is None else F.col(url)
    use = df.where(F.col(key).isNotNull() & F.col(page).isNotNull()).select(F.col(key).alias("k"), F.col(page).alias("h"), at.alias("u"))
    return use.mapInPandas(scan, f"k {kind}, block_no int, block string, block_md5 string").withColumnRenamed("k", key)
