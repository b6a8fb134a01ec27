"""What the sender of an e-mail newly wrote.

All sentences without a quoting mark are fingerprinted with 64-bit SimHash of their letter triples and looked up
among the sentences of the mail that was answered (every body held under its id, quoting marks taken off, so what
it quotes is searched as well), through partition tables over ``PARTS`` parts of the fingerprint: two fingerprints
that differ in at most ``NEAR`` bits share a part, so none of those is missed.  Near matches are verified by edit
distance and count as inherited.  The rest of a mail is read by its form: quoting marks, attribution lines, copied
headers, signatures, disclaimers and device notices.  Lines whose fingerprint a sender repeats in a large share
of the own mails are boilerplate.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.session import cut

_QUOTE = re.compile(r"^(?: {0,3}(?:>|\|(?= |$|\|)|[A-Z]{1,3}>(?= |$|>))| {4,}(?=\S)|\t)")
_ATTRIBUTION = re.compile(
    r"^(?:on .{6,120} wrote|am .{6,90} schrieb .{2,80}|le .{6,90} a écrit|el .{6,90} escribió|.{2,80} wrote on .{6,40}|.{0,60}<[^<>\s]+@[^<>\s]+> wrote|quoting .{2,100}|\* .{2,100} \[[^\[\]]+\]) ?:$", re.I
)
_ATTR_HEAD = re.compile(r"^(?:on \w{3}, .{6,100}|am \d.{6,90}|le \d.{6,90}|el \d.{6,90}|\* .{2,90}<\S+@\S+>.*|.{2,80} wrote on.*|quoting .{2,80})$", re.I)
_RULE = re.compile(r"^(?:-{2,} ?(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|mensaje original)\b ?-{2,}|begin forwarded message:|_{32})$", re.I)
_HEADER = re.compile(r"^\**(?:from|sent|date|to|cc|subject|reply-to|von|gesendet|datum|an|betreff|de|envoyé|à|objet|para|enviado|asunto)\s?:\**(?:\s|$)", re.I)
# Closing formulas.
_CLOSING = re.compile(
    r"^(?:(?:best|kind|warm|kindest|warmest)(?: regards| wishes)?|regards|sincerely(?: yours)?|yours(?: sincerely| faithfully| truly)?|cheers|(?:many )?thanks(?: again| in advance| a lot)?|thank you(?: very much)?|cordialement|bien cordialement|bien à vous|amicalement|merci(?: beaucoup)?|viele grüße|beste grüße|liebe grüße|schöne grüße|mit freundlichen grüßen|freundliche grüße|gruß|vg|mfg|lg|danke|vielen dank|saludos(?: cordiales)?|un saludo|atentamente|gracias|с уважением|спасибо|br|rgds)[,.!]?$", re.I
)
_DEVICE = re.compile(r"^(?:sent from (?:my|a) .{2,60}|sent via .{2,40}|envoyé (?:depuis|de) mon .{2,40}|von mein\w* .{2,40} gesendet|gesendet von mein\w* .{2,40}|enviado desde mi .{2,40}|get .{2,40} (?:for|app) .{2,30}|diese nachricht wurde von mein\w* .* gesendet.*)$", re.I)
_NOTICE = re.compile(
    r"^(?:this (?:message|e-?mail|communication|transmission)\b.{0,40}\b(?:attachment|confidential|intended|privileged|may contain)|confidentiality notice|disclaimer\b|the information (?:contained )?in this (?:transmission|message|e-?mail)|diese (?:nachricht|e-?mail) (?:kann|enthält|und)|.{2,40} accepts no liability|please consider the environment|ce message .{0,40}confidentiel|este mensaje .{0,40}confidencial|if you are not the intended recipient|unauthorised review)", re.I
)
_DEVICE_FIRST = frozenset("SsEeVvGgDd")
_PS = re.compile(r"^p\.? ?s\.? ?[:.\-–]|^p\.?s\.? ", re.I)
_BLANKISH = re.compile(r"^[\W_]*$")
_BARS = re.compile(r"^(?:_{5,}|-{2,}|={3,}|\*{3,}|-- ?)$")
_DIGITS = re.compile(r"\d+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\w\"'“(])")


_COMMAND = re.compile(r"^> ?(?:[$#] ?\S|(?:select|insert|update|delete|convert|import|def|sudo|git|curl|python)\b).*[^.!?]$")


def _mark(line: str) -> str:
    """The kind of quoting mark: ``>``, ``|``, initials or white space."""
    c = line.lstrip(" ")[:1] if not line.startswith(("    ", "\t")) else " "
    return "A" if c.isalpha() else c


def read_mail(body: str, known: frozenset[int] | set[int] = frozenset()) -> list[tuple[int, str, str]]:
    """``line_no, label, text`` of the visible lines of a body; labels ``new``, ``maybe`` and the rest.

    ``known`` are the lines (from 1) already found in the answered mail.  ``maybe`` is a line with a quoting
    mark that nothing but the mark shows to be quoted.
    """
    lines = [x.rstrip("\r") for x in body.split("\n")]
    n = len(lines)
    lab = [""] * n
    text = [x.strip(" \t\xa0") for x in lines]
    marked = [bool(t) and (x[0] in " >|\t" or ">" in x[:4]) and bool(_QUOTE.match(x)) for x, t in zip(lines, text, strict=True)]
    for k in known:
        lab[k - 1] = "quoted"
    i = 0
    tail = n  # from here on everything is an older mail without marks
    attributed = False
    while i < n:
        t = text[i]
        if not t or marked[i] or lab[i]:
            attributed |= bool(lab[i]) and t[-1:] == ":" and _ATTRIBUTION.match(t) is not None
            i += 1
            continue
        used = 0
        if t[-1] == ":":
            used = 1 if _ATTRIBUTION.match(t) else 0
        elif i + 1 < n and text[i + 1][-1:] == ":" and not marked[i + 1] and len(t) + len(text[i + 1]) < 170 and _ATTR_HEAD.match(t) and _ATTRIBUTION.match(f"{t} {text[i + 1]}"):
            used = 2
        if used:
            for k in range(i, i + used):
                lab[k] = "attribution"
            j = next((k for k in range(i + used, n) if text[k]), n)
            if j == n or not (marked[j] or lab[j]):
                tail = i
                break
            i += used
            continue
        if t[0] in "-_Bb" and _RULE.match(t):
            j = next((k for k in range(i + 1, n) if text[k]), n)
            if not t.startswith("_") or j < n and _HEADER.match(text[j]):
                tail = i
                break
        if ":" in t[:13] and _HEADER.match(t) and i + 1 < n and _HEADER.match(text[i + 1]) and (i + 2 >= n or _HEADER.match(text[i + 2]) or not text[i + 2]) and not any(s.endswith(".") for s in text[i : i + 2]):
            tail = i
            break
        i += 1
    for k in range(tail, n):
        lab[k] = lab[k] or "old"
    # marked lines: quoted, unless nothing else shows it: a lone line behind ">", or indents in a mail that attributes nothing
    attributed |= any(x == "attribution" for x in lab)
    kinds = {_mark(x) for x, m in zip(lines[:tail], marked[:tail], strict=True) if m}
    for k in range(tail):
        if not marked[k] or lab[k]:
            continue
        near = k and marked[k - 1] or k + 1 < tail and marked[k + 1]
        before = next((lab[q] for q in range(k - 1, -1, -1) if text[q]), "")
        kind = _mark(lines[k])
        if kind == " ":
            lab[k] = "quoted" if attributed else "new"
        elif near or before == "attribution":
            lab[k] = "quoted"
        elif kind == ">" and (not attributed or len(kinds) > 1 or _COMMAND.match(text[k])):
            lab[k] = "maybe"
        else:
            lab[k] = "quoted"
    for k in range(1, tail):  # a wrapped tail that lost its mark
        if text[k] and not marked[k] and lab[k] == "" and text[k - 1] and lab[k - 1] == "quoted" and _mark(lines[k - 1]) != " ":
            follows = k + 1 < tail and marked[k + 1]
            if follows or len(text[k]) <= 30 and not text[k][0].isupper() and (k + 1 >= n or not text[k + 1]):
                lab[k] = "quoted"
    # signature, notices and postscripts in the text between
    mode, signed = "text", False
    for k in range(tail):
        t = text[k]
        if lab[k] in ("quoted", "attribution"):
            # a notice may begin with lines that the answered mail ends with as well
            notice = lab[k] == "quoted" and not marked[k] and (mode == "notice" or _NOTICE.match(t) is not None)
            mode = "notice" if notice else "text"
            signed = signed and notice
            continue
        if not t:
            if mode in ("notice", "ps", "device"):
                mode = "signed" if mode != "text" and signed else "text"
            continue
        if k == 0 or mode == "text" and not any(lab[q] in ("signed",) for q in range(max(0, k - 1), k)):
            signed = mode in ("signed",)
        if lab[k] == "maybe":
            continue
        long = len(t) > 12
        if t[0] in "Pp" and _PS.match(t):
            signed, mode = mode == "signed" or (mode == "notice" and signed), "ps"
            lab[k] = "new"
        elif mode == "ps" and not (_BARS.match(t) or long and (_NOTICE.match(t) or _DEVICE.match(t))):
            lab[k] = "new"
        elif long and t[0].isalpha() and _NOTICE.match(t):
            signed, mode = mode == "signed" or signed, "notice"
            lab[k] = "notice"
        elif long and t[0] in _DEVICE_FIRST and len(t) < 100 and _DEVICE.match(t):
            lab[k] = "device"
        elif mode == "notice":
            lab[k] = "notice"
        elif t.startswith("--") and _BARS.match(t) and len(t) <= 3:
            nxt = next((q for q in range(k + 1, n) if text[q]), n)
            lab[k] = "bar"
            if len(t) == 2 or nxt < n and lab[nxt] not in ("attribution", "old"):
                if len(t) == 2:
                    mode, signed = "signed", True
        elif t[0] in "_-=*" and _BARS.match(t):
            lab[k] = "bar"
            nxt = text[k + 1] if k + 1 < n else ""
            if t[0] == "_" and " | " in nxt:
                mode, signed = "signed", True
        elif mode == "signed":
            lab[k] = "signed"
        elif len(t) <= 32 and _CLOSING.match(t):
            mode, signed = "signed", True
            lab[k] = "signed"
        elif not t[0].isalnum() and _BLANKISH.match(t):
            lab[k] = "bar"
        else:
            lab[k] = "new"
    return [(k + 1, lab[k] or "new", text[k]) for k in range(n) if text[k]]


#: Bits of the parts of a fingerprint, and the distance that they guarantee to be found: one less than there are parts.
PARTS = (6, 6, 6, 6, 5, 5, 5, 5, 5, 5, 5, 5)
NEAR = len(PARTS) - 1
#: The bits of every hash of a byte triple as bytes, eight of them in a number of 64 bits; the last row, of nothing, is zero.
_BITS = np.vstack([np.random.default_rng(64).integers(0, 2, (1 << 16, 64), dtype=np.uint8), np.zeros((1, 64), np.uint8)]).view(np.uint64)
_STEP = 1 << 15


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of the byte triples of each text in lower case; of texts shorter than three bytes 0."""
    raw = [t.lower().encode() for t in texts]
    out = np.zeros(len(raw), np.uint64)
    i = 0
    while i < len(raw):  # blocks of about _STEP bytes, a longer text in pieces of that length
        j, n = i, 0
        while j < len(raw) and (j == i or n + len(raw[j]) < _STEP):
            n += len(raw[j]) + 3
            j += 1
        if j == i + 1:
            ones = sum(_ones([raw[i][k : k + _STEP + 2]])[0] for k in range(0, max(1, len(raw[i]) - 2), _STEP))[None]
        else:
            ones = _ones(raw[i:j])
        triples = np.array([len(x) - 2 for x in raw[i:j]])[:, None]
        out[i:j] = np.packbits(2 * ones > triples, axis=1).view(">u8")[:, 0] * (triples[:, 0] > 0)
        i = j
    return out


def _ones(raw: list[bytes]) -> np.ndarray:
    """How many triples of each text have each bit: added up eight bits at once, 255 triples at most before they are taken apart."""
    b = np.frombuffer(b"\0\0\0".join(raw) + b"\0\0\0", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    h[(b[:-2] == 0) | (b[1:-1] == 0) | (b[2:] == 0)] = 1 << 16  # over the end of a text
    size = np.array([len(x) + 3 for x in raw])
    starts = np.cumsum(size) - size
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(starts - 255 * first, parts) + 255 * np.arange(parts.sum())
    at = np.minimum(at, len(h) - 1)
    return np.add.reduceat(np.add.reduceat(_BITS[h], at, axis=0).view(np.uint8), first, axis=0, dtype=np.int32)


def _words(t: str) -> list[str]:
    return re.findall(r"\w+", t.lower())


def sentences(lines: list[tuple[int, str]], least: int = 4) -> list[tuple[str, list[int]]]:
    """Sentences of at least ``least`` words over wrapped lines, with the lines each one touches."""
    out: list[tuple[str, list[int]]] = []
    nos: list[int] = []
    texts: list[str] = []
    for no, t in [*lines, (-1, "")]:
        if nos and (not t or no != nos[-1] + 1):
            starts = list(accumulate((len(x) + 1 for x in texts[:-1]), initial=0))
            buf, a = " ".join(texts), 0
            for m in [*_SENTENCE.finditer(buf), None]:
                z = m.start() if m else len(buf)
                s = buf[a:z]
                if s.count(" ") >= least - 1:
                    out.append((s, nos[bisect_right(starts, a) - 1 : bisect_right(starts, z - 1)]))
                a = m.end() if m else z
            nos, texts = [], []
        if t:
            nos.append(no)
            texts.append(t)
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two texts, or any number above ``most`` where it is larger; rows of the table are bits of whole numbers."""
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, top, d = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0  # cells one more, one less than the cell above
    for k, c in enumerate(b, 1):
        same = at.get(c, 0)
        level = same | down
        across = ((same & up) + up ^ up) | same
        more, less = down | full & ~(across | up), up & across
        d += 1 if more & top else -1 if less & top else 0
        if d - (len(b) - k) > most:
            return d
        more = (more << 1 | 1) & full
        up, down = (less << 1 | ~(level | more)) & full, more & level
    return d


def _near(a: str, b: str, share: float) -> bool:
    """Whether the edit distance of two sentences is at most ``share`` of the longer one."""
    k = int(share * max(len(a), len(b)))
    return a == b or abs(len(a) - len(b)) <= k and edit_distance(a, b, k) <= k


def partition_pairs(mine: np.ndarray, mine_of: np.ndarray, old: np.ndarray, old_of: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of fingerprints of one group (``mine_of`` = ``old_of``) that differ in at most ``NEAR`` bits.

    One table for each part of the fingerprint, keyed by group and part: the two sides meet in a sorted join on the key.
    """
    found = []
    shift = 0
    for bits in PARTS:
        part = lambda p, of: of.astype(np.uint64) << np.uint64(6) | p >> np.uint64(shift) & np.uint64((1 << bits) - 1)  # noqa: B023, E731
        k = part(old, old_of)
        order = np.argsort(k, kind="stable")
        k, q = k[order], part(mine, mine_of)
        lo = np.searchsorted(k, q, "left")
        n = np.searchsorted(k, q, "right") - lo
        i = np.repeat(np.arange(len(q)), n)
        j = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(i) else i
        near = np.bitwise_count(mine[i] ^ old[j]) <= NEAR
        found.append(np.stack([i[near], j[near]], 1))
        shift += bits
    return np.unique(np.concatenate(found), axis=0)


def near_matches(own: list[list[str]], older: list[list[str]], share: float = 0.15) -> list[set[int]]:
    """For each group which sentences of ``own`` are near matches of one of its ``older``: partition tables, then edit distance.

    A copy may differ by a few characters but not in its figures: sentences of one template that name
    another number are not inherited.
    """
    a, b = [s for g in own for s in g], [s for g in older for s in g]
    out: list[set[int]] = [set() for _ in own]
    if not a or not b:
        return out
    of = lambda groups: np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    a_of, first = of(own), np.concatenate(([0], np.cumsum([len(g) for g in own])))
    done = -1
    for i, j in partition_pairs(simhashes(a), a_of, simhashes(b), of(older)).tolist():
        if i != done and (a[i] == b[j] or _DIGITS.findall(a[i]) == _DIGITS.findall(b[j]) and _near(a[i], b[j], share)):
            out[a_of[i]].add(i - int(first[a_of[i]]))
            done = i
    return out


def inherited(bodies: list[str], olds: list[str]) -> list[set[int]]:
    """Lines (from 1) of each of ``bodies`` without quoting marks (indents are none) that come from the mail of ``olds`` beside it.

    Around sentences that are found, equal lines in the same order (greetings, signatures) belong to the same copy.
    """
    lines = [[(i, t.strip()) for i, t in enumerate(b.split("\n"), 1) if t[:1] in " \t" and _mark(t) == " " or not _QUOTE.match(t)] for b in bodies]
    mine = [sentences(x) for x in lines]
    seen: dict[str, list[str]] = {}
    for o in olds:
        if o not in seen:
            seen[o] = list(dict.fromkeys(s for s, _ in sentences([(i, _unmark(t).strip()) for i, t in enumerate(o.split("\n"), 1)])))
    hits = near_matches([[s for s, _ in m] for m in mine], [seen[o] for o in olds])
    out = []
    for own, m, hit, old in zip(lines, mine, hits, olds, strict=True):
        found: set[int] = set()
        if hit:
            of: dict[int, list[bool]] = {}
            for i, (_, touched) in enumerate(m):
                for no in touched:
                    of.setdefault(no, []).append(i in hit)
            found = {no for no, v in of.items() if all(v)}
        if found:
            a, b = [t.strip() for t in old.split("\n") if t.strip()], [(i, t) for i, t in own if t]
            for block in SequenceMatcher(None, a, [t for _, t in b], autojunk=False).get_matching_blocks():
                nos = [i for i, _ in b[block.b : block.b + block.size]]
                if any(no in found for no in nos):
                    found.update(nos)
        out.append(found)
    return out


def mail_key(c: Column) -> Column:
    """Message ids as they compare: without white space, brackets and case; null if empty."""
    k = F.lower(F.regexp_replace(c, r"[\s<>]", ""))
    return F.when(k != "", k)


def _unmark(text: str) -> str:
    while (m := _QUOTE.match(text)) and text.strip():
        text = text[m.end() :].lstrip(" ") if m.end() else text
    return text


def new_lines(df: DataFrame, *, repeat_share: float = 0.3, repeat_least: int = 20) -> DataFrame:
    """``email_id, line_no, line`` of each line with visible text that the sender newly wrote.

    ``df`` has ``email_id, message_id, in_reply_to, msg_from, body``.  Lines count from 1 after splitting
    at line feeds.  Greetings and postscripts are new; closing formulas and what follows, disclaimers,
    device notices, attribution lines, copied headers and everything inherited from the mail that
    ``in_reply_to`` names are not.  A line that a sender repeats in ``repeat_share`` of at least ``repeat_least``
    mails is boilerplate unless it is a greeting.  Null ids mean nobody; null and empty bodies have no rows; a mail archived
    twice is read each time; where an id is held with different bodies, each of them is the answered mail.
    """
    mails = df.where(F.col("email_id").isNotNull() & (F.col("body") != "")).select(
        F.col("email_id").cast("long").alias("email_id"), mail_key(F.col("in_reply_to")).alias("parent"), F.lower("msg_from").alias("sender"), "body")
    held = df.where(F.col("body") != "").select(mail_key(F.col("message_id")).alias("parent"), F.col("body").alias("old")).where("parent is not null")
    replies = mails.where("parent is not null")

    # ids with different bodies: the replies are looked up in each, one row a body, and the lines found are put together
    hashes = held.groupBy("parent").agg(F.min(F.xxhash64("old")).alias("lo"), F.max(F.xxhash64("old")).alias("hi"))
    several = cut(hashes.where("lo <> hi").select("parent"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = inherited(b["body"].tolist(), b["old"].tolist())
            yield pd.DataFrame([(e, no) for e, found in zip(b["email_id"].tolist(), hits, strict=True) for no in sorted(found)], columns=["email_id", "no"])

    many = replies.join(several, "parent", "left_semi")
    met = many.join(held.join(several, "parent", "left_semi").distinct(), "parent").mapInPandas(look, "email_id long, no int")
    known = met.groupBy("email_id").agg(F.collect_set("no").alias("known"))  # at most the lines of a body
    many = many.join(known, "email_id", "left").select("email_id", "sender", "body", F.lit(None).cast("string").alias("old"), "known")

    asked = replies.select("parent").distinct()
    olds = held.join(several, "parent", "left_anti").join(asked, "parent", "left_semi").groupBy("parent").agg(F.min("old").alias("old"))
    none = F.lit(None).cast("array<int>").alias("known")
    single = replies.join(several, "parent", "left_anti").join(olds, "parent", "left").select("email_id", "sender", "body", "old", none)
    lone = mails.where("parent is null").select("email_id", "sender", "body", F.lit(None).cast("string").alias("old"), none)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies, olds, knowns = b["body"].tolist(), b["old"].tolist(), b["known"].tolist()
            paired = [i for i, o in enumerate(olds) if o]
            found = dict(zip(paired, inherited([bodies[i] for i in paired], [olds[i] for i in paired]), strict=True))
            rows = []
            for i, (e, s, body, old, known) in enumerate(zip(b["email_id"].tolist(), b["sender"].tolist(), bodies, olds, knowns, strict=True)):
                plain = None
                for no, label, t in read_mail(body, found.get(i) or (frozenset(known) if known is not None else frozenset())):
                    if label == "maybe" and old:
                        plain = " ".join(_words(old)) if plain is None else plain
                        if " ".join(_words(t)) in plain:
                            continue
                    if label in ("new", "maybe"):
                        rows.append((e, s, no, t))
            out = pd.DataFrame(rows, columns=["email_id", "sender", "line_no", "line"])
            out["h"] = simhashes(out["line"].tolist()).view(np.int64)
            yield out

    all_mails = single.unionByName(lone).unionByName(many)
    lines = cut(all_mails.mapInPandas(read, "email_id long, sender string, line_no int, line string, h long"))
    per_sender = lines.groupBy("sender").agg(F.countDistinct("email_id").alias("mails")).where(F.col("mails") >= repeat_least)
    said = lines.where("sender is not null").groupBy("sender", "h").agg(F.count(F.lit(1)).alias("n"))
    boiler = said.join(per_sender, "sender").where(F.col("n") >= F.greatest(F.lit(5), F.col("mails") * repeat_share)).select("sender", "h")
    greeting = F.col("line").rlike(r"^[\p{L} '’-]{2,40}[,!:]?$") & (F.size(F.split("line", " ")) <= 4)
    out = lines.withColumn("g", greeting).join(boiler.withColumn("rep", F.lit(True)), ["sender", "h"], "left").where(F.col("rep").isNull() | F.col("g"))
    return out.select("email_id", "line_no", "line")
