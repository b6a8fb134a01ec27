"""Repair of text read from scanned pages.

Edge lines (running headers, page numbers, specks) are told by the page's own line width and by the
first lines of the pages beside it.  Words divided at line ends are joined with the corpus as
evidence for or against the hyphen.  Misread words are corrected in SQL: every word has an anagram
hash, the sum of the fifth powers of its characters; a confusion such as m read as rn changes that
sum by a fixed difference, so rare words meet their frequent variants in one equi-join on
``hash + difference`` and only these pairs are looked at closer.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.session import BROADCAST_ROWS, cut

# What is printed and how it is misread.
CONFUSIONS = [
    ("e", "c"), ("s", "5"), ("n", "ri"), ("a", "o"), ("t", "f"), ("i", "!"), ("l", "1"), ("d", "cl"), ("o", "0"), ("m", "rn"), ("u", "ii"),
    ("in", "m"), ("g", "9"), ("b", "6"), ("h", "b"), ("w", "vv"), ("rn", "m"), ("cl", "d"), ("i", "1"), ("l", "!"), ("i", "l"), ("l", "i"), ("c", "e"), ("o", "a"), ("f", "t"),
    ("b", "h"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("g", "q"), ("q", "g"), ("z", "2"), ("b", "8"), ("s", "8"), ("li", "h"), ("h", "li"), ("nn", "m"), ("m", "nn"), ("m", "in"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("n", "u"), ("u", "n"), ("y", "v"), ("v", "y"),
]
HYPHENS = "-‐­"

_ALNUM = re.compile(r"\w")
_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_HEAD, _TAIL = re.compile(r"^[\W_]*"), re.compile(r"[\W_]*$")
_DIGIT = r"[\dlIiOoSsBbZzgq!|]"
_PAGE_NO = re.compile(
    rf"^[\W_]*(?:page|seite|p|pg|s)?[. ]*(?:{_DIGIT}{{1,4}}|[ivxlcdm]{{1,8}})(?:\s*(?:of|von|sur|de|/)\s*{_DIGIT}{{1,4}})?[\W_]*$|^.{{3,50}}\|\s*p\W\s*\S{{1,5}}$", re.I
)


def _letters(line: str) -> str:
    return re.sub(r"[\W\d_]+", "", line).lower()


def _alike(a: str, b: str) -> bool:
    a, b = _letters(a), _letters(b)
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 4 + len(a) // 6:
        return False
    return a == b or difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.8


def edge_lines(text: str, *others: str | None) -> list[bool]:
    """Which lines of a page are running header, page number or specks.

    ``others`` are first lines of other pages: those of the neighbours and the most frequent of the file.  Specks have no letter or
    digit.  A page number stands on the last or first line.  A header is the first line if it repeats that of
    another page, or if it ends without punctuation though the next word would have fitted.
    """
    lines = text.split("\n")
    out = [bool(x.strip()) and not _ALNUM.search(x) for x in lines]
    body = [i for i, x in enumerate(lines) if x.strip() and not out[i]]
    if not body:
        return out
    width = max(len(lines[i].rstrip()) for i in body[1:-1] or body)
    end = body[-1]
    last = lines[end].strip()
    if len(body) > 1 or len(last) < 12:
        short = len(last) <= 0.6 * width and last[-1] not in ".;:?!,\"”" + HYPHENS and len(last) < 40 and not last[0].islower()
        if _PAGE_NO.match(last) and not re.match(r"^[a-z]{2,}\.$", last) and (len(last) < 0.6 * width) and not re.search(r"\d\.$", last) or short:
            out[end] = True
            body.pop()
    if not body:
        return out
    top = body[0]
    head = lines[top].strip()
    if _PAGE_NO.match(head) and len(body) > 1 and len(head) < 0.5 * width and not head.endswith("."):
        out[top] = True
        body = body[1:]
        if not body:
            return out
        top, head = body[0], lines[body[0]].strip()
    bare = re.sub(rf"\s+{_DIGIT}{{1,4}}$", "", head)
    if bare and bare[-1] not in ";:?!," + HYPHENS:
        rest = lines[body[1]].split() if len(body) > 1 else []
        fits = bool(rest) and len(lines[top].rstrip()) + 1 + len(rest[0]) <= width
        titled = head[0].isupper() or not head[0].islower() and not head[0].isalpha()
        same = any(n and _alike(bare, n) for n in others)
        caps = sum(c.isupper() for c in bare) > 0.6 * max(1, sum(c.isalpha() for c in bare)) and len(bare.split()) > 1
        numbered = bare != head and re.search(r"\s{2,}\S+$", head) is not None
        blank = top + 1 < len(lines) and not lines[top + 1].strip()
        if same and (titled or numbered) or caps or numbered or titled and bare[-1] != "." and len(bare.split()) < 12 and (fits or blank and len(bare) < 0.9 * width):
            out[top] = True
    return out


def _first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^[ \t]*(\S[^\n]*)$", 1)


def _core(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth powers of the characters: equal for anagrams, additive under replacement."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    code = F.transform(chars, lambda c: F.ascii(c).cast("long") % 1009 + 1)
    return F.aggregate(code, F.lit(0).cast("long"), lambda a, c: a + c * c * c * c * c)


def _hash(text: str) -> int:
    return sum((ord(c) % 1009 + 1) ** 5 for c in text)


def word_counts(pages: DataFrame, text: str) -> DataFrame:
    """``word, n`` over all pages, words divided at line ends left out; pieces between white space are counted before they are stripped to words."""
    whole = F.regexp_replace(F.col(text), rf"\S+[{HYPHENS}]\s*\n\s*\S+", " ")
    pieces = pages.select(F.explode(F.split(whole, r"\s+")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return pieces.select(_core(F.col("t")).alias("word"), "n").where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def corrections(words: DataFrame, extra: DataFrame | None = None, *, ratio: int = 4, least: int = 3) -> DataFrame:
    """``word, fixed``: rare words and the frequent word that each is a misreading of, best ranked first and only.

    ``words`` has ``word, n``; words of ``extra`` (column ``word``) are asked too.  A variant must be at
    least ``least`` times in the corpus and ``ratio`` times as frequent as the misreading; both are shares of
    counts, so they mean the same at every size.  Words with more digits than letters and codes
    (letters, hyphen, digits) are left alone.
    """
    spark = words.sparkSession
    asked = words.select("word", "n")
    if extra is not None:
        asked = asked.unionByName(extra.select("word", F.lit(0).cast("long").alias("n"))).groupBy("word").agg(F.max("n").alias("n"))
    plain = F.col("word").rlike(r"^\p{L}+(?:[-'’]\p{L}+)*$")
    known = words.where(plain & (F.col("n") >= least) & (F.length("word") >= 2)).select(F.col("word").alias("fixed"), F.col("n").alias("n_fixed"), anagram_hash(F.col("word")).alias("h"))
    letters, digits = F.length(F.regexp_replace("word", r"[^\p{L}]", "")), F.length(F.regexp_replace("word", r"[^0-9]", ""))
    odd = asked.where((letters >= digits) & (letters >= 1) & (F.length("word") >= 3) & ~F.col("word").rlike(r"^\p{L}{2}-\d+$")).withColumn("_h", anagram_hash(F.col("word")))
    table = spark.createDataFrame([(t, s, _hash(t) - _hash(s)) for t, s in CONFUSIONS], "true string, seen string, diff long")
    seen, size = F.col("seen"), F.length("seen")
    tried = odd.join(F.broadcast(table), F.contains("word", "seen"))
    tried = tried.select("*", F.explode(F.sequence(F.expr("locate(seen, word)"), F.length("word") - size + 1)).alias("i")).where(F.substring("word", F.col("i"), size) == seen)
    made = F.concat(F.substring("word", F.lit(1), F.col("i") - 1), F.col("true"), F.substring("word", F.col("i") + size, F.length("word")))
    tried = tried.select("word", "n", made.alias("made"), (F.col("_h") + F.col("diff")).alias("h"))
    met = tried.join(known, "h").where((F.col("made") == F.col("fixed")) & (F.col("n_fixed") >= F.greatest(F.lit(least), F.col("n") * ratio)))
    best = Window.partitionBy("word").orderBy(F.desc("n_fixed"), "fixed")
    return met.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("word", "fixed")


def _maybe_broadcast(small: DataFrame) -> DataFrame:
    """The written table, broadcast only if it is within the bound; beyond it the join shuffles."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def repair_evidence(df: DataFrame) -> DataFrame:
    """``pdf_id, page, line_no, kind, word`` of scanned pages: ``drop``, ``join`` and ``char``; see :func:`repair_marks`."""
    return repair_marks(df).where("kind <> 'tail'").select("pdf_id", "page", "line_no", "kind", "word").distinct()


def repair_marks(df: DataFrame) -> DataFrame:
    """``pdf_id, page, line_no, token, kind, word, tail``: every place of scanned pages that is to be repaired (see the module).

    ``token`` counts the pieces between white space of the line from 0.  ``drop`` is a whole line; ``join`` the first half of a
    divided word, ``word`` the whole; where the second half is the first word of the next page ``tail`` is what follows it there
    (null if the half is on the same page), and that place is marked ``tail``; ``char`` is a misread word, its correction in ``word``.

    ``df`` has ``pdf_id, page, text, ocr_used``.  Only rows with ``ocr_used`` are repaired, all rows are
    evidence.  Lines count from 1.  Null or empty texts, null ids and pages have no rows; repeated rows
    count once (of different texts under one page the smallest counts); empty tables give no rows.
    """
    pages = df.where(F.col("pdf_id").isNotNull() & F.col("page").isNotNull() & (F.col("text") != "")).select(
        F.col("pdf_id").cast("long").alias("pdf_id"), F.col("page").cast("int").alias("page"), "text", F.coalesce("ocr_used", F.lit(False)).alias("ocr"))
    pages = pages.groupBy("pdf_id", "page").agg(F.min(F.struct("text", "ocr")).alias("p")).select("pdf_id", "page", "p.text", "p.ocr")
    pages = cut(pages)
    scans = pages.where("ocr").drop("ocr")
    heads = pages.select("pdf_id", "page", _first_line(F.col("text")).alias("head"))
    beside = scans.join(heads.select("pdf_id", (F.col("page") + 1).alias("page"), F.col("head").alias("before")), ["pdf_id", "page"], "left")
    beside = beside.join(heads.select("pdf_id", (F.col("page") - 1).alias("page"), F.col("head").alias("after")), ["pdf_id", "page"], "left")

    per_file = heads.join(scans.select("pdf_id", "page"), ["pdf_id", "page"], "left_semi").withColumn("k", F.lower(F.regexp_replace("head", r"[^\p{L}]", "")))
    per_file = per_file.groupBy("pdf_id", "k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "head")).alias("f"))
    per_file = per_file.groupBy("pdf_id").agg(F.max_by(F.struct("f", "n"), F.struct("n", -F.col("f.page"))).alias("c"))
    beside = beside.join(per_file, "pdf_id", "left").withColumn("common", F.when((F.col("c.n") > 1) | (F.col("c.f.page") != F.col("page")), F.col("c.f.head"))).drop("c")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lines without divided words; ``half`` and ``rest`` of divided words; the first word of the page as ``head``."""
        for b in batches:
            out = []
            for pdf, page, text, *others in zip(*(b[c].tolist() for c in ("pdf_id", "page", "text", "before", "after", "common")), strict=True):
                rows, gone = text.split("\n"), edge_lines(text, *others)
                body = [(i, r.rstrip()) for i, r in enumerate(rows) if r.strip() and not gone[i]]
                out += [(pdf, page, i + 1, 0, "drop", "", "", "") for i, g in enumerate(gone) if g]
                carried = False
                for k, (i, r) in enumerate(body):
                    words = r.split()
                    if k == 0:
                        out.append((pdf, page, i + 1, 0, "head", "", "", words[0]))
                    at = int(carried)
                    words = words[at:]
                    carried = False
                    if words and len(words[-1]) > 1 and words[-1][-1] in HYPHENS and words[-1][-2].isalnum():
                        half = words.pop()[:-1]
                        carried = True
                        rest = body[k + 1][1].split()[0] if k + 1 < len(body) else None
                        out.append((pdf, page, i + 1, at + len(words), "half", "", half, rest))
                    out.append((pdf, page, i + 1, at, "line", " ".join(words), "", ""))
            yield pd.DataFrame(out, columns=["pdf_id", "page", "line_no", "token", "kind", "line", "half", "rest"])

    parsed = cut(beside.mapInPandas(lines, "pdf_id long, page int, line_no int, token int, kind string, line string, half string, rest string"))
    nexts = parsed.where("kind = 'head'").select("pdf_id", (F.col("page") - 1).alias("page"), F.col("rest").alias("over"), F.col("line_no").alias("over_line"))
    halves = parsed.where("kind = 'half'").drop("line", "kind").join(nexts, ["pdf_id", "page"], "left")
    halves = halves.withColumn("over_line", F.when(F.col("rest").isNull(), F.col("over_line"))).withColumn("rest", F.coalesce("rest", "over")).where(F.col("rest").isNotNull())
    a = F.lower(F.regexp_replace("half", r"^[^\p{L}\p{N}]+", ""))
    b = F.lower(F.regexp_replace("rest", r"[^\p{L}\p{N}]+$", ""))
    upper = F.substring("rest", 1, 1) != F.lower(F.substring("rest", 1, 1))
    tail = F.when(F.col("over_line").isNotNull(), F.regexp_extract("rest", r"[^\p{L}\p{N}]*$", 0))
    halves = halves.select("pdf_id", "page", "line_no", "token", "over_line", tail.alias("tail"), F.concat(a, b).alias("solid"), F.concat(a, F.lit("-"), b).alias("hyphened"), (upper | F.col("rest").rlike(r"^\d")).alias("upper"))
    halves = cut(halves)

    counts = cut(word_counts(pages, "text"))
    forms = halves.select(F.explode(F.array("solid", "hyphened")).alias("word")).distinct()
    fixes = cut(corrections(counts, forms))
    joined = halves
    for form in ("solid", "hyphened"):
        joined = joined.join(counts.select(F.col("word").alias(form), F.col("n").alias(f"n_{form}")), form, "left")
        joined = joined.join(fixes.select(F.col("word").alias(form), F.col("fixed").alias(f"f_{form}")), form, "left")
    ns, nh = F.coalesce("n_solid", F.lit(0)), F.coalesce("n_hyphened", F.lit(0))
    word = (
        F.when((ns > 0) & (ns >= nh) & ~(F.col("f_solid").isNotNull()), F.col("solid"))
        .when((nh > 0) & F.col("f_hyphened").isNull(), F.col("hyphened"))
        .otherwise(F.coalesce("f_solid", "f_hyphened", F.when(F.col("upper"), F.col("hyphened")).otherwise(F.col("solid"))))
    )
    joins = joined.select("pdf_id", "page", "line_no", "token", F.lit("join").alias("kind"), word.alias("word"), "tail")
    tails = halves.where("over_line is not null").select("pdf_id", (F.col("page") + 1).alias("page"), F.col("over_line").alias("line_no"), F.lit(0).alias("token"), F.lit("tail").alias("kind"), F.lit("").alias("word"), "tail")

    at = F.posexplode(F.split("line", " ")).alias("p", "t")
    tokens = parsed.where("kind = 'line'").select("pdf_id", "page", "line_no", "token", at)
    tokens = tokens.select("pdf_id", "page", "line_no", (F.col("token") + F.col("p")).alias("token"), "t")
    bad = fixes.join(counts, "word", "left_semi")
    pieces = tokens.groupBy("t").agg(F.lit(1)).select("t", _core(F.col("t")).alias("word"))  # each way of writing is looked at once
    bad = _maybe_broadcast(cut(pieces.join(bad, "word").select("t", "fixed")))
    none = F.lit(None).cast("string").alias("tail")
    chars = tokens.join(bad, "t").select("pdf_id", "page", "line_no", "token", F.lit("char").alias("kind"), F.col("fixed").alias("word"), none)
    chars = chars.join(tails.select("pdf_id", "page", "line_no", "token"), ["pdf_id", "page", "line_no", "token"], "left_anti")  # half a word is no misread word
    drops = parsed.where("kind = 'drop'").select("pdf_id", "page", "line_no", "token", "kind", F.lit("").alias("word"), none)
    return drops.unionByName(joins).unionByName(tails).unionByName(chars)


def _cased(word: str, like: str) -> str:
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:] if like[:1].isupper() else word


def repair_text(text: str, marks: list[tuple[int, int, str, str, str | None]]) -> str:
    """The page as paragraphs: marked lines dropped, divided words whole, misread words replaced, lines of a paragraph on one line.

    ``marks`` are (line, token, kind, word, tail) of :func:`repair_marks`, any number of them on a line.
    """
    at: dict[int, dict[int, tuple[str, str, str | None]]] = {}
    gone = set()
    for n, token, kind, word, tail in marks:
        if kind == "drop":
            gone.add(n)
        else:
            at.setdefault(n, {})[token] = (kind, word, tail)
    paras: list[list[str]] = [[]]
    carry = False
    for n, line in enumerate(text.split("\n"), 1):
        if n in gone:
            continue
        words = line.split()
        if not words:
            if not carry and paras[-1]:
                paras.append([])
            continue
        out = []
        if carry:  # the second half; what follows it stays
            paras[-1][-1] += _TAIL.search(words[0])[0]
            words[0] = ""
        carry = False
        for i, w in enumerate(words):
            kind, new, tail = at.get(n, {}).get(i, ("", "", None))
            core = _CORE.sub("", w)
            if kind == "char" and core:
                out.append(w.replace(core, _cased(new, core), 1))
            elif kind == "join":
                out.append(_HEAD.search(w)[0] + _cased(new, core) + (tail or ""))
                carry = tail is None
            elif kind != "tail" and w:
                out.append(w)
        paras[-1] += out
    return "\n\n".join(" ".join(p) for p in paras if p)


def repaired_pages(df: DataFrame) -> DataFrame:
    """``pdf_id, page, text`` of every page: scanned ones repaired into paragraphs, others as they are.

    A word divided over two pages is whole on the first one and gone from the second.  See :func:`repair_marks`
    for which rows count; marks are gathered per page, so their number is bounded by the page.
    """
    marks = repair_marks(df).groupBy("pdf_id", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "token", "kind", "word", "tail"))).alias("m"))
    pages = df.where(F.col("pdf_id").isNotNull() & F.col("page").isNotNull() & (F.col("text") != "")).select(F.col("pdf_id").cast("long").alias("pdf_id"), F.col("page").cast("int").alias("page"), "text")
    pages = pages.groupBy("pdf_id", "page").agg(F.min("text").alias("text"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [repair_text(t, [(x["line_no"], x["token"], x["kind"], x["word"], x["tail"]) for x in m]) for t, m in zip(b["text"].tolist(), b["m"].tolist(), strict=True)]
            yield b[["pdf_id", "page", "text"]]

    met = pages.join(marks, ["pdf_id", "page"], "left")
    done = met.where("m is not null").mapInPandas(fix, "pdf_id long, page int, text string")
    return met.where("m is null").select("pdf_id", "page", "text").unionByName(done)
