"""One canonical form for texts that look the same.

Most text is already canonical, and the quick-check properties of Unicode normalisation say so
without normalising: a document without any unstable character never leaves the JVM.  In the others
only the unstable segments are rewritten, each with the boundary context it may combine with (the
character before it and the marks after it), and spliced back between the unchanged stretches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.session import cut

# Letters of other scripts drawn like a Latin letter, source letters then their twins.
TWINS = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХЬаеѕіјорсухԁԛԝһӏ", "ABESIJKMHOPCTYXbaesijopcyxdqwhl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινϲϳ", "ABEZHIKMNOPTYXoivcj"),
    "Armenian": ("ՕՍՏԼօոսհ", "OUSLonuh"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHGZSVLCPKB"),
}
_LONE = {"Ь": None, "Υ": "Y", "У": "Y"}  # drawn alike but only in some founts: Ь is not folded

#: Characters without any ink: the soft hyphen and what Unicode lists as Default_Ignorable_Code_Point (joiners, direction
#: marks, fillers, variation selectors, tags); the property is not in ``unicodedata``.
INVISIBLE = "".join(map(chr, [
    0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F),
    *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF0, 0xFFF9),
    *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000),
]))
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
HYPHENS = "".join(map(chr, [0x2010, 0x2011, 0xFE63, 0xFF0D]))


# ASCII and the composed Latin letters below the first ligature (U+0132) are settled, but for the soft hyphen and the micro sign.
UNSETTLED = r"[^\x00-\x7F\u00A1-\u00AC\u00AE-\u00B4\u00B6-\u0131]"


@cache
def tables() -> tuple[dict[int, str | None], str]:
    """The character map, and the class of characters that are not canonical by themselves (as inside ``[]``)."""
    one: dict[int, str | None] = dict.fromkeys(map(ord, INVISIBLE))
    one |= dict.fromkeys(map(ord, SPACES), " ") | dict.fromkeys(map(ord, HYPHENS), "-")
    for src, dst in TWINS.values():
        one |= {ord(a): b for a, b in zip(src, dst, strict=True) if _LONE.get(a, b)}
    for c in range(0x80, 0x10000):
        tag, *parts = unicodedata.decomposition(chr(c)).split() or [""]
        if tag in ("<wide>", "<narrow>"):
            one.setdefault(c, "".join(chr(int(x, 16)) for x in parts))
        elif tag == "<compat>" and (c < 0x250 or 0xFB00 <= c <= 0xFB17) and len(parts) > 1 and all(unicodedata.category(chr(int(x, 16)))[0] == "L" and int(x, 16) != 0x2BC for x in parts):
            one.setdefault(c, unicodedata.normalize("NFKC", chr(c)))  # ligatures of Latin and Armenian letters
        elif c == 0xB5 or 0x2160 <= c < 0x2180 and tag == "<compat>":
            one.setdefault(c, unicodedata.normalize("NFKC", chr(c)))  # micro sign, Roman numerals
    for c in [*range(0x2100, 0x2150), *range(0x1D400, 0x1D800)]:
        if unicodedata.decomposition(chr(c)).startswith("<font>") and unicodedata.category(chr(c))[0] == "L":
            one.setdefault(c, unicodedata.normalize("NFKC", chr(c)))  # letters of mathematical founts
    for c, t in one.items():  # a plain letter may itself be drawn like a Latin one
        if t and len(t) == 1 and one.get(ord(t)):
            one[c] = one[ord(t)]
    folded = {}
    for c in range(0xA0, 0x2000):  # composed letters whose base has a twin
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and ord(d[0]) in one:
            folded[c] = unicodedata.normalize("NFC", "".join(one.get(ord(x), x) or "" for x in d))
    one |= folded
    no, maybe = set(), set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # quick check: no, and maybe (Hangul vowels and finals)
    for c in range(0x80, 0x30000):
        ch = chr(c)
        if unicodedata.combining(ch):
            maybe.add(c)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<":
            if unicodedata.normalize("NFC", ch) != ch:
                no.add(c)
            elif " " in d:
                maybe.add(int(d.split()[1], 16))
    unstable = sorted({*one, *no, *maybe} - set(range(0x80)))
    return one, "".join(_ranges(unstable))


def _ranges(codes: list[int]) -> Iterator[str]:
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        yield f"\\U{codes[i]:08x}" + (f"-\\U{codes[j]:08x}" if j > i else "")
        i = j + 1


@cache
def unstable() -> frozenset[str]:
    """The characters of the class of :func:`tables`: those that may change, by themselves or with their neighbours."""
    return frozenset(re.findall(f"[{tables()[1]}]", "".join(map(chr, range(0x80, 0x110000)))))


#: A stretch beyond ASCII with the character before it, which it may combine with; no mark reaches further.
_STRETCH = re.compile(r"[\x00-\x7F]?[^\x00-\x7F]+")


def _normal(segment: str) -> str:
    if unstable().isdisjoint(segment):
        return segment
    one = tables()[0]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", segment.translate(one)).translate(one))


_kept = lru_cache(maxsize=50_000)(_normal)


def canonical(text: str) -> str:
    """The canonical form of one text; see :func:`canonical_text`."""
    if text.isascii() or unstable().isdisjoint(text):
        return text
    return _STRETCH.sub(lambda m: _kept(m[0]) if len(m[0]) < 64 else _normal(m[0]), text)


@F.pandas_udf(T.StringType())
def _canonical_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else canonical(t))


def is_unstable(text: Column) -> Column:
    """Quick check in the JVM: whether any character may change under :func:`canonical_text`.

    ASCII (as many bytes as characters) and the composed Latin letters up to U+0131 are settled by their normalisation
    properties; a text with any other character is looked at closer by the exact class of :func:`tables`.
    """
    return (F.octet_length(text) > F.char_length(text)) & text.rlike(UNSETTLED)


def canonical_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the form in which texts that look the same are equal and no others.

    Invisible characters vanish; every kind of space is a space and every kind of hyphen a hyphen, their
    number kept; full-width letters, letters of mathematical founts, Roman numerals, ligatures and letters of other scripts
    drawn like Latin ones are the plain letters; accents are composed.  Other accents, digits, words and letter case stay apart.
    Null stays null and an empty text empty.  Only the texts of unstable documents are sent to Python.
    """
    moved = df.withColumn(out, _canonical_batch(F.when(is_unstable(F.col(text)), F.col(text))))
    return moved.withColumn(out, F.coalesce(F.col(out), F.col(text)))


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``*key, form, string``: of each document with a visible text the fingerprints (128 bits) of its canonical form and of the text itself."""
    rows = df.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    form = rows.withColumn("_m", _canonical_batch(F.when(is_unstable(F.col("_t")), F.col("_t"))))
    s = F.unhex(F.md5("_t"))
    f = F.when(F.col("_m").isNull(), s).otherwise(F.unhex(F.md5("_m")))
    out = form.select(F.col("_k").alias(key), F.when(F.coalesce(F.col("_m") == "", F.lit(False)), None).otherwise(f).alias("form"), s.alias("string"))
    return cut(out).where("form is not null")  # 40 bytes a row; feeds several branches


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``*key, class_id, n_strings, n_documents``: the documents of every form that two different strings have.

    ``class_id`` is the smallest key of the form; a document is linked to all of its class but those of its own string.
    Copies are not expanded into pairs, so a form with a third of all rows is as many rows.
    """
    c = look_classes(df, key, text)
    per = c.groupBy("form", "string").agg(F.min(key).alias("_k"), F.count(F.lit(1)).alias("_n"))
    per = per.groupBy("form").agg(F.min("_k").alias("class_id"), F.count(F.lit(1)).alias("n_strings"), F.sum("_n").alias("n_documents")).where("n_strings > 1")
    return c.join(per, "form").select(key, "class_id", "n_strings", "n_documents").distinct()


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``doc_a < doc_b`` whose non-empty texts look the same but are different strings.

    Different strings of one form are paired first, one row a string whatever its copies; then each pair of strings is
    expanded by the documents that hold them, so exact copies never meet each other.  The result has as many rows as there are
    such pairs of documents; :func:`lookalike_classes` states the same links in one row a document.
    Null or empty texts and texts without any visible character, and rows without a key, have no pair.
    """
    c = look_classes(df, key, text).select(F.col(key).alias("_k"), "form", "string")
    strings = c.groupBy("form", "string").agg(F.lit(1))
    several = strings.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    some = cut(c.join(several, "form", "left_semi").distinct())
    s = some.select("form", "string").distinct()
    links = s.select("form", F.col("string").alias("_sa")).join(s.select("form", F.col("string").alias("_sb")), "form").where("_sa < _sb").select("_sa", "_sb")
    a, b = (some.select(F.col("string").alias(s), F.col("_k").alias(k)) for s, k in (("_sa", "_a"), ("_sb", "_b")))
    met = links.join(a, "_sa").join(b, "_sb").where("_a <> _b")
    return met.select(F.least("_a", "_b").alias("doc_a"), F.greatest("_a", "_b").alias("doc_b")).distinct()
