"""Passages of evaluation items found in documents.

The q-gram lemma: a stretch of ``m`` characters that matches with at most ``k`` edits shares at least
``m + 1 - q (k + 1)`` q-grams with its source, all of them near one diagonal.  The items are few and of
fixed number, so their q-grams are sent to every task; documents are read once, never shuffled and
never cut.  Per document all q-grams are looked up at once, hits are counted per item in overlapping
diagonal bands, and only bands that reach the bound are aligned, inside the band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.lookalike import canonical

STEP, LONGEST = 8, 24  # bytes of a machine word, and of the longest q-gram
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 22)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&(?:nbsp|amp|lt|gt|quot|#\d+);")


#: ASCII letters in lower case and digits as they are, everything else blank.
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def word_bytes(text: str) -> bytes:
    """The words of :func:`words_of`, a blank before, between and behind them."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        words = text.encode().translate(_ASCII).split()
        return b" " + b" ".join(words) + b" " if words else b"  "
    text = canonical(text)
    text = _TAG.sub(" ", text) if "<" in text or "&" in text else text  # marks in other widths
    if text.isascii():
        return b" " + b" ".join(text.encode().translate(_ASCII).split()) + b" "
    return f" {' '.join(_WORD.findall(text.lower().replace(chr(0x307), '')))} ".encode()


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-case, of the canonical form, without tags and entities."""
    return word_bytes(text).decode().split()


def _grams(data: bytes, q: int) -> np.ndarray:
    """The q-gram (``q`` a multiple of 8) at every byte offset, mixed into one 64-bit number."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    n = len(b) - STEP + 1
    words = np.empty(n, np.uint64)
    for r in range(STEP):  # one strided view for each byte phase
        v = b[r : r + (len(b) - r) // STEP * STEP].view(np.uint64)
        words[r::STEP] = v[: len(words[r::STEP])]
    g = words[: len(b) - q + 1] * _MIX
    for j in range(STEP, q, STEP):
        g = (g ^ words[j : j + len(g)]) * _MIX
    return g ^ (g >> np.uint64(29))


@dataclass
class Index:
    """Q-grams of all items: ``gram[i]`` occurs at ``pos[i]`` of item ``item[i]``; sorted by gram."""

    gram: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    texts: list[bytes]
    ids: list[int]
    bits: np.ndarray
    n_words: int
    bound: int
    band: int
    q: int


def build_index(items: list[tuple[int, str]], n_words: int, edits: int) -> Index:
    """The longest q for which the lemma still asks for some shared q-grams is used; passages too short for any raise ``ValueError``."""
    texts, ids, least = [], [], 10**9
    for i, passage in items:
        w = words_of(passage or "")
        if i is None or len(w) < n_words:
            continue
        least = min(least, *(len(" ".join(w[j : j + n_words]).encode()) + 2 for j in range(len(w) - n_words + 1)))
        texts.append((" " + " ".join(w) + " ").encode())
        ids.append(i)
    least -= 2 if edits else 0  # with edits the blanks on either side need not match
    q = next((q for q in range(LONGEST, STEP, -STEP) if least + 1 - q * (edits + 1) >= STEP), STEP)
    bound = least + 1 - q * (edits + 1)
    if bound < 1:
        raise ValueError(f"{n_words} words of {least} bytes are too few for {edits} edits: some matches would share no {q}-gram")
    grams = [_grams(t, q) for t in texts] or [np.empty(0, np.uint64)]
    g = np.concatenate(grams)
    order = np.argsort(g, kind="stable")
    item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(x) for x in grams])
    pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in grams])
    g = g[order]
    bits = np.zeros(1 << 22, bool)
    bits[g >> _SHIFT] = True
    return Index(g, item[order], pos[order], texts, ids, bits, n_words, bound, max(16, 2 * edits), q)


def _aligned(doc: bytes, item: bytes, lo: int, hi: int, diagonals: range, n_words: int, edits: int, q: int) -> bool:
    """Whether the band holds ``n_words`` successive words of the item, aligned diagonal by diagonal.

    Without edits an alignment in a band is a run of equal bytes on one of its diagonals.  With edits a
    window of words may differ by at most ``edits`` single characters, checked by a banded table.
    """
    d = np.frombuffer(doc, np.uint8)
    t = np.frombuffer(item, np.uint8)
    for k in diagonals:
        a, b = max(lo, 0, k), min(hi, len(d), len(t) + k)
        if b - a < n_words * 2:
            continue
        diff = np.flatnonzero(d[a:b] != t[a - k : b - k])
        edge = np.concatenate(([-1], diff, [b - a]))
        for i in np.flatnonzero(np.diff(edge) > n_words * 2):
            run = doc[a + edge[i] + 1 : a + edge[i + 1]]
            if run.count(b" ") > n_words:  # n words with a blank on either side
                return True
    if edits:
        starts = [0, *(i + 1 for i, c in enumerate(item[:-1]) if c == 32 and i)]  # the item begins and ends with a blank
        words = [i if item[i] != 32 else i + 1 for i in starts]
        around = q * (edits + 1) + edits  # an edit within the first or last q bytes spoils all q-grams up to it
        for j in range(len(words) - n_words + 1):
            p, z = words[j], words[j + n_words] - 1 if j + n_words < len(words) else len(item) - 1
            # only what the band's diagonals can pair with this window, within the region of the hits
            a, b = max(0, lo - around, p + diagonals.start - edits), min(hi + around, z + diagonals.stop + edits)
            if b > a and _within(item[p:z], doc[a:b], edits):
                return True
    return False


def _within(p: bytes, t: bytes, k: int) -> bool:
    """Whether ``p`` occurs in ``t`` with at most ``k`` edits; a column of the table is bits of whole numbers."""
    at: dict[int, int] = {}
    for i, c in enumerate(p):
        at[c] = at.get(c, 0) | 1 << i
    full, top, d = (1 << len(p)) - 1, 1 << len(p) - 1, len(p)
    up, down = full, 0
    for c in t:
        same = at.get(c, 0)
        level = same | down
        across = ((same & up) + up ^ up) | same
        more, less = down | full & ~(across | up), up & across
        d += 1 if more & top else -1 if less & top else 0
        if d <= k:
            return True
        more = more << 1 & full
        up, down = (less << 1 | ~(level | more)) & full, more & level
    return False


def leaks(text: str, ix: Index, edits: int = 0) -> list[int]:
    """Positions in ``ix.ids`` of the items that ``text`` contains."""
    doc = word_bytes(text)
    g = _grams(doc, ix.q)
    if not len(g) or not ix.ids:
        return []
    at = np.flatnonzero(ix.bits[g >> _SHIFT])
    if len(at) < ix.bound:
        return []
    lo, hi = np.searchsorted(ix.gram, g[at], "left"), np.searchsorted(ix.gram, g[at], "right")
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    if len(at) < ix.bound:
        return []
    src = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    where, item = np.repeat(at, n), ix.item[src]
    diag = where - ix.pos[src] + (1 << 20)
    out = set()
    width = ix.band
    for shift in (0, width // 2):  # two rows of bands, each overlapping the other by half
        cell = item.astype(np.int64) << 40 | (diag + shift) // width
        order = np.argsort(cell, kind="stable")
        c = cell[order]
        begin = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        end = np.concatenate((begin[1:], [len(c)]))
        for b, e in zip(begin[end - begin >= ix.bound], end[end - begin >= ix.bound], strict=True):
            it = int(c[b] >> 40)
            if it in out:
                continue
            first = int((c[b] & ((1 << 40) - 1)) * width - shift - (1 << 20))
            w = where[order[b:e]]
            if _aligned(doc, ix.texts[it], int(w.min()), int(w.max()) + ix.q, range(first, first + width), ix.n_words, edits, ix.q):
                out.add(it)
    return sorted(out)


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, *, n_words: int = 12, edits: int = 0, max_items: int = 20_000) -> DataFrame:
    """Distinct ``doc_id, item_id``: each document with ``n_words`` successive words of an item's passage.

    Words are runs of letters and digits of the canonical form; case, punctuation, markup and line
    breaks do not matter.  ``edits`` allows single-byte edits within those words; passages too short for that many raise
    ``ValueError``.  The index of the items is held by every task, so the items are taken in blocks of about ``max_items``, and the
    documents are read once a block.  Null texts, ids and passages, and passages shorter than ``n_words``,
    have no row; repeated rows count once; texts of any length are read whole.
    """
    spark = docs.sparkSession
    rows = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p"))
    blocks = max(1, -(-rows.count() // max_items))
    use = docs.where(F.col(doc_id).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    out = None
    for k in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == k).distinct()
        shared = spark.sparkContext.broadcast(build_index(sorted(map(tuple, some.collect())), n_words, edits))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for b in batches:
                found = [(d, index.ids[i]) for d, t in zip(b["d"].tolist(), b["t"].tolist(), strict=True) for i in leaks(t, index, edits)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id"]).astype("int64")

        part = use.mapInPandas(scan, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
