import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdoc.llm.leakage import _within, build_index, leaked_items, leaks, words_of
from loomdoc.llm.lookalike import canonical, canonical_text, is_unstable, lookalike_classes, lookalike_pairs
from loomdoc.llm.newmail import NEAR, PARTS, inherited, near_matches, new_lines, partition_pairs, read_mail, simhashes
from loomdoc.llm.packing import boundaries, layout, pack
from loomdoc.llm.turns import clean_segment, drop_rolling, segments_clean, speaker_of, speaker_turns

SAME = [("ﬁnal", "final"), ("Ｆｕｌｌ", "Full"), ("café", "café"), ("a b", "a b"), ("a​b﻿", "ab"), ("ra­re", "rare"), ("w‑x", "w-x"), ("ехаmрlе", "example"), ("ё", "ë"), ("ё", "ë"), ("Ηello", "Hello"), ("a　b c", "a b c")]
APART = [("café", "cafe"), ("The", "the"), ("a1", "a2"), ("a b", "ab"), ("a  b", "a b"), ("l", "I"), ("й", "и"), ("naïve", "naive")]


def test_canonical():
    for a, b in SAME:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in APART:
        assert canonical(a) != canonical(b), (a, b)


def test_widths_ligatures_and_invisible_by_unicode(spark):
    """All widths, Latin and Armenian ligatures and ignorable characters, also where a text has no other character of that kind."""
    same = [("ｶﾞｷ", "ガキ"), ("ﾡￂ", "ㄱㅏ"), ("￨￩￣", "│←¯"), ("ĳs Ĳ", "ijs IJ"), ("\u01c6\u01c5 \u01f3 \u01c8", "d\u017eD\u017e dz Lj"), ("ﬓﬗ", "մնմխ"), ("ﬁ", "fi"), ("Ａ", "A")]
    same += [(f"a{chr(c)}b", "ab") for c in (0xE0100, 0xE01EF, 0x180B, 0x180D, 0x180F, 0x3164, 0xFFA0, 0xE0041, 0x2065)]
    for a, b in same:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in (("ŉ", "n"), ("ſ", "s"), ("ŀ", "l"), ("ㄱ", "ᄀ")):
        assert canonical(a) != canonical(b), (a, b)
    df = spark.createDataFrame([(i * 2 + j, t) for i, ab in enumerate(same) for j, t in enumerate(f"{i} {x}" for x in ab)], "k long, t string")
    assert {(r.doc_a, r.doc_b) for r in lookalike_pairs(df, "k", "t").collect()} == {(i * 2, i * 2 + 1) for i in range(len(same))}
    old = {*range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7)}
    assert all(ord(x) != c for c in old for x in canonical(chr(c)))



@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_canonical_is_stable_and_ignores_composition(s):
    c = canonical(s)
    assert canonical(c) == c
    assert canonical(unicodedata.normalize("NFD", s)) == canonical(unicodedata.normalize("NFC", s))


def test_pairs(spark):
    rows = [(i, t) for i, t in enumerate(x for p in SAME[:6] for x in p)] + [(100, "ﬁnal"), (101, None), (102, ""), (103, "​"), (104, ""), (None, "final"), (0, "ﬁnal"), (105, "x" * 200_000), (106, "x" * 200_000 + "​")]
    df = spark.createDataFrame(rows, "doc_a long, doc_b string")  # names clash with the result's on purpose
    texts = {k: t for k, t in rows if k is not None and t}
    want = {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and canonical(texts[a]) == canonical(texts[b]) != ""}
    assert {tuple(r) for r in lookalike_pairs(df, "doc_a", "doc_b").collect()} == want
    assert lookalike_pairs(df.limit(0), "doc_a", "doc_b").count() == 0
    linked = {x for p in want for x in p}
    got = {r.doc_a: (r.class_id, r.n_strings) for r in lookalike_classes(df, "doc_a", "doc_b").collect()}
    assert set(got) == linked and all(got[a][0] == got[b][0] <= a and got[a][1] >= 2 for a, b in want)
    assert lookalike_classes(df.limit(0), "doc_a", "doc_b").count() == 0
    out = canonical_text(df, "doc_b", "c")
    assert out.count() == len(rows) and out.where(~is_unstable(F.col("doc_b")) & (F.col("c") != F.col("doc_b"))).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["w%03d" % i for i in range(40)] + ["naïve", "straße"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 15, 40])))) for i in range(30)] + [(98, None), (99, "too short")]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.7:
            src = (rng.choice(items[:30])[1]).split()
            n = rng.choice([11, 12, 13, 30])
            a = rng.randrange(max(1, len(src) - n))
            at = rng.randrange(len(w) + 1)
            w[at:at] = src[a : a + n]
        sep = rng.choice([" ", "\n", ", ", " **", " "])
        docs.append((d, sep.join(x.upper() if rng.random() < 0.1 else x for x in w)))
    docs += [(500, None), (501, ""), (502, items[2][1]), (502, items[2][1])]
    runs = {}
    for i, p in items:
        w = words_of(p or "")
        for j in range(len(w) - 11):
            runs.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [words_of(t or "")] for j in range(len(w) - 11) for i in runs.get(tuple(w[j : j + 12]), ())}
    got = leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, p string"), "i", "p")
    assert {tuple(r) for r in got.collect()} == want and want
    blocks = leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, p string"), "i", "p", max_items=12)
    assert {tuple(r) for r in blocks.collect()} == want


def test_leaks_with_edits():
    text = "the quick brown fox jumps over the lazy dog near the old river bank today"
    ix = build_index([(1, text)], 12, 1)
    assert leaks(text.replace("jumps", "jumqs"), ix, 1) == [0]
    assert leaks("nothing of that kind stands in here " * 5, ix, 1) == []


def test_leaks_with_edits_anywhere():
    """An edit at any byte of the passage, two at once, against a search of the whole text."""
    w = "the quick brown fox jumps over the lazy dog near our river".split()
    item, before, after = " ".join(w), "some words stand here first and ", " then come others that say nothing of it"
    rng = random.Random(5)

    def edit(t, i, kind):
        return t[:i] + {"s": "z" if t[i] != "z" else "y", "d": "", "i": "z" + t[i]}[kind] + t[i + 1 :]

    once = [edit(item, i, k) for i in range(len(item)) for k in "sdi"]
    twice = [edit(t, rng.randrange(len(t)), rng.choice("sdi")) for t in rng.sample(once, 80)] + [edit(edit(item, 1, "s"), 3, "s"), edit(edit(item, len(item) - 1, "s"), len(item) - 3, "s")]
    for edits in (1, 2):
        ix = build_index([(7, item)], 12, edits)
        for t in [*once, *twice]:
            doc = before + t + after
            want = [0] if _within(item.encode(), doc.encode(), edits) else []
            assert leaks(doc, ix, edits) == want, (edits, t)
    with pytest.raises(ValueError):
        build_index([(7, "a b c d e f g h i j k l")], 12, 2)


MAIL = """Hi Bo,

New text one.
More of it.

> select a from b limit 3

-- 
Al Long
Tel. +1

PS: one more thing
still the postscript.

This message and any attachment are confidential and
intended only for the addressee.

On Mon, 1 Jan 2024 at 10:00, Bo <bo@x.example> wrote:
> Hi Al,
> old text here
lost tail
> and more

Below the quote.

Sent from my phone
"""


def test_read_mail():
    got = [no for no, lab, _ in read_mail(MAIL) if lab in ("new", "maybe")]
    lines = MAIL.split("\n")
    want = ["Hi Bo,", "New text one.", "More of it.", "> select a from b limit 3", "PS: one more thing", "still the postscript.", "Below the quote."]
    assert [lines[n - 1] for n in got] == want
    top = "New.\n\nVon: Al\nGesendet: heute\nAn: Bo\nBetreff: x\n\nOld words.\n"
    assert [no for no, lab, _ in read_mail(top) if lab == "new"] == [1]
    assert [no for no, lab, _ in read_mail("From: and To: are missing, see below.\n") if lab == "new"] == [1]


def test_new_lines(spark):
    old = "Dear Al,\n\nThe first sentence of the older mail has many words in it. A second sentence follows with other words.\n\nThanks,\nBo"
    rows = [
        (1, "<a@x>", None, "bo@x", old), (2, " <b@x>", "<A@x> ", "al@x", old + "\n\nHello Bo,\n\nThis reply is entirely new and was never seen.\n"),
        (3, "<c@x>", "<gone@x>", "al@x", "Only this line."), (4, None, None, None, None), (5, "<a@x>", None, "bo@x", ""), (None, "<z@x>", None, "bo@x", "x"), (6, "<d@x>", None, "q@x", "word " * 50_000),
    ]
    df = spark.createDataFrame(rows, "email_id long, message_id string, in_reply_to string, msg_from string, body string").withColumn("lines", F.lit(1))
    got = {}
    for r in new_lines(df).collect():
        got.setdefault(r.email_id, []).append(r.line_no)
    assert sorted(got) == [1, 2, 3, 6] and sorted(got[1]) == [1, 3] and sorted(got[2]) == [8, 10] and got[3] == [1]
    assert new_lines(df.limit(0)).count() == 0


def test_simhash_near_matches():
    a = "the portable transcript prints the registered entry quietly near the old gateway"
    assert near_matches([[a.replace("quietly", "quietlly"), "something else entirely with other words in it"], [a]], [[a], []]) == [{0}, set()]
    assert simhashes([a, a.upper(), "", "ab"]).tolist() == [simhashes([a])[0], simhashes([a])[0], 0, 0]
    long = " ".join(f"w{i}" for i in range(40_000))  # one sentence of as many different words
    assert near_matches([[long + " x"]], [[long]]) == [{0}]
    assert near_matches([["version 12 of the plan is ready for all"]], [["version 13 of the plan is ready for all"]]) == [set()]  # another figure


def test_edit_distance():
    from loomdoc.llm.newmail import edit_distance

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                prev, row[j] = row[j], min(prev + (c != d), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(2))
        want = table(a, b)
        assert edit_distance(a, b, 40) == want
        got = edit_distance(a, b, 5)
        assert got == want or got > 5 and want > 5


def test_partition_tables_miss_nothing():
    """All pairs of one group within the bound, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    old = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 20, 300)], np.uint64)
    mine, of = old ^ flips, rng.integers(0, 5, 300)
    want = {(i, j) for i in range(300) for j in range(300) if of[i] == of[j] and int(mine[i] ^ old[j]).bit_count() <= NEAR}
    assert sum(PARTS) == 64 and {tuple(p) for p in partition_pairs(mine, of, old, of).tolist()} == want and len(want) > 100


def test_copy_without_four_equal_successive_words():
    old = "Dear Al,\n\nThe careful printer of the northern office delivers another parcel before the summer holidays begin.\n"
    near = "The careful printre of the northern offcie delivers another parcl before the sumer holidays begin."
    words = lambda t: {tuple(t.lower().split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    assert not words(near) & words(old)
    assert inherited([near + "\n\nThis line is new and says something else."], [old]) == [{1}]


def test_every_body_under_an_id_is_the_answered_mail(spark):
    one, two = "The first body tells of the harbour and of its many cranes.", "Another body tells of the mountain and of its deep snow."
    rows = [(1, "<a@x>", None, "bo@x", one), (2, "<A@X>", None, "bo@x", two), (3, "<c@x>", "<a@x>", "al@x", f"{one}\n\n{two}\n\nOnly this was written for the answer.")]
    df = spark.createDataFrame(rows, "email_id long, message_id string, in_reply_to string, msg_from string, body string")
    assert [(r.email_id, r.line_no) for r in new_lines(df).where("email_id = 3").collect()] == [(3, 5)]


CAST = "0=Bendik Brasquel\n1=Katya Keldermann\n2=Amaris Bexley-Roe"


def test_speakers_and_segments():
    for label, no in [("SPEAKER_01", 1), ("spk-2:", 2), (" S0 ", 0), ("#1", 1), ("KATYA", 1), ("Keldermann, Katya", 1), ("B. Brasquel", 0), ("Bendik B.:", 0), ("Dr. Amaris Bexley-Roe", 2), ("Katya (host)", 1), ("Bendik Brasquel [remote]", 0), ("Nobody", None), ("7", None), (None, None)]:
        assert speaker_of(label, CAST) == no, label
    who, words = clean_segment(None, "Katya: [00:00:01] uh, We start at 13:45, (door slams) (the spoken aside) [MUSIC] ♪ - mm-hmm ER 2 er-team", CAST)
    assert who == 1 and words == ["We", "start", "at", "13:45,", "(the", "spoken", "aside)", "ER", "2", "er-team"]


def test_turns(spark):
    rows = [
        (5, 1, 0.0, 1.0, "SPEAKER_00", "The first words er of it"), (5, 1, 0.0, 1.0, "SPEAKER_00", "The first words er of it"), (3, 1, 2.0, None, "BENDIK", "and the rest"), (9, 1, 3.0, 4.0, "1", "[applause]"),
        (8, 1, 700.0, 701.0, "0", "later too"), (1, 1, 701.0, 702.0, None, "Katya: um yes"), (2, 1, 5.0, 6.0, "0", None), (4, 2, 0.0, 1.0, "Er", "er sagt das und der rest"),
        (6, 2, float("nan"), 1.0, "0", "x"), (7, None, 0.0, 1.0, "0", "x"),
    ]
    df = spark.createDataFrame(rows, "seg_id long, clip_id long, start_s double, end_s double, speaker string, text string").withColumn("cast", F.lit("x"))
    cast = spark.createDataFrame([(1, 0, "Bendik Brasquel"), (1, 1, "Katya Keldermann"), (2, 0, "Al Bo")], "clip_id long, speaker_no int, display_name string")
    got = sorted((r.clip_id, r.first_seg, r.speaker_no, r.n_words) for r in speaker_turns(df, cast).where("clip_id = 1").collect())
    assert got == [(1, 1, 1, 1), (1, 5, 0, 10)]
    assert {r.n_words for r in segments_clean(df, cast).where("clip_id = 2").collect()} == {6}  # "er" is a word of German
    assert len(speaker_turns(df, cast, pause_s=60.0).where("clip_id = 1").collect()) == 3
    assert speaker_turns(df.limit(0), cast).count() == 0
    roll = spark.createDataFrame([(1, 1, 0.0, 2.0, 0, "a b c d", 4), (2, 1, 1.0, 3.0, 0, "b c d e", 4)], "clip_id long, seg_id long, start_s double, end_s double, speaker_no int, text string, n_words int").select("clip_id", "seg_id", "start_s", "end_s", "speaker_no", "text", "n_words")
    roll = roll.withColumn("seg_id", F.col("clip_id")).withColumn("clip_id", F.lit(1).cast("long"))
    for shard in (600.0, 0.5):
        assert [r.text for r in drop_rolling(roll, shard_s=shard).orderBy("start_s").collect()] == ["a b c d", "e"]
    # silences of half a second and one of a minute, over many shards: the long one splits the turn
    talk = [(i, 1, i * 1.5 + (60.0 if i >= 20 else 0.0), i * 1.5 + 1.0 + (60.0 if i >= 20 else 0.0), "0", f"word number {i} here") for i in range(40)]
    say = spark.createDataFrame(talk, df.drop("cast").schema)
    for shard in (600.0, 7.0):
        got = sorted((r.first_seg, r.n_words) for r in speaker_turns(say, cast, pauses=True, shard_s=shard).collect())
        assert got == [(0, 80), (20, 80)]
        assert [(r.first_seg, r.n_words) for r in speaker_turns(say, cast, shard_s=shard).collect()] == [(0, 160)]


def test_bucket_boundaries_are_optimal():
    import itertools

    import numpy as np

    rng = random.Random(5)
    for _ in range(20):
        counts = np.zeros(30, np.int64)
        for _ in range(8):
            counts[rng.randint(1, 29)] += rng.randint(1, 9)
        used = [int(i) for i in np.flatnonzero(counts)]
        pad = lambda bs: sum(int(counts[i]) * (min(b for b in bs if b >= i) - i) for i in used)
        for k in (1, 2, 3):
            best = min(pad((*c, used[-1])) for c in itertools.combinations(used[:-1], min(k, len(used)) - 1))
            assert pad(boundaries(counts, k)) == best


def test_layout_uses_every_text():
    bounds, counts = [100, 300, 1000, 2048], [50, 30, 7, 2]
    plan = layout(bounds, counts, 2048)
    for b, n in enumerate(counts):
        assert sum(t * f.get(b, 0) for t, f in plan) == n
    assert all(sum(bounds[b] * k for b, k in f.items()) <= 2048 for _, f in plan)


def test_pack_round_trip(spark):
    from loomdoc.llm.packing import token_count
    from loomdoc.llm.plans_text import VOCABULARY

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 5, 40, 90, 500])))) for i in range(120)] + [(500, None), (501, ""), (None, "x")]
    df = spark.createDataFrame(rows, "piece_no long, t string")
    out = pack(df.withColumnRenamed("piece_no", "k"), "k", "t", VOCABULARY, capacity=128, buckets=16, salts=4).collect()
    size: dict[int, int] = {}
    per: dict[int, list] = {}
    for r in out:
        size[r.container_id] = size.get(r.container_id, 0) + r.n_tokens
        per.setdefault(r.k, []).append((r.from_token, r.n_tokens))
    assert max(size.values()) <= 128
    for k, t in rows:
        if k is not None and t:
            n = token_count(t, VOCABULARY)
            spans = sorted(per[k])
            assert sum(b for _, b in spans) == n and [a for a, _ in spans] == [128 * i for i in range(len(spans))]
            assert len(spans) == 1 or n > 128
    assert set(per) == {k for k, t in rows if k is not None and t}
    from loomdoc.llm.packing import fill

    told = fill(spark.createDataFrame(out), 128).collect()
    assert sum(r.containers for r in told) == len(size) and sum(r.tokens for r in told) == sum(size.values()) and all(0 < r.share <= 1 for r in told)
    assert pack(df.limit(0).withColumnRenamed("piece_no", "k"), "k", "t", VOCABULARY).count() == 0
