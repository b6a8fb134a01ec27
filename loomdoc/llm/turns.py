"""Speech transcripts brought into clean, ordered speaker turns.

Segments are cleaned once and swept in order of time: what the head of a segment repeats of the one before it
(rolling captions) is removed by their suffix-prefix overlap, and turns are split at changes of speaker, and where asked
at pauses that are long for the clip.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.operators.sequence import merge_runs
from loomdoc.session import cut

# Noises of hesitation and listening. The first set is a word of none of the languages;
# the others are noises only in the language named.
NOISES = frozenset("uh uhm uhh umm erm ehm hm hmm hmmm mm mmm mhm mm-hm mm-hmm uh-huh uh-uh ähm äh öh öhm euh heu ähh эм ээ ммм".split())
NOISES_IN = {"en": frozenset("um er ah eh oh-oh".split()), "de": frozenset(["ah", "eh"]), "fr": frozenset(["hum", "ah", "eh", "bah"]), "es": frozenset(["eh", "em", "ah"])}
# Frequent words by which the language of a clip is told.
COMMON = {
    "en": frozenset("the of and that with is are when what for every has have before after".split()),
    "de": frozenset("der die das und nicht für wenn ohne seit laut am den von was weder noch auch nur".split()),
    "fr": frozenset("le la les et sans quand selon depuis des du ne ni un de à".split()),
    "es": frozenset("el los las sin cuando según desde del una que al por y".split()),
}
# What sounds are called in transcripts.
SOUNDS = frozenset(
    """music laughter laughs laughing applause clapping inaudible unintelligible crosstalk sigh sighs cough coughs coughing phone rings ringing door slams
    background noise noises silence pause static beep footsteps cheering sneezes sniffs chuckles musik lachen gelächter applaus unverständlich husten telefon klingelt
    musique rires rire applaudissements inaudible toux soupir bruit de fond música risas aplausos tos""".split()
)

_TIME = re.compile(r"[\[(<{]?\s*\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?\s*[\])>}]?(?:\s*-->(?:\s*\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?)?)?")
_MARKED = re.compile(r"\[[^\[\]]*\]|<[^<>]*>")
_MAYBE = re.compile(r"\(+([^()]*)\)+|\*([^*\n]{1,40})\*")
_TITLE = re.compile(r"^(?:dr|prof|mr|mrs|ms|herr|frau|mme|m|sr|sra)\.? (?=\w)")
_ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_NUMBER = re.compile(r"^(?:speaker|spk|sprecher|locuteur|hablante|s)?[ _#-]*0*(\d+)$")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_LABEL = re.compile(r"^\s*([^:\n]{1,60}?)\s*:(?=\s|$)")


def _plain(label: str) -> str:
    s = re.sub(r"\s+", " ", _ASIDE.sub(" ", label.replace("\xa0", " "))).strip().rstrip(":").strip().lower()
    return _TITLE.sub("", s)


@lru_cache(maxsize=20_000)
def _names(cast: str) -> dict[str, int]:
    """Every way of writing a cast member's name that means one of them only."""
    forms: dict[str, set[int]] = {}
    for line in cast.split("\n"):
        no, _, name = line.partition("=")
        if not no:
            continue
        n = _plain(name)
        w = n.split(" ")
        ways = {f"#{int(no)}", n, w[0], w[-1]}
        if len(w) > 1:
            first, last = w[0], w[-1]
            ways |= {f"{last}, {first}", f"{first} {last[0]}.", f"{first} {last[0]}", f"{first[0]}. {last}", f"{first[0]} {last}", f"{first[0]}. {last[0]}.", f"{first[0]}{last[0]}"}
        for x in ways:
            forms.setdefault(x, set()).add(int(no))
    return {k: next(iter(v)) for k, v in forms.items() if len(v) == 1}


def speaker_of(label: str | None, cast: str) -> int | None:
    """The cast number that a label means, null if it means none or more than one."""
    if not label:
        return None
    s = _plain(label)
    m = _NUMBER.match(s)
    return _names(cast).get(f"#{int(m[1])}" if m else s)


def _is_noise(token: str, sets: frozenset[str]) -> bool:
    core = _EDGE.sub("", token)
    return core.lower() in sets and not (len(core) > 1 and core.isupper())


_ANY = NOISES.union(*NOISES_IN.values())


def _sound(m: re.Match) -> str:
    inner = [_EDGE.sub("", t).lower() for t in re.split(r"[\s_]+", m[1] or m[2] or "") if not _is_noise(t, _ANY)]
    inner = [t for t in inner if t]
    return " " if all(t in SOUNDS for t in inner) else m[0]


_LANGS = list(COMMON)


@lru_cache(maxsize=200_000)
def _token(w: str) -> tuple[bool, tuple[int, ...] | None]:
    """Whether a token is a word that may be kept, and its votes and noises by language (null if all are 0)."""
    if not any(c.isalnum() for c in w) or _is_noise(w, NOISES):
        return False, None
    core = _EDGE.sub("", w).lower()
    n = tuple(core in COMMON[x] for x in _LANGS) + tuple(_is_noise(w, NOISES_IN[x]) for x in _LANGS)
    return True, tuple(map(int, n)) if any(n) else None


def clean_segment(speaker: str | None, text: str | None, cast: str) -> tuple[int | None, list[str]]:
    """Cast number and the tokens left of one segment.

    Media times, described sounds, labels at the head of the text and noises that are words of no
    language are gone; noises of single languages are still there.
    """
    who = speaker_of(speaker, cast)
    t = text or ""
    if ":" in t:
        t = _TIME.sub(" ", t)
        for _ in range(2):
            m = _LABEL.match(t)
            found = speaker_of(m[1], cast) if m else None
            if found is None:
                break
            who = found if who is None else who
            t = t[m.end() :]
    if "[" in t or "<" in t:
        t = _MARKED.sub(" ", t)
    if "(" in t or "*" in t:
        t = _MAYBE.sub(_sound, t)
    return who, [w for w in t.split() if _token(w)[0]]


def segments_clean(df: DataFrame, cast: DataFrame) -> DataFrame:
    """``clip_id, seg_id, start_s, end_s, speaker_no, text, n_words`` of each segment with a word left.

    ``df`` has ``seg_id, clip_id, start_s, end_s, speaker, text`` and ``cast`` ``clip_id, speaker_no,
    display_name``.  Repeated rows (one ``seg_id`` in a clip) count once.  The language of a clip, told
    by all its segments, decides which noises are words.  Null texts, clips, starts and NaN starts are
    left out; a null end stays null; a label that means nobody of the cast gives a null ``speaker_no``.
    """
    casts = cast.where("clip_id is not null and speaker_no is not null and display_name is not null").groupBy("clip_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.concat(F.col("speaker_no").cast("string"), F.lit("="), F.col("display_name")))), "\n").alias("cast")
    )
    rows = df.where(F.col("clip_id").isNotNull() & F.col("text").isNotNull() & F.col("start_s").isNotNull() & ~F.isnan("start_s"))
    rows = rows.select("seg_id", "clip_id", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), "speaker", "text")
    rows = rows.dropDuplicates(["clip_id", "seg_id"]).join(casts, "clip_id", "left")
    langs = _LANGS
    extra = [f"e_{x}" for x in langs] + [f"w_{x}" for x in langs]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            who, text, count = [], [], []
            seen = np.zeros((len(b), len(extra)), np.int32)
            for i, (s, t, c) in enumerate(zip(b["speaker"].tolist(), b["text"].tolist(), b["cast"].tolist(), strict=True)):
                no, words = clean_segment(s, t, c or "")
                who.append(no)
                text.append(" ".join(words))
                count.append(len(words))
                for w in words:
                    if (n := _token(w)[1]) is not None:
                        seen[i] += n
            out = b[["clip_id", "seg_id", "start_s", "end_s"]].copy()
            out["speaker_no"] = pd.array(who, dtype="Int32")
            out["text"], out["n_all"] = text, count
            for i, x in enumerate(extra):
                out[x] = seen[:, i]
            yield out

    clean = cut(rows.mapInPandas(scan, "clip_id long, seg_id long, start_s double, end_s double, speaker_no int, text string, n_all int, " + ", ".join(f"{x} int" for x in extra)))
    votes = clean.groupBy("clip_id").agg(*[F.sum(f"e_{x}").alias(f"v_{x}") for x in langs])
    best = F.array_max(F.array(*[F.struct(F.col(f"v_{x}").alias("v"), F.lit(-i).alias("i"), F.lit(x).alias("lang")) for i, x in enumerate(langs)]))
    told = clean.join(votes.select("clip_id", best["lang"].alias("lang")), "clip_id")
    noise = F.coalesce(*[F.when(F.col("lang") == x, F.col(f"w_{x}")) for x in langs], F.lit(0))
    text = F.col("text")
    for x in langs:  # whole tokens only, not those in capitals
        words = "|".join(sorted(f"{w[0].upper()}?{w[0]}?{w[1:]}" for w in NOISES_IN[x]))
        text = F.when(F.col("lang") == x, F.trim(F.regexp_replace("text", rf"(?<!\S)[^\w\s]*(?:{words})[^\w\s]*(?!\S)\s*", ""))).otherwise(text)
    return told.withColumn("n_words", F.col("n_all") - noise).where("n_words > 0").select("clip_id", "seg_id", "start_s", "end_s", "speaker_no", text.alias("text"), "n_words")


def _swept(segs: DataFrame, shard_s: float) -> DataFrame:
    """Clean segments with ``_e`` (end, else start), ``_shard``, and of what comes before in the clip: ``_text`` and ``_end`` of the last segment, ``_reach`` of all.

    Clips are swept in shards of ``shard_s`` seconds; what the shards before hold is told from one row a shard.
    """
    order = ["start_s", "_e", "seg_id"]
    d = segs.withColumn("_e", F.greatest(F.coalesce("end_s", "start_s"), F.lit(-1e300))).withColumn("_shard", F.floor(F.col("start_s") / shard_s).cast("long"))
    w = Window.partitionBy("clip_id", "_shard").orderBy(*order)
    d = d.withColumn("_text", F.lag("text").over(w)).withColumn("_end", F.lag("_e").over(w)).withColumn("_reach", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = d.groupBy("clip_id", "_shard").agg(F.max_by(F.struct("text", "_e"), F.struct(*order)).alias("_z"), F.max("_e").alias("_m"))
    x = Window.partitionBy("clip_id").orderBy("_shard")
    s = s.select("clip_id", "_shard", F.lag("_z").over(x).alias("_z"), F.max("_m").over(x.rowsBetween(Window.unboundedPreceding, -1)).alias("_m"))
    d = d.join(s, ["clip_id", "_shard"])
    head = F.col("_reach").isNull()
    return d.select(*segs.columns, "_e", "_shard", F.when(head, F.col("_z.text")).otherwise(F.col("_text")).alias("_text"), F.when(head, F.col("_z._e")).otherwise(F.col("_end")).alias("_end"), F.greatest("_reach", "_m").alias("_reach"))


def drop_rolling(segs: DataFrame, least: int = 3, shard_s: float = 600.0) -> DataFrame:
    """Clean segments without the head that repeats the tail of the segment before (rolling captions).

    The longest suffix of the segment before that is a prefix of this one counts, by lower-case tokens.  At least
    ``least`` tokens must repeat and the two segments must touch or overlap in time.  Segments that hold nothing
    new are left out.
    """
    d = _swept(segs, shard_s)
    a, b = F.split(F.lower("_text"), " "), F.split(F.lower("text"), " ")
    sizes = F.filter(F.sequence(F.least(F.size("_a"), F.size("_b")), F.lit(1), F.lit(-1)), lambda k: F.slice("_a", F.size("_a") - k + 1, k) == F.slice("_b", F.lit(1), k))
    close = (F.col("_end") >= F.col("start_s") - 0.05) & F.array_contains("_a", F.get("_b", F.lit(0)))
    d = d.withColumn("_a", a).withColumn("_b", b).withColumn("_n", F.coalesce(F.when(close, F.get(sizes, F.lit(0))), F.lit(0)))
    d = d.withColumn("_n", F.when(F.col("_n") >= least, F.col("_n")).otherwise(0))
    rest = F.when(F.col("_n") > 0, F.array_join(F.slice(F.split("text", " "), F.col("_n") + 1, F.greatest(F.size("_b"), F.lit(1))), " ")).otherwise(F.col("text"))
    return d.withColumn("text", rest).withColumn("n_words", F.col("n_words") - F.col("_n")).where("n_words > 0").select(*segs.columns)


def clip_pauses(segs: DataFrame, least_s: float = 0.5, shard_s: float = 600.0) -> DataFrame:
    """``clip_id, pause_s``: the silence that splits turns in each clip, calibrated on all silences of the clip.

    It is the upper fence of the silences between its clean segments (third quartile and one and a half times the
    distance of the quartiles), ``least_s`` at least and where a clip has no silence.
    """
    d = _swept(segs, shard_s).select("clip_id", F.when(F.col("start_s") > F.col("_reach"), F.col("start_s") - F.col("_reach")).alias("gap"))
    q = d.groupBy("clip_id").agg(F.percentile_approx("gap", [0.25, 0.75], 1000).alias("q"))
    fence = F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])
    return q.select("clip_id", F.greatest(F.lit(least_s), fence).alias("pause_s"))


def speaker_turns(df: DataFrame, cast: DataFrame, *, pauses: bool = False, pause_s: float | None = None, rolling: int = 4, shard_s: float = 600.0) -> DataFrame:
    """Turns ``clip_id, first_seg, speaker_no, start_s, end_s, text, n_words`` of clean segments.

    A turn is a longest run of segments of one speaker in order of ``start_s`` (ties: ``end_s``, ``seg_id``).
    Repetition of rolling captions of ``rolling`` words or more is removed (see :func:`drop_rolling`; 0 keeps it).
    With ``pauses`` a silence longer than the clip's own (:func:`clip_pauses`) also splits a turn, with ``pause_s`` one longer
    than that.  A segment whose speaker is nobody of the cast is a turn of its own.  See :func:`segments_clean` for what counts
    as a segment; empty tables give no turns.  Clips are swept in shards of ``shard_s`` seconds, so no clip is one task.
    """
    segs = segments_clean(df, cast)
    segs = drop_rolling(segs, rolling, shard_s) if rolling else segs
    part = F.floor(F.col("start_s") / shard_s)
    if pauses or pause_s is not None:
        limit = segs.select("clip_id").distinct().withColumn("pause_s", F.lit(float(pause_s))) if pause_s is not None else clip_pauses(segs, shard_s=shard_s)
        late = _swept(segs, shard_s).join(limit, "clip_id")
        late = late.withColumn("_late", F.coalesce((F.col("start_s") - F.col("_reach") > F.col("pause_s")).cast("int"), F.lit(0)))
        w, x = Window.partitionBy("clip_id", "_shard").orderBy("start_s", "_e", "seg_id"), Window.partitionBy("clip_id").orderBy("_shard")
        per = late.groupBy("clip_id", "_shard").agg(F.sum("_late").alias("n")).select("clip_id", "_shard", F.coalesce(F.sum("n").over(x.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
        late = late.withColumn("_cut", F.sum("_late").over(w)).join(per, ["clip_id", "_shard"])
        segs = late.withColumn("_v", F.concat_ws(":", F.col("speaker_no").cast("string"), (F.col("_cut") + F.col("_off")).cast("string"))).drop("_shard", "_text", "_end", "_reach")
        segs = segs.withColumn("_v", F.when(F.col("speaker_no").isNotNull(), F.col("_v")))
    else:
        segs = segs.withColumn("_e", F.coalesce("end_s", "start_s")).withColumn("_v", F.col("speaker_no"))
    runs = merge_runs(
        segs, ["clip_id"], ["start_s", "_e", "seg_id"], "_v", shard=part, firsts={"first_seg": "seg_id", "from_s": "start_s", "who": "speaker_no"},
        maxs={"to_s": "_e"}, sums={"n_words": "n_words"}, texts={"text": ("text", " ")},
    )
    return runs.select("clip_id", "first_seg", F.col("who").alias("speaker_no"), F.col("from_s").alias("start_s"), F.col("to_s").alias("end_s"), "text", F.col("n_words").cast("int").alias("n_words"))
