"""Timestamps in many notations and zones, brought to one UTC second.

All parsing is done by JVM expressions in whole-stage code.  Missing zones are estimated by aligning the local
times of a source with their ingestion times: all offset histories of the zone database are tried on counts
by hour and lag, and weighed by the lags that rows with a stated offset have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.session import cut

# Month names as mail programs write them (English, German, French, Spanish).
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fevrier fevr febrero",
    3: "march mar märz mär mrz maerz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre set",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}

# Zone letters, minutes east of UTC. First the mail standard's, then the fixed offset
# the name has in Europe, then letters with one meaning only.
ZONE_LETTERS = {
    "z": 0, "ut": 0, "gmt": 0, "utc": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "oez": 120, "oesz": 180, "bst": 60, "ist": 60, "msk": 180, "trt": 180,
    "jst": 540, "kst": 540, "akst": -540, "akdt": -480, "hst": -600,
    "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
}

_MONTH_NO = {n: k for k, names in MONTHS.items() for n in names.split()}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([ap]\.?m\.?(?![a-z]))?"
_NAME = r"(\p{L}{3,})"
#: Pattern and the order year, month, day, hour, minute, second, am/pm, rest, all on the folded lower-case text.
_FORMS = [
    (rf"^(?:\p{{L}}+\.?,? )?(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:t|,? ){_TIME}(.*)$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"^(?:d:)?(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?((?: ?z| ?[+-].*)?)$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(?:\p{{L}}+\.?,? )?(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_TIME}(.*)$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(?:\p{{L}}+\.?,? ?)?(\d{{1,2}})\.?[ -]{_NAME}\.?,?[ -](\d{{4}}|\d{{2}}),?(?: at| um| à)? {_TIME}(.*)$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(?:\p{{L}}+\.?,? )?{_NAME}\.? (\d{{1,2}}),? (\d{{4}}),?(?: at)? {_TIME}(.*)$", "$3|$1-|$2|$4|$5|$6|$7|$8"),
    (rf"^(?:\p{{L}}+\.?,? )?{_NAME}\.? (\d{{1,2}}) {_TIME}((?: \p{{L}}+| ?[+-]\d{{2}}:?\d{{2}})?) (\d{{4}})$", "$8|$1-|$2|$3|$4|$5|$6|$7"),
]


def _fold(s: Column) -> Column:
    """Unfold header lines, drop comments in round brackets, unify signs and spaces, lower-case."""
    s = F.translate(s, "−‐‑–   \t\r\n", "----      ")
    for _ in range(3):  # comments nest
        s = F.regexp_replace(s, r"\([^()]*\)", " ")
    s = F.lower(F.trim(F.regexp_replace(s, r" +", " ")))
    return F.regexp_replace(s, r"^date: ", "")


def with_stamp_parts(df: DataFrame, header: str) -> DataFrame:
    """Add ``_local_s`` (wall time as if UTC, seconds), ``_epoch_s``, ``_offset_min``, ``_zone_name`` and ``_has_rest``.

    ``_epoch_s`` is set for counts since 1970 (seconds, milli-, micro- or nanoseconds by their number of
    digits).  All fields are null where no existing date with an existing time of day is stated: void,
    null or empty headers, days without a time, the 30th of February, hour 24.  Second 60 is not a time
    of day here.  ``_zone_name`` is the lower-case place name still to be looked up.

    The steps are separate projections on purpose: each text is matched once and referred to by name.
    """
    df = df.withColumn("_ts_s", _fold(F.col(header)))
    s = F.col("_ts_s")
    text = F.lit(None).cast("string")
    for pattern, order in reversed(_FORMS):
        text = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, order)).otherwise(text)
    df = df.withColumn("_ts_p", F.split(text, r"\|", 8))
    p = F.col("_ts_p")
    num = lambda i: F.get(p, F.lit(i)).try_cast("int")
    months = F.create_map(*[F.lit(x) for kv in _MONTH_NO.items() for x in kv])
    raw_m = F.regexp_replace(F.get(p, F.lit(1)), r"-$", "")
    half = F.substring(F.get(p, F.lit(6)), 1, 1)
    digits = F.regexp_extract(s, r"^(\d{9,19})(?:\.\d+)?$", 1)
    rest = F.trim(F.get(p, F.lit(7)))
    off = r"^(?:gmt|utc|ut)? ?([+-])(\d{1,2})[:']?(\d{2})?'?"
    df = df.select(
        "*",
        F.coalesce(raw_m.try_cast("int"), F.try_element_at(months, raw_m)).alias("_ts_mon"),
        F.when(num(0) < 100, num(0) + 2000).otherwise(num(0)).alias("_ts_y"),
        F.when(half == "", num(3)).when(~num(3).between(1, 12), None).when(half == "p", num(3) % 12 + 12).otherwise(num(3) % 12).alias("_ts_h"),
        num(4).alias("_ts_mi"), F.when(F.get(p, F.lit(5)) == "", 0).otherwise(num(5)).alias("_ts_sec"), num(2).alias("_ts_d"),
        rest.alias("_ts_rest"), F.regexp_extract(rest, off, 1).alias("_ts_sign"),
        F.regexp_extract(rest, off, 2).try_cast("int").alias("_ts_oh"), F.coalesce(F.regexp_extract(rest, off, 3).try_cast("int"), F.lit(0)).alias("_ts_om"),
        F.length(digits).alias("_ts_size"), digits.try_cast("long").alias("_ts_n"),
    )
    c = lambda n: F.col(f"_ts_{n}")
    ok = c("h").between(0, 23) & c("mi").between(0, 59) & c("sec").between(0, 59) & c("y").between(1, 9999)
    iso = F.concat_ws("-", F.lpad(c("y").cast("string"), 4, "0"), F.lpad(c("mon").cast("string"), 2, "0"), F.lpad(c("d").cast("string"), 2, "0"))
    local = F.when(ok, F.unix_date(iso.try_cast("date")).cast("long") * 86400 + c("h").cast("long") * 3600 + c("mi") * 60 + c("sec"))
    letters = F.create_map(*[F.lit(x) for kv in ZONE_LETTERS.items() for x in kv])
    word = F.regexp_extract(c("rest"), r"^([a-z]+)\.?(?: |$)", 1)
    numeric = F.when((c("oh") <= 23) & (c("om") <= 59), F.when(c("sign") == "-", -1).otherwise(1) * (c("oh") * 60 + c("om")))
    offset = F.when(c("sign") != "", numeric).otherwise(F.try_element_at(letters, word))
    place = F.regexp_extract(c("rest"), r"^\[?([a-z]+(?:[/_+-][a-z0-9_+-]+)*)\]?$", 1)
    size, n = c("size"), c("n")
    epoch = (
        F.when(size.between(9, 11), n)
        .when(size.between(12, 14) & p.isNull(), F.expr("_ts_n div 1000"))
        .when(size.between(15, 17), F.expr("_ts_n div 1000000"))
        .when(size.between(18, 19), F.expr("_ts_n div 1000000000"))
    )
    df = df.select("*", local.alias("_ts_local"), epoch.alias("_ts_epoch"), offset.alias("_ts_off"), place.alias("_ts_place0"))
    whole = c("epoch").isNull()
    parts = [
        F.when(whole, c("local")).alias("_local_s"), c("epoch").alias("_epoch_s"), F.when(whole, c("off")).alias("_offset_min"),
        F.when(whole & c("off").isNull() & (c("sign") == "") & (c("place0") != ""), c("place0")).alias("_zone_name"),
        (F.length(c("rest")) > 0).alias("_has_rest"),
    ]
    inner = "s p mon y h mi sec d rest sign oh om size n local epoch off place0"
    return df.select("*", *parts).drop(*[f"_ts_{x}" for x in inner.split()])


def iso_utc(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of seconds since 1970, whatever the session's zone."""
    day = F.floor(seconds / 86400).cast("int")
    r = seconds - day.cast("long") * 86400
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(r / 3600), F.lit(":"), two(r % 3600 / 60), F.lit(":"), two(r % 60), F.lit("Z"))


def wall_to_epoch(local_s: Column, zone: Column) -> Column:
    """Seconds since 1970 of wall time in a named zone.

    A wall time that occurs twice is its first occurrence; a skipped one counts as later by the length
    of the skip.
    """
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local_s), zone))


def zone_names(spark) -> DataFrame:
    """All zone ids the JVM knows (about 600, bounded by the zone database): ``place``, ``zone``."""
    ids = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    each = spark.range(1, numPartitions=1).select(F.explode(F.split(F.lit(",".join(ids)), ",")).alias("zone"))
    return each.groupBy(F.lower("zone").alias("place")).agg(F.min("zone").alias("zone"))


def zone_histories(spark) -> dict[str, str]:
    """Every zone id the JVM knows and the id that stands for its offset history: one of ``DEFAULT_CANDIDATES`` where possible, else the first by name."""
    of = spark._jvm.java.time.ZoneId
    held: dict[int, list] = {}
    out = {}
    for z in dict.fromkeys([*DEFAULT_CANDIDATES, *sorted(of.getAvailableZoneIds())]):
        rules = of.of(z).getRules()
        same = held.setdefault(rules.hashCode(), [])
        out[z] = next((n for r, n in same if r.equals(rules)), z)
        if out[z] == z:
            same.append((rules, z))
    return out


#: Half hours of lag that are told apart, how many times as likely the best zones must be as others, how many times to overrule
#: a stated zone, and how many rows the prior counts as.
LAG_BINS, LIKELIER, OVERRULE, PRIOR_ROWS = 672, 20.0, 1e9, 100


def _lag_bin(lag: Column) -> Column:
    """The half hour of a lag: -1 is fetched before it was written, ``LAG_BINS`` two weeks after or later."""
    return F.greatest(F.lit(-1), F.least(F.lit(LAG_BINS), F.floor(lag / 1800))).cast("int")


def _scores(held: dict[int, int], total: int) -> list[float]:
    """Log-likelihood of each bin from -1 on: its share of the rows with a stated zone and of a prior, by which short
    lags are likelier and written after it was fetched is next to impossible."""
    out = []
    for b in range(-1, LAG_BINS + 1):
        wide = 1440 if b < 0 else 17_520 if b == LAG_BINS else 1  # a month and a year of half hours
        prior = (0.01 if b < 0 else 0.1 if b == LAG_BINS else 0.89 / ((math.log(LAG_BINS) + 0.5772) * (b + 1))) / wide
        out.append(math.log((held.get(b, 0) / wide + PRIOR_ROWS * prior) / (total + PRIOR_ROWS)))
    return out


def lag_counts(df: DataFrame, sent_s: str, seen_s: str, weight: str | None = None) -> DataFrame:
    """One row ``held`` (half hour of lag to number of rows) and ``total``, of the rows with a stated zone; at most ``LAG_BINS + 2`` entries."""
    one = F.lit(1) if weight is None else F.col(weight)
    per = df.groupBy(_lag_bin(F.col(seen_s) - F.col(sent_s)).alias("b")).agg(F.sum(one).alias("n"))
    pairs = F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "n")))
    return per.agg(F.map_from_entries(pairs).alias("held"), F.coalesce(F.sum(F.when(F.col("b").isNotNull(), F.col("n"))), F.lit(0)).alias("total"))


def possible_zones(df: DataFrame, source: str, local_s: str, seen_s: str, lags: DataFrame, candidates: list[str] | None = None, weight: str | None = None, likelier: float = LIKELIER) -> DataFrame:
    """``source, zone, zones, violations, rows``: the zones of each source among all offset histories, with ties shown.

    ``local_s`` is wall time as if UTC, ``seen_s`` the second of ingestion.  ``lags`` is the row of :func:`lag_counts`: a candidate
    is as likely as the lags it gives the rows are there.  Before the histories are tried rows are counted by hour of wall
    time and quarter hour of lag, which all offsets keep apart: a source with a third of all rows is as many
    groups as it has such hours, counted in the tasks.
    ``zones`` are the candidates that are not ``likelier`` times less likely than the best, the likeliest first.
    ``zone`` is the first of them if all give the same instants for all rows of the source, else null.
    ``violations`` counts the rows with lags that no row with a stated zone has.
    """
    names = candidates or list(dict.fromkeys(zone_histories(df.sparkSession).values()))
    use = F.col("source").isNotNull() & F.col("hour").isNotNull() & F.col("quarter").isNotNull()
    tries = F.split(F.lit(",".join(names)), ",")  # as one literal: hundreds of structs exceed what is compiled
    rows = df.groupBy(F.col(source).alias("source"), F.floor(F.col(local_s) / 3600).alias("hour"), F.floor((F.col(seen_s) - F.col(local_s)) / 900).alias("quarter"))
    rows = rows.agg(F.sum(F.lit(1) if weight is None else F.col(weight)).alias("c"))
    told = lags.first()  # one row of at most LAG_BINS + 2 counts
    held = (told["held"] if told else None) or {}
    score, unseen = F.lit(_scores(held, told["total"] if told else 0)), F.lit([b not in held for b in range(-1, LAG_BINS + 1)])
    tried = rows.select("*", F.posexplode(F.when(use, tries)).alias("i", "z")).withColumn("l", F.col("hour") * 3600)
    tried = tried.withColumn("at", wall_to_epoch(F.col("l"), F.col("z")))
    b = _lag_bin(F.col("quarter") * 900 + F.col("l") - F.col("at")) + 1
    # the sums of offsets and of hashes stand for the instants of all rows
    per = tried.groupBy("source", "i", "z").agg(
        F.sum(F.col("c") * F.get(score, b)).alias("s"), F.sum(F.when(F.get(unseen, b), F.col("c")).otherwise(0)).alias("v"),
        F.sum("c").alias("rows"), F.sum((F.col("l") - F.col("at")) * F.col("c")).alias("o"), F.sum(F.xxhash64("l", "at").cast("decimal(20,0)")).alias("h"),
    )
    top = per.withColumn("m", F.max("s").over(Window.partitionBy("source"))).where(F.col("s") >= F.col("m") - math.log(likelier))
    best = top.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct(-F.round("s", 6), "i", "z", "v"))).alias("b"), F.count_distinct("o", "h").alias("k"), F.max("rows").alias("rows")
    )
    first = F.get("b", F.lit(0))
    return best.select("source", F.when(F.col("k") == 1, first["z"]).alias("zone"), F.transform("b", lambda x: x["z"]).alias("zones"), first["v"].alias("violations"), "rows")


def source_zones(df: DataFrame, header: str, source: str, seen: str, candidates: list[str] | None = None, likelier: float = LIKELIER) -> DataFrame:
    """:func:`possible_zones` of the sources of ``df``, calibrated on the lags of its own rows with a stated offset.

    The headers are parsed once into counts by source, hour and lag, which are written (:func:`loomdoc.session.cut`) and feed both.
    """
    p = df.select(F.col(source).alias("source"), F.col(header).alias("h"), F.unix_seconds(F.col(seen).cast("timestamp")).alias("seen"))
    p = with_stamp_parts(p, "h")
    stated = F.coalesce(F.col("_epoch_s"), F.col("_local_s") - F.col("_offset_min") * 60)
    kind = F.when(F.col("seen").isNull(), None).when(stated.isNotNull(), 1).when(~F.col("_has_rest") & F.col("_local_s").isNotNull(), 0)
    at = F.when(kind == 1, stated).otherwise(F.col("_local_s"))
    p = p.select(F.when(kind == 0, F.col("source")).alias("source"), kind.alias("kind"), F.when(kind == 0, F.floor(at / 3600)).alias("hour"), F.floor((F.col("seen") - at) / 900).alias("quarter"))
    p = cut(p.groupBy("source", "kind", "hour", "quarter").agg(F.count(F.lit(1)).alias("n")))
    p = p.select("*", (F.coalesce("hour", F.lit(0)) * 3600).alias("l")).withColumn("seen", F.col("l") + F.col("quarter") * 900)
    return possible_zones(p.where("kind = 0"), "source", "l", "seen", lag_counts(p.where("kind = 1"), "l", "seen", "n"), candidates, "n", likelier)


#: Candidates for a source without any hint: one zone for each offset history with many inhabitants.
DEFAULT_CANDIDATES = [
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Helsinki", "Europe/Moscow", "Asia/Dubai", "Asia/Kolkata",
    "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney", "Pacific/Auckland", "America/Sao_Paulo",
    "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles",
]


def normalise_timestamps(
    df: DataFrame, header: str, *, source: str | None = None, seen: str | None = None, zones: DataFrame | None = None,
    candidates: list[str] | None = None, out: str = "utc_second", drop_void: bool = False,
) -> DataFrame:
    """Add ``out``: the UTC second (text) that ``header`` states, null where it states none.

    Order of evidence: a count since 1970 or numeric offset; zone letters; a place name; the zone of the row's source.
    With ingestion times ``seen`` that zone is estimated (:func:`source_zones`): of the offset histories that the
    source's rows leave likely it is the one that ``zones`` (columns ``source, zone``, one row per source) states, else the
    likeliest; a stated zone that is ``OVERRULE`` times less likely is overruled.  Without ``seen``, or for a source that no row tells of, it is
    the stated one.  Text in round brackets is a comment.  Without any of these the wall time stays unresolved (null).
    A trailing text that is none of these makes the row void.  ``drop_void`` leaves void rows out.

    Null, empty and very long headers give null; repeated rows are kept; names used inside begin with ``_`` so that
    other columns may be called anything else.
    """
    spark = df.sparkSession
    p = with_stamp_parts(df, header)
    names = zone_names(spark).select(F.col("place").alias("_ts_place"), F.col("zone").alias("_ts_zone"))
    p = p.join(F.broadcast(names), F.col("_zone_name") == F.col("_ts_place"), "left")  # bounded by the zone database
    if source is not None:
        given = spark.createDataFrame([], "source string, zone string") if zones is None else zones.select("source", "zone")
        known = zone_names(spark).select("place", F.col("zone").alias("known"))
        given = given.join(F.broadcast(known), F.lower("zone") == F.col("place")).where("source is not null")
        given = given.groupBy("source").agg(F.min("known").alias("zone"))
        if seen is not None:
            same = zone_histories(spark)  # one name stands for each history
            stands = F.split(F.lit("|".join(f"{a},{b}" for a, b in same.items())), r"\|")
            stands = spark.range(1, numPartitions=1).select(F.explode(stands).alias("x")).select(F.split("x", ",")[0].alias("zone"), F.split("x", ",")[1].alias("history"))
            told = source_zones(df, header, source, seen, candidates, OVERRULE).select("source", "zones")
            both = given.join(F.broadcast(stands), "zone", "left").join(told, "source", "full")  # bounded by the zone database
            agrees = F.col("zones").isNull() | F.array_contains("zones", F.col("history"))
            given = both.select("source", F.when(F.col("zone").isNotNull() & agrees, F.col("zone")).otherwise(F.get("zones", F.lit(0))).alias("zone"))
        given = given.select(F.col("source").alias("_ts_source"), F.col("zone").alias("_ts_host"))
        p = p.join(given, F.col(source) == F.col("_ts_source"), "left")
    else:
        p = p.withColumn("_ts_source", F.lit(None).cast("string")).withColumn("_ts_host", F.lit(None).cast("string"))
    void = F.col("_has_rest") & F.col("_offset_min").isNull() & F.col("_ts_zone").isNull()
    zone = F.coalesce(F.col("_ts_zone"), F.col("_ts_host"))
    wall = F.col("_local_s")
    sec = F.coalesce(
        F.col("_epoch_s"),
        F.when(void, None).when(F.col("_offset_min").isNotNull(), wall - F.col("_offset_min") * 60).otherwise(wall_to_epoch(wall, zone)),
    )
    p = p.withColumn("_utc_s", sec)
    iso = iso_utc(F.col("_utc_s"))
    p = p.withColumn(out, F.explode(F.array_compact(F.array(iso))) if drop_void else iso)
    return p.drop("_utc_s", "_local_s", "_epoch_s", "_offset_min", "_zone_name", "_has_rest", "_ts_place", "_ts_zone", "_ts_source", "_ts_host")
