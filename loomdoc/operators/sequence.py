"""Operators on ordered rows: runs of one value, gaps, phrases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, shard: Column | None = None,
    firsts: Mapping[str, str] | None = None, lasts: Mapping[str, str] | None = None, sums: Mapping[str, str] | None = None, maxs: Mapping[str, str] | None = None,
    texts: Mapping[str, tuple[str, str]] | None = None, null_merges: bool = False,
) -> DataFrame:
    """One row for each longest run of rows with equal ``value`` in ``order``: ``*keys, value, n_rows`` and the asked aggregates.

    ``firsts``, ``lasts``, ``sums`` and ``maxs`` map output names to columns; ``texts`` maps an output name to
    (column, separator), joined in order.  Rows with a null value are runs of their own unless
    ``null_merges``.  ``order`` must be total within a key, else the result is that of one of its orders.

    ``shard`` cuts a key's rows into ranges of its order (a monotone number such as the minute).  Runs are
    then built shard by shard and only the two outer runs of a shard meet those of other shards, so a
    key with a third of all rows is many small tasks and a short stitching window.
    """
    firsts, lasts, sums, maxs, texts = firsts or {}, lasts or {}, sums or {}, maxs or {}, texts or {}
    d = df.withColumn("_shard", F.lit(0).cast("long") if shard is None else shard.cast("long"))
    inner = [*keys, "_shard"]
    w = Window.partitionBy(*inner).orderBy(*order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) if null_merges else F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))
    d = d.withColumn("_at", F.row_number().over(w)).withColumn("_new", F.when((F.col("_at") > 1) & same, 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def parts(at: str, joined: bool) -> list[Column]:
        """The aggregates, over rows (``joined`` false) or over runs of shards (true)."""
        src = lambda out, col: F.col(out if joined else col)
        out = [F.min_by(src(o, c), F.col(at)).alias(o) for o, c in firsts.items()]
        out += [F.max_by(src(o, c), F.col(at)).alias(o) for o, c in lasts.items()]
        out += [F.sum(src(o, c)).alias(o) for o, c in sums.items()] + [F.max(src(o, c)).alias(o) for o, c in maxs.items()]
        for o, (c, sep) in texts.items():
            rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), src(o, c).alias("t"))))
            out.append(F.array_join(F.transform(rows, lambda x: x["t"]), sep).alias(o))
        return [*out, (F.sum("n_rows") if joined else F.count(F.lit(1))).alias("n_rows")]

    runs = d.groupBy(*inner, value, "_run").agg(*parts("_at", False))
    names = [*keys, value, *firsts, *lasts, *sums, *maxs, *texts, "n_rows"]
    if shard is None:
        return runs.select(*names)
    last = Window.partitionBy(*inner)
    runs = runs.withColumn("_last", F.max("_run").over(last))
    whole = runs.where((F.col("_run") > 1) & (F.col("_run") < F.col("_last")))
    rim = runs.where((F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
    v = Window.partitionBy(*keys).orderBy("_shard", "_run")
    same = F.col(value).eqNullSafe(F.lag(value).over(v)) if null_merges else F.coalesce(F.col(value) == F.lag(value).over(v), F.lit(False))
    rim = rim.withColumn("_seq", F.row_number().over(v)).withColumn("_new", F.when((F.col("_seq") > 1) & (F.col("_run") == 1) & same, 0).otherwise(1))
    rim = rim.withColumn("_isle", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    rim = rim.groupBy(*keys, value, "_isle").agg(*parts("_seq", True))
    return whole.select(*names).unionByName(rim.select(*names))


def _joined_back(d: DataFrame, s: DataFrame, on: Sequence[str]) -> DataFrame:
    """``d`` with the columns of ``s``, one row for each value of ``on``; nulls meet nulls."""
    r = s.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(on)], *[c for c in s.columns if c not in on])
    meet = F.lit(True)
    for i, k in enumerate(on):
        meet = meet & d[k].eqNullSafe(r[f"_j{i}"])
    return d.join(r, meet).drop(*[f"_j{i}" for i in range(len(on))])


def gap_merge(
    df: DataFrame, keys: Sequence[str], start: str, end: str, speaker: str, *, merge_gap: float = 0.3, order: Sequence[str] = (), shard: float = 3600.0,
) -> DataFrame:
    """Segments in order of ``start`` joined to the one before them when the speaker is the same and the gap at most ``merge_gap``.

    Only the last merged segment counts, so another speaker in between ends a run; the end of a merged
    segment is the largest of its parts.  Output ``*keys, speaker, start, end, n_rows`` under the input's names.
    Rows without ``start`` are left out, a null ``end`` reaches nowhere, null keys and speakers are values of their own.

    A key's rows are swept in shards of ``shard`` units of ``start``.  How far the speech at the end of earlier shards
    reaches is told from one row a shard; only the first and last merged segment of a shard meet those of others.
    """
    x = Window.partitionBy(*keys).orderBy("_sh")
    cell = [*keys, "_sh"]
    w = Window.partitionBy(*cell).orderBy(start, *order)
    d = df.where(F.col(start).isNotNull()).withColumn("_sh", F.floor(F.col(start).cast("double") / shard).cast("long"))
    d = d.withColumn("_at", F.row_number().over(w)).withColumn("_turn", F.when((F.col("_at") > 1) & ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)), 1).otherwise(0))
    d = d.withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*cell, "_run").agg(F.max(end).alias("_e"), F.min_by(F.struct(speaker), F.col("_at")).alias("_who"))
    s = runs.groupBy(*cell).agg(F.min_by("_who", "_run").alias("_a"), F.max_by("_who", "_run").alias("_z"), F.max_by("_e", "_run").alias("_trail"), F.max("_run").alias("_nr"))
    s = s.withColumn("_link", F.lag("_sh").over(x).isNotNull() & F.col("_a").eqNullSafe(F.lag("_z").over(x)))
    s = s.withColumn("_g", F.sum(F.when(F.col("_link") & (F.col("_nr") == 0), 0).otherwise(1)).over(x.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_far", F.max("_trail").over(Window.partitionBy(*keys, "_g").orderBy("_sh").rowsBetween(Window.unboundedPreceding, 0)))
    s = s.select(*cell, F.when(F.col("_link"), F.lag("_far").over(x)).alias("_in"))
    d = _joined_back(d, s, cell)
    v = Window.partitionBy(*cell, "_run").orderBy(start, *order)
    reach = F.greatest(F.max(end).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.when(F.col("_run") == 0, F.col("_in")))
    d = d.withColumn("_cut", F.when(reach.isNull() | (F.col(start) - reach > merge_gap), 1).otherwise(0))
    d = d.withColumn("_part", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))  # 0 goes on from the shard before
    parts = d.groupBy(*cell, "_part").agg(F.min_by(F.struct(speaker), F.col("_at")).alias("_who"), F.min(start).alias("_s"), F.max(end).alias("_e"), F.count(F.lit(1)).alias("n_rows"))
    parts = parts.withColumn("_last", F.max("_part").over(Window.partitionBy(*cell)))
    rim = (F.col("_part") == 0) | (F.col("_part") == F.col("_last"))
    whole = parts.where(~rim)
    y = Window.partitionBy(*keys).orderBy("_sh", "_part")
    met = parts.where(rim).withColumn("_isle", F.sum(F.when(F.col("_part") == 0, 0).otherwise(1)).over(y.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.groupBy(*keys, "_isle").agg(F.min_by("_who", F.struct("_sh", "_part")).alias("_who"), F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("n_rows").alias("n_rows"))
    cols = [*keys, F.col(f"_who.{speaker}").alias(speaker), F.col("_s").alias(start), F.col("_e").alias(end), "n_rows"]
    return whole.select(*cols).unionByName(met.select(*cols))


#: Ends of sentences, a fixed value.
SENTENCE_ENDS = "。！？.!?"


def cut_phrases(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, text: str, *, max_s: float = 15.0, gap_s: float = 0.4, shard: float = 3600.0,
) -> DataFrame:
    """Words grouped into phrases: ``*keys, phrase_no, start_s, end_s, text, n_words``.

    A phrase ends after a word that ends a sentence, before a silence longer than ``gap_s`` and before a
    word that would end more than ``max_s`` after the phrase began.  Words without start or end are left out.
    Words stand in order of ``start``, then ``order``.  A key is swept in shards of ``shard`` units of ``start``; one row a
    shard tells which stretch between silences and sentence ends goes on into the next.  Only the greedy length rule is
    a fold, within one such stretch, and it keeps the places of the cuts, not the words.
    """
    cell = [*keys, "_sh"]
    x = Window.partitionBy(*keys).orderBy("_sh")
    w = Window.partitionBy(*cell).orderBy(start, *order)
    d = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_sh", F.floor(F.col(start).cast("double") / shard).cast("long")).withColumn("_i", F.row_number().over(w))
    stops = lambda t: F.coalesce(F.right(t, F.lit(1)).isin(*SENTENCE_ENDS), F.lit(False))
    inner = (F.col("_i") > 1) & ((F.col(start) - F.lag(end).over(w) > gap_s) | stops(F.lag(text).over(w)))
    d = d.withColumn("_h", F.sum(F.when(inner, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = d.groupBy(*cell).agg(F.min(start).alias("_a"), F.max_by(F.struct(F.col(end).alias("e"), F.col(text).alias("t")), F.col("_i")).alias("_z"), F.max("_h").alias("_n"))
    before = F.lag("_z").over(x)
    s = s.withColumn("_first", F.when(before.isNull() | (F.col("_a") - before["e"] > gap_s) | stops(before["t"]), 1).otherwise(0))
    s = s.withColumn("_end", F.when(F.col("_n") + F.col("_first") > 0, F.struct(F.col("_sh").alias("s"), (F.col("_n") + F.col("_first")).alias("h"))))
    s = s.select(*cell, "_first", F.last("_end", True).over(x.rowsBetween(Window.unboundedPreceding, -1)).alias("_on"))
    d = _joined_back(d, s, cell)
    own = F.struct(F.col("_sh").alias("s"), (F.col("_h") + F.col("_first")).alias("h"))
    d = d.withColumn("_hard", F.when(own["h"] == 0, F.col("_on")).otherwise(own))
    words = F.array_sort(F.collect_list(F.struct("_sh", "_i", F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.col(text).alias("t"))))
    part = d.groupBy(*keys, "_hard").agg(words.alias("ws"))
    none = F.expr("named_struct('from', cast(null as double), 'k', 0, 'cuts', cast(array() as array<int>))")

    def step(acc: Column, q: Column) -> Column:
        fresh = acc["from"].isNull() | (q["e"] - acc["from"] > max_s)
        cuts = F.when(fresh, F.concat(acc["cuts"], F.array(acc["k"]))).otherwise(acc["cuts"])
        return F.struct(F.when(fresh, q["s"]).otherwise(acc["from"]).alias("from"), (acc["k"] + 1).alias("k"), cuts.alias("cuts"))

    folded = part.withColumn("_c", F.aggregate("ws", none, step, lambda a: F.concat(a["cuts"], F.array(a["k"]))))
    each = folded.select(*keys, "_hard", "ws", "_c", F.posexplode(F.slice("_c", 1, F.size("_c") - 1)).alias("_k", "_b"))
    each = each.withColumn("p", F.slice("ws", F.col("_b") + 1, F.get("_c", F.col("_k") + 1) - F.col("_b"))).select(*keys, F.col("_hard.s").alias("_sh"), F.col("_hard.h").alias("_h"), "_k", "p")
    each = each.withColumn("_no", F.row_number().over(Window.partitionBy(*cell).orderBy("_h", "_k")))
    n = each.groupBy(*cell).agg(F.max("_no").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(x.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = _joined_back(each, n.select(*cell, "_off"), cell)
    return each.select(
        *keys, (F.col("_no") + F.col("_off")).cast("int").alias("phrase_no"), F.get("p", F.lit(0))["s"].alias("start_s"), F.element_at("p", -1)["e"].alias("end_s"),
        F.trim(F.array_join(F.transform("p", lambda q: q["t"]), " ")).alias("text"), F.size("p").alias("n_words"),
    )


def overlap_assign(
    left: DataFrame, right: DataFrame, key: str, left_id: str, l_start: str, l_end: str, right_id: str, r_start: str, r_end: str, label: str, *, bucket: float = 60.0, default: int = 0,
) -> DataFrame:
    """``key, left_id, label``: for each left interval the label of the right one that overlaps it longest.

    Ties go to the smaller ``right_id``; without any overlap the label is ``default``.  Both sides are put into
    time buckets, so the join is an equi-join on key and bucket and one key's rows are spread over
    its buckets; a pair that shares several buckets is counted in the first one only.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket))
    a = left.where(F.col(l_start).isNotNull() & F.col(l_end).isNotNull()).select(key, F.col(left_id).alias("_l"), F.col(l_start).alias("_ls"), F.col(l_end).alias("_le"), F.explode(span(l_start, l_end)).alias("_b"))
    b = right.where(F.col(r_end) > F.col(r_start)).select(key, F.col(right_id).alias("_r"), F.col(r_start).alias("_rs"), F.col(r_end).alias("_re"), F.col(label).alias("_v"), F.explode(span(r_start, r_end)).alias("_b"))
    over = F.least("_le", "_re") - F.greatest("_ls", "_rs")
    met = a.join(b, [key, "_b"]).where((over > 0) & (F.col("_b") == F.greatest(F.floor(F.col("_ls") / bucket), F.floor(F.col("_rs") / bucket))))
    best = met.groupBy(key, "_l").agg(F.max_by("_v", F.struct(over.alias("o"), (-F.col("_r")).alias("r"))).alias("_v"))
    out = left.where(F.col(l_start).isNotNull() & F.col(l_end).isNotNull()).select(key, left_id).join(best.withColumnRenamed("_l", left_id), [key, left_id], "left")
    return out.select(key, left_id, F.coalesce("_v", F.lit(default)).alias(label))
