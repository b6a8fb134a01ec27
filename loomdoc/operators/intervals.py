"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Times become whole units and every entity's time line is cut into shards of ``shard`` units.  The marked
units of one entity in one shard are one run bitmap: a row that holds the bitmap's set runs in order, at most
``shard / 2`` of them however many rows cover the shard.  Rows that cover whole shards are kept as one
bitmap of full shards.  Union happens inside the shards; after it only one row a bitmap, its first and last run,
meets the entity's other bitmaps, to tell which runs go on across a shard's border.  Set runs and
clear runs (the gaps) are then read off each bitmap by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows over more shards than this are a bitmap of full shards between their first and last one.
WIDE = 64


def to_units(seconds: Column, per_second: int = 1000) -> Column:
    """Whole units nearest to a time in seconds; null for null, NaN and infinite times."""
    d = seconds.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) > 9.0e14), None).otherwise(F.round(d * per_second)).cast("long")


def run_bitmaps(rows: DataFrame, keys: list[str], shard: int) -> DataFrame:
    """``*keys, _s0, _s1, _runs`` of rows ``*keys, _lo, _hi``: the set runs in order of the shards ``_s0`` to ``_s1`` (exclusive).

    ``_s1`` is ``_s0 + 1`` but for bitmaps of full shards, which hold one run.
    """
    first, last = F.floor(F.col("_lo") / shard), F.floor(F.greatest(F.col("_hi") - 1, F.col("_lo")) / shard)
    piece = lambda i: F.struct(i.alias("s0"), (i + 1).alias("s1"), F.greatest(F.col("_lo"), i * shard).alias("lo"), F.least(F.col("_hi"), (i + 1) * shard).alias("hi"))
    f, z = F.col("_first"), F.col("_last")
    full = F.struct((f + 1).alias("s0"), z.alias("s1"), ((f + 1) * shard).alias("lo"), (z * shard).alias("hi"))
    pieces = F.when(z - f > WIDE, F.array(piece(f), full, piece(z))).otherwise(F.transform(F.sequence(f, z), piece))
    p = rows.select("*", first.alias("_first"), last.alias("_last")).select(*keys, F.explode(pieces).alias("_p"))
    p = p.groupBy(*keys, F.col("_p.s0").alias("_s0"), F.col("_p.s1").alias("_s1"), F.col("_p.lo").alias("_lo")).agg(F.max("_p.hi").alias("_hi"))
    cell = [*keys, "_s0", "_s1"]
    w = Window.partitionBy(*cell).orderBy("_lo")
    reach = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("_new", F.when(reach.isNull() | (F.col("_lo") > reach), 1).otherwise(0))
    p = p.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = p.groupBy(*cell, "_run").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    return runs.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_runs"))


def interval_runs(
    df: DataFrame, keys: list[str], start: str, end: str, *, per_second: int = 1000, shard: int = 600_000, kinds: tuple[str, str] = ("period", "gap"),
) -> DataFrame:
    """Periods and gaps of each entity: ``*keys, kind, start_ms, end_ms``.

    A row counts if all keys and both times are present and finite and, before rounding, its end lies
    after its start; others are ignored, so an empty table or an entity without such a row gives no
    rows.  A row whose times round to the same unit marks no unit but still is a period where no other
    row touches it.  Touching rows continue a period, repeated rows change nothing, extra columns are
    dropped.  Names of key columns may be anything that does not begin with ``_``.
    """
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    keep = F.lit(True)
    for k in keys:
        keep = keep & F.col(k).isNotNull()
    rows = (
        df.where(keep & ~F.isnan(s) & ~F.isnan(e) & (e > s))
        .select(*keys, to_units(F.col(start), per_second).alias("_lo"), to_units(F.col(end), per_second).alias("_hi"))
        .where("_lo is not null and _hi is not null")
    )
    maps = run_bitmaps(rows, keys, shard)
    # from here on one row a bitmap: what full shards cover is dropped, then neighbours are compared
    wide = F.col("_s1") > F.col("_s0") + 1
    order = [F.asc("_s0"), F.desc(F.col("_s1"))]
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("_reach", F.max(F.when(wide, F.col("_s1"))).over(before))
    maps = maps.where(F.col("_reach").isNull() | (F.col("_s1") > F.col("_reach")))
    trimmed = F.greatest("_s0", "_reach")  # of a bitmap of full shards that overlaps an earlier one
    runs = F.when(trimmed > F.col("_s0"), F.array(F.struct((trimmed * shard).alias("lo"), F.element_at("_runs", -1)["hi"].alias("hi")))).otherwise(F.col("_runs"))
    maps = maps.select(*keys, trimmed.alias("_s0"), "_s1", runs.alias("_runs"))
    maps = maps.withColumn("_a", F.get("_runs", F.lit(0))).withColumn("_z", F.element_at("_runs", -1)).withColumn("_n", F.size("_runs"))
    meets = (F.lag("_s1").over(w) == F.col("_s0")) & (F.lag("_z").over(w)["hi"] == F.col("_a.lo"))
    maps = maps.withColumn("_on", F.coalesce(meets, F.lit(False)))  # the first run goes on from the bitmap before
    maps = maps.withColumn("_open", F.when((F.col("_n") > 1) | ~F.col("_on"), F.col("_z.lo")))
    maps = maps.withColumn("_from", F.last("_open", True).over(before)).withColumn("_off", F.coalesce(F.lead("_on").over(w), F.lit(False))).withColumn("_next", F.lead("_a").over(w)["lo"])
    each = maps.select(*keys, "_n", "_on", "_off", "_from", "_next", "_runs", F.posexplode("_runs").alias("_i", "_r"))
    ends = ~(F.col("_off") & (F.col("_i") == F.col("_n") - 1))
    lo = F.when(F.col("_on") & (F.col("_i") == 0), F.col("_from")).otherwise(F.col("_r.lo"))
    after = F.when(F.col("_i") < F.col("_n") - 1, F.get("_runs", F.col("_i") + 1)["lo"]).otherwise(F.col("_next"))
    out = F.array(
        F.when(ends, F.struct(F.lit(kinds[0]).alias("kind"), lo.alias("start_ms"), F.col("_r.hi").alias("end_ms"))),
        F.when(ends & after.isNotNull(), F.struct(F.lit(kinds[1]).alias("kind"), F.col("_r.hi").alias("start_ms"), after.alias("end_ms"))),
    )
    return each.select(*keys, F.explode(F.array_compact(out)).alias("_o")).select(*keys, "_o.kind", "_o.start_ms", "_o.end_ms")
