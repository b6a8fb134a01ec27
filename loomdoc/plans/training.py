"""Queries of the general training-data operators (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators.intervals import interval_runs
from loomdoc.operators.timestamps import normalise_timestamps, source_zones
from loomdoc.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    zones = table(spark, sf, "mailboxes").select("source", F.col("host_zone").alias("zone"))
    emails = table(spark, sf, "emails").select("email_id", "date_hdr", "source", "fetched_at")
    out = normalise_timestamps(emails, "date_hdr", source="source", seen="fetched_at", zones=zones, drop_void=True)
    return out.select("email_id", "utc_second").distinct()


def p1_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The zones of each archive as its local header dates and fetch times show them, beside the stated one."""
    boxes = table(spark, sf, "mailboxes").select("source", "host_zone")
    told = source_zones(table(spark, sf, "emails"), "date_hdr", "source", "fetched_at")
    return told.join(boxes, "source", "left").select("source", "zone", "host_zone", "violations", "rows", "zones")


def p1_estimated(spark: SparkSession, sf: str) -> DataFrame:
    """The emails' UTC seconds with no archive's zone stated: the estimate alone."""
    emails = table(spark, sf, "emails").select("email_id", "date_hdr", "source", "fetched_at")
    out = normalise_timestamps(emails, "date_hdr", source="source", seen="fetched_at", drop_void=True)
    return out.select("email_id", "utc_second").distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    segments = table(spark, sf, "diarized_segments").select("clip_id", "speaker", "start_s", "end_s")
    return interval_runs(segments, ["clip_id", "speaker"], "start_s", "end_s").select("clip_id", "speaker", "kind", "start_ms", "end_ms").distinct()


QUERIES = {"p1_found": p1_found, "p1_zones": p1_zones, "p1_estimated": p1_estimated, "p4_found": p4_found}

SQL = {
    "p4_found": """
WITH s AS (
  SELECT clip_id, speaker, CAST(round(start_s * 1000) AS BIGINT) AS lo, CAST(round(end_s * 1000) AS BIGINT) AS hi
  FROM diarized_segments
  WHERE clip_id IS NOT NULL AND speaker IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL
    AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s > start_s),
m AS (SELECT *, max(hi) OVER (PARTITION BY clip_id, speaker ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, speaker ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m),
p AS (SELECT clip_id, speaker, run, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY ALL),
n AS (SELECT *, lead(lo) OVER (PARTITION BY clip_id, speaker ORDER BY lo) AS nx FROM p)
SELECT clip_id, speaker, 'period' AS kind, lo AS start_ms, hi AS end_ms FROM n
UNION ALL
SELECT clip_id, speaker, 'gap', hi, nx FROM n WHERE nx IS NOT NULL
""",
}
