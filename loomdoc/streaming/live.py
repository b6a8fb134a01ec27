"""Structured Streaming forms of the sequence operators and of file conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.sources.converters import convert


def sessions(events: DataFrame, key: str, ts: str, *, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Islands of rows of one key without a silence longer than ``gap``; state is dropped once ``late`` has passed.

    The same frame works in batch and on a stream; on a stream rows later than the watermark are ignored.
    """
    return (
        events.withWatermark(ts, late)
        .groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_rows", "first_ts", "last_ts")
    )


def windowed_counts(events: DataFrame, kind: str, ts: str, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("w.start").alias("start_ts"), kind, "n_rows")


def watch_files(spark: SparkSession, folder: str, out: str, checkpoint: str, *, pattern: str = "*", max_rows: int = 500, max_col_width: int = 0):
    """Convert the files that are new in ``folder`` since the last run and append their documents to ``out``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    new = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    docs = convert(new, "path", "content", max_rows=max_rows, max_col_width=max_col_width)
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
