"""Queries of the file converters and the streaming operators, over texts of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.functions.text import STRIP, S, apply
from loomdoc.sources.converters import convert
from loomdoc.streaming.live import sessions, windowed_counts
from loomdoc.session import table


def mail_convert(spark, sf):
    """Each mail written as a message and read back."""
    head = F.concat(F.lit("Subject: test\nMessage-ID: <"), F.col("email_id").cast("string"), F.lit("@x>\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"))
    e = table(spark, sf, "emails").where("body is not null").select("email_id", F.concat(F.col("email_id").cast("string"), F.lit(".eml")).alias("source"), F.encode(F.concat(head, F.regexp_replace("body", "\r", "")), "UTF-8").alias("content"))
    out = convert(e)
    return out.select(F.regexp_extract("source", r"^(\d+)", 1).cast("long").alias("email_id"), F.get_json_object("frontmatter", "$.message_id").alias("message_id"), apply(F.col("content"), STRIP).alias("body"))


def json_convert(spark, sf):
    """Each event's properties as a JSON file and as the document it becomes."""
    e = table(spark, sf, "events").where("props is not null").select(F.concat(F.lit("event-number-"), F.col("event_id").cast("string"), F.lit(".json")).alias("source"), F.encode("props", "UTF-8").alias("content"))
    out = convert(e)
    at = lambda p: F.get_json_object("frontmatter", p)
    return out.select(F.regexp_extract("source", r"-(\d+)\.", 1).cast("long").alias("event_id"), at("$.key_count").cast("int").alias("key_count"), at("$.file_size").cast("int").alias("n_bytes"), "content")


def documents_convert(spark, sf):
    """Documents as files of the format they name; the converter's row of each, CSV tables with all their rows."""
    d = table(spark, sf, "documents").where("text is not null")
    ext = F.element_at(F.create_map(*[F.lit(x) for x in ("org", "org", "tex", "tex", "rst", "rst", "man", "1", "html", "html", "eml", "eml", "sub", "srt", "csv", "csv")]), F.col("converter"))
    d = d.select(F.concat(F.lit("document-"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce(ext, F.lit("org"))).alias("source"), F.encode("text", "UTF-8").alias("content"))
    return convert(d, max_rows=0).select("source", "converter", F.length("content").alias("n_chars"), F.col("error").isNull().alias("ok"))


def event_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions(e, "user_id", "ts", gap="1 hour").select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n_rows")


def event_days(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return windowed_counts(e, "event_type", "ts").select(F.unix_micros("start_ts").alias("start_us"), "event_type", "n_rows")


QUERIES = {f.__name__: f for f in (mail_convert, json_convert, documents_convert, event_sessions, event_days)}

SQL = {
    "mail_convert": rf"SELECT email_id, '<' || email_id || '@x>' AS message_id, regexp_replace(replace(body, chr(13), ''), '^{S}+|{S}+$', '', 'g') AS body FROM emails WHERE body IS NOT NULL",
    "json_convert": "SELECT event_id, CAST(len(json_keys(props)) AS INT) AS key_count, CAST(strlen(props) AS INT) AS n_bytes, array_to_string(list_transform(json_keys(props), lambda k: '- **' || k || '**: ' || coalesce(json_extract_string(props, '$.\"' || k || '\"'), 'None')), chr(10)) AS content FROM events WHERE props IS NOT NULL",
    "event_sessions": """
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n_rows FROM b GROUP BY user_id, s""",
    "event_days": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n_rows FROM events GROUP BY ALL",
}
