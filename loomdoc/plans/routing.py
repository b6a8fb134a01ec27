"""Queries of routing around models, repository totals and speaker alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.operators import models, sequence
from loomdoc.session import table


def page_route(spark, sf):
    p = table(spark, sf, "pdf_pages").groupBy("pdf_id", "page").agg(F.min("text").alias("text"), F.max("is_thin").alias("is_thin"))
    r = models.route_pages(F.lit(""), F.col("is_thin"), F.col("text"), ocr=True)
    return p.select("pdf_id", "page", r.alias("r")).select("pdf_id", "page", F.length("r.text").cast("int").alias("n_chars"), "r.ocr_used")


def language_route(spark, sf):
    d = table(spark, sf, "documents")
    r = models.route_speech(F.lit(None).cast("string"), F.lower("lang"), F.lit("en"), F.when(F.col("converter") == "yt", "parakeet-v2"))
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.language", models.resolve_alias(F.col("r.model")).alias("model"))


def language_votes(spark, sf):
    """The language of each source by the share of its documents."""
    d = table(spark, sf, "documents").where("lang is not null and source is not null").groupBy("source", F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    t = d.groupBy("source").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", F.col("n").cast("double")))).alias("m"))
    shares = F.transform_values("m", lambda k, v: v / F.col("all"))
    return t.select("source", models.detect_language(shares, F.lit(60.0)).alias("language"))


def corpus_totals(spark, sf):
    return models.repo_totals(table(spark, sf, "documents"), "doc_id", "text")


def aligned_turns(spark, sf):
    """Events of a user as text segments of two hours, the longest overlapping of their diarized parts as speaker, merged to turns."""
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).withColumn("e", F.col("t") + 7200)
    who = e.select("user_id", "event_id", (F.col("t") + 600).alias("s"), (F.col("t") + 4200).alias("z"), (F.col("event_id") % 3).cast("int").alias("label"))
    a = sequence.overlap_assign(e, who, "user_id", "event_id", "t", "e", "event_id", "s", "z", "label", bucket=3600.0)
    s = e.select("user_id", "event_id", "t", "event_type").join(a, ["user_id", "event_id"])
    runs = sequence.merge_runs(s, ["user_id"], ["t", "event_id"], "label", shard=F.floor(F.col("t") / 86_400), firsts={"first_event": "event_id"}, texts={"text": ("event_type", " ")})
    return runs.select("user_id", "label", "first_event", "text", "n_rows")


QUERIES = {f.__name__: f for f in (page_route, language_route, language_votes, corpus_totals, aligned_turns)}

SQL = {
    "page_route": "SELECT pdf_id, page, CAST(CASE WHEN thin AND t <> '' THEN length(t) ELSE 0 END AS INT) AS n_chars, coalesce(thin, false) AND coalesce(t <> '', false) AS ocr_used FROM (SELECT pdf_id, page, min(text) AS t, bool_or(is_thin) AS thin FROM pdf_pages GROUP BY ALL)",
    "language_route": "SELECT doc_id, l AS language, CASE WHEN converter = 'yt' THEN 'mlx-community/parakeet-tdt-0.6b-v2' WHEN l LIKE 'en%' THEN 'mlx-community/parakeet-tdt-0.6b-v3' ELSE 'mlx-community/Qwen3-ASR-1.7B-bf16' END AS model FROM (SELECT doc_id, converter, coalesce(nullif(lower(lang), ''), 'en') AS l FROM documents)",
    "language_votes": "WITH d AS (SELECT source, lower(lang) AS lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), t AS (SELECT source, sum(n) AS a, max((n, lang)) AS b FROM d GROUP BY source) SELECT source, CASE WHEN b[1] / a < 0.5 THEN 'en' ELSE b[2] END AS language FROM (SELECT source, a, [b[1]::VARCHAR, b[2]] AS c, b FROM t)".replace("b[1] / a", "CAST(c[1] AS DOUBLE) / a").replace("ELSE b[2]", "ELSE c[2]"),
    "corpus_totals": "SELECT count(doc_id) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words FROM documents",
    "aligned_turns": """
WITH e AS (SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events),
m AS (SELECT a.user_id, a.event_id, b.event_id AS r, CAST(b.event_id % 3 AS INT) AS label, least(a.t + 7200, b.t + 4200) - greatest(a.t, b.t + 600) AS ov FROM e a JOIN e b ON a.user_id = b.user_id),
x AS (SELECT user_id, event_id, arg_max(label, (ov, -r)) AS label FROM m WHERE ov > 0 GROUP BY ALL),
s AS (SELECT e.user_id, e.event_id, e.t, e.event_type, coalesce(x.label, 0) AS label FROM e LEFT JOIN x USING (user_id, event_id)),
n AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS f FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT user_id, label, arg_min(event_id, (t, event_id)) AS first_event, string_agg(event_type, ' ' ORDER BY t, event_id) AS text, count(*) AS n_rows FROM g GROUP BY user_id, run, label""",
}
