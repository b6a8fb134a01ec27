"""Queries of sequence, vector and catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.functions import meta
from loomdoc.operators import catalog, render, sequence, vectors
from loomdoc.session import table


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0)


def run_merge(spark, sf):
    """Runs of one event type of each user, cut into shards of a day."""
    return sequence.merge_runs(
        _events(spark, sf), ["user_id"], ["t", "event_id"], "event_type", shard=F.floor(F.col("t") / 86_400), firsts={"first_event": "event_id"}, sums={"total": "value"}, texts={"kinds": ("event_type", " ")},
    ).select("user_id", "event_type", "first_event", F.round("total", 4).alias("total"), "kinds", "n_rows")


def gap_merge(spark, sf):
    """Events as segments of an hour, merged per user and type across gaps of at most half an hour."""
    e = _events(spark, sf).withColumn("t_end", F.col("t") + 3600)
    return sequence.gap_merge(e, ["user_id"], "t", "t_end", "event_type", merge_gap=1800.0, order=["event_id"]).select("user_id", "event_type", F.round("t", 3).alias("t"), F.round("t_end", 3).alias("t_end"), "n_rows")


def diarization_merge(spark, sf):
    d = table(spark, sf, "diarized_segments").where("speaker is not null and start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s)")
    d = d.select("clip_id", "seg_id", "speaker", "start_s", "end_s").distinct()
    return sequence.gap_merge(d, ["clip_id"], "start_s", "end_s", "speaker", merge_gap=0.3, order=["end_s", "seg_id"]).select("clip_id", "speaker", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "n_rows")


def phrase_cut(spark, sf):
    """Events of a user as words of an hour; phrases of at most two days."""
    e = _events(spark, sf).withColumn("t_end", F.col("t") + 3600).withColumn("word", F.when(F.pmod("event_id", F.lit(7)) == 0, F.concat("event_type", F.lit("."))).otherwise(F.col("event_type")))
    p = sequence.cut_phrases(e, ["user_id"], ["t", "event_id"], "t", "t_end", "word", max_s=172_800.0, gap_s=86_400.0)
    return p.select("user_id", "phrase_no", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "text", "n_words")


def overlap_assign(spark, sf):
    """Orders of a customer against the ten days before each of the customer's urgent orders."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("d"))
    a = o.select("o_custkey", "o_orderkey", F.col("d").alias("s"), (F.col("d") + 20).alias("e"))
    b = o.where("o_orderpriority like '1%'").select("o_custkey", F.col("o_orderkey").alias("rid"), (F.col("d") - 10).alias("rs"), F.col("d").alias("re"), F.col("o_orderkey").alias("label"))
    return sequence.overlap_assign(a, b, "o_custkey", "o_orderkey", "s", "e", "rid", "rs", "re", "label", bucket=30.0)


def _segments(spark, sf):
    s = table(spark, sf, "transcript_segments").where("text is not null").select("seg_id", "clip_id", "start_s", "end_s", "speaker", "text").distinct()
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return s.withColumn("start_ms", ms("start_s")).withColumn("end_ms", F.coalesce(ms("end_s"), ms("start_s")))


def dialog_srt(spark, sf):
    return render.segments_srt(_segments(spark, sf), "clip_id", ["start_ms", "seg_id"], "start_ms", "end_ms", "text")


def dialog_markdown(spark, sf):
    return render.segments_markdown(_segments(spark, sf).withColumn("s", F.col("start_ms") / 1000.0), "clip_id", ["start_ms", "seg_id"], "s", "text", speaker="speaker")


def dialog_text(spark, sf):
    return render.segments_text(_segments(spark, sf), "clip_id", ["start_ms", "seg_id"], "text", speaker="speaker")


def timestamp_formats(spark, sf):
    s = table(spark, sf, "diarized_segments").where("start_s is not null and not isnan(start_s)").select("seg_id", F.round(F.col("start_s") * 1000).cast("long").alias("ms")).distinct()
    return s.select("seg_id", "ms", meta.clock(F.col("ms") / 1000.0).alias("md"), meta.clock_srt(F.col("ms")).alias("srt"))


def speaker_order(spark, sf):
    """Distinct speaker labels of each clip in the order in which they first speak."""
    s = _segments(spark, sf).where("speaker is not null").groupBy("clip_id", "speaker").agg(F.min(F.struct("start_ms", "seg_id")).alias("o"))
    return s.groupBy("clip_id").agg(render.joined(F.col("speaker"), F.col("o"), ", ").alias("speakers"))


def attendance(spark, sf):
    d = table(spark, sf, "diarized_segments").where("speaker is not null and end_s > start_s and not isnan(end_s) and not isnan(start_s)").distinct()
    return d.groupBy("clip_id", "speaker").agg(F.round(F.sum(F.col("end_s") - F.col("start_s")), 3).alias("seconds"), F.count(F.lit(1)).alias("n_segments"))


def page_dates(spark, sf):
    d = table(spark, sf, "emails").where("date_hdr is not null").select("email_id", "date_hdr")
    return d.select("email_id", meta.pdf_date(F.col("date_hdr")).alias("date"))


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def vec_normalize(spark, sf):
    n = vectors.normalize(vectors.doubles(F.col("embedding")))
    return _emb(spark, sf).select("vec_id", F.round(vectors.norm(n), 6).alias("norm"), F.round(F.get(n, F.lit(0)), 6).alias("x0"))


def centroid_stats(spark, sf):
    c = vectors.mean_vectors(_emb(spark, sf), "label", "embedding")
    s = vectors.distance_stats(_emb(spark, sf), "label", "embedding", c)
    return s.select("label", "enrollment_count", F.round("mean_distance", 6).alias("mean_distance"), F.round("std_distance", 6).alias("std_distance"))


def speaker_classify(spark, sf):
    c = vectors.mean_vectors(_emb(spark, sf), "label", "embedding")
    m = vectors.nearest_centroid(_emb(spark, sf), "vec_id", "embedding", c, "label", threshold=2.0)
    return m.select("vec_id", "label", F.round("distance", 6).alias("distance"), vectors.classify(F.round("distance", 6)).alias("confidence"))


def _catalog(spark, sf):
    """Enrollments, and of the speakers those in 20 meetings or more: the filter of the matching queries."""
    return table(spark, sf, "enrollments").select("enrollment_id", "speaker_id", "embedding"), table(spark, sf, "speakers").where("meeting_count >= 20")


def knn_top5(spark, sf):
    """The five nearest enrollments of the filtered speakers to the centroid of every speaker."""
    e, s = _catalog(spark, sf)
    n = vectors.nearest_enrollments(table(spark, sf, "speakers").select(F.col("id").alias("vec_id"), "centroid"), "vec_id", "centroid", e, s)
    return n.select("vec_id", "rank", "enrollment_id", "speaker_id", F.round("distance", 6).alias("distance"))


def speaker_identify(spark, sf):
    """The filtered speaker that the centroid of every speaker is matched with, and how surely."""
    e, s = _catalog(spark, sf)
    m = vectors.match_speaker(table(spark, sf, "speakers").select(F.col("id").alias("vec_id"), "centroid"), "vec_id", "centroid", e, s, threshold=vectors.LOW)
    return m.select("vec_id", "speaker_id", "name", "enrollment_id", F.round("distance", 6).alias("distance"), vectors.classify(F.round("distance", 6)).alias("confidence"))


def gallery_prune(spark, sf):
    e = table(spark, sf, "enrollments").where("enrollment_id is not null and speaker_id is not null").select("enrollment_id", "speaker_id", "created_at").distinct()
    kept = vectors.prune_gallery(e, "speaker_id", [F.desc_nulls_last("created_at"), F.asc("enrollment_id"), F.desc_nulls_last("created_at")])
    return kept.select("speaker_id", "enrollment_id")


def group_member_counts(spark, sf):
    g = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    m = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("speaker_id"))
    return catalog.group_counts(g, m)


def group_members(spark, sf):
    """Suppliers of each nation by name, as pairs: a group may have any number of members."""
    g = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    m = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("speaker_id"))
    return catalog.group_members(g, m, s)


def correlated_count(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").select("n_name", F.coalesce("k", F.lit(0)).cast("long").alias("customers"))


def next_unknown(spark, sf):
    return catalog.next_unknown(table(spark, sf, "speakers"))


def speakers_by_name(spark, sf):
    return table(spark, sf, "speakers").select("id", "name", F.coalesce(F.substring("last_seen_at", 1, 10), F.lit("-")).alias("last_seen"))


QUERIES = {f.__name__: f for f in (
    run_merge, gap_merge, diarization_merge, phrase_cut, overlap_assign, dialog_srt, dialog_markdown, dialog_text, timestamp_formats, speaker_order, attendance, page_dates, vec_normalize,
    centroid_stats, speaker_classify, knn_top5, speaker_identify, gallery_prune, group_member_counts, group_members, correlated_count, next_unknown, speakers_by_name,
)}

_E = "SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events"
_N = "list_transform(embedding, lambda x: x::DOUBLE)"
_SEG = "SELECT DISTINCT seg_id, clip_id, start_s, end_s, speaker, text, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, coalesce(CAST(round(end_s * 1000) AS BIGINT), CAST(round(start_s * 1000) AS BIGINT)) AS end_ms FROM transcript_segments WHERE text IS NOT NULL"
_SRT = lambda m: f"lpad(CAST({m} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({m} % 1000 AS VARCHAR), 3, '0')"
_MD = lambda m: f"CASE WHEN {m} >= 3600000 THEN lpad(CAST({m} // 3600000 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST({m} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} // 1000 % 60 AS VARCHAR), 2, '0')"


def _gap(source: str, key: str, start: str, end: str, speaker: str, order: str, gap: float) -> str:
    return f"""
WITH d AS ({source}),
a AS (SELECT *, CASE WHEN {speaker} IS NOT DISTINCT FROM lag({speaker}) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS turn FROM d WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
b AS (SELECT *, sum(turn) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, max({end}) OVER (PARTITION BY {key}, run ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
e AS (SELECT *, sum(CASE WHEN reach IS NULL OR {start} - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, run ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS part FROM c)
SELECT {key}, {speaker}, round(min({start}), 3) AS {start}, round(max({end}), 3) AS {end}, count(*) AS n_rows FROM e GROUP BY {key}, run, part, {speaker}"""


_CENT = f"""
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, label, {_N} AS v FROM embeddings)),
p AS (SELECT label, i, avg(v[i]) AS m FROM u, range(1, (SELECT max(len(embedding)) FROM embeddings) + 1) AS r(i) GROUP BY ALL),
m AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY label),
k AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM m)"""

_KNN = """
b AS (SELECT enrollment_id, min(speaker_id) AS speaker_id, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM enrollments
  WHERE enrollment_id IS NOT NULL AND len(embedding) > 0 AND speaker_id IN (SELECT id FROM speakers WHERE meeting_count >= 20) GROUP BY enrollment_id),
q AS (SELECT id AS vec_id, list_transform(centroid, lambda x: x::DOUBLE) AS v FROM speakers WHERE len(centroid) > 0),
bu AS (SELECT enrollment_id, speaker_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM b WHERE sqrt(list_dot_product(v, v)) >= 1e-10),
qu AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM q WHERE sqrt(list_dot_product(v, v)) >= 1e-10),
d AS (SELECT vec_id, enrollment_id, speaker_id, round(CASE WHEN len(qu.v) = len(bu.v) THEN 1 - list_dot_product(qu.v, CASE WHEN len(qu.v) = len(bu.v) THEN bu.v ELSE qu.v END) END, 12) AS distance FROM qu, bu),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, enrollment_id) AS INT) AS rank FROM d WHERE distance IS NOT NULL QUALIFY rank <= 5)"""

SQL = {
    "run_merge": f"""
WITH e AS ({_E}), a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, event_type, arg_min(event_id, (t, event_id)) AS first_event, round(sum(value), 4) AS total, string_agg(event_type, ' ' ORDER BY t, event_id) AS kinds, count(*) AS n_rows FROM b GROUP BY user_id, run, event_type""",
    "gap_merge": _gap("SELECT *, t + 3600 AS t_end FROM (" + _E + ")", "user_id", "t", "t_end", "event_type", "t, event_id", 1800.0),
    "diarization_merge": _gap("SELECT DISTINCT clip_id, seg_id, speaker, start_s, end_s FROM diarized_segments WHERE speaker IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)", "clip_id", "start_s", "end_s", "speaker", "start_s, end_s, seg_id", 0.3),
    "phrase_cut": f"""
WITH RECURSIVE w AS (SELECT user_id, t AS s, t + 3600 AS e, CASE WHEN event_id % 7 = 0 THEN event_type || '.' ELSE event_type END AS x, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ({_E})),
r AS (SELECT user_id, i, s, e, x, s AS frm, 1 AS ph FROM w WHERE i = 1
 UNION ALL SELECT w.user_id, w.i, w.s, w.e, w.x,
  CASE WHEN right(r.x, 1) IN ('。','！','？','.','!','?') OR w.s - r.e > 86400.0 OR w.e - r.frm > 172800.0 THEN w.s ELSE r.frm END,
  r.ph + CASE WHEN right(r.x, 1) IN ('。','！','？','.','!','?') OR w.s - r.e > 86400.0 OR w.e - r.frm > 172800.0 THEN 1 ELSE 0 END
  FROM r JOIN w ON w.user_id = r.user_id AND w.i = r.i + 1)
SELECT user_id, CAST(ph AS INT) AS phrase_no, round(min(s), 3) AS start_s, round(arg_max(e, i), 3) AS end_s, string_agg(x, ' ' ORDER BY i) AS text, CAST(count(*) AS INT) AS n_words FROM r GROUP BY user_id, ph""",
    "overlap_assign": """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders),
m AS (SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS label, least(a.d + 20, b.d) - greatest(a.d, b.d - 10) AS ov FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderpriority LIKE '1%'),
t AS (SELECT o_custkey, o_orderkey, arg_max(label, (ov, -label)) AS label FROM m WHERE ov > 0 GROUP BY ALL)
SELECT o.o_custkey, o.o_orderkey, coalesce(t.label, 0) AS label FROM o LEFT JOIN t USING (o_custkey, o_orderkey)""",
    "dialog_srt": f"SELECT clip_id, string_agg(n || chr(10) || {_SRT('start_ms')} || ' --> ' || {_SRT('end_ms')} || chr(10) || trim(text), chr(10) || chr(10) ORDER BY n) AS content FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms, seg_id) AS n FROM ({_SEG})) GROUP BY clip_id",
    "dialog_markdown": f"SELECT clip_id, string_agg('**' || CASE WHEN speaker IS NULL THEN '[' || {_MD('start_ms')} || ']**' ELSE speaker || '** [' || {_MD('start_ms')} || ']' END || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY start_ms, seg_id) AS content FROM ({_SEG}) GROUP BY clip_id",
    "dialog_text": f"SELECT clip_id, string_agg(coalesce(speaker || ': ', '') || text, chr(10) || chr(10) ORDER BY start_ms, seg_id) AS content FROM ({_SEG}) GROUP BY clip_id",
    "timestamp_formats": f"SELECT seg_id, ms, {_MD('ms')} AS md, {_SRT('ms')} AS srt FROM (SELECT DISTINCT seg_id, CAST(round(start_s * 1000) AS BIGINT) AS ms FROM diarized_segments WHERE start_s IS NOT NULL AND NOT isnan(start_s))",
    "speaker_order": f"SELECT clip_id, string_agg(speaker, ', ' ORDER BY o) AS speakers FROM (SELECT clip_id, speaker, min((start_ms, seg_id)) AS o FROM ({_SEG}) WHERE speaker IS NOT NULL GROUP BY ALL) GROUP BY clip_id",
    "attendance": "SELECT clip_id, speaker, round(sum(end_s - start_s), 3) AS seconds, count(*) AS n_segments FROM (SELECT DISTINCT * FROM diarized_segments WHERE speaker IS NOT NULL AND end_s > start_s AND NOT isnan(end_s) AND NOT isnan(start_s)) GROUP BY ALL",
    "page_dates": "SELECT email_id, coalesce(strftime(try_strptime(substr(regexp_replace(date_hdr, '^[D:]+', ''), 1, 8), '%Y%m%d'), '%Y-%m-%d'), date_hdr) AS date FROM emails WHERE date_hdr IS NOT NULL",
    "vec_normalize": f"SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS norm, round(u[1], 6) AS x0 FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT vec_id, {_N} AS v FROM embeddings))",
    "centroid_stats": f"WITH {_CENT}, d AS (SELECT label, 1 - list_dot_product(u.v, k.c) AS d FROM u JOIN k USING (label)) SELECT label, count(*) AS enrollment_count, round(avg(d), 6) AS mean_distance, round(stddev_pop(d), 6) AS std_distance FROM d GROUP BY label",
    "speaker_classify": f"""WITH {_CENT}, d AS (SELECT vec_id, min((round(1 - list_dot_product(u.v, k.c), 12), k.label)) AS b FROM u, k GROUP BY vec_id), r AS (SELECT vec_id, b[2] AS label, round(b[1], 6) AS distance FROM (SELECT vec_id, [b[1]::DOUBLE, b[2]::DOUBLE] AS b FROM d))
SELECT vec_id, CAST(label AS INT) AS label, distance, CASE WHEN distance <= 0.15 THEN 'high' WHEN distance <= 0.3 THEN 'medium' ELSE 'none' END AS confidence FROM r""",
    "knn_top5": f"WITH {_KNN} SELECT vec_id, rank, enrollment_id, speaker_id, round(distance, 6) AS distance FROM t",
    "speaker_identify": f"""WITH {_KNN}, m AS (SELECT vec_id, t.speaker_id, name, enrollment_id, round(distance, 6) AS distance FROM t JOIN speakers ON id = t.speaker_id WHERE rank = 1 AND distance <= 0.3)
SELECT id AS vec_id, speaker_id, m.name, enrollment_id, distance, CASE WHEN distance <= 0.15 THEN 'high' WHEN distance <= 0.3 THEN 'medium' ELSE 'none' END AS confidence FROM speakers LEFT JOIN m ON vec_id = id""",
    "gallery_prune": "SELECT speaker_id, enrollment_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY created_at DESC NULLS LAST, enrollment_id) AS r FROM (SELECT DISTINCT enrollment_id, speaker_id, created_at FROM enrollments WHERE enrollment_id IS NOT NULL AND speaker_id IS NOT NULL)) WHERE r <= 20",
    "group_member_counts": "SELECT n_name AS name, count(c_custkey) AS member_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_name",
    "group_members": "SELECT n_name AS group_name, s_name AS member FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "correlated_count": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation",
    "next_unknown": "SELECT 'Unknown_' || (coalesce(max(CASE WHEN regexp_matches(name, '^Unknown_\\d+$') THEN CAST(substr(name, 9) AS INT) END), -1) + 1) AS name FROM speakers",
    "speakers_by_name": "SELECT id, name, coalesce(substr(last_seen_at, 1, 10), '-') AS last_seen FROM speakers",
}
