"""Queries of the speaker catalog: changes through its own methods, identification, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.functions import meta
from loomdoc.operators import catalog, render, vectors
from loomdoc.session import table

AT = "2024-06-01T00:00:00Z"


def _enrollments(spark, sf):
    """Enrollments under the catalog's names, one row an id: of different rows the first in order of all columns."""
    e = table(spark, sf, "enrollments").where("enrollment_id is not null").select("enrollment_id", "speaker_id", "segment_start", "segment_end", "created_at", "source_file", "embedding").distinct()
    w = catalog.Window.partitionBy("enrollment_id").orderBy("speaker_id", "segment_start", "segment_end", "created_at", "source_file", "embedding")
    return e.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumnRenamed("enrollment_id", "id")


def _catalog(spark, sf):
    c = catalog.Catalog.empty(spark)
    e = _enrollments(spark, sf)
    for n, kind in c.frames["enrollments"].dtypes:
        if n not in e.columns:
            e = e.withColumn(n, F.lit(None).cast(kind))
    return catalog.Catalog(c.frames | {"speakers": table(spark, sf, "speakers"), "enrollments": e.select(*c.frames["enrollments"].columns)})


def _ends(c):
    r = c.frames["speakers"].agg(F.min("name").alias("a"), F.max("name").alias("z")).first()
    return r.a, r.z


def merge_speakers(spark, sf):
    """Enrollments of each speaker after the one with the smallest name became the one with the largest."""
    c = _catalog(spark, sf)
    f = c.frames
    _, e, _ = catalog.merge_speakers(f["speakers"], f["enrollments"], f["speaker_merges"], *_ends(c), reason=None, merged_at=AT)
    return e.where("speaker_id is not null").groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n"))


def merged_catalog(spark, sf):
    """Speakers and their counts after a merge, a removal and a new name, derived columns told anew where they changed."""
    c = _catalog(spark, sf)
    a, z = _ends(c)
    c = c.merge(a, z, AT).add_speaker("Zz New", AT, "new-1")
    second = c.frames["speakers"].agg(F.min("name").alias("n")).first().n
    c = c.remove_speaker(second)
    return c.frames["speakers"].select("id", "name", "enrollment_count", "updated_at")


def merge_audit(spark, sf):
    c = _catalog(spark, sf)
    return c.merge(*_ends(c), AT, reason="same voice").frames["speaker_merges"].select("from_speaker", "to_speaker", "reason", "merged_at")


def pruned_counts(spark, sf):
    """Counts of all speakers once each gallery keeps its newest twenty."""
    return _catalog(spark, sf).pruned(AT).frames["speakers"].select("id", "enrollment_count", F.round("mean_distance", 5).alias("mean_distance"))


def group_show(spark, sf):
    """A group of three speakers after one of them was added twice and another taken out."""
    c = _catalog(spark, sf)
    names = [r.name for r in c.frames["speakers"].orderBy("name").limit(3).collect()]
    c = c.create_group("team", AT, "g1").create_group("empty", AT, "g2")
    for n in [*names, names[0]]:
        c = c.add_member("team", n, AT)
    c = c.remove_member("team", names[1])
    return c.members("team").select("name", "added_at")


def group_list(spark, sf):
    c = _catalog(spark, sf)
    names = [r.name for r in c.frames["speakers"].orderBy("name").limit(3).collect()]
    c = c.create_group("team", AT, "g1").create_group("empty", AT, "g2").create_group("gone", AT, "g3")
    for n in names:
        c = c.add_member("team", n, AT).add_member("gone", n, AT)
    return c.delete_group("gone").groups()


def names_resolved(spark, sf):
    """A list of names and a group as the names it means."""
    c = _catalog(spark, sf)
    names = [r.name for r in c.frames["speakers"].orderBy("name").limit(4).collect()]
    c = c.create_group("team", AT, "g1")
    for n in names[:3]:
        c = c.add_member("team", n, AT)
    return c.named(f"{names[3]}, @team, {names[0]}, Somebody")


def speaker_listing(spark, sf):
    s = table(spark, sf, "speakers").select("name", F.col("enrollment_count").alias("n"), F.coalesce(F.substring("last_seen_at", 1, 10), F.lit("-")).alias("seen"))
    return render.fixed_table(s, ["name", "n", "seen"], ["name"], max_rows=100_000)


def _meetings(spark, sf):
    """Enrollments as the segments of meetings: a source file is a meeting, a speaker id the label."""
    return _enrollments(spark, sf).where("segment_start is not null and segment_end is not null and source_file is not null and speaker_id is not null and size(embedding) = 256")


def weighted_centroid(spark, sf):
    """Mean vectors by duration of all labels, as the checksum of their rounded numbers."""
    c = vectors.weighted_mean(_meetings(spark, sf), "speaker_id", "embedding", "segment_start", "segment_end")
    return c.select("speaker_id", F.md5(F.array_join(F.transform("centroid", lambda x: F.round(x * 100_000).cast("long").cast("string")), ",")).alias("centroid_md5"))


def identify_map(spark, sf):
    """Who the labels of every meeting are."""
    seg = _meetings(spark, sf).withColumnRenamed("speaker_id", "label")
    found = catalog.identify(seg, "source_file", "label", "embedding", "segment_start", "segment_end", _catalog(spark, sf))
    return found.select("source_file", "label", "name", "matched", F.round("distance", 5).alias("distance"), "high_conf")


def vector_blobs(spark, sf):
    """Vectors written as bytes and read back."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", catalog.to_blob(F.col("embedding")).alias("b"))
    return e.select("vec_id", F.octet_length("b").cast("int").alias("n_bytes"), (catalog.from_blob(F.col("b")) == F.col("embedding")).alias("same"))


def page_fields(spark, sf):
    p = table(spark, sf, "web_pages").where("html is not null")
    return p.select("page_id", meta.page_fields(F.col("html"), F.col("url")).alias("f")).select("page_id", "f.title", "f.description", "f.author", "f.sitename")


def input_kinds(spark, sf):
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", F.concat_ws(".", "source", "converter").alias("path"), (F.col("doc_id") % 2 == 0).alias("there"))
    return d.select("doc_id", meta.input_kind(F.col("path"), F.col("there")).alias("kind"))


QUERIES = {f.__name__: f for f in (
    merge_speakers, merged_catalog, merge_audit, pruned_counts, group_show, group_list, names_resolved, speaker_listing, weighted_centroid, identify_map, vector_blobs, page_fields, input_kinds,
)}

_E = """e AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY enrollment_id ORDER BY speaker_id NULLS FIRST, segment_start NULLS FIRST, segment_end NULLS FIRST, created_at NULLS FIRST, source_file NULLS FIRST, embedding NULLS FIRST) AS r
  FROM (SELECT DISTINCT enrollment_id, speaker_id, segment_start, segment_end, created_at, source_file, embedding FROM enrollments WHERE enrollment_id IS NOT NULL)) WHERE r = 1)"""
_M = "m AS (SELECT * FROM e WHERE segment_start IS NOT NULL AND segment_end IS NOT NULL AND source_file IS NOT NULL AND speaker_id IS NOT NULL AND len(embedding) = 256 AND list_dot_product(embedding, embedding) > 0)"
_I = "i AS (SELECT arg_min(id, name) AS f, arg_max(id, name) AS t FROM speakers)"


def _mean(key: str) -> str:
    return f"""
x AS (SELECT {key}, greatest(segment_end - segment_start, 1e-6) AS w, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM m),
p AS (SELECT {key}, i, sum(v::DOUBLE * w) / sum(w) AS a FROM x GROUP BY ALL),
c0 AS (SELECT {key}, list(a ORDER BY i) AS c FROM p GROUP BY ALL),
c AS (SELECT {key}, list_transform(c, lambda y: y / sqrt(list_dot_product(c, c))) AS c FROM c0)"""


_TAG = lambda first, second: f"(?i)<meta[\\s]+{first}{second}"


def _meta_sql(name: str) -> str:
    kinds = [
        rf"""(?i)<meta\s+name=["'](?:og:)?{name}["']\s+content=["']([^"']*)["']""", rf"""(?i)<meta\s+content=["']([^"']*)["'][^>]*name=["'](?:og:)?{name}["']""",
        rf"""(?i)<meta\s+property=["']og:{name}["']\s+content=["']([^"']*)["']""", rf"""(?i)<meta\s+content=["']([^"']*)["'][^>]*property=["']og:{name}["']""",
    ]
    lit = lambda k: "'" + k.replace("'", "''") + "'"
    return "nullif(coalesce(" + ", ".join(f"CASE WHEN regexp_matches(html, {lit(k)}) THEN trim(regexp_extract(html, {lit(k)}, 1)) END" for k in kinds) + "), '')"


SQL = {
    "merge_speakers": f"WITH {_I}, {_E} SELECT CASE WHEN speaker_id = f THEN t ELSE speaker_id END AS speaker_id, count(*) AS n FROM e, i WHERE speaker_id IS NOT NULL GROUP BY 1",
    "merged_catalog": f"""
WITH {_I}, {_E}, n AS (SELECT count(*) AS n FROM e, i WHERE speaker_id IN (f, t)), r AS (SELECT min(name) AS gone FROM speakers, i WHERE id <> f)
SELECT id, name, CAST(CASE WHEN id = t THEN n ELSE enrollment_count END AS INT) AS enrollment_count, CASE WHEN id = t THEN '{AT}' ELSE updated_at END AS updated_at FROM speakers, i, n, r WHERE id <> f AND name <> gone
UNION ALL SELECT 'new-1', 'Zz New', 0, '{AT}'""",
    "merge_audit": f"WITH {_I} SELECT f AS from_speaker, t AS to_speaker, 'same voice' AS reason, '{AT}' AS merged_at FROM i",
    "pruned_counts": f"""
WITH {_E}, k AS (SELECT * FROM e WHERE speaker_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY created_at DESC NULLS LAST, enrollment_id DESC) <= 20),
n AS (SELECT speaker_id, count(*) AS n FROM k GROUP BY 1),
u AS (SELECT enrollment_id, speaker_id, CASE WHEN sqrt(list_dot_product(v, v)) < 1e-10 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS v FROM (SELECT enrollment_id, speaker_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM k WHERE embedding IS NOT NULL)),
p AS (SELECT speaker_id, i, avg(x) AS a FROM (SELECT speaker_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY ALL),
c0 AS (SELECT speaker_id, list(a ORDER BY i) AS c FROM p GROUP BY 1), c AS (SELECT speaker_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c0),
d AS (SELECT speaker_id, avg(CASE WHEN len(v) = len(c) THEN 1 - list_dot_product(v, CASE WHEN len(v) = len(c) THEN c ELSE v END) END) AS d FROM u JOIN c USING (speaker_id) GROUP BY 1)
SELECT id, CAST(coalesce(n, 0) AS INT) AS enrollment_count, round(d, 5) AS mean_distance FROM speakers LEFT JOIN n ON n.speaker_id = id LEFT JOIN d ON d.speaker_id = id""",
    "group_show": f"SELECT name, '{AT}' AS added_at FROM (SELECT name, row_number() OVER (ORDER BY name) AS r FROM speakers) WHERE r IN (1, 3)",
    "group_list": "SELECT * FROM (VALUES ('empty', 0::BIGINT), ('team', 3::BIGINT)) AS v(name, member_count)",
    "names_resolved": "SELECT CAST(CASE WHEN r = 4 THEN 1 ELSE r + 1 END AS INT) AS pos, name FROM (SELECT name, row_number() OVER (ORDER BY name) AS r FROM speakers) WHERE r <= 4 UNION ALL SELECT 5, 'Somebody'",
    "speaker_listing": """
WITH s AS (SELECT name, coalesce(CAST(enrollment_count AS VARCHAR), '-') AS n, coalesce(substr(last_seen_at, 1, 10), '-') AS d FROM speakers), w AS (SELECT CAST(greatest(4, max(length(name))) AS INT) AS a, CAST(greatest(1, max(length(n))) AS INT) AS b, CAST(greatest(4, max(length(d))) AS INT) AS c FROM s)
SELECT rpad('name', a, ' ') || '  ' || rpad('n', b, ' ') || '  ' || rpad('seen', c, ' ') || chr(10) || repeat('-', a) || '  ' || repeat('-', b) || '  ' || repeat('-', c) || chr(10) || t AS content
FROM w, (SELECT string_agg(rpad(name, a, ' ') || '  ' || rpad(n, b, ' ') || '  ' || rpad(d, c, ' '), chr(10) ORDER BY name) AS t FROM s, w)""",
    "weighted_centroid": f"WITH {_E}, {_M}, {_mean('speaker_id')} SELECT speaker_id, md5(array_to_string(list_transform(c, lambda y: CAST(CAST(round(y * 100000) AS BIGINT) AS VARCHAR)), ',')) AS centroid_md5 FROM c",
    "identify_map": f"""
WITH {_E}, {_M}, {_mean('source_file, speaker_id')},
b AS (SELECT enrollment_id, speaker_id AS who, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM e WHERE len(embedding) = 256 AND speaker_id IN (SELECT id FROM speakers) AND list_dot_product(embedding, embedding) > 0),
bu AS (SELECT enrollment_id, who, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM b),
d AS (SELECT source_file, speaker_id, who, round(1 - list_dot_product(c.c, bu.v), 12) AS d FROM c, bu QUALIFY row_number() OVER (PARTITION BY source_file, speaker_id ORDER BY round(1 - list_dot_product(c.c, bu.v), 12), enrollment_id) = 1),
l AS (SELECT DISTINCT source_file, speaker_id FROM e WHERE segment_start IS NOT NULL AND segment_end IS NOT NULL AND source_file IS NOT NULL AND speaker_id IS NOT NULL AND len(embedding) = 256)
SELECT l.source_file, l.speaker_id AS label, coalesce(name, l.speaker_id) AS name, name IS NOT NULL AS matched, CASE WHEN name IS NOT NULL THEN round(abs(d), 5) END AS distance, coalesce(d <= 0.15, false) AS high_conf
FROM l LEFT JOIN d ON d.source_file = l.source_file AND d.speaker_id = l.speaker_id AND d <= 0.3 LEFT JOIN speakers ON id = who""",
    "vector_blobs": "SELECT vec_id, CAST(4 * len(embedding) AS INT) AS n_bytes, true AS same FROM embeddings",
    "page_fields": rf"""
SELECT page_id, coalesce({_meta_sql("title")}, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), '')) AS title, {_meta_sql("description")} AS description, {_meta_sql("author")} AS author,
 nullif(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1), '') AS sitename FROM web_pages WHERE html IS NOT NULL""",
    "input_kinds": r"""
SELECT doc_id, CASE WHEN regexp_matches(path, '(?:youtube\.com/(?:[^/\n\s]+/\S+/|(?:v|e(?:mbed)?)/|\S*?[?&]v=)|youtu\.be/)') OR regexp_matches(path, '^[A-Za-z0-9_-]{11}$') OR doc_id % 2 <> 0 THEN 'youtube' ELSE 'file' END AS kind
FROM (SELECT doc_id, concat_ws('.', source, converter) AS path FROM documents WHERE source IS NOT NULL)""",
}
