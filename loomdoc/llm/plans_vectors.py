"""Queries on voice embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdoc.llm.neighbours import nearest
from loomdoc.session import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    enr = table(spark, sf, "enrollments").select("enrollment_id", "embedding")
    spk = table(spark, sf, "speakers").select("id", "centroid")
    return nearest(enr, "enrollment_id", "embedding", extra=spk, extra_id="id", extra_vec="centroid", k=5).select("vec_id", "neighbor_id")


QUERIES = {"p5_found": p5_found}

_UNIT = lambda c: f"list_transform({c}, lambda x: x::DOUBLE / sqrt(list_dot_product({c}, {c})))"

SQL: dict[str, str] = {
    # every vector against every other
    "p5_found": f"""
WITH e AS (SELECT enrollment_id AS id, list_transform(min(embedding), lambda x: x::DOUBLE) AS v FROM enrollments WHERE enrollment_id IS NOT NULL AND len(embedding) = 256 GROUP BY 1),
s AS (SELECT id, list_transform(centroid, lambda x: x::DOUBLE) AS v FROM speakers WHERE len(centroid) = 256),
b AS (SELECT id, {_UNIT("v")} AS v FROM e WHERE list_dot_product(v, v) > 0),
q AS (SELECT id, v, true AS own FROM b UNION ALL SELECT id, {_UNIT("v")}, false FROM s WHERE list_dot_product(v, v) > 0),
d AS (SELECT q.id AS vec_id, q.own, b.id AS neighbor_id, list_dot_product(q.v, b.v) AS s FROM q JOIN b ON NOT (q.own AND q.id = b.id))
SELECT vec_id, neighbor_id FROM d QUALIFY row_number() OVER (PARTITION BY own, vec_id ORDER BY s DESC, neighbor_id) <= 5""",
}
