"""Speaker vectors: unit length, centroids, distances, nearest speakers, galleries; all in DOUBLE."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distances up to which a match is of high confidence or accepted, accepted in plain matching, and rows a gallery keeps.
HIGH, LOW, MATCH, KEEP = 0.15, 0.30, 0.55, 20
#: Most rows and queries (about) that one cell of the exact search compares.
CELL = 4096


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; unchanged where the length is below 1e-10."""
    n = norm(v)
    return F.when(n < 1e-10, v).otherwise(F.transform(v, lambda x: x / n))


#: Keys whose partial sums one task holds before it passes them on.
HELD = 4096


def _means(df: DataFrame, key: str, vec: str, weight: Column, unit: bool) -> DataFrame:
    """``key, centroid``: weighted means, position by position, scaled to unit length; ``unit`` scales each vector first.

    Tasks add up whole vectors by key in Arrow batches, so what is shuffled is one sum a key and task: a key with a third of
    all rows is combined before it is sent.  Vectors of one key may differ in length; null vectors and numbers do not count.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), weight.cast("double").alias("w"))
    schema = f"k {kind}, s array<double>, w array<double>"

    def table(held: dict) -> pa.RecordBatch:
        keys, sums = pa.array(list(held), type=arrow_key), list(held.values())
        return pa.RecordBatch.from_arrays([keys, pa.array([s for s, _ in sums], pa.list_(pa.float64())), pa.array([w for _, w in sums], pa.list_(pa.float64()))], ["k", "s", "w"])

    def add(held: dict, k: object, x: np.ndarray, w: np.ndarray) -> None:
        if k not in held:
            held[k] = x, w
            return
        s, t = held[k]
        if len(s) < len(x):
            (s, t), (x, w) = (x, w), (s, t)
        s, t = s.copy(), t.copy()
        s[: len(x)] += x
        t[: len(x)] += w
        held[k] = s, t

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            n = np.asarray(b.column("v").value_lengths())
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(n)))
            ks, ws = b.column("k").to_pylist(), b.column("w").to_numpy(zero_copy_only=False)
            groups: dict = {}
            for i, (k, m) in enumerate(zip(ks, n.tolist(), strict=True)):
                groups.setdefault((k, m), []).append(i)
            for (k, m), rows in groups.items():
                x = np.stack([flat[at[i] : at[i] + m] for i in rows]) if m else np.empty((len(rows), 0))
                w = np.repeat(ws[rows][:, None], m, axis=1)
                if unit:
                    size = np.sqrt(np.nansum(x * x, axis=1))[:, None]
                    x = np.where(size < 1e-10, x, x / np.maximum(size, 1e-300))
                w = np.where(np.isnan(x), 0.0, w)
                add(held, k, np.nansum(x * w, axis=0), w.sum(0))
            if len(held) > HELD:
                yield table(held)
                held = {}
        yield table(held)

    def total(t: pa.Table) -> pa.Table:
        held: dict = {}
        for s, w in zip(t.column("s").to_pylist(), t.column("w").to_pylist(), strict=True):
            add(held, 0, np.array(s, float), np.array(w, float))
        s, w = held[0]
        m = s / np.where(w == 0, np.nan, w)
        m = m[~np.isnan(m)]
        size = np.sqrt((m * m).sum())
        m = m if size < 1e-10 else m / size
        return pa.table({"k": t.column("k")[:1], "centroid": pa.array([m.tolist()], pa.list_(pa.float64()))})

    arrow_key = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16(), "double": pa.float64()}[kind]
    sums = rows.mapInArrow(partial, schema)
    return sums.groupBy("k").applyInArrow(total, f"k {kind}, centroid array<double>").where(F.size("centroid") > 0).withColumnRenamed("k", key)


def mean_vectors(df: DataFrame, key: str, vec: str, weight: Column | None = None) -> DataFrame:
    """``key, centroid``: the (weighted) mean of unit vectors, again of unit length."""
    return _means(df, key, vec, F.lit(1.0) if weight is None else weight, True)


def weighted_mean(df: DataFrame, key: str, vec: str, start: str, end: str) -> DataFrame:
    """Mean by duration (at least 1e-6); null and zero vectors do not count, a key without others has no row."""
    usable = df.where(F.col(vec).isNotNull() & (norm(doubles(F.col(vec))) >= 1e-10))
    return _means(usable, key, vec, F.greatest(F.col(end) - F.col(start), F.lit(1e-6)), False)


def distance_stats(df: DataFrame, key: str, vec: str, centroids: DataFrame) -> DataFrame:
    """``key, enrollment_count, mean_distance, std_distance`` (population) of cosine distances to the centroid."""
    d = df.join(centroids, key).select(key, (1 - dot(normalize(doubles(F.col(vec))), F.col("centroid"))).alias("_d"))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("enrollment_count"), F.avg("_d").alias("mean_distance"), F.stddev_pop("_d").alias("std_distance"))


def nearest_centroid(queries: DataFrame, query_id: str, vec: str, centroids: DataFrame, name: str, *, threshold: float = MATCH) -> DataFrame:
    """``query_id, name, distance``: the nearest centroid within ``threshold``, null where there is none; ties to the smaller name.

    An exact search in cells (:func:`knn`); the centroids may be any number.
    """
    best = knn(queries, query_id, vec, centroids, name, "centroid", k=1)
    ok = F.col("distance") <= threshold
    return queries.select(query_id).distinct().join(best, query_id, "left").select(query_id, F.when(ok, F.col(name)).alias(name), F.when(ok, F.col("distance")).alias("distance"))


def knn(queries: DataFrame, query_id: str, vec: str, base: DataFrame, base_id: str, base_vec: str, *, k: int = 5) -> DataFrame:
    """``query_id, base_id, distance, rank``: the ``k`` rows of ``base`` with the least cosine distance to each query.

    Exact: all pairs are compared, in cells of about ``CELL`` rows by ``CELL`` queries, so no task holds a whole side.
    Null ids and vectors that are null, empty, not finite or shorter than 1e-10 neither ask nor answer; vectors of
    different length are not compared.  Rows of one id count once.  Distances are rounded to 12 digits, ties go to the smaller id.
    """

    def side(df: DataFrame, key: str, v: str, asks: bool) -> DataFrame:
        d = df.select(F.col(key).cast("string").alias("id"), doubles(F.col(v)).alias("v"), F.lit(asks).alias("asks"))
        n = norm(F.col("v"))
        return d.where(F.col("id").isNotNull() & (F.size("v") > 0) & (n >= 1e-10) & (n < float("inf")))

    q, b = side(queries, query_id, vec, True), side(base, base_id, base_vec, False)
    nq, nb = (max(1, -(-d.count() // CELL)) for d in (q, b))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    asked = q.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("cell", F.col("cell") * nq + mine(nq))
    held = b.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("cell", mine(nb) * nq + F.col("cell"))

    def search(t: pa.Table) -> pa.Table:
        asks, ids = t.column("asks").to_numpy(), np.array(t.column("id").to_pylist(), object)
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        rows, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        rows = rows[np.unique(ids[rows], return_index=True)[1]]  # sorted by id: ties go to the smaller
        got: list[tuple] = []
        for i in range(0, len(ask) if len(rows) else 0, 256):
            d = np.round(1 - x[ask[i : i + 256]] @ x[rows].T, 12)
            m = min(k, len(rows))
            a, r = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m])
            order = np.lexsort((r, d[a, r], a))
            a, r = a[order], r[order]
            first = np.arange(len(a)) - np.searchsorted(a, a) < m
            a, r = a[first], r[first]
            got.append((ids[ask[i + a]], ids[rows[r]], d[a, r]))
        a, r, d = (np.concatenate(c) if got else [] for c in (zip(*got, strict=True) if got else ((), (), ())))
        return pa.table({"q": pa.array(a, pa.string()), "b": pa.array(r, pa.string()), "d": pa.array(d, pa.float64())})

    cells = asked.unionByName(held).groupBy("cell", F.size("v").alias("dim"))
    hits = cells.applyInArrow(search, "q string, b string, d double").groupBy("q", "b").agg(F.min("d").alias("d"))
    w = Window.partitionBy("q").orderBy("d", "b")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("q").cast(queries.schema[query_id].dataType).alias(query_id), F.col("b").cast(base.schema[base_id].dataType).alias(base_id), F.col("d").alias("distance"), "rank")


def nearest_enrollments(queries: DataFrame, query_id: str, vec: str, enrollments: DataFrame, speakers: DataFrame, *, k: int = 5) -> DataFrame:
    """``query_id, rank, enrollment_id, speaker_id, distance``: the ``k`` nearest enrollments among those of ``speakers``.

    A filter on speakers is the choice of the rows of ``speakers``; it holds before the nearest are taken.
    """
    e = enrollments.join(speakers.select(F.col("id").alias("speaker_id")).distinct(), "speaker_id", "left_semi")
    top = knn(queries, query_id, vec, e, "enrollment_id", "embedding", k=k)
    return top.join(e.groupBy("enrollment_id").agg(F.min("speaker_id").alias("speaker_id")), "enrollment_id").select(query_id, "rank", "enrollment_id", "speaker_id", "distance")


def match_speaker(queries: DataFrame, query_id: str, vec: str, enrollments: DataFrame, speakers: DataFrame, *, k: int = 5, threshold: float = MATCH) -> DataFrame:
    """``query_id, speaker_id, name, distance, enrollment_id`` of the nearest enrollment of ``speakers`` within ``threshold``, else nulls.

    A query that no enrollment can be compared with is matched with the centroids of speakers that count enrollments
    (``enrollment_id`` is null then).  ``speakers`` has ``id, name, centroid, enrollment_count``.
    """
    ids = queries.select(query_id).distinct()
    near = nearest_enrollments(queries, query_id, vec, enrollments, speakers, k=k).where("rank = 1").drop("rank")
    rest = queries.join(near.select(query_id), query_id, "left_anti")
    c = knn(rest, query_id, vec, speakers.where("enrollment_count > 0").select(F.col("id").alias("speaker_id"), "centroid"), "speaker_id", "centroid", k=1)
    best = near.unionByName(c.drop("rank"), allowMissingColumns=True).where(F.col("distance") <= threshold)
    named = best.join(speakers.select(F.col("id").alias("speaker_id"), "name"), "speaker_id")
    return ids.join(named, query_id, "left").select(query_id, "speaker_id", "name", "distance", "enrollment_id")


def classify(distance: Column) -> Column:
    """``high``, ``medium`` or ``none`` by distance."""
    return F.when(distance <= HIGH, "high").when(distance <= LOW, "medium").otherwise("none")


def prune_gallery(df: DataFrame, key: str, newest: list[Column], *, keep: int = KEEP) -> DataFrame:
    """The ``keep`` newest rows of each key; pruned per task before the shuffle by the window's group limit."""
    w = Window.partitionBy(key).orderBy(*newest)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
