"""The most similar vectors of every vector: inverted file, product-quantised residuals, exact rerank.

The coarse quantiser has two levels, ``LISTS`` centroids at most and a book of residuals that all of them
share, so the number of lists follows the number of rows (one for ``PER_LIST`` rows) while both levels are
fitted on a bounded sample.  Every vector is indexed and every vector is a query.  A vector lies in the list
of its nearest centroid; a query visits the lists that are within ``margin`` of the nearest, and more until
they hold ``reach`` rows.  Lists are searched in cells of at most ``CELL`` rows by ``CELL`` queries, so a list
that holds a third of all rows becomes many tasks.  In a cell asymmetric distance tables score the codes of all
rows and the best are reranked with their vectors.  A vector travels in full once, to its own list; the copies that
only ask travel in 16 bits a number (error of a cosine about 3e-6).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows and most queries of one cell.
CELL = 4096
#: Most rows that centroids and codebooks are fitted on; codebooks of residuals on the first ``BOOK_ROWS`` of them.
SAMPLE, BOOK_ROWS = 12_000, 4096
#: Rows a list, lists of the first level at most, and centroids of the second level at most (``LISTS`` x ``FINE`` lists in all).
PER_LIST, LISTS, FINE = 256, 1024, 256


@dataclass
class Quantiser:
    coarse: np.ndarray  # (c1, dim)
    fine: np.ndarray  # (c2, dim): list ``i * c2 + j`` is around ``coarse[i] + fine[j]``
    books: np.ndarray  # (parts, 256, dim / parts)

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def nearest(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``p`` nearest lists of each row, nearest first, and their squared distances (less the row's own length)."""
        c1, c2 = len(self.coarse), len(self.fine)
        p1 = min(p, c1)
        d = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        top = np.argpartition(d, p1 - 1, axis=1)[:, :p1]
        cross = 2 * self.coarse @ self.fine.T + (self.fine**2).sum(1)
        both = np.take_along_axis(d, top, 1)[:, :, None] + cross[top] - 2 * (x @ self.fine.T)[:, None, :]
        flat = both.reshape(len(x), p1 * c2)
        p = min(p, flat.shape[1])
        at = np.argpartition(flat, p - 1, axis=1)[:, :p]
        v = np.take_along_axis(flat, at, 1)
        order = np.argsort(v, axis=1, kind="stable")
        at, v = np.take_along_axis(at, order, 1), np.take_along_axis(v, order, 1)
        return np.take_along_axis(top, at // c2, 1) * c2 + at % c2, v

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.centre(lists)
        parts, _, w = self.books.shape
        out = np.empty((len(x), parts), np.uint8)
        for j in range(parts):
            b = self.books[j]
            out[:, j] = np.argmin((b * b).sum(1) - 2 * r[:, j * w : (j + 1) * w] @ b.T, axis=1)
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spread: bool) -> np.ndarray:
    """Lloyd's rounds from distance-weighted (``spread``) or uniform seeds."""
    k = min(k, len(x))
    if spread:
        c = np.empty((k, x.shape[1]), x.dtype)
        c[0] = x[rng.integers(len(x))]
        d = ((x - c[0]) ** 2).sum(1)
        for i in range(1, k):
            t = d.sum()
            c[i] = x[rng.choice(len(x), p=d / t)] if t > 0 else x[rng.integers(len(x))]
            d = np.minimum(d, np.maximum(0, (x * x).sum(1) - 2 * x @ c[i] + c[i] @ c[i]))
    else:
        c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(n[full])[:-1])), axis=0) / n[full, None]
    return c


def fit(x: np.ndarray, lists: int, parts: int = 32, rounds: int = 4, seed: int = 7) -> Quantiser:
    """A quantiser of about ``lists`` lists, fitted on the rows of ``x``."""
    rng = np.random.default_rng(seed)
    dim, c1 = x.shape[1], max(1, min(lists, LISTS, len(x)))
    c = _kmeans(x, c1, rounds, rng, spread=True)
    q = Quantiser(np.ascontiguousarray(c, np.float32), np.zeros((1, dim), np.float32), np.zeros((parts, 1, dim // parts), np.float32))
    c2 = min(FINE, -(-lists // c1))
    if c2 > 1:
        q.fine = np.ascontiguousarray(_kmeans(x - q.centre(q.nearest(x, 1)[0][:, 0]), c2, rounds, rng, spread=False), np.float32)
    res = x - q.centre(q.nearest(x, 1)[0][:, 0])
    res = res[rng.permutation(len(res))[:BOOK_ROWS]]
    w = dim // parts
    books = [_kmeans(np.ascontiguousarray(res[:, j * w : (j + 1) * w]), 256, rounds, rng, spread=False) for j in range(parts)]
    q.books = np.stack([np.pad(b, ((0, 256 - len(b)), (0, 0)), mode="edge") for b in books]).astype(np.float32)
    return q


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows of a list column, and their row numbers."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.asarray(a.value_lengths().fill_null(0))
    at = np.flatnonzero(n == dim)
    flat = a.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    norm = np.linalg.norm(flat.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return (flat[good] / norm[good, None]).astype(np.float32), at[good]


def _visits(q: Quantiser, y: np.ndarray, size: np.ndarray, k: int, probes: int, margin: float, reach: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, list) that the rows visit, and the nearest list of each row."""
    if exact:
        own = q.nearest(y, 1)[0][:, 0]
        held = np.flatnonzero(size)
        return np.repeat(np.arange(len(y)), len(held)), np.tile(held, len(y)), own
    top, d = q.nearest(y, probes)
    sizes = size[top]
    near = (d <= d[:, :1] + margin) | (np.cumsum(sizes, axis=1) - sizes < reach)
    near &= sizes > 0
    i, at = np.nonzero(near)
    i, ls = i, top[i, at]
    held = np.bincount(i, weights=size[ls], minlength=len(y))
    few = np.flatnonzero((held <= k) & (held < size.sum()))  # so few rows nearby that k are not sure to be among them
    for r in few.tolist():
        order = q.nearest(y[r : r + 1], len(q))[0][0]
        need = order[: int(np.searchsorted(np.cumsum(size[order]), k + 1)) + 1]
        more = need[~np.isin(need, ls[i == r]) & (size[need] > 0)]
        i, ls = np.append(i, np.full(len(more), r)), np.append(ls, more)
    return i, ls, top[:, 0]


def _short(y: np.ndarray) -> list[bytes]:
    """Unit vectors as 16-bit numbers behind their scale."""
    scale = np.maximum(np.abs(y).max(1), 1e-30).astype("<f4")
    n = np.rint(y / scale[:, None] * 32767).astype("<i2")
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, n, strict=True)]


def _long(raw: list[bytes], dim: int) -> np.ndarray:
    """The vectors of full and short form."""
    out = np.empty((len(raw), dim), np.float32)
    full = np.fromiter((len(r) == 4 * dim for r in raw), bool, len(raw))
    if full.any():
        out[full] = np.frombuffer(b"".join(r for r in raw if len(r) == 4 * dim), "<f4").reshape(-1, dim)
    if not full.all():
        a = np.frombuffer(b"".join(r for r in raw if len(r) != 4 * dim), np.uint8).reshape(-1, 4 + 2 * dim)
        out[~full] = np.ascontiguousarray(a[:, 4:]).view("<i2") * (np.ascontiguousarray(a[:, :4]).view("<f4") / 32767)
    return out


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, codes: np.ndarray, centre: np.ndarray, books: np.ndarray, k: int, rerank: int) -> Iterator[tuple]:
    """Top ``k`` of the cell for each query: asymmetric tables over all codes, then the cosines of the ``rerank`` best; ``xid`` ascends."""
    parts, _, w = books.shape
    m = len(x)
    r = min(rerank, m)
    for b in range(0, len(q), 256):
        y, ids = q[b : b + 256], qid[b : b + 256]
        s = np.repeat((y @ centre)[:, None], m, axis=1)
        for j in range(parts):
            s += (y[:, j * w : (j + 1) * w] @ books[j].T)[:, codes[:, j]]
        cand = np.sort(np.argpartition(-s, r - 1, axis=1)[:, :r], axis=1)
        exact = np.einsum("qrd,qd->qr", x[cand], y) if r < m else y @ x.T
        exact = np.where(xid[cand] == ids[:, None], -np.inf, exact)
        top = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        yield ids, xid[np.take_along_axis(cand, top, 1)], np.take_along_axis(exact, top, 1)


def nearest(
    base: DataFrame, base_id: str, base_vec: str, *, extra: DataFrame | None = None, extra_id: str = "id", extra_vec: str = "vec",
    k: int = 5, dim: int = 256, probes: int = 8, margin: float = 0.1, reach: int = 256, parts: int = 32, rerank: int = 48, lists: int | None = None, exact: bool = False,
) -> DataFrame:
    """``vec_id, neighbor_id, similarity``: the ``k`` rows of ``base`` most similar by cosine to each vector.

    Queries are all rows of ``base`` (never their own neighbour) and of ``extra``.  Usable is a vector of
    ``dim`` finite numbers that are not all zero under an id that is not null; others neither ask nor
    answer.  Repeated rows count once; of different vectors under one id each asks and answers and the best counts.
    Fewer than ``k`` neighbours come out only where fewer exist; equal similarities go to the smaller id.  Approximate: a
    neighbour in a list that is not visited, or whose code is not among the ``rerank`` best of a list, is missed; recall
    against brute force is measured in the tests.  ``exact`` visits every list and reranks every row: all pairs, in cells.
    Centroids and codebooks are fitted on at most ``SAMPLE`` distinct ids chosen by a hash of the id, everything else covers every row.
    """
    spark = base.sparkSession
    usable = lambda d, i, v, own: d.where(F.col(i).isNotNull() & (F.size(v) == dim)).select(F.col(i).cast("string").alias("id"), F.col(v).cast("array<float>").alias("v"), F.lit(own).alias("own"))
    b = usable(base, base_id, base_vec, True)
    fine = b.where(F.exists("v", lambda e: e != 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) > 3e38)))
    n = fine.select("id").agg(F.approx_count_distinct("id")).first()[0]
    share = min(1.0, 1.1 * SAMPLE / max(1, n))
    # one row an id before the limit, combined in the tasks: a repeated id is one row whatever its number
    few = fine.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000))).groupBy("id").agg(F.min("v").alias("v")).limit(SAMPLE).toArrow()
    x = _matrix(few.column("v"), dim)[0] if len(few) else np.empty((0, dim), np.float32)
    if not len(x):
        return spark.createDataFrame([], "vec_id string, neighbor_id string, similarity double")
    order = np.lexsort(x[:, :4].T)  # whatever the order of arrival
    quant = fit(x[order], lists or max(1, -(-n // PER_LIST)), parts)
    n_lists = len(quant)
    shared = spark.sparkContext.broadcast(quant)
    rows = b if extra is None else b.unionByName(usable(extra, extra_id, extra_vec, False))

    def tally(what) -> np.ndarray:
        """Rows or queries of each list, counted in the tasks; as many rows to the driver as lists are met."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_lists, np.int64)
            for batch in batches:
                y, at = _matrix(batch.column("v"), dim)
                if len(y):
                    np.add.at(total, what(y, batch.column("own").to_numpy(zero_copy_only=False)[at]), 1)
            i = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["list", "n"])

        out = np.zeros(n_lists, np.int64)
        for r in rows.mapInArrow(run, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
            out[r["list"]] = r["n"]
        return out

    size = tally(lambda y, own: shared.value.nearest(y[own], 1)[0][:, 0])
    asked = tally(lambda y, own: _visits(shared.value, y, size, k, probes, margin, reach, exact)[1])
    blocks = np.maximum(1, -(-np.stack([size, asked], 1) // CELL))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each cell a vector belongs to; in a list of one cell the rows are also the queries."""
        met: set[tuple[str, int]] = set()  # repeated rows of one task count once here, those of several tasks in the cell
        for batch in batches:
            y, at = _matrix(batch.column("v"), dim)
            if not len(y):
                continue
            ids = batch.column("id").take(pa.array(at)).to_pylist()
            own = batch.column("own").to_numpy(zero_copy_only=False)[at]
            raw = [r.tobytes() for r in y]
            fresh = []
            for r, (i, v, o) in enumerate(zip(ids, raw, own.tolist(), strict=True)):
                key = (i if o else "\0" + i, zlib.crc32(v))
                if key not in met:
                    met.add(key)
                    fresh.append(r)
            y, own, ids, raw = y[fresh], own[fresh], [ids[r] for r in fresh], [raw[r] for r in fresh]
            if not len(y):
                continue
            vi, vl, home = _visits(shared.value, y, size, k, probes, margin, reach, exact)
            h = np.array([zlib.crc32(i.encode()) for i in ids], np.int64)
            out: list[list] = [[], [], [], []]  # row, list, cell, role: 1 row, 2 query, 3 both

            def put(*cols: np.ndarray, out=out) -> None:
                for o, c in zip(out, cols, strict=True):
                    o.append(c)

            one = (blocks[:, 0] == 1) & (blocks[:, 1] == 1)
            nb, nq = blocks[home, 0], blocks[home, 1]
            for j in range(int(nq.max())):
                i = np.flatnonzero(own & (j < nq))
                put(i, home[i], (h[i] % nb[i]) * nq[i] + j, np.where(one[home[i]], 3, 1))
            ask = ~(own[vi] & (vl == home[vi]) & one[vl])
            vi, vl = vi[ask], vl[ask]
            nb, nq = blocks[vl, 0], blocks[vl, 1]
            for j in range(int(nb.max()) if len(vl) else 0):
                i = np.flatnonzero(j < nb)
                put(vi[i], vl[i], j * nq[i] + h[vi[i]] % nq[i], np.full(len(i), 2))
            i, ls, cell, role = (np.concatenate(o) for o in out)
            brief = _short(y)
            codes = [r.tobytes() for r in shared.value.encode(y, home)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ls.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(role.astype(np.int8)), pa.array(own[i]), pa.array([ids[t] for t in i], pa.string()),
                 pa.array([brief[t] if r == 2 else raw[t] for t, r in zip(i, role, strict=True)], pa.binary()), pa.array([codes[t] if r != 2 else None for t, r in zip(i, role, strict=True)], pa.binary())],
                ["list", "cell", "role", "own", "id", "x", "code"],
            )

    cells = rows.mapInArrow(spread, "list int, cell int, role byte, own boolean, id string, x binary, code binary")

    def search(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        ids = np.array(t.column("id").to_pylist(), object)
        v = _long(t.column("x").to_pylist(), dim)
        held, asks = np.flatnonzero((role & 1) == 1), np.flatnonzero((role & 2) == 2)
        held = held[np.argsort(ids[held], kind="stable")]  # ties go to the smaller id
        a, n, s = [np.empty(0, object)], [np.empty(0, object)], [np.empty(0, np.float64)]
        if len(held) and len(asks):
            same = np.append(False, (ids[held][1:] == ids[held][:-1]) & (v[held][1:] == v[held][:-1]).all(1))
            held = held[~same]
            code = np.frombuffer(b"".join(t.column("code").take(pa.array(held)).to_pylist()), np.uint8).reshape(len(held), parts)
            name = np.where(t.column("own").to_numpy(zero_copy_only=False)[asks], "", "\0") + ids[asks]  # an extra id is no row's own
            q = shared.value
            centre = q.centre(t.column("list")[:1].to_numpy())[0]
            for i, j, e in _best(v[asks], name, v[held], ids[held], code, centre, q.books, k, len(held) if exact else rerank):
                ok = np.isfinite(e)
                a.append(np.repeat(i, ok.sum(1)))
                n.append(j[ok])
                s.append(e[ok].astype(np.float64))
        return pa.table({"vec_id": pa.array(np.concatenate(a), pa.string()), "neighbor_id": pa.array(np.concatenate(n), pa.string()), "similarity": pa.array(np.concatenate(s))})

    hits = cells.groupBy("list", "cell").applyInArrow(search, "vec_id string, neighbor_id string, similarity double")
    hits = hits.groupBy("vec_id", "neighbor_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbor_id")
    ranked = hits.withColumn("_r", F.row_number().over(w)).where(f"_r <= {k}")
    return ranked.select(F.regexp_replace("vec_id", "^\\x00", "").alias("vec_id"), "neighbor_id", "similarity")
