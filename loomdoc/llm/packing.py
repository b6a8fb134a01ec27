"""Texts packed into containers of a fixed number of tokens.

Lengths in tokens are counted once and reduced to a global histogram of at most ``capacity`` bins.
Dynamic programming over the histogram chooses the bucket boundaries with the least padding; over the
bucket counts, which are as many as there are buckets, the driver lays out how many containers of
which filling there are.  Every text then finds its container by arithmetic from its rank in its
bucket; ranks are counted in salted parts, so no bucket is one task and nothing is sorted globally.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.session import cut

#: The word pattern of the public byte-level vocabularies (a fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Pieces that one task ranks (about).
RANKED = 50_000


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})



def token_count(text: str, path: str) -> int:
    return len(_encoder(path).encode_ordinary(text))


def with_tokens(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key, n_tokens`` of each row with a key and a text that is not empty."""
    kind = dict(df.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n_tokens": [len(enc.encode_ordinary(t)) for t in b["t"].tolist()]})

    use = df.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return use.mapInPandas(scan, f"k {kind}, n_tokens int").withColumnRenamed("k", key)


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket boundaries (ascending, the last one the longest length) that minimise padding over the histogram.

    ``counts[i]`` is the number of texts of ``i`` tokens.  Exact: cost(a, b] = sum over lengths of
    (b - length) * count; the optimum over ``buckets`` is found by dynamic programming with a monotone
    divide and conquer on the split.
    """
    used = np.flatnonzero(counts)
    if not len(used):
        return []
    m, k = len(used), min(buckets, len(used))
    c = counts[used].astype(np.float64)
    n, s = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * used)))
    best = used * n[1:] - s[1:]
    back = np.zeros((k, m), np.int64)
    for j in range(1, k):
        new = np.full(m, np.inf)
        stack = [(j, m - 1, j - 1, m - 2)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid - 1, b) + 1)
            cost = best[i] + used[mid] * (n[mid + 1] - n[i + 1]) - (s[mid + 1] - s[i + 1])
            at = int(np.argmin(cost))
            new[mid], back[j, mid] = cost[at], i[at]
            stack += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        best = np.where(np.isfinite(new), new, best)
    out, at = [], m - 1
    for j in range(k - 1, -1, -1):
        out.append(int(used[at]))
        if j:
            at = int(back[j, at])
    return sorted(set(out))


def layout(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Containers as ``(how many, {bucket: texts of it})``: token-budget batches of one bucket, the rest of the budget topped up from shorter buckets.

    Largest bucket first; a filling is repeated as often as all its buckets last, so there are at most
    as many fillings as buckets times buckets.
    """
    left, plan = list(counts), []
    for b in range(len(bounds) - 1, -1, -1):
        while left[b]:
            room, fill = capacity, {}
            for j in range(b, -1, -1):
                take = min(room // bounds[j], left[j])
                if take:
                    fill[j] = take
                    room -= take * bounds[j]
            times = min(left[j] // t for j, t in fill.items())
            for j, t in fill.items():
                left[j] -= times * t
            plan.append((times, fill))
    return plan


def pack(df: DataFrame, key: str, text: str, vocabulary: str, *, capacity: int = 2048, buckets: int = 128, salts: int | None = None) -> DataFrame:
    """``key, piece_no, from_token, n_tokens, bucket, container_id``: every token of every text in one container.

    A text of up to ``capacity`` tokens is one piece; a longer one is cut into full containers and a
    rest.  The pieces of a container never exceed ``capacity``.  Ranks are counted in parts of about ``RANKED`` pieces (``salts`` sets
    another number of parts).  Null keys and null or empty texts have no piece;
    repeated rows are packed each time; an empty table gives no container.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    sizes = with_tokens(df.select(key, text), key, text, vocabulary)
    cuts = F.floor((F.col("n_tokens") - 1) / capacity)
    pieces = sizes.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), cuts.cast("int"))).alias("piece_no"))
    pieces = pieces.select(key, "piece_no", (F.col("piece_no") * capacity).alias("from_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).alias("n_tokens"))
    pieces = cut(pieces.where("n_tokens > 0"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("n_tokens").count().collect():  # at most ``capacity`` rows
        hist[r[0]] = r[1]
    bounds = boundaries(hist, buckets)
    salts = salts or int(hist.sum() // RANKED + 1)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)).cast("int"))
    if not bounds:
        return spark.createDataFrame([], f"{key} {kind}, piece_no int, from_token int, n_tokens int, bucket int, container_id bigint")
    of = np.searchsorted(bounds, np.arange(capacity + 1))
    counts = [int(hist[(of == b)].sum()) for b in range(len(bounds))]
    plan = layout(bounds, counts, capacity)
    # for each bucket: from which rank on a filling takes its texts, how many a container, and the first container's number
    rows, first, rank = [], 0, [0] * len(bounds)
    for times, fill in plan:
        for b, t in fill.items():
            rows.append((b, rank[b], t, first))
            rank[b] += times * t
        first += times
    steps: dict[int, list[tuple[int, int, int]]] = {}
    for b, start, t, f in rows:
        steps.setdefault(b, []).append((start, t, f))

    bucket = F.element_at(F.lit(of.tolist()), F.col("n_tokens") + 1)
    pieces = pieces.withColumn("bucket", bucket.cast("int"))
    per = pieces.groupBy("bucket", "salt").count()  # buckets x salts rows: fewer than one for 400 pieces
    w = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.select("bucket", "salt", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("off"))
    inner = Window.partitionBy("bucket", "salt").orderBy(key, "piece_no")
    ranked = pieces.withColumn("r", F.row_number().over(inner) - 1).join(offset, ["bucket", "salt"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("off"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {b: tuple(np.array(x) for x in zip(*s, strict=True)) for b, s in steps.items()}
        for p in batches:
            where = np.zeros(len(p), np.int64)
            bs, rs = p["bucket"].to_numpy(), p["r"].to_numpy()
            for b in np.unique(bs):
                start, t, f = tables[int(b)]
                at = np.flatnonzero(bs == b)
                i = np.searchsorted(start, rs[at], "right") - 1
                where[at] = f[i] + (rs[at] - start[i]) // t[i]
            p["container_id"] = where
            yield p[["k", "piece_no", "from_token", "n_tokens", "bucket", "container_id"]]

    out = ranked.select(F.col(key).alias("k"), "piece_no", "from_token", "n_tokens", "bucket", "r")
    out = out.mapInPandas(place, f"k {kind}, piece_no int, from_token int, n_tokens int, bucket int, container_id long")
    limits = F.element_at(F.lit(bounds), F.col("bucket") + 1)
    return out.withColumn("bucket", limits.cast("int")).withColumnRenamed("k", key)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``bucket, containers, pieces, tokens, share``: of the containers whose longest piece is of that bucket, how full they are."""
    per = packed.groupBy("container_id").agg(F.max("bucket").alias("bucket"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    out = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"))
    return out.withColumn("share", F.round(F.col("tokens") / (F.col("containers") * capacity), 4))
