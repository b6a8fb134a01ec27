import math
import random

from pyspark.sql import functions as F

from loomdoc.operators.intervals import interval_runs
from loomdoc.operators.sequence import cut_phrases, gap_merge, merge_runs, overlap_assign


def brute_runs(rows):
    by = {}
    for k, a, b in rows:
        if k is None or a is None or b is None or math.isnan(a) or math.isnan(b) or not b > a:
            continue
        by.setdefault(k, []).append((round(a * 1000), round(b * 1000)))
    out = set()
    for k, v in by.items():
        merged = []
        for a, b in sorted(v):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def test_interval_runs_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), round(rng.uniform(0, 3000), 3), 0.0) for _ in range(3000)]
    rows = [(k, a, round(a + rng.choice([0.0, -1.0, 0.5, 3.0, 700.0 if rng.random() < 0.01 else 1.0]), 3)) for k, a, _ in rows]
    rows += [(1, float("nan"), 2.0), (1, None, 2.0), (2, 1.0, None), *rows[:50], (3, 0.0, 1.0), (3, 1.0, 2.0), (4, 0.0, 90_000_000.0), (4, 90_000_100.0, 90_000_101.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double").withColumn("kind", F.lit("x"))
    for shard in (600_000, 5_000, 700):
        got = {tuple(r) for r in interval_runs(df, ["k"], "a", "b", shard=shard).collect()}
        assert got == brute_runs(rows)


def test_interval_runs_of_nothing(spark):
    assert interval_runs(spark.createDataFrame([], "k int, a double, b double"), ["k"], "a", "b").count() == 0


def test_merge_runs_same_with_and_without_shards(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice(["a", "b", None]), 1) for k in (1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t int, v string, n int")
    args = dict(firsts={"f": "t"}, lasts={"l": "t"}, sums={"s": "n"}, texts={"x": ("v", "")})
    a = sorted(map(str, merge_runs(df, ["k"], ["t"], "v", **args).collect()))
    b = sorted(map(str, merge_runs(df, ["k"], ["t"], "v", shard=F.floor(F.col("t") / 7), **args).collect()))
    assert a == b
    assert sum(r.n_rows for r in merge_runs(df, ["k"], ["t"], "v").collect()) == 1000


def test_gap_merge(spark):
    df = spark.createDataFrame([("c", 0.0, 1.0, 1), ("c", 1.2, 2.0, 1), ("c", 2.1, 3.0, 2), ("c", 3.0, 4.0, 1), ("c", 4.5, 5.0, 1)], "c string, s double, e double, p int")
    got = [(r.p, r.s, r.e) for r in gap_merge(df, ["c"], "s", "e", "p").orderBy("s").collect()]
    assert got == [(1, 0.0, 2.0), (2, 2.1, 3.0), (1, 3.0, 4.0), (1, 4.5, 5.0)]


def test_phrases(spark):
    w = [("c", 1, 0.0, 0.5, "Hello"), ("c", 2, 0.6, 1.0, "there."), ("c", 3, 1.1, 1.5, "New"), ("c", 4, 2.5, 3.0, "gap"), ("c", 5, None, 3.0, "lost"), ("c", 6, 3.0, 20.0, "long")]
    df = spark.createDataFrame(w, "c string, i int, s double, e double, t string")
    got = [(r.text, r.start_s, r.end_s) for r in cut_phrases(df, ["c"], ["i"], "s", "e", "t").orderBy("phrase_no").collect()]
    assert got == [("Hello there.", 0.0, 1.0), ("New", 1.1, 1.5), ("gap", 2.5, 3.0), ("long", 3.0, 20.0)]


def test_overlap(spark):
    left = spark.createDataFrame([("k", 1, 2.0, 8.0), ("k", 2, 50.0, 51.0), ("k", 3, None, 1.0)], "k string, i int, s double, e double")
    right = spark.createDataFrame([("k", 1, 0.0, 4.0, 10), ("k", 2, 3.0, 10.0, 11)], "k string, r int, s double, e double, v int")
    for bucket in (1.0, 60.0):
        got = {r.i: r.v for r in overlap_assign(left, right, "k", "i", "s", "e", "r", "s", "e", "v", bucket=bucket).collect()}
        assert got == {1: 11, 2: 0}


def test_cut_writes_and_clears(spark):
    from loomdoc.session import clear_cuts, cut

    df = cut(spark.range(10))
    assert df.agg(F.sum("id")).first()[0] == 45
    assert "loomdoc-" in df.inputFiles()[0]
    clear_cuts(spark)


def test_runs_gaps_and_phrases_do_not_depend_on_the_shards(spark):
    """One key over many shards: long rows over several of them, one speaker through whole shards, ties and nulls."""
    rng = random.Random(8)
    rows, t = [], 0.0
    for i in range(1500):
        t += rng.choice([0.0, 0.1, 0.3, 1.0, 30.0 if rng.random() < 0.02 else 0.2])
        rows.append((rng.choice([1, 1, 1, None]), i, round(t, 2), None if rng.random() < 0.02 else round(t + rng.choice([0.2, 1.0, 40.0 if rng.random() < 0.03 else 0.4]), 2), rng.choice([1, 1, 1, 1, 2, None]), rng.choice(["a", "b", "c.", "d"])))
    df = spark.createDataFrame(rows, "k int, i int, s double, e double, p int, w string")

    def merged(width):
        return sorted(map(str, gap_merge(df, ["k"], "s", "e", "p", order=["i"], shard=width).collect()))

    def phrases(width):
        return sorted(map(str, cut_phrases(df, ["k"], ["i"], "s", "e", "w", max_s=2.0, shard=width).collect()))

    brute = []
    for k in (1, None):
        last, reach = None, None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if last is None or last[1] != r[4]:
                brute.append([k, r[4], r[2], r[3], 1])
                reach = r[3]
            elif reach is None or r[2] - reach > 0.3:
                brute.append([k, r[4], r[2], r[3], 1])
            else:
                brute[-1][4] += 1
                brute[-1][3] = max(x for x in (brute[-1][3], r[3]) if x is not None) if brute[-1][3] is not None or r[3] is not None else None
            if reach is None or (r[3] is not None and r[3] > reach):
                reach = r[3] if r[3] is not None else reach
            last = (k, r[4])
    want = sorted(map(str, (tuple(b) for b in brute)))
    got = sorted(str(tuple(r)) for r in gap_merge(df, ["k"], "s", "e", "p", order=["i"], shard=1e9).collect())
    assert got == want
    assert merged(3.0) == merged(0.5) == merged(1e9) and phrases(3.0) == phrases(0.5) == phrases(1e9)
    words = [r for r in rows if r[3] is not None]
    assert sum(r.n_words for r in cut_phrases(df, ["k"], ["i"], "s", "e", "w", shard=3.0).collect()) == len(words)


def test_no_window_over_all_runs_of_a_key(spark):
    """Before windows of one key alone there is one row a bitmap or shard, not one a run."""
    df = spark.range(20_000).selectExpr("1 as k", "id * 2.0 as a", "id * 2.0 + 1 as b")
    assert interval_runs(df, ["k"], "a", "b").count() == 39_999
    from loomdoc.operators.intervals import run_bitmaps

    assert run_bitmaps(df.selectExpr("k", "id * 2000 as _lo", "id * 2000 + 1000 as _hi") if "id" in df.columns else spark.range(20_000).selectExpr("1 as k", "id * 2000 as _lo", "id * 2000 + 1000 as _hi"), ["k"], 600_000).count() == 67
