import random
import statistics

from pyspark.sql import functions as F

from partloom.functions.numeric import score_bucket, size_bucket
from partloom.operators import ordered


def skewed(n=2000):
    """One key holds most rows."""
    rng = random.Random(1)
    return [("hot" if i % 10 else f"k{i % 7}", i, rng.choice([0.0, 0.1, 0.25, 0.25, rng.random(), 1.0])) for i in range(n)]


def test_running_sums_cross_chunks(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    out = ordered.running_sums(df, ["k"], ["i"], ordered.id_chunk("i", 64), {"before": F.lit(1), "total": F.col("v")})
    seen, sums = {}, {}
    want = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = (seen.get(k, 0), sums.get(k, 0.0))
        seen[k], sums[k] = seen.get(k, 0) + 1, sums.get(k, 0.0) + v
    for r in out.collect():
        assert r["before"] == want[r["i"]][0]
        assert abs(r["total"] - want[r["i"]][1]) < 1e-9


def test_running_sums_fall_with_scores(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    ties = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    out = ordered.running_sums(ties, ["k"], [F.desc("v")], -score_bucket(F.col("v")), {"above": F.col("n")})
    for r in out.collect():
        assert r["above"] == sum(1 for k, _, v in rows if k == r["k"] and v > r["v"])



def test_score_bucket_is_monotone(spark):
    rng = random.Random(3)
    values = sorted([0.0, 1.0, 1e-12, 1 - 1e-12, *[rng.random() for _ in range(500)], *[rng.random() ** 20 for _ in range(500)]])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", score_bucket(F.col("v")).alias("b"), size_bucket(F.col("v")).alias("s"))
    rows = sorted(df.collect())
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    assert [r["s"] for r in rows] == sorted(r["s"] for r in rows)


def test_global_row_number_is_dense(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    out = ordered.global_row_number(df, ["v"], "n").collect()
    assert sorted(r["n"] for r in out) == list(range(1, 5001))
    assert all(r["n"] == r["v"] + 1 for r in out)


def test_smallest_k_is_exact(spark):
    df = spark.range(3000).select((F.col("id") * 1009 % 3000).alias("v"))
    for k in (1, 777, 3000):
        out = ordered.smallest_k(df, [], [F.col("v")], ordered.id_chunk("v", 100), F.lit(k))
        assert sorted(r["v"] for r in out.collect()) == list(range(k))


def test_exact_median(spark):
    rng = random.Random(2)
    rows = [("odd" if i < 301 else "even", rng.choice([0.0, 0.5, rng.random() * 1000])) for i in range(501)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = ordered.exact_median(df, ["k"], "v", size_bucket(F.col("v"))).collect()
    for r in out:
        assert abs(r["median"] - statistics.median(v for k, v in rows if k == r["k"])) < 1e-12


def test_decayed_series_over_many_runs(spark):
    rng = random.Random(4)
    values = [rng.uniform(-5, 5) for _ in range(3000)]
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)] + [("b", 1, 3.0)], "k string, i bigint, v double")
    for decay in (0.999, 0.5):
        want, state = [], None
        for v in values:
            state = v if state is None else decay * state + (1 - decay) * v
            want.append(state)
        out = {(r["k"], r["i"]): r["ema"] for r in ordered.decayed_series(df, "k", "i", "v", decay).collect()}
        assert abs(out[("b", 1)] - 3.0) < 1e-12
        assert max(abs(out[("a", i + 1)] - w) for i, w in enumerate(want)) < 1e-9


def test_decayed_series_keeps_what_came_long_ago(spark):
    """A huge first value is felt after any number of runs."""
    df = spark.range(50_000).select(F.lit("a").alias("k"), (F.col("id") + 1).alias("i"), F.when(F.col("id") == 0, 1e25).otherwise(0.0).alias("v"))
    out = {r["i"]: r["ema"] for r in ordered.decayed_series(df, "k", "i", "v", 0.999).filter("i in (49000, 50000)").collect()}
    for i, got in out.items():
        assert abs(got / (1e25 * 0.999 ** (i - 1)) - 1) < 1e-9
    assert len(out) == 2


def test_decayed_series_joins_runs_by_levels(spark, monkeypatch):
    """With two runs to a bundle there are many levels, and no row is added on the way."""
    monkeypatch.setattr(ordered, "RUNS", 2)
    values = [float((i * 37) % 11) for i in range(900)]
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "k string, i bigint, v double")
    decay, state = 0.02, None
    out = {r["i"]: r["ema"] for r in ordered.decayed_series(df, "k", "i", "v", decay).collect()}
    assert len(out) == 900
    for i, v in enumerate(values):
        state = v if state is None else decay * state + (1 - decay) * v
        assert abs(out[i + 1] - state) < 1e-9


def test_exact_median_of_one_value_is_one_row(spark):
    df = spark.range(20_001).select(F.lit("k").alias("k"), F.when(F.col("id") < 9_000, 0.25).when(F.col("id") < 10_001, 0.5).otherwise(0.75).alias("v"))
    assert [r["median"] for r in ordered.exact_median(df, ["k"], "v", size_bucket(F.col("v"))).collect()] == [0.5]
    even = df.limit(0).unionByName(spark.createDataFrame([("k", 1.0), ("k", 3.0)], "k string, v double"))
    assert [r["median"] for r in ordered.exact_median(even, ["k"], "v", size_bucket(F.col("v"))).collect()] == [2.0]
