"""Lags over blocks with halos, and quantiles from mergeable sketches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardcast.operators import features as X
from wardcast.operators import quantiles as Q
from wardcast.operators import series as S
from wardcast.operators.blocks import with_lags
from wardcast.session import stage_table


def gappy(spark, seed=4):
    """Three series with missing positions and missing values."""
    rng = np.random.default_rng(seed)
    rows = [(k, t, None if rng.random() < 0.1 else float(rng.normal()))
            for k in ("a", "b", None) for t in range(1, 200) if rng.random() < 0.85]
    return rows, spark.createDataFrame(rows, "k string, t int, y double")


@pytest.mark.parametrize("block", [1, 3, 7, 64, 100_000])
def test_lags_over_blocks(spark, block):
    rows, df = gappy(spark)
    at = {(k, t): y for k, t, y in rows}
    lags = [1, 2, 9, 40]
    got = with_lags(df, ["k"], lags, F.col("y"), block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.y == at[r.k, r.t]
        assert [r[f"_lag{k}"] for k in lags] == [at.get((r.k, r.t - k)) for k in lags]


def test_lag_pairs_tell_missing_rows_from_missing_values(spark):
    rows, df = gappy(spark)
    at = {(k, t): y for k, t, y in rows if k}
    got = {(r.k_, r.t, r.k): r.y_lag for r in S.lagged(df.filter("k is not null").withColumnRenamed("k", "k_"), ["k_"], "y", [1, 5]).collect()}
    assert got == {(k, t, n): at[k, t - n] for k, t in at for n in (1, 5) if (k, t - n) in at}
    wide = X.distributed_lags(df.withColumnRenamed("k", "k_"), ["k_"], "y", 3, cumulative=True).filter("k_ = 'a'").collect()
    for r in wide:
        parts = [at.get(("a", r.t - i)) for i in (1, 2, 3)]
        assert r.y_sum3 == (None if None in parts else pytest.approx(sum(parts)))


def test_acf_with_gaps_and_a_large_mean(spark):
    rows, _ = gappy(spark)
    df = spark.createDataFrame([(k, t, y and y + 1e9) for k, t, y in rows if k], "s string, t int, y double")
    got = {(r.s, r.k): r for r in S.acf(df, ["s"], "y", 12).collect()}
    for s in ("a", "b"):
        obs = {t: y + 1e9 for k, t, y in rows if k == s and y is not None}
        m = math.fsum(obs.values()) / len(obs)
        den = math.fsum((y - m) ** 2 for y in obs.values())
        for k in range(1, 13):
            num = math.fsum((y - m) * (obs[t - k] - m) for t, y in obs.items() if t - k in obs)
            assert got[s, k].r == pytest.approx(num / den, abs=1e-7) and got[s, k].n == len(obs)


def test_one_long_series_is_cut_into_tasks(spark):
    """A million points of one key: no task sees the series, and the shuffle carries n rows and halos, not n x lags."""
    n, lags = 1_000_000, 24
    df = spark.range(1, n + 1).select(F.lit("s").alias("s"), F.col("id").cast("int").alias("t"),
                                      (F.sin(F.col("id") * 0.7) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("y"))
    blocks = with_lags(df, ["s"], [1, lags], F.col("y"))
    parts = blocks.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < n / 4
    plan = S.acf(df, ["s"], "y", lags)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2
    y = np.array([r.y for r in df.orderBy("t").select("y").collect()])
    e = y - y.mean()
    for r in S.acf(df, ["s"], "y", lags).collect():
        assert r.r == pytest.approx(float(e[r.k:] @ e[:-r.k] / (e @ e)), abs=1e-9)


def test_sketch_is_exact_up_to_its_size(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 500, Q.K):
        v = rng.normal(size=n).round(2)
        df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
        r = Q.five_numbers(Q.sketches(df, [], "v"), []).first()
        assert [r.n, r.lowest, r.highest] == [n, v.min(), v.max()]
        assert [r.q1, r.median, r.q3] == pytest.approx(np.percentile(v, [25, 50, 75]).tolist(), abs=1e-12)


def test_sketch_error_and_merge(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(
        F.exp(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10_000.0)).alias("v"))
    daily = Q.sketches(df, ["day"], "v")
    for k, found in ((None, Q.sketches(df, [], "v")), (7, Q.merge(daily, []))):
        assert found.select(F.length("sketch").alias("b")).first().b < 60_000
        box = Q.five_numbers(found, [])
        assert box.first().n == n
        box = stage_table(box, "box")
        ranks = Q.true_ranks(df, [], "v", box, ["q1", "median", "q3"]).first()
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert ranks[f"{name}_below"] - 3 * Q.rank_error() <= p <= ranks[f"{name}_upto"] + 3 * Q.rank_error()


def test_sketch_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in Q.five_numbers(Q.sketches(df, ["k"], "v"), ["k"]).collect()}
    assert got == {"a": (0, None, None, None, None, None), "b": (1, 2.0, 2.0, 2.0, 2.0, 2.0)}
    assert Q.rank_error(200) == pytest.approx(0.0133, abs=1e-4)
