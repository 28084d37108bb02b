"""Centred fits, quantiles far out, complete periods, ISO weeks, open episodes."""

import datetime as dt
import os
import subprocess
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardcast.functions.stats import chi2_sf, t_quantile, t_two_sided_p
from wardcast.operators import forecast as FC
from wardcast.operators import regress as R
from wardcast.operators import series as S
from wardcast.operators.intervals import point_in_interval_left

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("mean,spread,level,noise", [
    (1000.0, 0.2, 0.0, 1.0), (2000.0, 0.5, 0.0, 1.0), (10000.0, 1.0, 1e8, 0.1), (5.0, 1.0, 1e9, 1.0)])
def test_large_mean_predictor_and_target(spark, mean, spread, level, noise):
    rng = np.random.default_rng(3)
    n = 200
    x = mean + spread * rng.standard_normal(n)
    y = level + 3.0 * (x - mean) + noise * rng.standard_normal(n)
    pdf = pd.DataFrame({"key": "a", "t": np.arange(1, n + 1), "x": x, "y": y})
    m = R.fit(spark.createDataFrame(pdf), ["key"], "y", ["x"])
    xc, yc = x - x.mean(), y - y.mean()
    b = (xc @ yc) / (xc @ xc)
    sse = float(((yc - b * xc) ** 2).sum())
    co = {r["term"]: r["estimate"] for r in m.coefficients(with_p=False).collect()}
    assert co["x"] == pytest.approx(b, rel=1e-6)
    assert m.coef_rows.first()["sse"] == pytest.approx(sse, rel=1e-6)
    assert m.summary().first()["sigma"] == pytest.approx((sse / (n - 2)) ** 0.5, rel=1e-6)
    hat = 1 / n + xc ** 2 / (xc @ xc)
    got = np.array([r["hat"] for r in m.augment().orderBy("t").collect()])
    assert np.allclose(got, hat, rtol=1e-6)


def test_batch_mixes_full_rank_and_aliased_keys(spark):
    rng = np.random.default_rng(5)
    x1 = rng.standard_normal(30)
    frames = [pd.DataFrame({"key": k, "t": range(30), "x1": x1, "x2": x2, "y": x1 + rng.standard_normal(30)})
              for k, x2 in (("free", rng.standard_normal(30)), ("twin", 2 * x1), ("flat", np.full(30, 7.0)))]
    m = R.fit(spark.createDataFrame(pd.concat(frames)), ["key"], "y", ["x1", "x2"])
    rank = {r["key"]: r["rank"] for r in m.coef_rows.collect()}
    assert rank == {"free": 3, "twin": 2, "flat": 2}


def test_level_data_steps_keep_valid_predictors(spark):
    rng = np.random.default_rng(8)
    n = 300
    x = 1000 + 0.05 * rng.standard_normal(n)
    pdf = pd.DataFrame({"key": "a", "t": range(n), "x": x, "z": rng.standard_normal(n)})
    pdf["y"] = 1e6 + 40 * (pdf["x"] - 1000) + 0.1 * rng.standard_normal(n)
    path = R.stepwise(spark.createDataFrame(pdf), ["key"], "y", ["x", "z"], "backward").orderBy("step").collect()
    assert "x" in path[-1]["model"].split("+") and not np.isnan(path[-1]["aicc"])


def test_t_quantile_far_out():
    assert t_quantile(0.9999, 1) == pytest.approx(3183.0988, rel=1e-6)
    assert t_quantile(0.99999, 1) == pytest.approx(31830.9886, rel=1e-6)
    assert t_quantile(0.025, 7) == pytest.approx(-t_quantile(0.975, 7), rel=1e-12)
    for p in (0.6, 0.9, 0.995):
        for df in (1, 3, 40, 1e6):
            q = float(t_quantile(p, df))
            assert 1 - t_two_sided_p(q, df) / 2 == pytest.approx(p, rel=1e-10)


def test_large_degrees_of_freedom_converge():
    assert chi2_sf(1e6, 1e6) == pytest.approx(0.5, abs=1e-3)
    assert t_two_sided_p(1.96, 1e8) == pytest.approx(0.05, abs=1e-4)


def test_complete_periods_come_from_the_data(spark):
    days = [(dt.datetime(2004, 1, 1) + dt.timedelta(days=d), 1.0) for d in range(365 + 366 + 40)]
    df = spark.createDataFrame(days, "ts timestamp_ntz, v double")
    def kept(rows, unit, last="drop"):
        return S.build_series(rows, [], "ts", {"y": F.sum("v")}, unit, last=last)

    def last_period(series):
        return series.agg(F.max("period")).first()[0]

    assert last_period(kept(df, "month")) == dt.date(2006, 1, 1)          # 2006-02-09 is mid-month
    whole = df.filter(F.col("ts") < F.lit("2005-07-01").cast("timestamp_ntz"))
    assert kept(whole, "month").agg(F.sum("y")).first()[0] == whole.count()
    assert last_period(kept(whole, "year")) == dt.date(2004, 1, 1)
    assert kept(df.limit(0), "month").count() == 0
    flags = {r.period: r.is_complete for r in kept(df, "month", "flag").collect()}
    assert len(flags) == 26 and [p for p, f in flags.items() if not f] == [dt.date(2006, 2, 1)]
    with pytest.raises(ValueError, match="no last day"):
        kept(df, "hour")


def test_weekly_seasons_keep_every_week(spark):
    days = [("a", dt.datetime(2019, 12, 30) + dt.timedelta(days=d), 1.0) for d in range(7 * 310)]
    df = spark.createDataFrame(days, "k string, ts timestamp_ntz, v double")
    w = S.build_series(df, ["k"], "ts", {"y": F.sum("v")}, "week")
    wide = S.seasonal_wide(w, ["k"], "y", 53)
    cells = sum(v is not None for r in wide.collect() for v in r[2:])
    assert cells == w.count() == 310


def test_zero_runs_are_not_missing_runs(spark):
    rows = [("a", dt.date(2020, m, 1), m, v) for m, v in [(1, 1.0), (2, 0.0), (3, 0.0), (4, None), (5, 2.0)]]
    s = spark.createDataFrame(rows, "k string, period date, t int, y double")
    zero = S.gaps(s, ["k"], "y", "month", zeros=True).collect()
    missing = S.gaps(s, ["k"], "y", "month").collect()
    assert [(r.gap_start.month, r.n_missing) for r in zero] == [(2, 2)]
    assert [(r.gap_start.month, r.n_missing) for r in missing] == [(4, 1)]


def test_open_episode_costs_point_days_only(spark):
    pts = spark.createDataFrame([(1, dt.datetime(2020, 1, d, 8), float(d)) for d in (1, 2, 9)],
                                "k long, ts timestamp_ntz, v double")
    iv = spark.createDataFrame([(1, dt.datetime(2020, 1, 2), dt.datetime(9999, 12, 31))],
                               "k long, s timestamp_ntz, e timestamp_ntz")
    out = point_in_interval_left(pts, iv, "k", "ts", "s", "e")
    assert sorted((r.v, r.in_interval) for r in out.collect()) == [(1.0, 0), (2.0, 1), (9.0, 1)]
    assert "sequence" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_attach_splits_a_hot_key_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_KEYS", 0)
    pdf = pd.DataFrame({"key": ["h"] * 2000 + ["c"] * 50, "t": list(range(2000)) + list(range(50))})
    pdf["x"] = np.sin(pdf["t"])
    pdf["y"] = 2 * pdf["x"] + np.cos(3 * pdf["t"])
    df = spark.createDataFrame(pdf)
    m = R.fit(df, ["key"], "y", ["x"])
    split = m.glance().select("key", "cv").orderBy("key").collect()
    parts = (m.augment().filter("key = 'h'").select(F.spark_partition_id().alias("p")).distinct().count())
    monkeypatch.setattr(R, "BROADCAST_KEYS", 10)
    whole = R.fit(df, ["key"], "y", ["x"]).glance().select("key", "cv").orderBy("key").collect()
    assert [r.cv for r in split] == pytest.approx([r.cv for r in whole])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(R, "BROADCAST_KEYS", 0)
        parts = m.augment().filter("key = 'h'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1


SHIP = """
import sys
sys.path.insert(0, {root!r})
import numpy as np, pandas as pd
from wardcast.session import build_session
from wardcast.operators import regress as R, forecast as FC
s = build_session("local[2]", shuffle_partitions=2)
t = np.arange(40.0)
pdf = pd.DataFrame(dict(key="a", t=t, x=np.sin(t), z=np.cos(2 * t), y=3 * np.sin(t) + np.cos(5 * t)))
df = s.createDataFrame(pdf)
m = R.fit(df, ["key"], "y", ["x"])
assert m.coefficients().count() == 2
assert FC.forecast(m, df.limit(3)).select("lo95").count() == 3
assert R.all_subsets(df, ["key"], "y", ["x", "z"]).count() == 4
print("SHIPPED")
"""


def test_package_reaches_workers_from_another_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SHIP.format(root=ROOT)], cwd=tempfile.mkdtemp(prefix="elsewhere-"),
                         env=env, capture_output=True, text=True, timeout=300)
    assert "SHIPPED" in out.stdout, out.stderr[-2000:]
