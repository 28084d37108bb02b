"""Series operators on hand-made and literal series."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from wardcast.operators import features as X
from wardcast.operators import series as S


def literal_yearly(spark):
    # The literal series 123, 39, 78, 52, 110 for 2012-2016
    data = [(datetime(2012 + i, 6, 1), float(v)) for i, v in enumerate([123, 39, 78, 52, 110])]
    df = spark.createDataFrame(data, "ts timestamp_ntz, v double").withColumn("series_id", F.lit("a"))
    return S.build_series(df, ["series_id"], "ts", {"y": F.sum("v")}, "year")


def test_literal_series(spark):
    out = rows(literal_yearly(spark), ["t"])
    assert [r["y"] for r in out] == [123, 39, 78, 52, 110]
    assert [r["t"] for r in out] == [1, 2, 3, 4, 5]
    assert out[0]["period"] == date(2012, 1, 1)


def monthly_with_gap(spark):
    data = [(datetime(2020, m, 15), float(m)) for m in (1, 2, 4, 5)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, v double").withColumn("series_id", F.lit("a"))
    return S.build_series(df, ["series_id"], "ts", {"y": F.sum("v")}, "month")


def test_spine_keeps_missing_period_and_gap_report(spark):
    s = rows(monthly_with_gap(spark), ["t"])
    assert [r["y"] for r in s] == [1.0, 2.0, None, 4.0, 5.0]
    assert [r["season"] for r in s] == [1, 2, 3, 4, 5]
    g = rows(S.gaps(monthly_with_gap(spark), ["series_id"], "y", "month"))
    assert g == [{"series_id": "a", "gap_start": date(2020, 3, 1),
                  "gap_end": date(2020, 3, 1), "n_missing": 1}]


def test_single_period_series(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1), 5.0)], "ts timestamp_ntz, v double") \
              .withColumn("series_id", F.lit("a"))
    s = S.build_series(df, ["series_id"], "ts", {"y": F.sum("v")}, "quarter")
    assert rows(s)[0]["t"] == 1
    a = rows(S.acf(s, ["series_id"], "y", 2), ["k"])
    assert [r["r"] for r in a] == [None, None]       # zero variance: undefined, no error


def test_acf_matches_formula(spark):
    rng = np.random.default_rng(30)
    y = rng.normal(size=50)
    data = [(i + 1, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(data, "t int, y double").withColumn("series_id", F.lit("w"))
    out = rows(S.acf_bounds(S.acf(df, ["series_id"], "y", 10)), ["k"])
    e = y - y.mean()
    for r in out:
        k = r["k"]
        assert r["r"] == pytest.approx((e[k:] * e[:-k]).sum() / (e * e).sum(), abs=1e-12)
    assert out[0]["bound"] == pytest.approx(2 / math.sqrt(50))      # G4: +-0.28
    assert round(out[0]["bound"], 2) == 0.28


def test_lagged_pairs(spark):
    s = literal_yearly(spark)
    out = rows(S.lagged(s, ["series_id"], "y", [1, 2]), ["k", "t"])
    assert [(r["k"], r["t"], r["y"], r["y_lag"]) for r in out][:2] == [(1, 2, 39, 123), (1, 3, 78, 39)]
    assert len(out) == 4 + 3


def test_seasonal_wide_and_subseries(spark):
    s = monthly_with_gap(spark)
    w = rows(S.seasonal_wide(s, ["series_id"], "y", 12))
    assert w[0]["s01"] == 1.0 and w[0]["s03"] is None and w[0]["s12"] is None
    sub = rows(S.seasonal_subseries(s, ["series_id"], "y"), ["season"])
    assert sub[0]["season_mean"] == 1.0


def test_histogram_and_density(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=400)
    df = spark.createDataFrame([(float(v),) for v in y], "y double").withColumn("series_id", F.lit("a"))
    h = rows(S.histogram(df, ["series_id"], "y", 10), ["bin"])
    assert sum(r["n"] for r in h) == 400 and len(h) == 10
    counts, _ = np.histogram(y, bins=10, range=(y.min(), y.max()))
    assert [r["n"] for r in h] == list(counts)
    d = rows(S.density(df, ["series_id"], "y", 64), ["g"])
    xs = np.array([r["x"] for r in d])
    ds = np.array([r["density"] for r in d])
    assert 0.85 < np.trapezoid(ds, xs) <= 1.0


def test_corr_matrix(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=30)
    b = a * 2 + rng.normal(size=30)
    df = spark.createDataFrame([(float(x), float(z)) for x, z in zip(a, b)], "a double, b double") \
              .withColumn("k", F.lit(1))
    r = rows(S.corr_matrix(df, ["k"], ["a", "b"]))[0]
    assert r["var_a"] == "a" and r["r"] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_fourier_drops_sine_at_half_period(spark):
    s = S.build_series(
        spark.createDataFrame([(datetime(2020, m, 1), 1.0) for m in range(1, 13)],
                              "ts timestamp_ntz, v double").withColumn("series_id", F.lit("a")),
        ["series_id"], "ts", {"y": F.sum("v")}, "quarter")
    f = X.fourier(s, 4, 2)
    assert "sin_2" not in f.columns and {"sin_1", "cos_1", "cos_2"} <= set(f.columns)
    assert X.fourier_names(4, 2) == ["sin_1", "cos_1", "cos_2"]
    with pytest.raises(ValueError):
        X.fourier(s, 4, 3)


def test_calendar_features(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 3, 1),), (date(2024, 4, 1),),
                                (date(2019, 4, 1),), (date(2016, 3, 1),)], "period date")
    td = {r["period"]: r["trading_days"] for r in rows(X.trading_days(df))}
    assert td[date(2024, 1, 1)] == 23
    hol = spark.createDataFrame([(date(2024, 1, 1),)], "day date")
    assert rows(X.trading_days(df.limit(1), holidays=hol))[0]["trading_days"] == 22
    wc = {r["period"]: r for r in rows(X.weekday_counts(df))}
    assert wc[date(2024, 1, 1)]["mon"] == 5 and wc[date(2024, 1, 1)]["sun"] == 4
    e = {r["period"]: r["easter"] for r in rows(X.easter(df))}
    # Easter 2024-03-31 (Good Friday 29 Mar): all in March; 2019-04-21: April;
    # 2016-03-27: March
    assert e[date(2024, 3, 1)] == 1.0 and e[date(2024, 4, 1)] == 0.0
    assert e[date(2019, 4, 1)] == 1.0 and e[date(2016, 3, 1)] == 1.0
    # a holiday spanning two months: Easter 2002-03-31 -> Good Friday 29 Mar -> all March;
    # Easter 2013-03-31 likewise; Easter 2010-04-04: Good Friday 2 Apr -> April
    df2 = spark.createDataFrame([(date(2010, 4, 1),), (date(2010, 3, 1),)], "period date")
    e2 = {r["period"]: r["easter"] for r in rows(X.easter(df2, include_monday=True))}
    assert e2[date(2010, 4, 1)] == 1.0


def test_easter_split_across_months(spark):
    # Easter 2027-03-28: Good Friday 26 Mar, Easter Monday 29 Mar -> all March;
    # Easter 2029-04-01: Good Friday 30 Mar, Sat 31 Mar, Sun 1 Apr -> 2/3 March
    df = spark.createDataFrame([(date(2029, 3, 1),), (date(2029, 4, 1),)], "period date")
    e = {r["period"]: r["easter"] for r in rows(X.easter(df))}
    assert e[date(2029, 3, 1)] == pytest.approx(2 / 3) and e[date(2029, 4, 1)] == pytest.approx(1 / 3)


def test_distributed_lags_and_trailing(spark):
    s = literal_yearly(spark)
    lag = rows(X.distributed_lags(s, ["series_id"], "y", 2), ["t"])
    assert [(r["y_lag1"], r["y_lag2"]) for r in lag] == [(None, None), (123, None), (39, 123), (78, 39), (52, 78)]
    cum = rows(X.distributed_lags(s, ["series_id"], "y", 2, cumulative=True), ["t"])
    assert cum[2]["y_sum2"] == 162 and cum[1]["y_sum2"] is None


def test_dummies_drop_base_level(spark):
    df = spark.createDataFrame([("A",), ("N",), ("R",)], "f string")
    out = X.dummies(df, "f", ["A", "N", "R"], prefix="flag")
    assert out.columns == ["f", "flag_N", "flag_R"]


def test_from_values_and_frequency(spark):
    s = rows(S.from_values(spark, [123, 39, 78, 52, 110], "2012-01-01", "year"), ["t"])
    assert [r["y"] for r in s] == [123, 39, 78, 52, 110] and s[-1]["period"] == date(2016, 1, 1)
    assert S.seasonal_period("month") == 12 and S.seasonal_period("quarter") == 4


def test_white_noise_correlogram(spark):
    wn = S.white_noise(spark, 50, seed=30, keys=40, partitions=4)
    a = S.acf_bounds(S.acf(wn, ["series_id"], "y", 10))
    share = a.agg(F.avg(F.when(~F.col("significant"), 1.0).otherwise(0.0))).first()[0]
    assert 0.9 < share <= 1.0            # about 95% of spikes inside +-2/sqrt(T)
    again = S.white_noise(spark, 50, seed=30, keys=40, partitions=4)
    assert wn.exceptAll(again).count() == 0


def test_constant_series_density_is_null_not_error(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "y double").withColumn("series_id", F.lit("c"))
    d = rows(S.density(df, ["series_id"], "y", 8))
    assert len(d) == 8 and all(r["density"] is None for r in d)
    h = rows(S.histogram(df, ["series_id"], "y", 4), ["bin"])
    assert h[0]["n"] == 5 and sum(r["n"] for r in h) == 5
