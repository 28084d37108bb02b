"""Named feature queries (regression predictors): (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.operators import features as X
from wardcast.plans.common import rounded
from wardcast.session import stage_table
from wardcast.sources import series_inputs as I
from wardcast.sources.tables import read_table

K = ["series_id"]
SPIKE = ("2000-01-01", "2000-03-01")


def _monthly(spark, sf):
    return I.orders_series(spark, sf, "month")


def trend_season_design(spark, sf):
    d = X.season_dummies(X.trend(_monthly(spark, sf)), 12)
    return rounded(d.drop("season", "cycle"), ["y"], 2)


def fourier_terms(spark, sf):
    d = X.fourier(_monthly(spark, sf).select(*K, "period", "t"), 12, 6)
    return rounded(d, X.fourier_names(12, 6), 9)


def trading_days(spark, sf):
    return X.trading_days(_monthly(spark, sf).select(*K, "period"), "month")


def weekday_counts(spark, sf):
    return X.weekday_counts(_monthly(spark, sf).select(*K, "period"), "month")


def easter_dummy(spark, sf):
    m = X.easter(_monthly(spark, sf).select(*K, "period"), "month")
    q = X.easter(I.orders_series(spark, sf, "quarter").select(*K, "period"), "quarter")
    return rounded(m.withColumn("unit", F.lit("month"))
                    .unionByName(q.withColumn("unit", F.lit("quarter"))), ["easter"], 9)


def distributed_lags(spark, sf):
    m = I.lineitem_monthly(spark, sf).select(*K, "period", "t", "sum_qty")
    return rounded(X.distributed_lags(m, K, "sum_qty", 3),
                   ["sum_qty"] + [f"sum_qty_lag{k}" for k in (1, 2, 3)], 4)


def trailing_sums(spark, sf):
    m = I.lineitem_monthly(spark, sf).select(*K, "period", "t", "sum_qty")
    return rounded(X.distributed_lags(m, K, "sum_qty", 3, cumulative=True),
                   ["sum_qty"] + [f"sum_qty_sum{k}" for k in (1, 2, 3)], 4)


def event_dummy(spark, sf):
    m = _monthly(spark, sf).select(*K, "period", "y")
    peak = m.groupBy(*K).agg(F.max_by("period", "y").alias("period"))
    return rounded(X.event_dummy(m, peak, [*K, "period"], "outlier"), ["y"], 2)


def spike_dummy(spark, sf):
    m = _monthly(spark, sf).select(*K, "period", "y")
    return rounded(X.spike_dummy(m, *SPIKE, name="spike"), ["y"], 2)


def category_dummies(spark, sf):
    m = I.lineitem_monthly(spark, sf).select(*K, "period", "sum_price")
    return rounded(X.dummies(m, "series_id", ["A", "N", "R"], prefix="flag"), ["sum_price"], 2)


# --- fixed values: seasonal periods of the daily series and their harmonics ---
DAILY_PERIODS = {7: 3, 3.5: 1, 365.25: 2}      # 1/3.5 is the second harmonic of the week
# --- fixed values: holiday rules (features.HOLIDAY_SCHEMA) ---
HOLIDAY_RULES = [
    ("AFRICA", "leap day", "fixed", 2, 29, None, None, None, None, None, None),
    ("AFRICA", "christmas", "fixed", 12, 25, None, None, None, "skip", None, None),
    ("AMERICA", "new year", "fixed", 1, 1, None, None, None, "nearest", None, None),
    ("AMERICA", "last monday of may", "nth", 5, None, -1, 0, None, None, None, None),
    ("AMERICA", "fourth of july", "fixed", 7, 4, None, None, None, "nearest", None, None),
    ("AMERICA", "fourth thursday of november", "nth", 11, None, 4, 3, None, None, None, None),
    ("AMERICA", "christmas", "fixed", 12, 25, None, None, None, "nearest", None, None),
    ("ASIA", "new year", "fixed", 1, 1, None, None, None, "monday", None, None),
    ("ASIA", "first of october", "fixed", 10, 1, None, None, None, "none", 1997, 2000),
    ("EUROPE", "new year", "fixed", 1, 1, None, None, None, "none", None, None),
    ("EUROPE", "good friday", "easter", None, None, None, None, -2, None, None, None),
    ("EUROPE", "easter monday", "easter", None, None, None, None, 1, None, None, None),
    ("EUROPE", "first of may", "fixed", 5, 1, None, None, None, None, None, None),
    ("EUROPE", "christmas", "fixed", 12, 25, None, None, None, "monday", None, None),
    ("EUROPE", "second day of christmas", "fixed", 12, 26, None, None, None, "monday", None, None),
]


def fourier_daily(spark, sf):
    """Weekly and yearly harmonics of daily event values in one basis."""
    d = X.fourier_multi(I.events_series(spark, sf, "day").select(*K, "period", "t"), DAILY_PERIODS)
    return rounded(d, X.fourier_multi_names(DAILY_PERIODS), 9)


def event_shares(spark, sf):
    """Share of each day that the events of a type cover, an event lasting as many minutes as its value."""
    ev = read_table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), "ts",
        (F.col("ts") + F.make_dt_interval(secs=(F.col("value") * 60).cast("decimal(18,6)"))).alias("until"))
    days = I.events_series(spark, sf, "day", "count").select(*K, "period", F.col("y").alias("n"))
    return rounded(X.event_shares(days, ev, K, "ts", "until", "day", "busy"), ["busy"], 9)


def holiday_trading_days(spark, sf):
    """Monthly order value per region with its business days: Mon-Fri without the region's holidays."""
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = read_table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    r = read_table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("series_id"))
    y = (o.join(c, "o_custkey").join(n, "n_nationkey").join(r, "r_regionkey")
          .groupBy("series_id", F.trunc("o_orderdate", "month").alias("period")).agg(F.sum("o_totalprice").alias("y")))
    rules = spark.createDataFrame(HOLIDAY_RULES, X.HOLIDAY_SCHEMA)
    return rounded(X.regional_trading_days(stage_table(y, "region-month"), "series_id", rules), ["y"], 2)


QUERIES = {
    "fourier_daily": fourier_daily,
    "event_shares": event_shares,
    "holiday_trading_days": holiday_trading_days,
    "trend_season_design": trend_season_design,
    "fourier_terms": fourier_terms,
    "trading_days": trading_days,
    "weekday_counts": weekday_counts,
    "easter_dummy": easter_dummy,
    "distributed_lags": distributed_lags,
    "trailing_sums": trailing_sums,
    "event_dummy": event_dummy,
    "spike_dummy": spike_dummy,
    "category_dummies": category_dummies,
}
