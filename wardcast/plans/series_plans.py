"""Named time-series queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.operators import quantiles as Q
from wardcast.operators import series as S
from wardcast.plans.common import rounded
from wardcast.session import stage_table
from wardcast.sources import series_inputs as I
from wardcast.sources.tables import read_table

K = ["series_id"]
WINDOW_START = "1997-01-01"
ACF_LAGS = 24
LAGS_QUARTERLY = list(range(1, 10))


def monthly_series(spark, sf):
    return rounded(I.orders_series(spark, sf, "month"), ["y"], 2)


def quarterly_series(spark, sf):
    return rounded(I.orders_series(spark, sf, "quarter"), ["y"], 2)


def series_window(spark, sf):
    return rounded(I.orders_series(spark, sf, "quarter", start=WINDOW_START), ["y"], 2)


def series_gaps(spark, sf):
    return S.gaps(I.events_series(spark, sf, "hour", "count"), K, "y", "hour")


def series_zero_runs(spark, sf):
    """Hours without events count as 0 here; the runs are told from missing ones."""
    return S.gaps(I.events_series(spark, sf, "hour", "count", fill=0.0), K, "y", "hour", zeros=True)


def facet_long(spark, sf):
    m = I.lineitem_monthly(spark, sf)
    return rounded(S.to_long(m, [*K, "period"], I.MULTI_VARS), ["value"], 6)


def seasonal_plot(spark, sf):
    w = S.seasonal_wide(I.orders_series(spark, sf, "month"), K, "y", int(S.seasonal_period("month")))
    return rounded(w, [f"s{s:02d}" for s in range(1, 13)], 2)


def seasonal_plot_weekly(spark, sf):
    """Weekly order value, one row per ISO year, 53 weeks."""
    w = S.seasonal_wide(I.orders_series(spark, sf, "week"), K, "y", 53)
    return rounded(w, [f"s{s:02d}" for s in range(1, 54)], 2)


def seasonal_subseries(spark, sf):
    s = S.seasonal_subseries(I.orders_series(spark, sf, "month"), K, "y")
    return rounded(rounded(s, ["y"], 2), ["season_mean"], 4)


def lag_pairs(spark, sf):
    q = I.orders_series(spark, sf, "quarter", start=WINDOW_START)
    lp = S.lagged(q, K, "y", LAGS_QUARTERLY).select(
        *K, F.col("k").cast("int").alias("k"), "period", "season", "y", "y_lag")
    return rounded(lp, ["y", "y_lag"], 2)


def scatter_pairs(spark, sf):
    y = I.orders_series(spark, sf, "month").select(*K, "period", "y")
    x = I.lineitem_revenue_monthly(spark, sf).select("period", "x")
    return rounded(S.align(y, x, ["period"]), ["x", "y"], 2)


def corr_matrix(spark, sf):
    return rounded(S.corr_matrix(I.lineitem_monthly(spark, sf), K, I.MULTI_VARS), ["r"], 6)


def scatter_matrix(spark, sf):
    m = I.lineitem_monthly(spark, sf)
    return rounded(S.pair_scatter(m, [*K, "period"], I.MULTI_VARS), ["x", "y"], 6)


def histogram(spark, sf):
    h = S.histogram(I.orders_series(spark, sf, "month"), K, "y", 10)
    return rounded(h, ["lo", "hi"], 2)


def density(spark, sf):
    d = S.density(I.lineitem_monthly(spark, sf), K, "avg_disc", 32)
    return rounded(d, ["x", "density"], 6)


def _acf(spark, sf):
    return S.acf(I.orders_series(spark, sf, "month"), K, "y", ACF_LAGS)


def acf(spark, sf):
    return rounded(_acf(spark, sf), ["r"], 6)


def acf_bounds(spark, sf):
    return rounded(S.acf_bounds(_acf(spark, sf)), ["r", "bound"], 6)


def acf_signature(spark, sf):
    sig = S.acf_signature(S.acf_bounds(_acf(spark, sf)), K, int(S.seasonal_period("month")))
    return rounded(sig, ["r1", "rm", "share_inside"], 6)


def monthly_series_flagged(spark, sf):
    """Every month with its state: the last one may not be over."""
    return rounded(I.orders_series(spark, sf, "month", last="flag"), ["y"], 2)


def price_quartiles(spark, sf):
    """Box-plot data of the line items' prices per return flag from one sketch
    per month, merged (T10).  The quartiles' true ranks are counted in one
    more pass and must lie within three times the stated error; lowest and
    highest are exact."""
    li = read_table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.trunc("l_shipdate", "month").alias("month"), "l_extendedprice")
    monthly = stage_table(Q.sketches(li, [*K, "month"], "l_extendedprice"), "price-sketches")
    box = stage_table(Q.five_numbers(Q.merge(monthly, K), K), "price-quartiles")
    ranks = Q.true_ranks(li, K, "l_extendedprice", box, ["q1", "median", "q3"])
    near = [((F.col(f"{c}_below") <= p + 3 * Q.rank_error()) & (F.col(f"{c}_upto") >= p - 3 * Q.rank_error())).alias(f"{c}_near")
            for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return rounded(box.join(ranks, K).select(*K, "n", "lowest", "highest", *near), ["lowest", "highest"], 2)


def discount_quartiles(spark, sf):
    """Quartiles of monthly average discounts: fewer values than a sketch keeps, so exact."""
    s = Q.sketches(I.lineitem_monthly(spark, sf), K, "avg_disc")
    return rounded(Q.five_numbers(s, K), ["lowest", "q1", "median", "q3", "highest"], 9)


def series_head(spark, sf):
    return rounded(S.head(I.orders_series(spark, sf, "quarter"), K, 6), ["y"], 2)


QUERIES = {
    "monthly_series": monthly_series,
    "quarterly_series": quarterly_series,
    "series_window": series_window,
    "series_gaps": series_gaps,
    "series_zero_runs": series_zero_runs,
    "facet_long": facet_long,
    "seasonal_plot": seasonal_plot,
    "seasonal_plot_weekly": seasonal_plot_weekly,
    "seasonal_subseries": seasonal_subseries,
    "lag_pairs": lag_pairs,
    "scatter_pairs": scatter_pairs,
    "corr_matrix": corr_matrix,
    "scatter_matrix": scatter_matrix,
    "histogram": histogram,
    "density": density,
    "acf": acf,
    "acf_bounds": acf_bounds,
    "acf_signature": acf_signature,
    "series_head": series_head,
    "monthly_series_flagged": monthly_series_flagged,
    "price_quartiles": price_quartiles,
    "discount_quartiles": discount_quartiles,
}
