"""Named regression / diagnostics / forecast queries: (spark, sf_dir) -> DataFrame.

Models over the driver tables:
* A - quarterly order value per priority from 1997, y ~ trend + season;
* B - monthly line-item changes per return flag (percent / point changes),
      d_price ~ d_items + d_disc + d_tax;
* C - monthly order value per priority on total line-item revenue (two
      trending series: the spurious-regression case).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.operators import features as X
from wardcast.operators import forecast as FC
from wardcast.operators import regress as R
from wardcast.operators import series as S
from wardcast.operators import tsqr
from wardcast.operators.subsets import best_subsets as best
from wardcast.plans.common import dec_rounded, sig_rounded
from wardcast.session import stage_table
from wardcast.sources import series_inputs as I

K = ["series_id"]
A_X = ["trend", "season_2", "season_3", "season_4"]
A_FOURIER = ["trend", "sin_1", "cos_1", "cos_2"]
B_X = ["d_items", "d_disc", "d_tax"]
WINDOW_START = "1997-01-01"
TRAIN_END = "2000-04-01"        # ex-post split: train through 2000Q2
H_QUARTERS = 8                  # 2 x frequency
# --- fixed values: scenario predictors (h = 4) -------------------------------
SCENARIOS = {"up": {"d_items": 1.0, "d_disc": 0.5, "d_tax": 0.0},
             "down": {"d_items": -1.0, "d_disc": -0.5, "d_tax": 0.0}}
H_SCENARIO = 4


def model_a_data(spark, sf, end=None, quarterly=None):
    q = quarterly if quarterly is not None else I.orders_series(spark, sf, "quarter", start=WINDOW_START)
    if end is not None:
        q = S.time_window(q, K, end=end)
    return X.season_dummies(X.trend(q), 4)


def model_a(spark, sf, end=None, target="y", data=None):
    return R.fit(data if data is not None else model_a_data(spark, sf, end), K, target, A_X)


def model_b_data(spark, sf):
    m = I.lineitem_monthly(spark, sf)
    prev = m.select(*K, (F.col("t") + 1).alias("t"), F.col("sum_price").alias("p_price"),
                    F.col("n_items").alias("p_items"), F.col("avg_disc").alias("p_disc"),
                    F.col("avg_tax").alias("p_tax"))
    j = m.join(prev, [*K, "t"])
    return j.select(*K, "period", "t",
                    (100 * (F.try_divide(F.col("sum_price"), F.col("p_price")) - 1)).alias("d_price"),
                    (100 * (F.try_divide(F.col("n_items"), F.col("p_items")) - 1)).alias("d_items"),
                    (100 * (F.col("avg_disc") - F.col("p_disc"))).alias("d_disc"),
                    (100 * (F.col("avg_tax") - F.col("p_tax"))).alias("d_tax"))


def model_b(spark, sf):
    return R.fit(model_b_data(spark, sf), K, "d_price", B_X)


def model_c_data(spark, sf):
    y = I.orders_series(spark, sf, "month").select(*K, "period", "t", "y")
    x = I.lineitem_revenue_monthly(spark, sf).select("period", "x")
    return S.align(y, x, ["period"])


# ---- model A -------------------------------------------------------------------

def ols_trend_season(spark, sf):
    c = model_a(spark, sf).coefficients(with_p=False)
    return sig_rounded(dec_rounded(c, ["estimate", "std_error"], 2), ["t_value"])


def coef_pvalues(spark, sf):
    return sig_rounded(model_a(spark, sf).coefficients(with_p=True),
                       ["estimate", "std_error", "t_value", "p_value"], 6)


def fitted_residuals(spark, sf):
    a = model_a(spark, sf).augment().select(*K, "period", "t", "y", "fitted", "residual")
    return dec_rounded(a, ["y", "fitted", "residual"], 2)


def actual_vs_fitted(spark, sf):
    a = model_a(spark, sf).augment().select(*K, "period", "season",
                                            F.col("y").alias("actual"), "fitted")
    return dec_rounded(a, ["actual", "fitted"], 2)


def resid_vs_fitted(spark, sf):
    a = model_a(spark, sf).augment()
    s = a.groupBy(*K).agg(F.corr(F.abs("residual"), F.col("fitted")).alias("abs_resid_fitted_corr"))
    return sig_rounded(s, ["abs_resid_fitted_corr"], 6)


def resid_fitted_pairs(spark, sf):
    """The rows of the residuals-against-fitted plot."""
    a = model_a(spark, sf).augment().select(*K, "period", "fitted", "residual")
    return dec_rounded(a, ["fitted", "residual"], 2)


def model_glance(spark, sf):
    g = model_a(spark, sf).glance().select(*K, "n", "k", "df_resid", "r2", "adj_r2", "sigma",
                                           "aic", "aicc", "bic", "cv")
    return sig_rounded(g, ["r2", "adj_r2", "sigma", "aic", "aicc", "bic", "cv"])


def ols_fourier(spark, sf):
    """trend + Fourier K = m/2 spans the same space as seasonal dummies."""
    d = X.fourier(X.trend(I.orders_series(spark, sf, "quarter", start=WINDOW_START)), 4, 2)
    g = R.fit(d, K, "y", A_FOURIER).glance().select(*K, "n", "k", "r2", "sigma", "aicc")
    return sig_rounded(g, ["r2", "sigma", "aicc"], 7)


def influence(spark, sf):
    i = R.influence(model_a(spark, sf)).select(*K, "period", "hat", "std_resid", "cooks_d")
    return sig_rounded(i, ["hat", "std_resid", "cooks_d"], 7)


def resid_diagnostics(spark, sf):
    m = model_a(spark, sf)
    a = m.augment()
    s = a.groupBy(*K).agg(F.count("*").cast("bigint").alias("n"),
                          F.stddev_samp("residual").alias("sd_resid"))
    r1 = R.residual_acf1(a, K)
    return sig_rounded(s.join(r1, K), ["sd_resid", "resid_acf1"], 7)


def breusch_godfrey(spark, sf):
    """Order 2m, at most a fifth of the series: each key's own."""
    return sig_rounded(R.breusch_godfrey(model_a(spark, sf), m=4), ["lm", "p_value"], 7)


def resid_bundle(spark, sf):
    """Residual diagnostics in one result (R8): autocorrelations at lags 1-8,
    a histogram of 10 bins, and the Breusch-Godfrey statistic and p-value."""
    m = model_a(spark, sf)
    a = m.augment().select(*K, "t", "residual")
    r = S.acf(a, K, "residual", 8).select(*K, F.lit("acf").alias("part"), F.col("k").alias("idx"), F.col("r").alias("value"))
    h = S.histogram(a, K, "residual", 10).select(*K, F.lit("hist").alias("part"), F.col("bin").alias("idx"),
                                                F.col("n").cast("double").alias("value"))
    bg = R.breusch_godfrey(m, m=4).select(*K, F.posexplode(F.array("lm", "p_value")).alias("idx", "value"))
    bg = bg.select(*K, F.lit("bg").alias("part"), "idx", "value")
    return sig_rounded(r.unionByName(h).unionByName(bg), ["value"], 7)


def _future_a(base):
    fut = FC.future_frame(base, K, "quarter", H_QUARTERS)
    return X.season_dummies(X.trend(fut), 4)


def forecast_exante(spark, sf):
    d = model_a_data(spark, sf)
    m = model_a(spark, sf, data=d)
    f = FC.forecast(m, _future_a(d), intervals=False)
    return dec_rounded(f.select(*K, "h", "period", "t", "season", "point", "se"), ["point", "se"], 2)


def forecast_intervals(spark, sf):
    d = model_a_data(spark, sf)
    m = model_a(spark, sf, data=d)
    f = FC.forecast(m, _future_a(d))
    return sig_rounded(f.select(*K, "h", "period", "point", "se", "lo80", "hi80", "lo95", "hi95"),
                       ["point", "se", "lo80", "hi80", "lo95", "hi95"], 7)


def _expost(spark, sf):
    """Train through TRAIN_END, forecast the later quarters with their known
    (realised) predictors: t and season of the full window."""
    q = I.orders_series(spark, sf, "quarter", start=WINDOW_START)
    m = model_a(spark, sf, data=model_a_data(spark, sf, end=TRAIN_END, quarterly=q))
    test = model_a_data(spark, sf, quarterly=q).filter(
        F.col("period") > F.lit(TRAIN_END).cast("date"))
    return FC.forecast(m, test, intervals=False)


def forecast_expost(spark, sf):
    f = _expost(spark, sf).select(*K, "period", F.col("y").alias("actual"), "point",
                                  (F.col("y") - F.col("point")).alias("error"))
    return dec_rounded(f, ["actual", "point", "error"], 2)


def prediction_eval(spark, sf):
    f = _expost(spark, sf).withColumnRenamed("y", "actual")
    return sig_rounded(dec_rounded(FC.accuracy(f, K), ["me", "rmse", "mae"], 2), ["mape"], 7)


def transform_target(spark, sf):
    d = X.log_transform(model_a_data(spark, sf), "y", "log", "log_y")
    m = R.fit(d, K, "log_y", A_X)
    fut = _future_a(d)
    f = FC.forecast(m, fut, intervals=False)
    out = f.select(*K, "h", "period", F.col("point").alias("point_log"),
                   X.back_transform(F.col("point"), "log").alias("point"))
    return sig_rounded(dec_rounded(out, ["point"], 2), ["point_log"], 9)


def transform_limits(spark, sf):
    """Square-root target, point and 95 % limits back on the original scale."""
    d = X.log_transform(model_a_data(spark, sf), "y", "sqrt", "sqrt_y")
    f = FC.forecast(R.fit(d, K, "sqrt_y", A_X), _future_a(d), levels=(95,))
    out = f.select(*K, "h", "period", X.back_transform(F.col("point"), "sqrt").alias("point"),
                   *[X.back_transform_limit(F.col(c), "sqrt").alias(c) for c in ("lo95", "hi95")])
    return sig_rounded(out, ["point", "lo95", "hi95"], 7)


# ---- model B -------------------------------------------------------------------

def ols_simple(spark, sf):
    s = R.simple_regression(model_b_data(spark, sf), K, "d_price", "d_items")
    return sig_rounded(s, ["slope", "intercept", "r2", "sigma"])


def ols_multi(spark, sf):
    c = model_b(spark, sf).coefficients(with_p=False)
    return sig_rounded(c, ["estimate", "std_error", "t_value"], 7)


def resid_vs_x(spark, sf):
    a = model_b(spark, sf).augment()
    long = S.to_long(a.select(*K, "period", "residual", *B_X), [*K, "period", "residual"],
                     B_X, "predictor", "x")
    return sig_rounded(long, ["residual", "x"], 7)


def all_subsets(spark, sf):
    s = R.all_subsets(model_b_data(spark, sf), K, "d_price", B_X)
    return sig_rounded(s.select(*K, "model", "n", "k", "adj_r2", "cv", "aic", "aicc", "bic",
                                "rank_aicc"), ["adj_r2", "cv", "aic", "aicc", "bic"], 7)


def best_subsets(spark, sf):
    """The four best of model B's subsets, by branch and bound."""
    s = best(model_b_data(spark, sf), K, "d_price", B_X, top=4)
    return sig_rounded(s.select(*K, "model", "k", "aicc", "rank_aicc"), ["aicc"], 7)


def best_lag_subsets(spark, sf):
    """The ten best of 2^15 models: changes of price on the three predictors and four lags of each."""
    d = model_b_data(spark, sf)
    for x in B_X:
        d = X.distributed_lags(d, K, x, 4)
    xs = B_X + [f"{x}_lag{k}" for x in B_X for k in range(1, 5)]
    s = best(stage_table(d, "lagged-b"), K, "d_price", xs, top=10)
    return sig_rounded(s.select(*K, "model", "k", "sse", "aicc", "rank_aicc"), ["sse", "aicc"], 6)


def ols_polynomial(spark, sf):
    """Monthly order value on raw powers of the calendar year (1995.0833, ...):
    a design whose normal equations lose every digit, fitted by QR."""
    year = F.year("period") + (F.month("period") - 1) / 12.0
    d = I.orders_series(spark, sf, "month").select(*K, "y", year.alias("year"))
    d = d.select("*", F.pow("year", F.lit(2.0)).alias("year2"), F.pow("year", F.lit(3.0)).alias("year3"))
    m = tsqr.fit(d, K, "y", ["year", "year2", "year3"])
    b = m.coef_rows.select(*K, *[F.col("beta")[i].alias(f"b{i}") for i in range(4)])
    out = m.summary().select(*K, "n", "k", "r2", "sigma").join(b, K)
    # powers of 1998.25 in float64 are the design only to 1e-7 of what tells them apart: fewer digits are compared
    return sig_rounded(sig_rounded(out, ["r2", "sigma"], 4), [f"b{i}" for i in range(4)], 3)


def stepwise(spark, sf):
    return sig_rounded(R.stepwise(model_b_data(spark, sf), K, "d_price", B_X, "backward"),
                       ["aicc"], 7)


def stepwise_forward(spark, sf):
    return sig_rounded(R.stepwise(model_b_data(spark, sf), K, "d_price", B_X, "forward"),
                       ["aicc"], 7)


def _scenarios(spark, sf, **options):
    d = model_b_data(spark, sf)
    m = R.fit(d, K, "d_price", B_X)
    fut = FC.future_frame(d, K, "month", H_SCENARIO)
    rows = [(name, *[v[c] for c in B_X]) for name, v in SCENARIOS.items()]
    scen = spark.createDataFrame(rows, ["scenario", *B_X])      # fixed, 2 rows
    return FC.forecast(m, fut.crossJoin(F.broadcast(scen)), **options)


def forecast_scenario_limits(spark, sf):
    f = _scenarios(spark, sf).select(*K, "scenario", "h", "period", "lo80", "hi80", "lo95", "hi95")
    return sig_rounded(f, ["lo80", "hi80", "lo95", "hi95"], 7)


def forecast_expost_realised(spark, sf):
    """Ex-post forecast of model B: fitted through TRAIN_END, the later months
    forecast with the predictors that were realised in them (R35)."""
    d = model_b_data(spark, sf)
    cut = F.lit(TRAIN_END).cast("date")
    m = R.fit(d.filter(F.col("period") <= cut), K, "d_price", B_X)
    f = FC.forecast(m, d.filter(F.col("period") > cut), intervals=False).select(
        *K, "period", F.col("d_price").alias("actual"), "point", (F.col("d_price") - F.col("point")).alias("error"))
    return sig_rounded(f, ["actual", "point", "error"], 6)


def forecast_scenarios(spark, sf):
    f = _scenarios(spark, sf, intervals=False)
    return sig_rounded(f.select(*K, "scenario", "h", "period", "point", "se"), ["point", "se"], 7)


# ---- model C -------------------------------------------------------------------

def spurious_check(spark, sf):
    d = model_c_data(spark, sf)
    s = R.simple_regression(d, K, "y", "x")
    aug = (d.join(s.select(*K, "slope", "intercept"), K)
            .withColumn("residual", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))))
    r1 = R.residual_acf1(aug, K)
    out = (s.select(*K, "r2", "n").join(r1, K)
            .withColumn("spurious", (F.col("r2") > 0.5)
                        & (F.col("resid_acf1") > 2 / F.sqrt(F.col("n").cast("double")))))
    return sig_rounded(out, ["r2", "resid_acf1"], 7)


# ---- L1-L3 ----------------------------------------------------------------------

def _bucket(col):
    """Stable 0..99 bucket from md5 (same value in any engine)."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10)
                  .cast("bigint"), F.lit(100))


def hash_split(spark, sf, train_pct: int = 80):
    from wardcast.sources.tables import read_table
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return o.select("o_orderkey", F.when(_bucket("o_orderkey") < train_pct, "train")
                    .otherwise("test").alias("split"))


def screen_topk(spark, sf, k: int = 10, train_pct: int = 80):
    """Fit price ~ quantity on the training orders, score every test order
    and keep the k best per priority.  The joined, aggregated orders are
    staged once for both; Spark cuts each group to k before the exchange."""
    from pyspark.sql import Window as W
    from wardcast.sources.tables import read_table
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    qty = (read_table(spark, sf, "lineitem").groupBy("l_orderkey")
           .agg(F.sum("l_quantity").alias("qty")))
    d = stage_table(o.join(qty, o.o_orderkey == qty.l_orderkey).drop("l_orderkey")
                    .withColumn("_b", _bucket("o_orderkey")), "screen")
    model = (d.filter(F.col("_b") < train_pct)
              .agg(F.regr_slope("o_totalprice", "qty").alias("b"),
                   F.regr_intercept("o_totalprice", "qty").alias("a")))
    scored = (d.filter(F.col("_b") >= train_pct).crossJoin(F.broadcast(model))   # 1 row
               .withColumn("score", F.col("a") + F.col("b") * F.col("qty")))
    order = [F.col("score").desc(), F.col("o_orderkey")]
    top = scored.withColumn("rank", F.row_number().over(
        W.partitionBy("o_orderpriority").orderBy(*order)).cast("int")).filter(F.col("rank") <= k)
    return sig_rounded(top.select("o_orderpriority", "rank", "o_orderkey", "qty", "score"),
                       ["score"], 8)


QUERIES = {
    "ols_trend_season": ols_trend_season,
    "coef_pvalues": coef_pvalues,
    "fitted_residuals": fitted_residuals,
    "actual_vs_fitted": actual_vs_fitted,
    "resid_vs_fitted": resid_vs_fitted,
    "resid_fitted_pairs": resid_fitted_pairs,
    "model_glance": model_glance,
    "ols_fourier": ols_fourier,
    "influence": influence,
    "resid_diagnostics": resid_diagnostics,
    "breusch_godfrey": breusch_godfrey,
    "forecast_exante": forecast_exante,
    "forecast_intervals": forecast_intervals,
    "forecast_expost": forecast_expost,
    "prediction_eval": prediction_eval,
    "transform_target": transform_target,
    "ols_simple": ols_simple,
    "ols_multi": ols_multi,
    "resid_vs_x": resid_vs_x,
    "all_subsets": all_subsets,
    "best_subsets": best_subsets,
    "best_lag_subsets": best_lag_subsets,
    "ols_polynomial": ols_polynomial,
    "stepwise": stepwise,
    "stepwise_forward": stepwise_forward,
    "forecast_scenarios": forecast_scenarios,
    "forecast_scenario_limits": forecast_scenario_limits,
    "forecast_expost_realised": forecast_expost_realised,
    "transform_limits": transform_limits,
    "resid_bundle": resid_bundle,
    "spurious_check": spurious_check,
    "hash_split": hash_split,
    "screen_topk": screen_topk,
}
