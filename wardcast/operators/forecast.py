"""Forecasts from fitted regressions (R33-R36) and accuracy (L2).

The future frame is generated per key from its last period (calendar
arithmetic, h rows per key); predictors that are functions of time (trend,
season, Fourier) are recomputed on it, scenario predictors come from a small
scenario table.  Point forecasts and standard errors are column expressions
over the coefficient row of the key:

    yhat = x' b,  se = sigma * sqrt(1 + x' (X'X)^-1 x)

and the 80/95% limits use Student-t quantiles with the residual df.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.functions.calendar import add_periods, cycle_of, season_of
from wardcast.functions.stats import t_quantile_udf
from wardcast.operators.regress import OLSFit, attach
from wardcast.session import ship_package, stage_table

LEVELS = (80, 95)


def future_frame(series: DataFrame, keys: list[str], unit: str, h: int) -> DataFrame:
    """h future periods per key after its last period: h, period, t, season, cycle."""
    last = series.groupBy(*keys).agg(F.max("period").alias("_last"), F.max("t").alias("_T"))
    f = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    per = add_periods(F.col("_last"), F.col("h"), unit)
    return f.select(*keys, F.col("h").cast("int").alias("h"), per.alias("period"),
                    (F.col("_T") + F.col("h")).cast("int").alias("t"),
                    season_of(per, unit).alias("season"), cycle_of(per, unit).alias("cycle"))


def forecast(fitm: OLSFit, newdata: DataFrame, levels=LEVELS,
             intervals: bool = True) -> DataFrame:
    """Point forecast, standard error and prediction intervals for every row
    of ``newdata`` (keys + the model's predictor columns)."""
    g = fitm.summary().select(*fitm.keys, "sigma", "df_resid")
    quantiles = [f"_q{lv}" for lv in levels] if intervals else []
    if intervals:
        # the quantile depends on the level and the degrees of freedom only
        ship_package(newdata.sparkSession)
        df = stage_table(g.select("df_resid").distinct(), "df").select("df_resid", *[
            t_quantile_udf(F.lit(0.5 + lv / 200.0), F.col("df_resid").cast("double")).alias(q)
            for lv, q in zip(levels, quantiles)])
        g = g.join(df, "df_resid", "left")
    rows = stage_table(fitm.predictors().join(g, fitm.keys), "predict")
    out = (attach(newdata, rows, fitm.keys).withColumn("point", fitm.linear_predictor())
           .withColumn("se", F.col("sigma") * F.sqrt(1 + fitm.quad_form())))
    for lv, q in zip(levels if intervals else [], quantiles):
        out = (out.withColumn(f"lo{lv}", F.col("point") - F.col(q) * F.col("se"))
                  .withColumn(f"hi{lv}", F.col("point") + F.col(q) * F.col("se")))
    return out.drop("mid", "betac", "invc", "sigma", "df_resid", *quantiles)


def accuracy(df: DataFrame, keys: list[str], actual: str = "actual",
             point: str = "point") -> DataFrame:
    """Forecast accuracy per key: ME, RMSE, MAE, MAPE (%)."""
    e = F.col(actual) - F.col(point)
    return df.groupBy(*keys).agg(
        F.count(e).cast("bigint").alias("n"),
        F.avg(e).alias("me"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(F.try_divide(e, F.col(actual))) * 100).alias("mape"))
