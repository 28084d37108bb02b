"""Driver tables -> keyed regular series (FIXTURES.md section 3).

Each builder is the only pass over the large table: the raw rows are
reduced to one row per (key, period) and that small result is staged in the
shared checkpoint folder, so every analysis that reuses a series (ACF, lags,
fits, forecasts) reads the staged table instead of re-aggregating the source.

* monthly / quarterly order value by order priority (seasonal m = 12 / 4),
  an incomplete last period dropped or flagged (see build_series);
* multivariate monthly line-item series by return flag;
* daily (m = 7) and hourly (m = 24) event series by event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.operators.series import build_series
from wardcast.session import stage_table
from wardcast.sources.tables import read_table

MULTI_VARS = ["sum_price", "sum_qty", "avg_disc", "avg_tax", "n_items"]


def _from(df: DataFrame, ts: str, start: str | None) -> DataFrame:
    """Rows from ``start``: a plain filter that reaches the scan."""
    return df if start is None else df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))


def orders_series(spark: SparkSession, sf_dir: str, unit: str = "month",
                  start: str | None = None, last: str = "drop") -> DataFrame:
    """Order value per priority; ``start`` (a period start) cuts at the scan,
    and t counts from it.  ``last`` as in ``build_series``."""
    o = _from(read_table(spark, sf_dir, "orders")
              .select(F.col("o_orderpriority").alias("series_id"), "o_orderdate", "o_totalprice"), "o_orderdate", start)
    return stage_table(build_series(o, ["series_id"], "o_orderdate", {"y": F.sum("o_totalprice")},
                                    unit, start=start, last=last), f"orders-{unit}")


def lineitem_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return stage_table(build_series(li, ["series_id"], "l_shipdate", {
        "sum_price": F.sum("l_extendedprice"), "sum_qty": F.sum("l_quantity"),
        "avg_disc": F.avg("l_discount"), "avg_tax": F.avg("l_tax"),
        "n_items": F.count("*").cast("double")}, "month", last="drop"), "lineitem-month")


def lineitem_revenue_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice")
    return stage_table(build_series(li, [], "l_shipdate", {"x": F.sum("l_extendedprice")},
                                    "month", last="drop"), "revenue-month")


def events_series(spark: SparkSession, sf_dir: str, unit: str = "day",
                  measure: str = "sum", fill=None) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), "ts", "value")
    agg = F.sum("value") if measure == "sum" else F.count("*").cast("double")
    return stage_table(build_series(ev, ["series_id"], "ts", {"y": agg}, unit, fill=fill),
                       f"events-{unit}-{measure}")
