"""Physical-plan checks: pushdown, pruning, no cartesian/nested-loop joins,
no row-at-a-time Python, no single-partition windows on series."""

import re
import tempfile

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from wardcast.operators import clinical as C
from wardcast.sources import fixtures as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_measurement_filters_reach_the_scan(spark):
    path = tempfile.mkdtemp(prefix="wardcast-ce-") + "/chartevents"
    X.chartevents(spark, SF_SMALL).write.parquet(path)
    ce = spark.read.parquet(path)
    p = plan(C.heightweight(ce))
    scan = [ln for ln in p.splitlines() if "FileScan parquet" in ln][0]
    assert "IsNotNull(valuenum)" in scan and "In(itemid" in scan
    assert "Not(EqualTo(valuenum,0.0))" in scan
    m = re.search(r"FileScan parquet \[([^\]]*)\]", scan)
    assert set(re.sub(r"#\d+L?", "", f) for f in m.group(1).split(",")) == {
        "subject_id", "icustay_id", "charttime", "itemid", "valuenum", "error"}


def test_series_scan_prunes_and_pushes(spark):
    from wardcast.operators.series import build_series
    from wardcast.sources.tables import read_table
    from pyspark.sql import functions as F
    o = read_table(spark, SF_SMALL, "orders").filter(
        F.col("o_orderdate") < F.lit("2001-08-01").cast("timestamp_ntz"))
    s = build_series(o.withColumnRenamed("o_orderpriority", "series_id"), ["series_id"],
                     "o_orderdate", {"y": F.sum("o_totalprice")}, "month")
    scan = [ln for ln in plan(s).splitlines() if "FileScan parquet" in ln][0]
    assert "LessThan(o_orderdate" in scan
    assert "o_custkey" not in scan and "o_orderstatus" not in scan


@pytest.mark.parametrize("name", ["sofa", "vaso_cv", "pafi_vent", "echo_weight", "lag_pairs",
                                  "acf", "density", "screen_topk", "all_subsets"])
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    if name != "screen_topk":      # screen_topk crosses with its 1-row model only
        assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["lag_pairs", "acf", "distributed_lags", "monthly_series"])
def test_series_ops_have_no_global_window(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "SinglePartition" not in p
    # lags run over blocks of positions, never over a whole series
    for line in (ln for ln in p.splitlines() if re.search(r"[-+ ]Window \[", ln)):
        assert re.search(r"windowspecdefinition\(series_id#\d+, _block#\d+", line), line


def test_no_row_at_a_time_python_anywhere(spark):
    for name, fn in E.queries().items():
        p = plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in p, name


def test_first_value_is_one_partial_aggregate(spark):
    p = plan(C.heightweight(X.chartevents(spark, SF_SMALL)))
    assert "Window" not in p
    assert p.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["monthly_series", "model_glance", "breusch_godfrey", "all_subsets", "stepwise",
                                  "forecast_intervals", "forecast_scenarios", "screen_topk", "acf", "publish_mart"])
def test_plans_of_the_staged_jobs(spark, monkeypatch, name):
    """The eager jobs of a query are the tables it writes: their plans have
    no row-at-a-time Python, no cartesian product, and scan what they use."""
    from pyspark.sql import DataFrameWriter
    from wardcast.plans.catalog import all_queries
    seen = []
    write = DataFrameWriter.parquet

    def spy(self, path, *args, **kw):
        seen.append(plan(self._df))
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    all_queries()[name](spark, SF_SMALL)
    assert seen, "nothing was staged"
    for p in seen:
        assert "BatchEvalPython" not in p and "CartesianProduct" not in p
        for scan in (ln for ln in p.splitlines() if "FileScan parquet" in ln and "lineitem.parquet" in ln):
            assert "l_comment" not in scan and "l_shipinstruct" not in scan
    if name in ("model_glance", "breusch_godfrey", "forecast_intervals"):
        # the window start cuts at the scan, and no further scan looks for the last complete period
        scans = [ln for p in seen for ln in p.splitlines() if "FileScan parquet" in ln and "orders.parquet" in ln]
        assert len(scans) == 1 and "GreaterThanOrEqual(o_orderdate" in scans[0]
