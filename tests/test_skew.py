"""Hot keys: one stay holding a third of all rows."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import CHART, STAYS, T0, at, rows
from wardcast.operators import clinical as C
from wardcast.operators.intervals import window_join


def hot_chart(spark, n_hot=3000, n_cold=60):
    hot = [(1, 10, at(-1 + 2.0 * i / n_hot), 762 if i % 2 else 3581, 50.0 + i % 37, None)
           for i in range(n_hot)]
    cold = [(k, 100 + k, at(0.1 * (i % 9)), 763, 60.0 + i, None)
            for k in range(2, 2 + n_cold) for i in range(n_hot // (2 * n_cold))]
    return spark.createDataFrame(hot + cold, CHART)


def stays(spark, n_cold=60):
    return spark.createDataFrame([(1, 1000, 10, T0)] + [(k, 1000 + k, 100 + k, T0)
                                                       for k in range(2, 2 + n_cold)], STAYS)


def test_hot_stay_same_result_with_salt(spark):
    ce, st = hot_chart(spark), stays(spark)
    base = {r["icustay_id"]: r["weight"] for r in rows(C.stay_weight(st, ce, salt=1))}
    salted = {r["icustay_id"]: r["weight"] for r in rows(C.stay_weight(st, ce, salt=16))}
    assert base.keys() == salted.keys() and len(base) == 61
    for k in base:
        assert salted[k] == pytest.approx(base[k], rel=1e-12)


def test_salted_join_keys_and_day_buckets(spark):
    ce, st = hot_chart(spark), stays(spark)
    j = window_join(ce.select("icustay_id", "charttime", "valuenum"), st.select("icustay_id", "intime"),
                    "icustay_id", "charttime", F.col("intime") - F.expr("INTERVAL 1 DAY"),
                    F.col("intime") + F.expr("INTERVAL 1 DAY"), salt=8,
                    salt_cols=["charttime", "valuenum"])
    p = j._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in p and "_day" in p
    # every event of the hot stay falls in its window and is matched exactly once
    assert j.filter(F.col("icustay_id") == 10).count() == 3000


def test_session_enables_skew_handling(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
