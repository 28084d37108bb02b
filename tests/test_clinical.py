"""Hand-made edge rows for the clinical marts (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import types as T

from tests.helpers import CHART, STAYS, T0, at, rows
from wardcast.operators import clinical as C


def chart(spark, data):
    return spark.createDataFrame(data, CHART)


def stays(spark, data=None):
    return spark.createDataFrame(data or [(1, 100, 10, T0), (2, 200, 20, T0)], STAYS)


def test_unit_conversion_and_filters(spark):
    ce = chart(spark, [
        (1, 10, at(0), 3581, 100.0, None),      # lb -> kg
        (1, 10, at(1), 3582, 100.0, 0),         # oz -> kg
        (1, 10, at(2), 920, 70.0, None),        # inches -> cm
        (1, 10, at(3), 3485, 170.0, None),      # cm unchanged
        (1, 10, at(4), 762, 0.0, None),         # raw zero dropped
        (1, 10, at(5), 762, 80.0, 1),           # error = 1 dropped
        (1, 10, at(6), 762, None, None),        # NULL value dropped
        (1, 10, at(7), 226531, 150.0, None),    # deliberately ignored code
        (1, 10, at(8), 999, 1.0, None),         # not a height/weight code
    ])
    out = rows(C.to_standard_units(ce), ["charttime"])
    assert [r["itemid"] for r in out] == [3581, 3582, 920, 3485]
    assert out[0]["valuenum"] == pytest.approx(45.359237)
    assert out[1]["valuenum"] == pytest.approx(2.83495231)
    assert out[2]["valuenum"] == pytest.approx(177.8)
    assert [r["parameter"] for r in out] == ["WEIGHT", "WEIGHT", "HEIGHT", "HEIGHT"]


def test_heightweight_first_min_max_null_stay_and_rounding(spark):
    ce = chart(spark, [
        (1, 10, at(2), 762, 80.0, None),
        (1, 10, at(1), 762, 70.455, None),      # first by time; rounds half up
        (1, 10, None, 762, 10.0, None),         # NULL time sorts last
        (1, 10, at(0), 3485, 170.0, None),
        (2, None, at(0), 763, 60.0, None),      # NULL stay is its own group
        (2, None, at(1), 763, 65.0, None),
    ])
    out = rows(C.heightweight(ce), ["subject_id"])
    assert len(out) == 2
    a = out[0]
    assert a["weight_first"] == 70.46 and a["weight_min"] == 10.0 and a["weight_max"] == 80.0
    assert a["height_first"] == a["height_min"] == a["height_max"] == 170.0
    b = out[1]
    assert b["icustay_id"] is None and b["weight_first"] == 60.0 and b["height_first"] is None
    # First within [min, max]
    for r in out:
        if r["weight_first"] is not None:
            assert r["weight_min"] <= r["weight_first"] <= r["weight_max"]


def test_stay_weight_closed_window(spark):
    ce = chart(spark, [
        (1, 10, at(-1), 762, 60.0, None),        # exactly intime - 1 day: in
        (1, 10, at(1), 762, 80.0, None),         # exactly intime + 1 day: in
        (1, 10, at(1, minutes=1), 762, 500.0, None),   # outside
        (1, 10, at(-7), 762, 500.0, None),       # outside
        (1, 10, at(0), 920, 70.0, None),         # height: not a weight
        (2, 20, at(0), 3581, 100.0, None),
    ])
    out = {r["icustay_id"]: r["weight"] for r in rows(C.stay_weight(stays(spark), ce))}
    assert out[10] == pytest.approx(70.0)
    assert out[20] == pytest.approx(45.359237)


def test_stay_weight_salted_is_identical(spark):
    ce = chart(spark, [(1, 10, at(h / 24.0), 762, 50.0 + h, None) for h in range(40)])
    a = rows(C.stay_weight(stays(spark), ce, salt=1))
    b = rows(C.stay_weight(stays(spark), ce, salt=7))
    assert a[0]["weight"] == pytest.approx(b[0]["weight"])


def test_echo_weight_open_window_keeps_every_stay(spark):
    echo = spark.createDataFrame([
        (100, at(-7), 300.0),            # exactly -7 days: excluded (open)
        (100, at(-6), 200.0),
        (100, at(1), 900.0),             # exactly +1 day: excluded (open)
        (100, at(0), 0.0),               # echo weight 0 kept (0 kg)
    ], "hadm_id bigint, charttime timestamp_ntz, weight double")
    out = {r["icustay_id"]: r["weight"] for r in rows(C.echo_weight(stays(spark), echo))}
    assert out[10] == pytest.approx(100.0 * 0.45359237)
    assert out[20] is None


def test_vaso_cv_weight_division_and_nulls(spark):
    st = stays(spark)
    cv = spark.createDataFrame([
        (10, at(0.5), 30047, 10.0),      # per minute / weight 50 -> 0.2
        (10, at(0.5), 30120, 0.05),
        (10, at(0.5), 30043, None),      # NULL rate ignored
        (10, at(2), 30043, 99.0),        # outside [intime, intime+1d]
        (10, at(0.2), 30001, 5.0),       # not a vasopressor code
        (20, at(0), 30044, 3.0),         # weight 0 -> NULL, not an error
    ], "icustay_id bigint, charttime timestamp_ntz, itemid int, rate double")
    wt = spark.createDataFrame([(10, 50.0), (20, 0.0)], "icustay_id bigint, weight double")
    ec = spark.createDataFrame([(10, 70.0), (20, None)], "icustay_id bigint, weight double")
    out = {r["icustay_id"]: r for r in rows(C.vaso_cv(st, cv, wt, ec))}
    assert out[10]["rate_norepinephrine"] == pytest.approx(0.2)
    assert out[10]["rate_dopamine"] is None
    assert out[20]["rate_epinephrine"] is None


def test_vaso_mv_status_filter(spark):
    mv = spark.createDataFrame([
        (10, at(0.1), 221906, 0.3, "FinishedRunning"),
        (10, at(0.1), 221906, 9.0, "Rewritten"),
        (10, at(0.1), 221289, 9.0, None),       # NULL status dropped (<> is null-rejecting)
        (20, at(0.1), 221662, None, "FinishedRunning"),   # only NULL rates: row with NULLs
    ], "icustay_id bigint, starttime timestamp_ntz, itemid int, rate double, statusdescription string")
    out = {r["icustay_id"]: r for r in rows(C.vaso_mv(stays(spark), mv))}
    assert out[10]["rate_norepinephrine"] == pytest.approx(0.3)
    assert out[10]["rate_epinephrine"] is None
    assert 20 in out and out[20]["rate_dopamine"] is None


def test_pafi_overlapping_episodes_and_bounds(spark):
    bg = spark.createDataFrame([
        (10, at(0), 120.0),              # exactly at start: ventilated
        (10, at(1), 130.0),              # exactly at end: ventilated
        (10, at(3), 68.0),               # not ventilated
        (20, at(0.5), 250.0),            # inside two overlapping episodes
    ], "icustay_id bigint, charttime timestamp_ntz, PaO2FiO2 double")
    vd = spark.createDataFrame([
        (10, at(0), at(1)), (20, at(0), at(2)), (20, at(0.25), at(0.75)),
    ], "icustay_id bigint, starttime timestamp_ntz, endtime timestamp_ntz")
    out = {r["icustay_id"]: r for r in rows(C.pafi(bg, vd))}
    assert out[10]["PaO2FiO2_vent_min"] == 120.0
    assert out[10]["PaO2FiO2_novent_min"] == 68.0
    assert out[20]["PaO2FiO2_vent_min"] == 250.0 and out[20]["PaO2FiO2_novent_min"] is None


SCORE_SCHEMA = ("icustay_id bigint, subject_id bigint, hadm_id bigint, MeanBP_Min double, "
                "rate_norepinephrine double, rate_epinephrine double, rate_dopamine double, "
                "rate_dobutamine double, Creatinine_Max double, Bilirubin_Max double, "
                "Platelet_Min double, PaO2FiO2_novent_min double, PaO2FiO2_vent_min double, "
                "UrineOutput double, MinGCS double")


def score(spark, **kw):
    cols = [f.split()[0] for f in SCORE_SCHEMA.split(", ")]
    vals = tuple(kw.get(c, 1 if c in ("icustay_id", "subject_id", "hadm_id") else None) for c in cols)
    return rows(C.sofa_from_components(C.score_calc(spark.createDataFrame([vals], SCORE_SCHEMA)),
                                       ordered=False))[0]


def test_score_worked_examples(spark):
    r = score(spark, PaO2FiO2_novent_min=68.0, PaO2FiO2_vent_min=120.0)
    assert r["respiration"] == 3                    # G1: 3, not 4
    assert score(spark, PaO2FiO2_vent_min=250.0)["respiration"] == 0
    assert score(spark, rate_epinephrine=0.0)["cardiovascular"] == 3   # recorded 0 -> 3
    assert score(spark, MinGCS=12.5)["cns"] == 0
    assert score(spark, Creatinine_Max=3.4, UrineOutput=400.0)["renal"] == 3
    assert score(spark, UrineOutput=150.0)["renal"] == 4
    assert score(spark, Bilirubin_Max=1.2)["liver"] == 1
    assert score(spark, Platelet_Min=150.0)["coagulation"] == 0


def test_missing_components_null_but_zero_in_total(spark):
    r = score(spark, Platelet_Min=10.0)
    assert r["coagulation"] == 4 and r["liver"] is None and r["respiration"] is None
    assert r["SOFA"] == 4                            # G2
    empty = score(spark)
    assert empty["SOFA"] == 0 and all(empty[c] is None for c in C.COMPONENTS)


def test_sofa_every_stay_once(spark):
    from tests.conftest import SF_SMALL
    from wardcast.sources.fixtures import clinical_inputs
    inp = clinical_inputs(spark, SF_SMALL)
    out = C.sofa(inp, ordered=False)
    n_stays = inp["icustays"].count()
    assert out.count() == n_stays == out.select("icustay_id").distinct().count()
