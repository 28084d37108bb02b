"""Clinical marts: per-stay height/weight and the six-organ failure score.

Each CTE of the original SQL is one function ``DataFrame -> DataFrame``.
Scale notes:
* the measurement filters (itemid IN, valuenum not null / <> 0) push down to
  the parquet scan; unit conversion is a literal map lookup (no join).
* first/min/max per (subject, stay, parameter) is one partial aggregate with
  ``min_by`` instead of a window + DISTINCT, so a hot stay is combined
  map-side before the shuffle and no group is ever sorted in one task.
* the six per-stay inputs are each pre-aggregated on ``icustay_id`` and then
  joined on that one key, so the exchanges line up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.functions.banding import band_sql, total_with_missing_as_zero
from wardcast.functions.codes import (CV_CODES, CV_DRUGS, HEIGHT_WEIGHT_CODES,
                                      LB_TO_KG, MV_CODES, MV_DRUGS,
                                      MV_REWRITTEN, hw_itemids, weight_itemids)
from wardcast.operators.interval_index import covering_counts
from wardcast.operators.intervals import window_join

def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def _lookup(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def _valid_measurement(itemids: list[int]) -> Column:
    """valuenum not null, raw valuenum <> 0, error IS DISTINCT FROM 1."""
    return (F.col("valuenum").isNotNull() & (F.col("valuenum") != 0)
            & ~F.col("error").eqNullSafe(1) & F.col("itemid").isin(itemids))


def to_standard_units(chartevents: DataFrame, itemids: list[int] | None = None) -> DataFrame:
    """Valid height/weight rows labelled and converted to cm / kg."""
    ids = itemids or hw_itemids()
    param = _lookup([(c[0], c[1]) for c in HEIGHT_WEIGHT_CODES])
    factor = _lookup([(c[0], c[2]) for c in HEIGHT_WEIGHT_CODES])
    return (chartevents.filter(_valid_measurement(ids))
            .select("charttime", "itemid", "subject_id", "icustay_id",
                    param[F.col("itemid")].alias("parameter"),
                    (F.col("valuenum") * factor[F.col("itemid")]).alias("valuenum")))


def _first_order(cond: Column | None = None) -> Column:
    """Ordering key for 'first by charttime': NULL times last, ties broken by
    (itemid, value) so the pick is deterministic."""
    key = F.struct(F.col("charttime").isNull().alias("n"), F.col("charttime").alias("t"),
                   F.col("itemid").alias("i"), F.col("valuenum").alias("v"))
    return key if cond is None else F.when(cond, key)


def first_min_max(raw: DataFrame) -> DataFrame:
    """first/min/max value per (subject, stay, parameter); NULL stay is a group."""
    return (raw.groupBy("subject_id", "icustay_id", "parameter")
               .agg(F.min_by("valuenum", _first_order()).alias("first_valuenum"),
                    F.min("valuenum").alias("min_valuenum"),
                    F.max("valuenum").alias("max_valuenum")))


def _round2(c: Column) -> Column:
    """ROUND(CAST(x AS NUMERIC), 2): exact decimal, half away from zero.
    Absurd junk values beyond the decimal range become NULL instead of
    failing the job under ANSI mode."""
    return F.round(c.try_cast("decimal(38,6)"), 2).cast("double")


def heightweight(chartevents: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per (subject, stay): height/weight first, min, max (cm, kg)."""
    from wardcast.sources.schemas import check
    raw = to_standard_units(check("chartevents", chartevents))
    aggs = []
    for p in ("HEIGHT", "WEIGHT"):
        is_p = F.col("parameter") == p
        v = F.when(is_p, F.col("valuenum"))
        aggs += [F.min_by(v, _first_order(is_p)).alias(f"{p.lower()}_first"),
                 F.min(v).alias(f"{p.lower()}_min"),
                 F.max(v).alias(f"{p.lower()}_max")]
    out = raw.groupBy("subject_id", "icustay_id").agg(*aggs)
    cols = ["height_first", "height_min", "height_max",
            "weight_first", "weight_min", "weight_max"]
    out = out.select("icustay_id", "subject_id", *[_round2(F.col(c)).alias(c) for c in cols])
    if ordered:
        out = out.orderBy(F.asc_nulls_last("subject_id"), F.asc_nulls_last("icustay_id"))
    return out


def stay_weight(icustays: DataFrame, chartevents: DataFrame, salt: int = 1) -> DataFrame:
    """Average admission weight (kg) per stay from charted weights within
    [intime - 1 day, intime + 1 day]; stays without one are absent."""
    w = to_standard_units(chartevents, weight_itemids()).select(
        "icustay_id", "charttime", "itemid", "valuenum")
    stays = icustays.select("icustay_id", "intime")
    j = window_join(w, stays, "icustay_id", "charttime",
                    F.col("intime") - _days(1), F.col("intime") + _days(1), salt=salt,
                    salt_cols=["charttime", "itemid", "valuenum"])
    return j.groupBy("icustay_id").agg(F.avg("valuenum").alias("weight"))


def echo_weight(icustays: DataFrame, echodata: DataFrame) -> DataFrame:
    """Average echo-report weight (lb -> kg) per stay, charted in the open
    window (intime - 7 days, intime + 1 day) of the same admission.  Every
    stay is returned; NULL when no report matches."""
    stays = icustays.select("icustay_id", "hadm_id", "intime")
    echo = echodata.select("hadm_id", F.col("charttime").alias("echo_time"),
                           (F.col("weight") * LB_TO_KG).alias("w"))
    matched = window_join(echo, stays, "hadm_id", "echo_time",
                          F.col("intime") - _days(7), F.col("intime") + _days(1),
                          lo_open=True, hi_open=True)
    agg = matched.groupBy("icustay_id").agg(F.avg("w").alias("weight"))
    return stays.select("icustay_id").join(agg, "icustay_id", "left")


def _drug_max(codes: list[int], value: Column) -> Column:
    return F.when(F.col("itemid").isin(codes), value)


def vaso_cv(icustays: DataFrame, inputevents_cv: DataFrame, wt: DataFrame,
            echo: DataFrame, salt: int = 1) -> DataFrame:
    """Max vasopressor rate per stay in [intime, intime + 1 day] (CareVue);
    per-minute doses divided by weight (charted, else echo)."""
    stays = (icustays.select("icustay_id", "intime")
             .join(wt.withColumnRenamed("weight", "wt_weight"), "icustay_id", "left")
             .join(echo.withColumnRenamed("weight", "echo_weight"), "icustay_id", "left")
             .withColumn("kg", F.coalesce("wt_weight", "echo_weight"))
             .drop("wt_weight", "echo_weight"))
    ev = inputevents_cv.filter(F.col("itemid").isin(CV_CODES) & F.col("rate").isNotNull()) \
                       .select("icustay_id", "charttime", "itemid", "rate")
    j = window_join(ev, stays, "icustay_id", "charttime", F.col("intime"),
                    F.col("intime") + _days(1), salt=salt,
                    salt_cols=["charttime", "itemid", "rate"])
    per_kg = F.try_divide(F.col("rate"), F.col("kg"))
    aggs = []
    for drug, spec in CV_DRUGS.items():
        v = None
        if spec["per_weight"]:
            v = F.when(F.col("itemid").isin(spec["per_weight"]), per_kg)
        if spec["per_kg"]:
            v = (F.when(F.col("itemid").isin(spec["per_kg"]), F.col("rate")) if v is None
                 else v.when(F.col("itemid").isin(spec["per_kg"]), F.col("rate")))
        aggs.append(F.max(v).alias(f"rate_{drug}"))
    return j.groupBy("icustay_id").agg(*aggs)


def vaso_mv(icustays: DataFrame, inputevents_mv: DataFrame, salt: int = 1) -> DataFrame:
    """Max vasopressor rate per stay with start in [intime, intime + 1 day]
    (MetaVision); rewritten orders and NULL status are excluded."""
    ev = inputevents_mv.filter(F.col("itemid").isin(MV_CODES)
                               & (F.col("statusdescription") != MV_REWRITTEN)) \
                       .select("icustay_id", "starttime", "itemid", "rate")
    stays = icustays.select("icustay_id", "intime")
    j = window_join(ev, stays, "icustay_id", "starttime", F.col("intime"),
                    F.col("intime") + _days(1), salt=salt,
                    salt_cols=["starttime", "itemid", "rate"])
    return j.groupBy("icustay_id").agg(
        *[F.max(_drug_max([code], F.col("rate"))).alias(f"rate_{drug}")
          for drug, code in MV_DRUGS.items()])


def pafi(bloodgas: DataFrame, ventdurations: DataFrame) -> DataFrame:
    """Lowest PaO2/FiO2 per stay while not ventilated and while ventilated
    (a gas is 'ventilated' when it lies in any closed ventilation episode)."""
    bg = bloodgas.select("icustay_id", "charttime", "PaO2FiO2")
    # a minimum does not mind how many episodes hold a gas: one row per gas is enough
    counted = covering_counts(bg, ventdurations, "icustay_id", "charttime", "starttime", "endtime", "n_vent")
    return counted.groupBy("icustay_id").agg(
        F.min(F.when(F.col("n_vent") == 0, F.col("PaO2FiO2"))).alias("PaO2FiO2_novent_min"),
        F.min(F.when(F.col("n_vent") > 0, F.col("PaO2FiO2"))).alias("PaO2FiO2_vent_min"))


SCORE_INPUTS = ["MeanBP_Min", "rate_norepinephrine", "rate_epinephrine",
                "rate_dopamine", "rate_dobutamine", "Creatinine_Max",
                "Bilirubin_Max", "Platelet_Min", "PaO2FiO2_novent_min",
                "PaO2FiO2_vent_min", "UrineOutput", "MinGCS"]


def score_components(icustays: DataFrame, cv: DataFrame, mv: DataFrame,
                     pf: DataFrame, vitals: DataFrame, labs: DataFrame,
                     uo: DataFrame, gcs: DataFrame) -> DataFrame:
    """Star of left joins on icustay_id: one row per stay with every input."""
    drugs = ["norepinephrine", "epinephrine", "dopamine", "dobutamine"]
    cvr = cv.select("icustay_id", *[F.col(f"rate_{d}").alias(f"cv_{d}") for d in drugs])
    mvr = mv.select("icustay_id", *[F.col(f"rate_{d}").alias(f"mv_{d}") for d in drugs])
    base = icustays.select("subject_id", "hadm_id", "icustay_id")
    j = (base.join(cvr, "icustay_id", "left")
             .join(mvr, "icustay_id", "left")
             .join(pf.select("icustay_id", "PaO2FiO2_novent_min", "PaO2FiO2_vent_min"),
                   "icustay_id", "left")
             .join(vitals.select("icustay_id", "MeanBP_Min"), "icustay_id", "left")
             .join(labs.select("icustay_id", "Creatinine_Max", "Bilirubin_Max",
                               "Platelet_Min"), "icustay_id", "left")
             .join(uo.select("icustay_id", "UrineOutput"), "icustay_id", "left")
             .join(gcs.select("icustay_id", "MinGCS"), "icustay_id", "left"))
    return j.select("subject_id", "hadm_id", "icustay_id", "MeanBP_Min",
                    *[F.coalesce(f"cv_{d}", f"mv_{d}").alias(f"rate_{d}") for d in drugs],
                    "Creatinine_Max", "Bilirubin_Max", "Platelet_Min",
                    "PaO2FiO2_novent_min", "PaO2FiO2_vent_min", "UrineOutput", "MinGCS")


COMPONENTS = ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"]


# --- fixed values: organ-failure bands -------------------------------------
# Ordered first-match cascades (condition, score); NULL comparisons fall
# through, then the NULL condition, else 0.
SCORE_BANDS = {
    "respiration": ([("PaO2FiO2_vent_min < 100", 4), ("PaO2FiO2_vent_min < 200", 3),
                     ("PaO2FiO2_novent_min < 300", 2), ("PaO2FiO2_novent_min < 400", 1)],
                    "coalesce(PaO2FiO2_vent_min, PaO2FiO2_novent_min) IS NULL"),
    "coagulation": ([("Platelet_Min < 20", 4), ("Platelet_Min < 50", 3),
                     ("Platelet_Min < 100", 2), ("Platelet_Min < 150", 1)],
                    "Platelet_Min IS NULL"),
    "liver": ([("Bilirubin_Max >= 12.0", 4), ("Bilirubin_Max >= 6.0", 3),
               ("Bilirubin_Max >= 2.0", 2), ("Bilirubin_Max >= 1.2", 1)],
              "Bilirubin_Max IS NULL"),
    "cardiovascular": (
        [("rate_dopamine > 15 OR rate_epinephrine > 0.1 OR rate_norepinephrine > 0.1", 4),
         ("rate_dopamine > 5 OR rate_epinephrine <= 0.1 OR rate_norepinephrine <= 0.1", 3),
         ("rate_dopamine > 0 OR rate_dobutamine > 0", 2),
         ("MeanBP_Min < 70", 1)],
        "coalesce(MeanBP_Min, rate_dopamine, rate_dobutamine, rate_epinephrine,"
        " rate_norepinephrine) IS NULL"),
    "cns": ([("MinGCS >= 13 AND MinGCS <= 14", 1), ("MinGCS >= 10 AND MinGCS <= 12", 2),
             ("MinGCS >= 6 AND MinGCS <= 9", 3), ("MinGCS < 6", 4)],
            "MinGCS IS NULL"),
    "renal": ([("Creatinine_Max >= 5.0", 4), ("UrineOutput < 200", 4),
               ("Creatinine_Max >= 3.5 AND Creatinine_Max < 5.0", 3), ("UrineOutput < 500", 3),
               ("Creatinine_Max >= 2.0 AND Creatinine_Max < 3.5", 2),
               ("Creatinine_Max >= 1.2 AND Creatinine_Max < 2.0", 1)],
              "coalesce(UrineOutput, Creatinine_Max) IS NULL"),
}


def score_calc(comp: DataFrame) -> DataFrame:
    """Per-component 0-4 bands; NULL when the inputs were not measured."""
    return comp.selectExpr("*", *[f"{band_sql(cases, null_when)} AS {name}"
                                  for name, (cases, null_when) in SCORE_BANDS.items()])


def sofa_from_components(calc: DataFrame, ordered: bool = True) -> DataFrame:
    out = calc.select("subject_id", "hadm_id", "icustay_id",
                      total_with_missing_as_zero(COMPONENTS).alias("SOFA"), *COMPONENTS)
    return out.orderBy("icustay_id") if ordered else out


def sofa(inputs: dict[str, DataFrame], salt: int = 1, ordered: bool = True) -> DataFrame:
    """The full mart from the clinical input views (see sources.fixtures);
    every input is checked against its contract first."""
    from wardcast.sources.schemas import check_all
    check_all(inputs)
    st = inputs["icustays"]
    wt = stay_weight(st, inputs["chartevents"], salt=salt)
    ec = echo_weight(st, inputs["echodata"])
    cv = vaso_cv(st, inputs["inputevents_cv"], wt, ec, salt=salt)
    mv = vaso_mv(st, inputs["inputevents_mv"], salt=salt)
    pf = pafi(inputs["bloodgasfirstdayarterial"], inputs["ventdurations"])
    comp = score_components(st, cv, mv, pf, inputs["vitalsfirstday"],
                            inputs["labsfirstday"], inputs["uofirstday"],
                            inputs["gcsfirstday"])
    return sofa_from_components(score_calc(comp), ordered=ordered)
