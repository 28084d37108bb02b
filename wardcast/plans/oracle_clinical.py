"""DuckDB SQL for the clinical queries: an independent statement of the same
semantics, used as the correctness oracle (driver views + marts)."""

from __future__ import annotations

# Fixture views over `events` (FIXTURES.md section 3), DuckDB dialect.
SID = "(user_id*10 + CAST(floor((dayofyear(ts)-1)/7) AS BIGINT))"

VIEWS = f"""
icustays AS (
  SELECT CAST(min(user_id) % 60 AS BIGINT) AS subject_id,
         CAST({SID} + 100000 AS BIGINT) AS hadm_id,
         {SID} AS icustay_id,
         min(ts) + INTERVAL 12 HOUR AS intime
  FROM events GROUP BY {SID}),
chartevents AS (
  SELECT CAST(user_id % 60 AS BIGINT) AS subject_id,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE {SID} END AS icustay_id,
         ts AS charttime,
         CAST(([762,763,3723,3580,226512,3581,3582,920,1394,4187,3486,226707,3485,4188,226531,999])[1 + event_id % 16] AS INTEGER) AS itemid,
         CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 0.0 ELSE value END AS valuenum,
         CAST(CASE WHEN event_id % 17 = 0 THEN 1 WHEN event_id % 5 = 0 THEN 0 END AS INTEGER) AS error
  FROM events),
inputevents_cv AS (
  SELECT {SID} AS icustay_id, ts AS charttime,
         CAST(([30047,30120,30044,30119,30309,30043,30307,30042,30306,30001])[1 + event_id % 10] AS INTEGER) AS itemid,
         CASE WHEN event_id % 31 = 0 THEN NULL
              WHEN event_id % 10 IN (1,3,4) THEN value/500
              WHEN event_id % 10 IN (0,2) THEN value/10
              ELSE value/8 END AS rate
  FROM events WHERE event_type IN ('view','click')),
inputevents_mv AS (
  SELECT {SID} AS icustay_id, ts AS starttime,
         CAST(([221906,221289,221662,221653])[1 + event_id % 4] AS INTEGER) AS itemid,
         CASE WHEN event_id % 4 < 2 THEN value/500 ELSE value/8 END AS rate,
         CASE WHEN event_id % 7 = 0 THEN 'Rewritten' WHEN event_id % 11 = 0 THEN NULL
              ELSE 'FinishedRunning' END AS statusdescription
  FROM events WHERE event_type = 'purchase'),
echodata AS (
  SELECT CAST({SID} + 100000 AS BIGINT) AS hadm_id, ts AS charttime, 100 + value AS weight
  FROM events WHERE event_type = 'signup'),
bloodgasfirstdayarterial AS (
  SELECT {SID} AS icustay_id, ts AS charttime, 40 + value*5 AS PaO2FiO2
  FROM events WHERE event_type = 'error'),
ventdurations AS (
  SELECT {SID} AS icustay_id, ts AS starttime, ts + INTERVAL 36 HOUR AS endtime
  FROM events WHERE event_type = 'signup'),
vitalsfirstday AS (
  SELECT {SID} AS icustay_id, 60 + 2*min(value) AS MeanBP_Min
  FROM events WHERE event_type = 'view' GROUP BY {SID}),
labsfirstday AS (
  SELECT {SID} AS icustay_id,
         max(CASE WHEN event_type='click' THEN value END)/40 AS Creatinine_Max,
         max(CASE WHEN event_type='purchase' THEN value END)/15 AS Bilirubin_Max,
         8*min(CASE WHEN event_type='signup' THEN value END) AS Platelet_Min
  FROM events WHERE event_type IN ('click','purchase','signup') GROUP BY {SID}),
uofirstday AS (
  SELECT {SID} AS icustay_id, 4*sum(value) AS UrineOutput
  FROM events WHERE event_type = 'error' GROUP BY {SID}),
gcsfirstday AS (
  SELECT {SID} AS icustay_id, CAST(3 + min(event_id % 40) % 13 AS INTEGER) AS MinGCS
  FROM events WHERE event_type = 'purchase' GROUP BY {SID})"""

# Fixed values of the marts, stated here on their own: nothing is imported
# from the code under test, so a wrong code, factor or threshold there shows.
HW_CODES = """code_hw(code, param, factor) AS (VALUES
  (762, 'WEIGHT', 1.0), (763, 'WEIGHT', 1.0), (3723, 'WEIGHT', 1.0), (3580, 'WEIGHT', 1.0),
  (226512, 'WEIGHT', 1.0), (3581, 'WEIGHT', 0.45359237), (3582, 'WEIGHT', 0.0283495231),
  (920, 'HEIGHT', 2.54), (1394, 'HEIGHT', 2.54), (4187, 'HEIGHT', 2.54), (3486, 'HEIGHT', 2.54),
  (226707, 'HEIGHT', 2.54), (3485, 'HEIGHT', 1.0), (4188, 'HEIGHT', 1.0))"""
CV_CODES_SQL = """code_cv(code, drug, per_weight) AS (VALUES
  (30047, 'norepinephrine', true), (30120, 'norepinephrine', false),
  (30044, 'epinephrine', true), (30119, 'epinephrine', false), (30309, 'epinephrine', false),
  (30043, 'dopamine', false), (30307, 'dopamine', false),
  (30042, 'dobutamine', false), (30306, 'dobutamine', false))"""
MV_CODES_SQL = """code_mv(code, drug) AS (VALUES
  (221906, 'norepinephrine'), (221289, 'epinephrine'), (221662, 'dopamine'), (221653, 'dobutamine'))"""
POUND = "0.45359237"
DRUGS = ["norepinephrine", "epinephrine", "dopamine", "dobutamine"]


def _passed(*tests: str) -> str:
    """How many of the tests hold (an unknown one does not)."""
    return "(" + " + ".join(f"coalesce(CAST({t} AS INTEGER), 0)" for t in tests) + ")"


def _if(test: str, score: int) -> str:
    return f"CASE WHEN {test} THEN {score} ELSE 0 END"


# One expression per component.  Where the thresholds of one measure are
# nested, the score is the number of thresholds passed; components of several
# measures are the worst of their parts.
BANDS = {
    "respiration": ("coalesce(PaO2FiO2_vent_min, PaO2FiO2_novent_min)", "greatest("
                    + ", ".join([_if("PaO2FiO2_vent_min < 100", 4), _if("PaO2FiO2_vent_min < 200", 3),
                                 _passed("PaO2FiO2_novent_min < 400", "PaO2FiO2_novent_min < 300")]) + ")"),
    "coagulation": ("Platelet_Min", _passed("Platelet_Min < 150", "Platelet_Min < 100",
                                            "Platelet_Min < 50", "Platelet_Min < 20")),
    "liver": ("Bilirubin_Max", _passed("Bilirubin_Max >= 1.2", "Bilirubin_Max >= 2.0",
                                       "Bilirubin_Max >= 6.0", "Bilirubin_Max >= 12.0")),
    "cardiovascular": (
        "coalesce(MeanBP_Min, rate_dopamine, rate_dobutamine, rate_epinephrine, rate_norepinephrine)",
        "greatest(" + ", ".join([
            _if("MeanBP_Min < 70", 1), _if("rate_dobutamine > 0", 2),
            "CASE WHEN rate_dopamine > 15 THEN 4 WHEN rate_dopamine > 5 THEN 3 WHEN rate_dopamine > 0 THEN 2 ELSE 0 END",
            "CASE WHEN rate_epinephrine IS NULL THEN 0 WHEN rate_epinephrine > 0.1 THEN 4 ELSE 3 END",
            "CASE WHEN rate_norepinephrine IS NULL THEN 0 WHEN rate_norepinephrine > 0.1 THEN 4 ELSE 3 END"]) + ")"),
    "cns": ("MinGCS", _passed("MinGCS < 15", "MinGCS < 13", "MinGCS < 10", "MinGCS < 6")),
    "renal": ("coalesce(UrineOutput, Creatinine_Max)", "greatest(" + ", ".join([
        _passed("Creatinine_Max >= 1.2", "Creatinine_Max >= 2.0", "Creatinine_Max >= 3.5", "Creatinine_Max >= 5.0"),
        _if("UrineOutput < 500", 3), _if("UrineOutput < 200", 4)]) + ")"),
}

HW_RAW = f"""
{HW_CODES},
hw_raw AS (
  select ce.charttime, ce.itemid, ce.subject_id, ce.icustay_id, k.param AS parameter,
         ce.valuenum * k.factor AS valuenum
  from chartevents ce join code_hw k on k.code = ce.itemid
  where ce.valuenum is not null and ce.valuenum <> 0 and coalesce(ce.error, 0) <> 1)"""

HW_SINGLE = """
hw_single AS (
  select subject_id, icustay_id, parameter,
         arg_min(valuenum, (charttime is null, charttime, itemid, valuenum)) AS first_valuenum,
         min(valuenum) AS min_valuenum, max(valuenum) AS max_valuenum
  from hw_raw group by all)"""

SOFA_CTES = f"""
{HW_CODES}, {CV_CODES_SQL}, {MV_CODES_SQL},
kg_chart AS (
  select st.icustay_id, avg(ce.valuenum * k.factor) AS weight
  from icustays st
  join chartevents ce on ce.icustay_id = st.icustay_id
  join code_hw k on k.code = ce.itemid and k.param = 'WEIGHT'
  where ce.valuenum is not null and ce.valuenum <> 0 and coalesce(ce.error, 0) <> 1
    and ce.charttime >= st.intime - INTERVAL 1 DAY and ce.charttime <= st.intime + INTERVAL 1 DAY
  group by st.icustay_id),
kg_echo AS (
  select st.icustay_id,
         (select avg(e.weight * {POUND}) from echodata e
           where e.hadm_id = st.hadm_id
             and e.charttime > st.intime - INTERVAL 7 DAY
             and e.charttime < st.intime + INTERVAL 1 DAY) AS weight
  from icustays st),
cv_rates AS (
  select st.icustay_id, k.drug,
         CASE WHEN k.per_weight
              THEN ev.rate / nullif(coalesce(kc.weight, ke.weight), 0) ELSE ev.rate END AS r
  from icustays st
  join inputevents_cv ev on ev.icustay_id = st.icustay_id
   and ev.charttime >= st.intime and ev.charttime <= st.intime + INTERVAL 1 DAY
  join code_cv k on k.code = ev.itemid
  left join kg_chart kc on kc.icustay_id = st.icustay_id
  left join kg_echo ke on ke.icustay_id = st.icustay_id
  where ev.rate is not null),
cv_max AS (
  select icustay_id, {", ".join(f"max(r) FILTER (WHERE drug = '{d}') AS rate_{d}" for d in DRUGS)}
  from cv_rates group by icustay_id),
mv_max AS (
  select st.icustay_id, {", ".join(f"max(ev.rate) FILTER (WHERE k.drug = '{d}') AS rate_{d}" for d in DRUGS)}
  from icustays st
  join inputevents_mv ev on ev.icustay_id = st.icustay_id
   and ev.starttime >= st.intime and ev.starttime <= st.intime + INTERVAL 1 DAY
  join code_mv k on k.code = ev.itemid
  where ev.statusdescription <> 'Rewritten'
  group by st.icustay_id),
gas AS (
  select g.icustay_id, g.PaO2FiO2,
         exists (select 1 from ventdurations v where v.icustay_id = g.icustay_id
                 and g.charttime between v.starttime and v.endtime) AS vented
  from bloodgasfirstdayarterial g),
gas_min AS (
  select icustay_id,
         min(PaO2FiO2) FILTER (WHERE NOT vented) AS PaO2FiO2_novent_min,
         min(PaO2FiO2) FILTER (WHERE vented) AS PaO2FiO2_vent_min
  from gas group by icustay_id),
inputs AS (
  select st.subject_id, st.hadm_id, st.icustay_id, vi.MeanBP_Min,
         {", ".join(f"coalesce(c.rate_{d}, m.rate_{d}) AS rate_{d}" for d in DRUGS)},
         lb.Creatinine_Max, lb.Bilirubin_Max, lb.Platelet_Min,
         gm.PaO2FiO2_novent_min, gm.PaO2FiO2_vent_min, u.UrineOutput, gc.MinGCS
  from icustays st
  left join cv_max c using (icustay_id)
  left join mv_max m using (icustay_id)
  left join gas_min gm using (icustay_id)
  left join vitalsfirstday vi using (icustay_id)
  left join labsfirstday lb using (icustay_id)
  left join uofirstday u using (icustay_id)
  left join gcsfirstday gc using (icustay_id)),
bands AS (
  select *, {", ".join(f"CAST(CASE WHEN {known} IS NOT NULL THEN {score} END AS INTEGER) AS {name}"
                       for name, (known, score) in BANDS.items())}
  from inputs)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join([VIEWS, *parts])


R6 = "round({0}, 6) AS {0}"


def _r6(cols):
    return ", ".join(R6.format(c) for c in cols)


RATES = ["rate_norepinephrine", "rate_epinephrine", "rate_dopamine", "rate_dobutamine"]

HW_PIVOT = """
hw_pivot AS (
  select subject_id, icustay_id,
    any_value(first_valuenum) FILTER (WHERE parameter = 'HEIGHT') AS height_first,
    any_value(min_valuenum) FILTER (WHERE parameter = 'HEIGHT') AS height_min,
    any_value(max_valuenum) FILTER (WHERE parameter = 'HEIGHT') AS height_max,
    any_value(first_valuenum) FILTER (WHERE parameter = 'WEIGHT') AS weight_first,
    any_value(min_valuenum) FILTER (WHERE parameter = 'WEIGHT') AS weight_min,
    any_value(max_valuenum) FILTER (WHERE parameter = 'WEIGHT') AS weight_max
  from hw_single group by subject_id, icustay_id)"""

ORACLE = {
    "hw_raw_convert": _with(HW_RAW) + """
SELECT charttime, itemid, subject_id, icustay_id, parameter, round(valuenum, 6) AS valuenum
FROM hw_raw""",
    "hw_first_min_max": _with(HW_RAW, HW_SINGLE) + """
SELECT subject_id, icustay_id, parameter,
       round(first_valuenum, 6) AS first_valuenum,
       round(min_valuenum, 6) AS min_valuenum, round(max_valuenum, 6) AS max_valuenum
FROM hw_single""",
    "heightweight": _with(HW_RAW, HW_SINGLE, HW_PIVOT) + """
SELECT icustay_id, subject_id,
  CAST(round(TRY_CAST(height_first AS DECIMAL(38,6)), 2) AS DOUBLE) AS height_first,
  CAST(round(TRY_CAST(height_min AS DECIMAL(38,6)), 2) AS DOUBLE) AS height_min,
  CAST(round(TRY_CAST(height_max AS DECIMAL(38,6)), 2) AS DOUBLE) AS height_max,
  CAST(round(TRY_CAST(weight_first AS DECIMAL(38,6)), 2) AS DOUBLE) AS weight_first,
  CAST(round(TRY_CAST(weight_min AS DECIMAL(38,6)), 2) AS DOUBLE) AS weight_min,
  CAST(round(TRY_CAST(weight_max AS DECIMAL(38,6)), 2) AS DOUBLE) AS weight_max
FROM hw_pivot ORDER BY subject_id NULLS LAST, icustay_id NULLS LAST""",
    "stay_weight": _with(SOFA_CTES) + "\nSELECT icustay_id, round(weight, 6) AS weight FROM kg_chart",
    "echo_weight": _with(SOFA_CTES) + "\nSELECT icustay_id, round(weight, 6) AS weight FROM kg_echo",
    "vaso_cv": _with(SOFA_CTES) + f"\nSELECT icustay_id, {_r6(RATES)} FROM cv_max",
    "vaso_mv": _with(SOFA_CTES) + f"\nSELECT icustay_id, {_r6(RATES)} FROM mv_max",
    "pafi_vent": _with(SOFA_CTES) + """
SELECT icustay_id, round(PaO2FiO2_novent_min, 6) AS PaO2FiO2_novent_min,
       round(PaO2FiO2_vent_min, 6) AS PaO2FiO2_vent_min FROM gas_min""",
    "sofa_components": _with(SOFA_CTES) + """
SELECT subject_id, hadm_id, icustay_id, round(MeanBP_Min, 6) AS MeanBP_Min,
  round(rate_norepinephrine, 6) AS rate_norepinephrine,
  round(rate_epinephrine, 6) AS rate_epinephrine,
  round(rate_dopamine, 6) AS rate_dopamine, round(rate_dobutamine, 6) AS rate_dobutamine,
  round(Creatinine_Max, 6) AS Creatinine_Max, round(Bilirubin_Max, 6) AS Bilirubin_Max,
  round(Platelet_Min, 6) AS Platelet_Min,
  round(PaO2FiO2_novent_min, 6) AS PaO2FiO2_novent_min,
  round(PaO2FiO2_vent_min, 6) AS PaO2FiO2_vent_min,
  round(UrineOutput, 6) AS UrineOutput, MinGCS
FROM inputs""",
    "sofa_scores": _with(SOFA_CTES) + """
SELECT icustay_id, respiration, coagulation, liver, cardiovascular, cns, renal
FROM bands""",
    "publish_mart": _with(SOFA_CTES) + """
SELECT ie.subject_id, ie.hadm_id, ie.icustay_id,
  CAST(coalesce(respiration,0) + coalesce(coagulation,0) + coalesce(liver,0)
     + coalesce(cardiovascular,0) + coalesce(cns,0) + coalesce(renal,0) AS INTEGER) AS SOFA,
  respiration, coagulation, liver, cardiovascular, cns, renal
FROM icustays ie LEFT JOIN bands s ON ie.icustay_id = s.icustay_id""",
    "sofa": _with(SOFA_CTES) + """
SELECT ie.subject_id, ie.hadm_id, ie.icustay_id,
  CAST(coalesce(respiration,0) + coalesce(coagulation,0) + coalesce(liver,0)
     + coalesce(cardiovascular,0) + coalesce(cns,0) + coalesce(renal,0) AS INTEGER) AS SOFA,
  respiration, coagulation, liver, cardiovascular, cns, renal
FROM icustays ie LEFT JOIN bands s ON ie.icustay_id = s.icustay_id
ORDER BY ie.icustay_id""",
}

ORACLE["vent_overlap"] = _with(SOFA_CTES) + """
SELECT bg.icustay_id, bg.charttime, round(bg.PaO2FiO2, 6) AS PaO2FiO2,
       (SELECT count(*) FROM ventdurations v WHERE v.icustay_id = bg.icustay_id
          AND bg.charttime BETWEEN v.starttime AND v.endtime) AS n_vent
FROM bloodgasfirstdayarterial bg"""

ORACLE["mart_cascade"] = _with(HW_RAW, HW_SINGLE, HW_PIVOT) + """,
hw AS (SELECT subject_id, round(TRY_CAST(height_max AS DECIMAL(38,6)), 2) AS h FROM hw_pivot),
tall AS (SELECT subject_id, max(h) AS h FROM hw GROUP BY 1)
SELECT 'tallest_stays' AS mart, count(*) AS n_rows, CAST(1 AS INTEGER) AS dropped FROM hw JOIN tall USING (subject_id, h)
UNION ALL SELECT 'tallest', count(*), 2 FROM tall
UNION ALL SELECT 'heightweight', count(*), 3 FROM hw"""
