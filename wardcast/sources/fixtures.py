"""Driver tables -> the clinical input views of the marts.

The clinical views are a deterministic mapping of ``events`` (see
FIXTURES.md): a stay id ``sid`` per user and week of January 2024, codes
picked by ``event_id`` position, NULL / zero / error cases injected by
modulo rules.  Each view is one projection (no shuffle) or one partial
aggregate, written as SQL expressions so a whole view is built in a single
call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.functions.codes import (FIXTURE_CHART_ITEMS, FIXTURE_CV_ITEMS,
                                      FIXTURE_MV_ITEMS)
from wardcast.session import stage_table
from wardcast.sources.tables import read_table

SID = "CAST(user_id * 10 + floor((dayofyear(ts) - 1) / 7) AS BIGINT)"


def _pick(codes: list[int]) -> str:
    """Code at position 1 + event_id mod len(codes)."""
    arr = ", ".join(str(c) for c in codes)
    return f"CAST(element_at(array({arr}), CAST(pmod(event_id, {len(codes)}) + 1 AS INT)) AS INT)"


def _events(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value")
    return ev.filter(where) if where else ev


def icustays(spark, sf_dir) -> DataFrame:
    """One row per stay; staged because every mart step joins to it."""
    ev = _events(spark, sf_dir).selectExpr(f"{SID} AS sid", "user_id", "ts")
    stays = ev.groupBy("sid").agg({"user_id": "min", "ts": "min"}).selectExpr(
        "CAST(`min(user_id)` % 60 AS BIGINT) AS subject_id",
        "CAST(sid + 100000 AS BIGINT) AS hadm_id",
        "sid AS icustay_id",
        "`min(ts)` + INTERVAL 12 HOURS AS intime")
    return stage_table(stays, "icustays")


def chartevents(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "CAST(user_id % 60 AS BIGINT) AS subject_id",
        f"CASE WHEN pmod(event_id, 23) = 0 THEN CAST(NULL AS BIGINT) ELSE {SID} END AS icustay_id",
        "ts AS charttime",
        f"{_pick(FIXTURE_CHART_ITEMS)} AS itemid",
        "CASE WHEN pmod(event_id, 19) = 0 THEN CAST(NULL AS DOUBLE)"
        " WHEN pmod(event_id, 29) = 0 THEN 0.0D ELSE value END AS valuenum",
        "CAST(CASE WHEN pmod(event_id, 17) = 0 THEN 1 WHEN pmod(event_id, 5) = 0 THEN 0 END AS INT)"
        " AS error")


def inputevents_cv(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, "event_type IN ('view', 'click')").selectExpr(
        f"{SID} AS icustay_id", "ts AS charttime",
        f"{_pick(FIXTURE_CV_ITEMS)} AS itemid",
        "CASE WHEN pmod(event_id, 31) = 0 THEN CAST(NULL AS DOUBLE)"
        " WHEN pmod(event_id, 10) IN (1, 3, 4) THEN value / 500"
        " WHEN pmod(event_id, 10) IN (0, 2) THEN value / 10"
        " ELSE value / 8 END AS rate")


def inputevents_mv(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, "event_type = 'purchase'").selectExpr(
        f"{SID} AS icustay_id", "ts AS starttime",
        f"{_pick(FIXTURE_MV_ITEMS)} AS itemid",
        "CASE WHEN pmod(event_id, 4) < 2 THEN value / 500 ELSE value / 8 END AS rate",
        "CASE WHEN pmod(event_id, 7) = 0 THEN 'Rewritten'"
        " WHEN pmod(event_id, 11) = 0 THEN CAST(NULL AS STRING)"
        " ELSE 'FinishedRunning' END AS statusdescription")


def echodata(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, "event_type = 'signup'").selectExpr(
        f"CAST({SID} + 100000 AS BIGINT) AS hadm_id", "ts AS charttime",
        "value + 100 AS weight")


def bloodgasfirstdayarterial(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, "event_type = 'error'").selectExpr(
        f"{SID} AS icustay_id", "ts AS charttime", "value * 5 + 40 AS PaO2FiO2")


def ventdurations(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, "event_type = 'signup'").selectExpr(
        f"{SID} AS icustay_id", "ts AS starttime", "ts + INTERVAL 36 HOURS AS endtime")


def _per_stay(spark, sf_dir, where: str, aggs: list[str]) -> DataFrame:
    ev = _events(spark, sf_dir, where).selectExpr(f"{SID} AS icustay_id", "*")
    return ev.groupBy("icustay_id").agg(*[F.expr(a) for a in aggs])


def vitalsfirstday(spark, sf_dir) -> DataFrame:
    return _per_stay(spark, sf_dir, "event_type = 'view'",
                     ["min(value) * 2 + 60 AS MeanBP_Min"])


def labsfirstday(spark, sf_dir) -> DataFrame:
    return _per_stay(spark, sf_dir, "event_type IN ('click', 'purchase', 'signup')", [
        "max(CASE WHEN event_type = 'click' THEN value END) / 40 AS Creatinine_Max",
        "max(CASE WHEN event_type = 'purchase' THEN value END) / 15 AS Bilirubin_Max",
        "min(CASE WHEN event_type = 'signup' THEN value END) * 8 AS Platelet_Min"])


def uofirstday(spark, sf_dir) -> DataFrame:
    return _per_stay(spark, sf_dir, "event_type = 'error'", ["sum(value) * 4 AS UrineOutput"])


def gcsfirstday(spark, sf_dir) -> DataFrame:
    return _per_stay(spark, sf_dir, "event_type = 'purchase'",
                     ["CAST(pmod(min(pmod(event_id, 40)), 13) + 3 AS INT) AS MinGCS"])


CLINICAL_VIEWS = {
    "icustays": icustays,
    "chartevents": chartevents,
    "inputevents_cv": inputevents_cv,
    "inputevents_mv": inputevents_mv,
    "echodata": echodata,
    "bloodgasfirstdayarterial": bloodgasfirstdayarterial,
    "ventdurations": ventdurations,
    "vitalsfirstday": vitalsfirstday,
    "labsfirstday": labsfirstday,
    "uofirstday": uofirstday,
    "gcsfirstday": gcsfirstday,
}


def clinical_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {k: f(spark, sf_dir) for k, f in CLINICAL_VIEWS.items()}
