"""Named clinical queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from wardcast.operators import clinical as C
from wardcast.operators.interval_index import covering_counts
from wardcast.plans.common import rounded
from wardcast.session import ensure_checkpoint_dir
from wardcast.sources import fixtures as X
from wardcast.sources.publish import drop_published, publish, read_published

RATES = ["rate_norepinephrine", "rate_epinephrine", "rate_dopamine", "rate_dobutamine"]


def _salt(spark) -> int:
    """Deterministic salt width for the stay-window joins (cluster setting)."""
    return int(spark.conf.get("wardcast.join.salt", "1"))


def hw_raw_convert(spark, sf):
    raw = C.to_standard_units(X.chartevents(spark, sf))
    return rounded(raw, ["valuenum"])


def hw_first_min_max(spark, sf):
    fmm = C.first_min_max(C.to_standard_units(X.chartevents(spark, sf)))
    return rounded(fmm, ["first_valuenum", "min_valuenum", "max_valuenum"])


def heightweight(spark, sf):
    return C.heightweight(X.chartevents(spark, sf))


def stay_weight(spark, sf):
    return rounded(C.stay_weight(X.icustays(spark, sf), X.chartevents(spark, sf),
                                 salt=_salt(spark)), ["weight"])


def echo_weight(spark, sf):
    return rounded(C.echo_weight(X.icustays(spark, sf), X.echodata(spark, sf)), ["weight"])


def vaso_cv(spark, sf):
    st = X.icustays(spark, sf)
    wt = C.stay_weight(st, X.chartevents(spark, sf), salt=_salt(spark))
    ec = C.echo_weight(st, X.echodata(spark, sf))
    return rounded(C.vaso_cv(st, X.inputevents_cv(spark, sf), wt, ec, salt=_salt(spark)), RATES)


def vaso_mv(spark, sf):
    return rounded(C.vaso_mv(X.icustays(spark, sf), X.inputevents_mv(spark, sf),
                             salt=_salt(spark)), RATES)


def pafi_vent(spark, sf):
    return rounded(C.pafi(X.bloodgasfirstdayarterial(spark, sf), X.ventdurations(spark, sf)),
                   ["PaO2FiO2_novent_min", "PaO2FiO2_vent_min"])


def vent_overlap(spark, sf):
    """How many ventilation episodes of its stay hold each blood gas."""
    return rounded(covering_counts(X.bloodgasfirstdayarterial(spark, sf), X.ventdurations(spark, sf), "icustay_id",
                                   "charttime", "starttime", "endtime", "n_vent"), ["PaO2FiO2"])


def _components(spark, sf):
    inp = X.clinical_inputs(spark, sf)
    st, salt = inp["icustays"], _salt(spark)
    wt = C.stay_weight(st, inp["chartevents"], salt=salt)
    ec = C.echo_weight(st, inp["echodata"])
    return C.score_components(
        st, C.vaso_cv(st, inp["inputevents_cv"], wt, ec, salt=salt),
        C.vaso_mv(st, inp["inputevents_mv"], salt=salt),
        C.pafi(inp["bloodgasfirstdayarterial"], inp["ventdurations"]),
        inp["vitalsfirstday"], inp["labsfirstday"], inp["uofirstday"], inp["gcsfirstday"])


def sofa_components(spark, sf):
    comp = _components(spark, sf)
    dbl = [c for c in C.SCORE_INPUTS if c != "MinGCS"]
    return rounded(comp, dbl)


def sofa_scores(spark, sf):
    return C.score_calc(_components(spark, sf)).select("icustay_id", *C.COMPONENTS)


def sofa(spark, sf):
    return C.sofa(X.clinical_inputs(spark, sf), salt=_salt(spark))


def _marts(spark, sf, run: str) -> str:
    """The folder of a data set's marts: other data sets publish elsewhere."""
    data = hashlib.sha256(sf.rstrip("/").encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/marts/{run}-{data}"


def publish_mart(spark, sf):
    """Publish the score mart as a table in the shared folder (overwrite)
    and return the read-back relation."""
    return publish(C.sofa(X.clinical_inputs(spark, sf), salt=_salt(spark), ordered=False),
                   f"{_marts(spark, sf, 'scores')}/sofa", sort_within=["icustay_id"])


def mart_cascade(spark, sf):
    """Three marts, the second made from the first and the third from both;
    dropping the first takes them in order.  Rows of each when it was published,
    and its place in the drop."""
    root = _marts(spark, sf, f"cascade-{uuid.uuid4().hex}")
    weights = publish(C.heightweight(X.chartevents(spark, sf), ordered=False), f"{root}/heightweight", depends_on=[])
    tall = publish(weights.groupBy("subject_id").agg(F.max("height_max").alias("height_max")), f"{root}/tallest",
                   depends_on=["heightweight"])
    publish(weights.join(tall, ["subject_id", "height_max"]), f"{root}/tallest_stays", depends_on=["heightweight", "tallest"])
    n = {m: read_published(spark, f"{root}/{m}").count() for m in ("heightweight", "tallest", "tallest_stays")}
    order = drop_published(spark, root, "heightweight", cascade=True)
    return spark.createDataFrame([(m, n[m], i) for i, m in enumerate(order, 1)], "mart string, n_rows bigint, dropped int")


QUERIES = {
    "hw_raw_convert": hw_raw_convert,
    "hw_first_min_max": hw_first_min_max,
    "heightweight": heightweight,
    "stay_weight": stay_weight,
    "echo_weight": echo_weight,
    "vaso_cv": vaso_cv,
    "vaso_mv": vaso_mv,
    "pafi_vent": pafi_vent,
    "vent_overlap": vent_overlap,
    "sofa_components": sofa_components,
    "sofa_scores": sofa_scores,
    "sofa": sofa,
    "publish_mart": publish_mart,
    "mart_cascade": mart_cascade,
}
