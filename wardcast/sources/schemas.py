"""Input contracts of the clinical marts (FIXTURES.md section 1).

Explicit StructTypes: used to read raw exports without inference (ingest) and
checked at the entry of the marts, so a missing or mistyped column fails
before any job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

L, I, D, S, TS = (T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(),
                  T.TimestampNTZType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CLINICAL_SCHEMAS = {
    "icustays": _st(("subject_id", L), ("hadm_id", L), ("icustay_id", L), ("intime", TS)),
    "chartevents": _st(("subject_id", L), ("icustay_id", L), ("charttime", TS),
                       ("itemid", I), ("valuenum", D), ("error", I)),
    "inputevents_cv": _st(("icustay_id", L), ("charttime", TS), ("itemid", I), ("rate", D)),
    "inputevents_mv": _st(("icustay_id", L), ("starttime", TS), ("itemid", I), ("rate", D),
                          ("statusdescription", S)),
    "echodata": _st(("hadm_id", L), ("charttime", TS), ("weight", D)),
    "bloodgasfirstdayarterial": _st(("icustay_id", L), ("charttime", TS), ("PaO2FiO2", D)),
    "ventdurations": _st(("icustay_id", L), ("starttime", TS), ("endtime", TS)),
    "vitalsfirstday": _st(("icustay_id", L), ("MeanBP_Min", D)),
    "labsfirstday": _st(("icustay_id", L), ("Creatinine_Max", D), ("Bilirubin_Max", D),
                        ("Platelet_Min", D)),
    "uofirstday": _st(("icustay_id", L), ("UrineOutput", D)),
    "gcsfirstday": _st(("icustay_id", L), ("MinGCS", D)),
}

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def _compatible(want: T.DataType, have: T.DataType) -> bool:
    if isinstance(want, _NUMERIC) and isinstance(have, _NUMERIC):
        return True           # ids and measures may arrive as any numeric type
    if isinstance(want, T.TimestampNTZType):
        return isinstance(have, (T.TimestampNTZType, T.TimestampType))
    return type(want) is type(have)


def check(name: str, df: DataFrame) -> DataFrame:
    """Raise if ``df`` lacks a contract column or has an incompatible type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in CLINICAL_SCHEMAS[name].fields:
        if f.name not in have:
            problems.append(f"missing {f.name}")
        elif not _compatible(f.dataType, have[f.name]):
            problems.append(f"{f.name}: {have[f.name].simpleString()} is not "
                            f"{f.dataType.simpleString()}")
    if problems:
        raise ValueError(f"{name}: " + "; ".join(problems))
    return df


def check_all(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    for k, v in inputs.items():
        if k in CLINICAL_SCHEMAS:
            check(k, v)
    return inputs
