from datetime import datetime, timedelta

from pyspark.sql import types as T

CHART = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("icustay_id", T.LongType()),
    T.StructField("charttime", T.TimestampNTZType()), T.StructField("itemid", T.IntegerType()),
    T.StructField("valuenum", T.DoubleType()), T.StructField("error", T.IntegerType())])
STAYS = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("hadm_id", T.LongType()),
    T.StructField("icustay_id", T.LongType()), T.StructField("intime", T.TimestampNTZType())])

T0 = datetime(2024, 1, 10, 12, 0, 0)


def at(days=0.0, hours=0.0, minutes=0.0):
    return T0 + timedelta(days=days, hours=hours, minutes=minutes)


def rows(df, order=None):
    out = [r.asDict() for r in df.collect()]
    if order:
        out.sort(key=lambda d: tuple((d[k] is None, d[k]) for k in order))
    return out
