"""The hierarchical interval index against nested loops, and its cost."""

from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardcast.operators import clinical as C
from wardcast.operators.interval_index import LEVELS, covering_buckets, covering_counts, interval_join
from wardcast.operators.intervals import point_in_interval_left

T0 = datetime(2024, 3, 1)
P_SCHEMA = "k long, at timestamp_ntz, v int"
I_SCHEMA = "k long, s timestamp_ntz, e timestamp_ntz, name string"


def cover(spark, spans):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i long, a long, b long")
    rows = df.select("i", covering_buckets(F.col("a"), F.col("b")).alias("c")).collect()
    return {r.i: [(x.lv, x.bk) for x in r.c] for r in rows}


def test_covering_buckets_tile_the_range(spark):
    spans = [(a, a + n) for a in (-70, -1, 0, 3, 4, 63, 1000) for n in (0, 1, 2, 3, 4, 5, 15, 64, 257, 1021)]
    for i, pieces in cover(spark, spans).items():
        a, b = spans[i]
        base = sorted(x for lv, bk in pieces for x in range(bk << 2 * lv, (bk + 1) << 2 * lv))
        assert base == list(range(a, b))


def test_covering_buckets_of_ages(spark):
    """An interval of thousands of years is a few dozen rows."""
    pieces = cover(spark, [(1, (1 << 32) - 3), (5, 5), (7, 3)])
    assert len(pieces[0]) <= 6 * LEVELS and pieces[1] == pieces[2] == []


at = st.integers(0, 20_000).map(lambda s: T0 + timedelta(seconds=s * 7))
key = st.one_of(st.none(), st.integers(1, 2))
maybe = st.one_of(st.none(), at)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(key, maybe), max_size=25), st.lists(st.tuples(key, maybe, maybe), max_size=25))
def test_counts_match_nested_loops(spark, points, spans):
    points = [(k, t, i % 3) for i, (k, t) in enumerate(points)]
    spans = [(*s, str(i)) for i, s in enumerate(spans)]
    p, iv = spark.createDataFrame(points, P_SCHEMA), spark.createDataFrame(spans, I_SCHEMA)

    def inside(q):
        return [s for s in spans if None not in (*q[:2], *s[:3]) and q[0] == s[0] and s[1] <= q[1] <= s[2]]

    got = covering_counts(p, iv, "k", "at", "s", "e").collect()
    assert Counter(map(tuple, got)) == Counter((*q, len(inside(q))) for q in points)
    left = point_in_interval_left(p, iv, "k", "at", "s", "e", "hit").collect()
    assert Counter(map(tuple, left)) == Counter((*q, int(bool(inside(q)))) for q in points for _ in range(max(1, len(inside(q)))))
    joined = interval_join(p, iv, "k", "at", F.col("s"), F.col("e"), lo_open=True).select("k", "at", "v", "name").collect()
    assert Counter(map(tuple, joined)) == Counter((*q, s[3]) for q in points for s in inside(q) if s[1] < q[1])


def test_times_of_other_types(spark):
    d = date(2024, 2, 29)
    p = spark.createDataFrame([(1, d), (1, d + timedelta(days=400))], "k long, at date")
    iv = spark.createDataFrame([(1, d, date(9999, 12, 31)), (1, d, d)], "k long, s date, e date")
    assert sorted(r.n_intervals for r in covering_counts(p, iv, "k", "at", "s", "e").collect()) == [1, 2]
    z = [x.select("k", *[F.col(c).cast("timestamp").alias(c) for c in x.columns[1:]]) for x in (p, iv)]
    assert sorted(r.n_intervals for r in covering_counts(*z, "k", "at", "s", "e").collect()) == [1, 2]
    with pytest.raises(ValueError, match="points have"):
        covering_counts(p, z[1], "k", "at", "s", "e")
    with pytest.raises(ValueError, match="timestamps or dates"):
        covering_counts(p.select("k", F.lit(1).alias("at")), iv.select("k", F.lit(1).alias("s"), F.lit(1).alias("e")),
                        "k", "at", "s", "e")


def test_many_open_episodes_on_one_stay(spark):
    """10^5 overlapping open-ended episodes of one stay: a gas meets a few rows per level, not every episode."""
    n = 100_000
    ids = spark.range(n)
    begin = F.lit(T0).cast("timestamp_ntz")
    ends = F.lit(datetime(9999, 12, 31)).cast("timestamp_ntz")
    vent = ids.select(F.lit(5).cast("long").alias("icustay_id"),
                      (begin + F.make_dt_interval(secs=(F.col("id") * 30).cast("decimal(18,6)"))).alias("starttime"),
                      ends.alias("endtime"))
    gas = spark.range(2000).select(F.lit(5).cast("long").alias("icustay_id"),
                                   (begin + F.make_dt_interval(secs=((F.col("id") - 50) * 1501).cast("decimal(18,6)"))).alias("charttime"),
                                   (F.col("id") + 100).cast("double").alias("PaO2FiO2"))
    got = covering_counts(gas, vent, "icustay_id", "charttime", "starttime", "endtime").collect()
    for r in got:
        s = (r.charttime - T0).total_seconds()
        assert r.n_intervals == (min(n, int(s // 30) + 1) if s >= 0 else 0)
    row = C.pafi(gas, vent).collect()
    assert [tuple(r) for r in row] == [(5, 100.0, 150.0)]
    # candidates: what the probes of all gases find in the index
    from wardcast.operators import interval_index as X
    kind = gas.schema["charttime"].dataType
    pieces = X._pieces(vent.withColumnRenamed("icustay_id", "_k"), "starttime", "endtime", kind)
    probes = X._probes(gas.select(F.col("icustay_id").alias("_k"), F.col("charttime").alias("_t")), "_t", kind, pieces)
    index = pieces.groupBy("_k", "_lv", "_bk", F.when(F.col("_lv") < 0, F.col("starttime")).alias("s")).count()
    assert probes.join(index, ["_k", "_lv", "_bk"]).count() <= 2000 * (LEVELS + 6)
