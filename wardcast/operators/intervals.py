"""Interval joins on a key plus a time range.

Spark has no native range join; an equi key with a range residual plans as a
sort-merge (or broadcast hash) join.  Two hazards at scale are handled here:

* a hot key (one stay holding a large share of events) would land in one
  task.  The window side is exploded into calendar-day buckets and the day
  becomes a second equi key, so a hot key spreads over its days; optionally a
  deterministic salt spreads it further (the small side is replicated
  ``salt`` times, the large side picks a bucket from a hash of its row, which
  is stable under task retries).  AQE skew-join handling stays on as well.
* intervals of any length, and points in many overlapping intervals, go
  through the hierarchical index of ``interval_index``.

All helpers are exact: the residual predicate is always applied, and every
(event, window) pair can meet in exactly one day bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.operators.interval_index import covering_counts

_BUCKET = "_day"
_SALT = "_salt"


def _day_span(lo: Column, hi: Column) -> Column:
    """Array of calendar days touched by [lo, hi] (empty when hi < lo)."""
    lo_d, hi_d = F.to_date(lo), F.to_date(hi)
    return F.when(hi_d >= lo_d, F.sequence(lo_d, hi_d)).otherwise(F.array().cast("array<date>"))


def window_join(events: DataFrame, windows: DataFrame, key: str, ts: str,
                lo: Column, hi: Column, lo_open: bool = False,
                hi_open: bool = False, salt: int = 1,
                salt_cols: list[str] | None = None) -> DataFrame:
    """Inner join: event rows whose ``ts`` lies in the window of its key.

    ``windows`` has one or more rows per key; ``lo``/``hi`` are Column
    expressions over ``windows`` columns (e.g. ``intime - 1 day``).
    ``events`` and ``windows`` must not share column names besides ``key``.
    Returns event columns + window columns (``key`` once).
    """
    w = windows.select("*", lo.alias("_lo"), hi.alias("_hi"),
                       F.explode(_day_span(lo, hi)).alias(_BUCKET))
    e = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()) \
              .select("*", F.to_date(F.col(ts)).alias(_BUCKET))
    keys = [key, _BUCKET]
    if salt > 1:
        w = w.select("*", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias(_SALT))
        hcols = [F.col(c) for c in (salt_cols or [ts])]
        e = e.select("*", F.pmod(F.xxhash64(*hcols), F.lit(salt)).cast("int").alias(_SALT))
        keys.append(_SALT)
    t = F.col(ts)
    lo_ok = (t > F.col("_lo")) if lo_open else (t >= F.col("_lo"))
    hi_ok = (t < F.col("_hi")) if hi_open else (t <= F.col("_hi"))
    j = e.join(w, on=keys, how="inner").filter(lo_ok & hi_ok)
    return j.drop(_BUCKET, _SALT, "_lo", "_hi")


def point_in_interval_left(points: DataFrame, intervals: DataFrame, key: str,
                           ts: str, start: str, end: str,
                           flag: str = "in_interval") -> DataFrame:
    """LEFT join points to every closed interval [start, end] of the same key
    that contains ``ts``; adds ``flag`` = 1 when matched else 0.

    Rows multiply by the number of overlapping intervals, exactly as the SQL
    left join does.  The intervals are counted through the hierarchical index,
    so neither long nor many overlapping episodes cost candidates; a caller to
    whom repeats do not matter takes ``covering_counts`` and its one row a point.
    """
    n = covering_counts(points, intervals, key, ts, start, end, "_n")
    hit = F.when(F.col("_n") > 0, 1).otherwise(0)
    return n.select(*points.columns, F.explode(F.array_repeat(hit, F.greatest("_n", F.lit(1)).cast("int"))).alias(flag))
