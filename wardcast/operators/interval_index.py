"""Hierarchical interval index (J3, J5): long and open-ended intervals.

Time is cut into base buckets of ``2**BASE_BITS`` seconds, four of which make a
bucket of the next level, and so on.  The base buckets that lie wholly inside
an interval are covered by O(log length) buckets of the hierarchy (each as
large as alignment allows); the two base buckets that hold its ends are kept
apart as edges.  A point looks at one bucket per level in use and at one base
bucket's edges:

* a hit in a covering bucket is a match without looking at the interval, so
  intervals that share a bucket can be counted there before they meet a point;
* only edges carry the exact range test; their candidates are the intervals
  that begin or end in the same base bucket.

So an interval of many years costs a few dozen rows, whatever its length, a
point costs as many probes as there are levels, and the join keys
(key, level, bucket) spread a hot key over its time line.  Every point meets
every interval that contains it exactly once: its base bucket is either an
edge of the interval or lies in exactly one covering bucket.

Times are TIMESTAMP_NTZ, TIMESTAMP or DATE; those of points and intervals must
have the same type.  Intervals with a null end or an end before their start
contain nothing; points with a null key or time lie in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_BITS = 6      # base buckets of 64 seconds
LEVELS = 16        # levels above them: 64 * 4**16 seconds is over 8,000 years
EDGE = -1          # level of the rows that stand for an interval's ends


def _seconds(c: Column, kind: T.DataType) -> Column:
    """Whole seconds on a line that keeps the order of ``c``, in any session
    time zone (a wall-clock time has no zone to take it through)."""
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    if isinstance(kind, T.DateType):
        return days
    if isinstance(kind, T.TimestampNTZType):
        return days + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    raise ValueError(f"interval times must be timestamps or dates, not {kind.simpleString()}")


def _base(c: Column, kind: T.DataType) -> Column:
    return F.shiftright(_seconds(c, kind), BASE_BITS)


def _run(lv: Column, lo: Column, hi: Column) -> Column:
    """(lv, bk) for bk in lo .. hi - 1; a level leaves at most three on a side,
    and the years 1 to 9999 lie in at most three buckets of the last level."""
    some = F.filter(F.array(*[lo + i for i in range(4)]), lambda b: b < hi)
    return F.transform(some, lambda b: F.struct(lv.cast("int").alias("lv"), b.alias("bk")))


def covering_buckets(first: Column, after: Column) -> Column:
    """The buckets (lv, bk) that cover the base buckets first .. after - 1."""
    none = F.array().cast("array<struct<lv:int,bk:bigint>>")
    begin = F.struct(first.cast("bigint").alias("lo"), F.greatest(first, after).cast("bigint").alias("hi"), none.alias("out"))

    def up(a: Column, lv: Column) -> Column:
        lo = F.least(a["hi"], F.shiftleft(F.shiftright(a["lo"] + 3, 2), 2))
        hi = F.greatest(lo, F.shiftleft(F.shiftright(a["hi"], 2), 2))
        return F.struct(F.shiftright(lo, 2).alias("lo"), F.shiftright(hi, 2).alias("hi"),
                        F.concat(a["out"], _run(lv, a["lo"], lo), _run(lv, hi, a["hi"])).alias("out"))

    # what is left above the last level
    return F.aggregate(F.array(*map(F.lit, range(LEVELS))), begin, up,
                       lambda a: F.concat(a["out"], _run(F.lit(LEVELS), a["lo"], a["hi"])))


def _kind(df: DataFrame, *cols: str) -> T.DataType:
    kinds = {df.schema[c].dataType for c in cols}
    if len(kinds) > 1:
        raise ValueError(f"{cols} must have one type, not {sorted(k.simpleString() for k in kinds)}")
    return kinds.pop()


def _same(a: T.DataType, b: T.DataType) -> T.DataType:
    if a != b:
        raise ValueError(f"points have {a.simpleString()} times, intervals {b.simpleString()}")
    return a


def _pieces(intervals: DataFrame, lo: str, hi: str, kind: T.DataType) -> DataFrame:
    """``intervals`` with a row per covering bucket and per edge (lv, bk)."""
    a, z = _base(F.col(lo), kind), _base(F.col(hi), kind)
    edges = F.transform(F.array_distinct(F.array(a, z)), lambda b: F.struct(F.lit(EDGE).alias("lv"), b.alias("bk")))
    fit = intervals.filter(F.col(lo) <= F.col(hi))
    return fit.select("*", F.explode(F.concat(edges, covering_buckets(a + 1, z))).alias("_at")).select(
        *fit.columns, F.col("_at.lv").alias("_lv"), F.col("_at.bk").alias("_bk"))


def _probes(points: DataFrame, ts: str, kind: T.DataType, pieces: DataFrame) -> DataFrame:
    """``points`` with a row per level that the index uses (one number per level)."""
    used = pieces.agg(F.array_sort(F.collect_set("_lv")).alias("used")).scalar()
    p = points.withColumn("_b", _base(F.col(ts), kind)).select("*", F.explode(used).alias("_lv"))
    up = F.expr("shiftright(_b, 2 * greatest(_lv, 0))")
    return p.select(*points.columns, "_lv", up.alias("_bk"))


def covering_counts(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str,
                    name: str = "n_intervals") -> DataFrame:
    """``points`` with the number of closed intervals [start, end] of the same
    key that contain ``ts``.  Intervals are counted per bucket before the join,
    so a point meets at most one row per level besides the edges near it,
    however many intervals contain it."""
    kind = _same(_kind(points, ts), _kind(intervals, start, end))
    iv = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e")).filter("_k is not null")
    pieces = _pieces(iv, "_s", "_e", kind)
    whole = F.col("_lv") != EDGE
    # an edge stays one row per distinct interval, a covering bucket one row
    index = pieces.groupBy("_k", "_lv", "_bk", F.when(~whole, F.col("_s")).alias("_s"),
                           F.when(~whole, F.col("_e")).alias("_e")).agg(F.count("*").alias("_n"))
    at = points.select(F.col(key).alias("_k"), F.col(ts).alias("_t")).filter(
        "_k is not null and _t is not null").distinct()
    hits = _probes(at, "_t", kind, pieces).join(index, ["_k", "_lv", "_bk"]).filter(
        whole | ((F.col("_s") <= F.col("_t")) & (F.col("_t") <= F.col("_e"))))
    n = hits.groupBy("_k", "_t").agg(F.sum("_n").alias("_n"))
    return points.join(n, (points[key] == n["_k"]) & (points[ts] == n["_t"]), "left").select(
        *[points[c] for c in points.columns], F.coalesce(n["_n"], F.lit(0)).cast("bigint").alias(name))


def interval_join(events: DataFrame, intervals: DataFrame, key: str, ts: str, lo: Column, hi: Column,
                  lo_open: bool = False, hi_open: bool = False) -> DataFrame:
    """Inner join: event rows with every interval of their key that contains
    ``ts``; columns as in ``intervals.window_join`` (the two must not share
    names besides ``key``).  For intervals of any length: no row per day."""
    held = intervals.select("*", lo.alias("_lo"), hi.alias("_hi")).filter(F.col(key).isNotNull())
    kind = _same(_kind(events, ts), _kind(held, "_lo", "_hi"))
    pieces = _pieces(held, "_lo", "_hi", kind)
    e = _probes(events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()), ts, kind, pieces)
    t = F.col(ts)
    inside = ((t > F.col("_lo")) if lo_open else (t >= F.col("_lo"))) & ((t < F.col("_hi")) if hi_open else (t <= F.col("_hi")))
    # covering buckets lie strictly between the ends: only edges need the test
    return e.join(pieces, [key, "_lv", "_bk"]).filter((F.col("_lv") != EDGE) | inside).drop("_lv", "_bk", "_lo", "_hi")
