"""Regression predictors for series frames.

All features are column expressions or a join with a per-period calendar
table whose size is set by the number of distinct periods, never by the data.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardcast.functions.calendar import add_periods, easter_sunday, micros, once, period_start, step
from wardcast.operators.blocks import with_lags

WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def trend(df: DataFrame, name: str = "trend") -> DataFrame:
    """Linear trend predictor x = t."""
    return df.withColumn(name, F.col("t").cast("double"))


def dummies(df: DataFrame, col: str, levels: list, base=None, prefix: str | None = None) -> DataFrame:
    """c levels -> c-1 indicator columns; ``base`` (default: first level) is
    dropped so coefficients are differences to it (R16)."""
    base = levels[0] if base is None else base
    prefix = prefix or col
    return df.select("*", *[F.when(F.col(col) == F.lit(v), 1.0).otherwise(0.0).alias(f"{prefix}_{v}")
                           for v in levels if v != base])


def season_dummies(df: DataFrame, m: int, base: int = 1) -> DataFrame:
    """Seasonal dummies season_2..season_m (first season omitted)."""
    return dummies(df, "season", list(range(1, m + 1)), base=base, prefix="season")


def season_dummy_names(m: int, base: int = 1) -> list[str]:
    return [f"season_{s}" for s in range(1, m + 1) if s != base]


def fourier_names(m: int, K: int) -> list[str]:
    names = []
    for j in range(1, K + 1):
        if 2 * j != m:              # sin(pi t) == 0: never a column
            names.append(f"sin_{j}")
        names.append(f"cos_{j}")
    return names


def fourier(df: DataFrame, m: float, K: int, t: str = "t") -> DataFrame:
    """Fourier pairs sin/cos(2 pi j t / m), j = 1..K, K <= m/2.

    At j = m/2 the sine is identically zero and is left out analytically."""
    if K > m / 2:
        raise ValueError("K must be <= m/2")
    cols = []
    for j in range(1, K + 1):
        ang = F.lit(2 * math.pi * j / m) * F.col(t)
        if 2 * j != m:
            cols.append(F.sin(ang).alias(f"sin_{j}"))
        cols.append(F.cos(ang).alias(f"cos_{j}"))
    return df.select("*", *cols)


def fourier_frequencies(periods: dict[float, int]) -> list[tuple[str, str, Fraction]]:
    """(period, j, frequency) of the harmonics j = 1..K of all ``periods``
    {period: K}, without those that repeat an earlier one on whole t (R24, T2).

    Periods may be fractions (365.25).  At whole t a frequency f cannot be told
    from 1 - f, nor from f + 1: each is folded into [0, 1/2]; 0 is the
    intercept.  Exact arithmetic decides what coincides."""
    out, seen = [], {Fraction(0)}
    for m, K in periods.items():
        period = Fraction(str(m))
        if K > period / 2:
            raise ValueError(f"K must be <= m/2, not {K} for period {m}")
        for j in range(1, K + 1):
            f = (Fraction(j) / period) % 1
            f = min(f, 1 - f)
            if f not in seen:
                seen.add(f)
                out.append((str(m).replace(".", "_"), str(j), f))
    return out


def fourier_multi_names(periods: dict[float, int]) -> list[str]:
    return [f"{part}_{m}_{j}" for m, j, f in fourier_frequencies(periods)
            for part in (("sin", "cos") if f != Fraction(1, 2) else ("cos",))]


def fourier_multi(df: DataFrame, periods: dict[float, int], t: str = "t") -> DataFrame:
    """Joint Fourier basis of several periods at once, such as {7: 3, 365.25: 4}
    for daily data: columns sin_{period}_{j}, cos_{period}_{j} that are
    linearly independent on whole t.  The phase is taken from t modulo the
    frequency's denominator, so late t lose no digits."""
    cols = []
    for m, j, f in fourier_frequencies(periods):
        turn = F.pmod(F.col(t).cast("bigint") * F.lit(f.numerator), F.lit(f.denominator)) / F.lit(float(f.denominator))
        ang = F.lit(2 * math.pi) * turn
        if f != Fraction(1, 2):
            cols.append(F.sin(ang).alias(f"sin_{m}_{j}"))
        cols.append(F.cos(ang).alias(f"cos_{m}_{j}"))
    return df.select("*", *cols)


def event_dummy(df: DataFrame, events: DataFrame, on: list[str], name: str = "event") -> DataFrame:
    """1 on the periods listed in ``events`` (keys + period), else 0.
    ``events`` is small (one row per event); the join is on the full key."""
    ev = events.select(*on).distinct().withColumn("_hit", F.lit(1.0))
    return df.join(ev, on, "left").withColumn(name, F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def spike_dummy(df: DataFrame, start, end, name: str = "spike") -> DataFrame:
    """Intervention spike: 1 for periods in [start, end], else 0."""
    dt = df.schema["period"].dataType
    inside = (F.col("period") >= F.lit(start).cast(dt)) & (F.col("period") <= F.lit(end).cast(dt))
    return df.withColumn(name, F.when(inside, 1.0).otherwise(0.0))


def merged_spans(spans: DataFrame, keys: list[str], start: str, end: str, unit: str) -> DataFrame:
    """(keys, period, lo, hi): half-open spans [start, end) cut at the periods
    and merged within each where they overlap or touch.

    Cutting comes first: a merge then looks at the spans of one key and one
    period only, so a key with very many or very long spans is spread over its
    periods.  Spans with a null or an end that is not after the start count for
    nothing."""
    fit = spans.filter(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    kind = fit.schema["_s"].dataType
    first = period_start(F.col("_s"), unit)
    # an end on a period's start does not reach into that period
    periods = F.sequence(first, period_start(F.col("_e") - F.make_dt_interval(secs=F.lit(0.000001)), unit), step(unit))
    cut = fit.select("*", F.explode(periods).alias("period")).select(
        *keys, "period", F.greatest("_s", F.col("period").cast(kind)).alias("lo"),
        F.least("_e", add_periods(F.col("period"), F.lit(1), unit).cast(kind)).alias("hi"))
    w = W.partitionBy(*keys, "period").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    return (cut.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
               .groupBy(*keys, "period", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run"))


def event_shares(df: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, unit: str,
                 name: str = "event_share") -> DataFrame:
    """``df`` (keys, period, ...) with the share of each period that the
    events of an interval table cover (R18, R19): 0 without any, 1 where they
    cover it whole, overlapping events counted once.  A spike or a level shift
    is the special case of one long span."""
    cut, kind = merged_spans(spans, keys, start, end, unit), spans.schema[start].dataType
    covered = cut.groupBy(*keys, "period").agg(
        F.sum(micros(F.col("hi"), kind) - micros(F.col("lo"), kind)).alias("_covered"))
    days = F.datediff(F.to_date(add_periods(F.col("period"), F.lit(1), unit)), F.to_date("period"))
    whole = F.lit(3_600_000_000) if unit == "hour" else days * F.lit(86_400_000_000)
    out = df.join(covered, [*keys, "period"], "left")
    return out.select(*df.columns, (F.coalesce("_covered", F.lit(0)) / whole).alias(name))


# ---- holiday calendars ---------------------------------------------------------

HOLIDAY_SCHEMA = ("region string, name string, kind string, month int, day int, nth int, weekday int, "
                  "easter_offset int, observed string, first_year int, last_year int")


def holidays(rules: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(region, name, day): the holidays of a rule table from ``first_year`` to
    ``last_year`` (R20), generated on the executors.

    A rule (columns of ``HOLIDAY_SCHEMA``) is of one kind:

    * ``fixed``: month and day (a 29 February exists in leap years only);
    * ``nth``: the nth weekday (0 = Monday) of the month, from the end if
      negative; a fifth that a month does not have is no holiday;
    * ``easter``: days after Easter Sunday.

    ``observed`` says what a Saturday or Sunday becomes: NULL or ``none`` stays,
    ``nearest`` Friday or Monday, ``monday`` the next Monday, ``skip`` no
    holiday.  Where two holidays of a region would be observed on one day, both
    are listed; counting days takes them once.  first_year and last_year of a
    rule bound it (NULL: open)."""
    years = F.sequence(F.greatest(F.coalesce("first_year", F.lit(first_year)), F.lit(first_year)),
                       F.least(F.coalesce("last_year", F.lit(last_year)), F.lit(last_year)))
    some = F.when(F.coalesce("first_year", F.lit(first_year)) <= F.lit(last_year), years)
    r = rules.filter((F.coalesce("last_year", F.lit(last_year)) >= first_year)
                     & (F.coalesce("first_year", F.lit(first_year)) <= F.coalesce("last_year", F.lit(last_year)))
                     ).select("*", F.explode(some).alias("yr"))
    day = F.when(F.col("kind") == "easter", F.date_add(easter_sunday(F.col("yr")), F.coalesce("easter_offset", F.lit(0)))
                 ).otherwise(once(F.make_date("yr", F.coalesce("month", F.lit(1)), F.lit(1)), _day_of_month))
    return (r.select("region", "name", once(day, _observed).alias("day")).filter("day is not null"))


def _day_of_month(month1: Column) -> Column:
    """The day of a ``fixed`` or ``nth`` rule in the month that starts on
    ``month1``; NULL if the month does not have it (counted on from its first
    day, since a date that does not exist cannot be made)."""
    fixed = F.date_add(month1, F.coalesce("day", F.lit(1)) - 1)
    ahead = F.date_add(month1, F.pmod(F.col("weekday") - F.weekday(month1), F.lit(7)) + 7 * (F.col("nth") - 1))
    last = F.last_day(month1)
    back = F.date_sub(last, F.pmod(F.weekday(last) - F.col("weekday"), F.lit(7)) + 7 * (-F.col("nth") - 1))
    nth = F.when(F.col("nth") > 0, ahead).when(F.col("nth") < 0, back)
    found = F.when(F.col("kind") == "fixed", fixed).when(F.col("kind") == "nth", nth)
    return F.when(F.month(found) == F.month(month1), found)


def _observed(day: Column) -> Column:
    """When a holiday is observed; NULL if it is not."""
    wd, rule = F.weekday(day), F.col("observed")
    return (F.when((rule == "skip") & (wd >= 5), F.lit(None).cast("date"))
             .when((rule == "nearest") & (wd == 5), F.date_sub(day, 1))
             .when((rule == "nearest") & (wd == 6), F.date_add(day, 1))
             .when((rule == "monday") & (wd >= 5), F.date_add(day, 7 - wd))
             .otherwise(day))


def regional_trading_days(df: DataFrame, region: str, rules: DataFrame, unit: str = "month",
                          name: str = "trading_days", holiday_name: str = "holidays") -> DataFrame:
    """``df`` (``region``, period, ...) with the business days (Mon-Fri) of
    each period that are no holiday of its region, and the number of weekdays
    lost to holidays (R20).  The grid is one row per region, distinct period
    and day: the calendar's size, not the data's."""
    grid = df.select(F.col(region).alias("_region"), "period").distinct()
    span = grid.agg(F.min(F.year("period")).alias("lo"), F.max(F.year("period")).alias("hi")).first()
    if span.lo is None:
        return df.select("*", F.lit(0).alias(name), F.lit(0).alias(holiday_name))
    # a holiday may be observed in the year before or after its own
    off = holidays(rules, span.lo - 1, span.hi + 1).select(F.col("region").alias("_region"), "day").distinct().withColumn("_off", F.lit(1))
    end = F.date_sub(add_periods(F.col("period"), F.lit(1), unit), 1)
    days = grid.select("*", F.explode(F.sequence("period", end)).alias("day")).filter(F.weekday("day") < 5)
    n = days.join(off, ["_region", "day"], "left").groupBy("_region", F.col("period").alias("_period")).agg(
        F.sum(F.when(F.col("_off").isNull(), 1).otherwise(0)).cast("int").alias("_work"),
        F.count("_off").cast("int").alias("_lost"))
    j = df.join(n, F.col(region).eqNullSafe(F.col("_region")) & (F.col("period") == F.col("_period")), "left")
    return j.select(*df.columns, F.coalesce("_work", F.lit(0)).alias(name),
                    F.coalesce("_lost", F.lit(0)).alias(holiday_name))


def _days_of_period(periods: DataFrame, unit: str) -> DataFrame:
    """(period, day) for every calendar day of each distinct period."""
    last = F.date_sub(add_periods(F.col("period"), F.lit(1), unit), 1)
    return periods.select("period", F.explode(F.sequence(F.col("period"), last)).alias("day"))


def trading_days(df: DataFrame, unit: str = "month", holidays: DataFrame | None = None,
                 name: str = "trading_days") -> DataFrame:
    """Business days (Mon-Fri, minus ``holidays``) in each period."""
    days = _days_of_period(df.select("period").distinct(), unit).filter(F.weekday("day") < 5)
    if holidays is not None:
        days = days.join(holidays.select(F.col(holidays.columns[0]).cast("date").alias("day")),
                         "day", "left_anti")
    cnt = days.groupBy("period").agg(F.count("*").cast("int").alias(name))
    return df.join(cnt, "period", "left").fillna({name: 0})


def weekday_counts(df: DataFrame, unit: str = "month") -> DataFrame:
    """Number of Mondays .. Sundays in each period: 7 columns."""
    days = _days_of_period(df.select("period").distinct(), unit)
    wide = (days.withColumn("wd", F.weekday("day")).groupBy("period")
                .pivot("wd", list(range(7))).agg(F.count("day")))
    wide = wide.select("period", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("int").alias(d)
                                   for i, d in enumerate(WEEKDAYS)])
    return df.join(wide, "period", "left")


def easter(df: DataFrame, unit: str = "month", include_monday: bool = False,
           name: str = "easter") -> DataFrame:
    """Share of the Easter holiday (Good Friday .. Easter Sunday, optionally
    Monday) that falls in each period: 1, 0 or a fraction when it spans two
    periods (R23)."""
    years = df.select(F.year("period").alias("yr")).distinct()
    n = 4 if include_monday else 3
    es = years.select(F.explode(F.sequence(F.date_sub(easter_sunday(F.col("yr")), 2),
                                           F.date_add(easter_sunday(F.col("yr")), n - 3)))
                      .alias("day"))
    share = (es.groupBy(period_start(F.col("day"), unit).alias("period"))
               .agg((F.count("*") / F.lit(float(n))).alias(name)))
    return df.join(share, "period", "left").fillna({name: 0.0})


def distributed_lags(series: DataFrame, keys: list[str], x: str, m: int,
                     cumulative: bool = False) -> DataFrame:
    """x lagged 1..m periods (R22/W4), or with ``cumulative`` the trailing
    sums over the previous 1..m periods (W6).  Missing history -> NULL.

    Blocks with halos: no window over a whole series, no self-join."""
    out = with_lags(series, keys, list(range(1, m + 1)), F.col(x))
    if not cumulative:
        return out.select(*series.columns, *[F.col(f"_lag{k}").alias(f"{x}_lag{k}") for k in range(1, m + 1)])
    cols = []
    for k in range(1, m + 1):
        parts = [F.col(f"_lag{i}") for i in range(1, k + 1)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        cols.append(total.alias(f"{x}_sum{k}"))
    return out.select(*series.columns, *cols)


def log_transform(df: DataFrame, col: str, kind: str = "log", name: str | None = None) -> DataFrame:
    """Variance-stabilising transform of the target (P22): log or sqrt.  A
    value outside its domain is an error; it is never dropped from a fit."""
    f, inside = {"log": (F.log, F.col(col) > 0), "sqrt": (F.sqrt, F.col(col) >= 0)}[kind]
    bad = F.raise_error(F.concat(F.lit(f"{kind} of {col} = "), F.col(col).cast("string"))).cast("double")
    value = F.when(F.col(col).isNull(), F.lit(None).cast("double")).when(inside, f(F.col(col))).otherwise(bad)
    return df.withColumn(name or f"{kind}_{col}", value)


def back_transform(c: Column, kind: str = "log") -> Column:
    return F.exp(c) if kind == "log" else c * c


def back_transform_limit(c: Column, kind: str = "log") -> Column:
    """An interval limit on the original scale: the inverse is monotone only
    over the transform's range, so a limit below 0 of a square root is 0."""
    return back_transform(F.greatest(c, F.lit(0.0)) if kind == "sqrt" else c, kind)
