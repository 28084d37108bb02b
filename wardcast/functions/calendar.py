"""Calendar arithmetic as Column expressions (periods, seasons, Easter).

Everything is integer/date arithmetic on columns, so it runs inside
whole-stage codegen on any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("year", "quarter", "month", "week", "day", "hour")
DATE_UNITS = ("year", "quarter", "month", "week", "day")


def period_start(ts: Column, unit: str) -> Column:
    """Start of the period containing ``ts`` (DATE for day and coarser,
    TIMESTAMP_NTZ for hours).  Weeks start on Monday.

    Pure calendar arithmetic on the wall-clock value: independent of the
    session time zone (no round trip through a zoned timestamp, so no DST
    shifts)."""
    if unit not in UNITS:
        raise ValueError(unit)
    if unit == "day":
        return F.to_date(ts)
    if unit in DATE_UNITS:
        return F.trunc(F.to_date(ts), unit)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def step(unit: str) -> Column:
    """One period as an interval literal (for sequence / arithmetic)."""
    return {
        "year": F.make_ym_interval(F.lit(1), F.lit(0)),
        "quarter": F.make_ym_interval(F.lit(0), F.lit(3)),
        "month": F.make_ym_interval(F.lit(0), F.lit(1)),
        "week": F.make_dt_interval(days=F.lit(7)),
        "day": F.make_dt_interval(days=F.lit(1)),
        "hour": F.make_dt_interval(hours=F.lit(1)),
    }[unit]


def add_periods(period: Column, n: Column, unit: str) -> Column:
    """period + n units (n may be a column)."""
    if unit in ("year", "quarter", "month"):
        months = {"year": 12, "quarter": 3, "month": 1}[unit]
        return F.add_months(period, (n * months).cast("int"))
    if unit in ("week", "day"):
        return F.date_add(period, (n * (7 if unit == "week" else 1)).cast("int"))
    return period + F.make_dt_interval(hours=n.cast("int"))


def micros(c: Column, kind) -> Column:
    """Microseconds on a line that keeps distances between wall-clock times
    (TIMESTAMP_NTZ) or instants (TIMESTAMP), in any session time zone."""
    if kind.typeName() == "timestamp":
        return F.unix_micros(c)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    if kind.typeName() == "date":
        return days * 86_400_000_000
    seconds = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000
    return days * 86_400_000_000 + seconds + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def periods_between(a: Column, b: Column, unit: str) -> Column:
    """Whole periods from a to b (both period starts), as int."""
    if unit in ("year", "quarter", "month"):
        months = (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))
        return (months / {"year": 12, "quarter": 3, "month": 1}[unit]).cast("int")
    if unit in ("week", "day"):
        return (F.datediff(b, a) / (7 if unit == "week" else 1)).cast("int")
    return (F.datediff(F.to_date(b), F.to_date(a)) * 24 + F.hour(b) - F.hour(a)).cast("int")


def season_of(period: Column, unit: str) -> Column:
    """Position within the seasonal cycle, 1-based: quarter, month,
    weekday (Mon=1 .. Sun=7) for days, hour+1 for hours, ISO week for weeks."""
    return {
        "year": F.lit(1),
        "quarter": F.quarter(period),
        "month": F.month(period),
        "week": F.weekofyear(period),
        "day": F.weekday(period) + 1,
        "hour": F.hour(period) + 1,
    }[unit].cast("int")


def cycle_of(period: Column, unit: str) -> Column:
    """Start date of the seasonal cycle containing the period (year for
    quarter/month, ISO year - that of the week's Thursday - for weeks, Monday
    week for days, day for hours)."""
    if unit == "week":
        return F.make_date(F.year(F.date_add(period, 3)), F.lit(1), F.lit(1))
    if unit in ("year", "quarter", "month"):
        return F.make_date(F.year(period), F.lit(1), F.lit(1))
    if unit == "day":
        return F.trunc(period, "week")
    return F.to_date(period)


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once (and not copied into every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter Sunday of ``year`` (anonymous Gregorian computus)."""
    def div(x, n: int) -> Column:
        return F.floor(x / n).cast("int")

    def epact(y):
        b = div(y, 100)
        return F.pmod(19 * F.pmod(y, F.lit(19)) + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15, F.lit(30))

    def weekday_shift(y, h):
        c = F.pmod(y, F.lit(100))
        return F.pmod(32 + 2 * F.pmod(div(y, 100), F.lit(4)) + 2 * div(c, 4) - h - F.pmod(c, F.lit(4)), F.lit(7))

    def day(y, h, w):
        late = div(F.pmod(y, F.lit(19)) + 11 * h + 22 * w, 451)
        return once(h + w - 7 * late + 114, lambda n: F.make_date(y, div(n, 31), F.pmod(n, F.lit(31)) + 1))

    return once(year.cast("int"), lambda y: once(epact(y), lambda h: once(weekday_shift(y, h), lambda w: day(y, h, w))))
