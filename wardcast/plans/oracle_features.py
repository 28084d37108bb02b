"""DuckDB SQL for the feature queries."""

from __future__ import annotations

from wardcast.plans.oracle_series import MONTHLY, MULTI, QUARTERLY

DUMMIES = ", ".join(f"CASE WHEN season = {s} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS season_{s}"
                    for s in range(2, 13))


def _fourier(m, K):
    cols = []
    for j in range(1, K + 1):
        ang = f"(2 * pi() * {j} / {m}) * t"
        if 2 * j != m:
            cols.append(f"round(sin({ang}), 9) AS sin_{j}")
        cols.append(f"round(cos({ang}), 9) AS cos_{j}")
    return ", ".join(cols)


# Gregorian Easter Sunday by the anonymous computus, in SQL integer arithmetic.
EASTER = """
ey AS (SELECT DISTINCT year(period) AS yr FROM {src}),
ec AS (
  SELECT yr, yr % 19 AS a, yr // 100 AS b, yr % 100 AS c FROM ey),
ec2 AS (SELECT *, b // 4 AS d, b % 4 AS e, (b + 8) // 25 AS f FROM ec),
ec3 AS (SELECT *, (b - f + 1) // 3 AS g FROM ec2),
ec4 AS (SELECT *, (19 * a + b - d - g + 15) % 30 AS h, c // 4 AS i, c % 4 AS k FROM ec3),
ec5 AS (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM ec4),
ec6 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS mm FROM ec5),
es AS (
  SELECT make_date(yr, CAST((h + l - 7 * mm + 114) // 31 AS INTEGER),
                   CAST((h + l - 7 * mm + 114) % 31 + 1 AS INTEGER)) AS sunday FROM ec6),
edays AS (SELECT CAST(unnest(generate_series(sunday - INTERVAL 2 DAY, sunday, INTERVAL 1 DAY)) AS DATE) AS day FROM es),
eshare AS (SELECT CAST(date_trunc('{unit}', day) AS DATE) AS period, count(*) / 3.0 AS easter FROM edays GROUP BY 1)"""

DAYS = """
per AS (SELECT DISTINCT period FROM ms),
days AS (
  SELECT period, CAST(unnest(generate_series(period, period + INTERVAL 1 MONTH - INTERVAL 1 DAY,
                                              INTERVAL 1 DAY)) AS DATE) AS day
  FROM per)"""

ORACLE = {
    "trend_season_design": f"""WITH {MONTHLY}
SELECT series_id, period, t, CAST(t AS DOUBLE) AS trend, {DUMMIES}, round(y, 2) AS y FROM ms""",
    "fourier_terms": f"WITH {MONTHLY}\nSELECT series_id, period, t, {_fourier(12, 6)} FROM ms",
    "trading_days": f"""WITH {MONTHLY}, {DAYS},
td AS (SELECT period, CAST(count(*) AS INTEGER) AS trading_days FROM days WHERE isodow(day) <= 5 GROUP BY 1)
SELECT ms.series_id, ms.period, coalesce(td.trading_days, 0) AS trading_days
FROM ms LEFT JOIN td USING (period)""",
    "weekday_counts": f"""WITH {MONTHLY}, {DAYS},
wc AS (
  SELECT period,
    {", ".join(f"CAST(count(*) FILTER (WHERE isodow(day) = {i + 1}) AS INTEGER) AS {d}"
               for i, d in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"]))}
  FROM days GROUP BY 1)
SELECT ms.series_id, ms.period, mon, tue, wed, thu, fri, sat, sun
FROM ms LEFT JOIN wc USING (period)""",
    "easter_dummy": "WITH " + MONTHLY + "," + QUARTERLY + "," +
    EASTER.format(src="ms", unit="month") + """
SELECT ms.series_id, ms.period, round(coalesce(eshare.easter, 0.0), 9) AS easter, 'month' AS unit
FROM ms LEFT JOIN eshare USING (period)
UNION ALL
SELECT qs.series_id, qs.period,
  round(coalesce((SELECT sum(e2.easter) FROM eshare e2
                  WHERE CAST(date_trunc('quarter', e2.period) AS DATE) = qs.period), 0.0), 9),
  'quarter'
FROM qs""",
    "distributed_lags": f"""WITH {MULTI}
SELECT a.series_id, a.period, a.t, round(a.sum_qty, 4) AS sum_qty,
  round(l1.sum_qty, 4) AS sum_qty_lag1, round(l2.sum_qty, 4) AS sum_qty_lag2,
  round(l3.sum_qty, 4) AS sum_qty_lag3
FROM li a
LEFT JOIN li l1 ON a.series_id = l1.series_id AND l1.t = a.t - 1
LEFT JOIN li l2 ON a.series_id = l2.series_id AND l2.t = a.t - 2
LEFT JOIN li l3 ON a.series_id = l3.series_id AND l3.t = a.t - 3""",
    "trailing_sums": f"""WITH {MULTI}
SELECT a.series_id, a.period, a.t, round(a.sum_qty, 4) AS sum_qty,
  round(l1.sum_qty, 4) AS sum_qty_sum1,
  round(l1.sum_qty + l2.sum_qty, 4) AS sum_qty_sum2,
  round(l1.sum_qty + l2.sum_qty + l3.sum_qty, 4) AS sum_qty_sum3
FROM li a
LEFT JOIN li l1 ON a.series_id = l1.series_id AND l1.t = a.t - 1
LEFT JOIN li l2 ON a.series_id = l2.series_id AND l2.t = a.t - 2
LEFT JOIN li l3 ON a.series_id = l3.series_id AND l3.t = a.t - 3""",
    "event_dummy": f"""WITH {MONTHLY},
pk AS (SELECT series_id, arg_max(period, y) AS period FROM ms GROUP BY 1)
SELECT ms.series_id, ms.period, round(ms.y, 2) AS y,
  CASE WHEN pk.series_id IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS outlier
FROM ms LEFT JOIN pk ON ms.series_id = pk.series_id AND ms.period = pk.period""",
    "spike_dummy": f"""WITH {MONTHLY}
SELECT series_id, period, round(y, 2) AS y,
  CASE WHEN period BETWEEN DATE '2000-01-01' AND DATE '2000-03-01' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS spike
FROM ms""",
    "category_dummies": f"""WITH {MULTI}
SELECT series_id, period, round(sum_price, 2) AS sum_price,
  CASE WHEN series_id = 'N' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS flag_N,
  CASE WHEN series_id = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS flag_R
FROM li""",
}

_TURNS = [("7_1", "1 / 7.0", True), ("7_2", "2 / 7.0", True), ("7_3", "3 / 7.0", True),
          ("365_25_1", "1 / 365.25", True), ("365_25_2", "2 / 365.25", True)]
ORACLE["fourier_daily"] = f"""WITH d AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS day FROM events GROUP BY ALL),
b AS (SELECT series_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
g AS (SELECT series_id, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS period FROM b),
n AS (SELECT series_id, period, CAST(period - lo + 1 AS INTEGER) AS t FROM g)
SELECT series_id, period, t,
  {", ".join(f"round({f}(2 * pi() * t * {w}), 9) AS {f}_{m}" for m, w, _ in _TURNS for f in ("sin", "cos"))}
FROM n"""

# islands over the whole time line first, days cut out of them afterwards
ORACLE["event_shares"] = """WITH sp AS (
  SELECT event_type AS series_id, ts AS s, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS e
  FROM events WHERE value > 0),
m AS (SELECT *, max(e) OVER (PARTITION BY series_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m),
isl AS (SELECT series_id, min(s) AS s, max(e) AS e FROM r GROUP BY series_id, run),
d AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
b AS (SELECT series_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
g AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS period FROM b),
c AS (
  SELECT g.series_id, g.period, sum(date_diff('microsecond', greatest(s, CAST(g.period AS TIMESTAMP)),
                                       least(e, CAST(g.period + INTERVAL 1 DAY AS TIMESTAMP)))) AS us
  FROM g JOIN isl ON isl.series_id = g.series_id AND s < g.period + INTERVAL 1 DAY AND e > g.period GROUP BY ALL)
SELECT g.series_id, g.period, d.n, round(coalesce(us, 0) / 86400000000.0, 9) AS busy
FROM g LEFT JOIN c ON c.series_id = g.series_id AND c.period = g.period
LEFT JOIN d ON d.series_id = g.series_id AND d.day = g.period"""

# holidays told from the dates themselves: a fourth Thursday is a Thursday from the 22nd to the 28th
ORACLE["holiday_trading_days"] = """WITH y AS (
  SELECT r_name AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS y
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
dates AS (SELECT CAST(unnest(generate_series(DATE '1993-12-25', DATE '2003-01-05', INTERVAL 1 DAY)) AS DATE) AS day),
ms AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS period FROM dates),""" + \
    EASTER.format(src="ms", unit="month") + """,
nat AS (
  SELECT *, month(day) AS m, day(day) AS d, isodow(day) AS w, year(day) AS y FROM dates),
hol AS (
  SELECT 'AFRICA' AS region, day AS observed FROM nat WHERE (m = 2 AND d = 29) OR (m = 12 AND d = 25 AND w <= 5)
  UNION ALL
  SELECT 'AMERICA', CASE w WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END FROM nat
  WHERE (m, d) IN ((1, 1), (7, 4), (12, 25))
  UNION ALL SELECT 'AMERICA', day FROM nat WHERE (m = 5 AND w = 1 AND d >= 25) OR (m = 11 AND w = 4 AND d BETWEEN 22 AND 28)
  UNION ALL SELECT 'ASIA', CASE w WHEN 6 THEN day + 2 WHEN 7 THEN day + 1 ELSE day END FROM nat WHERE m = 1 AND d = 1
  UNION ALL SELECT 'ASIA', day FROM nat WHERE m = 10 AND d = 1 AND y BETWEEN 1997 AND 2000
  UNION ALL SELECT 'EUROPE', day FROM nat WHERE (m, d) IN ((1, 1), (5, 1))
  UNION ALL SELECT 'EUROPE', CAST(sunday - INTERVAL 2 DAY AS DATE) FROM es
  UNION ALL SELECT 'EUROPE', CAST(sunday + INTERVAL 1 DAY AS DATE) FROM es
  UNION ALL SELECT 'EUROPE', CASE w WHEN 6 THEN day + 2 WHEN 7 THEN day + 1 ELSE day END FROM nat WHERE m = 12 AND d IN (25, 26)),
grid AS (
  SELECT y.series_id, y.period, n.day, EXISTS (SELECT 1 FROM hol WHERE region = y.series_id AND observed = n.day) AS is_off
  FROM y JOIN nat n ON date_trunc('month', n.day) = y.period WHERE n.w <= 5)
SELECT y.series_id, y.period, round(any_value(y.y), 2) AS y, CAST(count(*) FILTER (WHERE NOT is_off) AS INTEGER) AS trading_days,
  CAST(count(*) FILTER (WHERE is_off) AS INTEGER) AS holidays
FROM y JOIN grid g ON g.series_id = y.series_id AND g.period = y.period GROUP BY y.series_id, y.period"""
