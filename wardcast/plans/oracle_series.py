"""DuckDB SQL for the time-series queries (independent statement of the
same semantics: aggregate to periods, calendar spine, self-joins)."""

from __future__ import annotations


def _series(name, src, key, ts, aggs, unit, where):
    step = {"month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH"}[unit]
    season = {"month": "month(period)", "quarter": "quarter(period)"}[unit]
    agg_sel = ", ".join(f"{e} AS {n}" for n, e in aggs.items())
    cols = ", ".join(f"a.{n}" for n in aggs)
    keysel = f"{key} AS series_id, " if key else ""
    keygrp = "series_id, " if key else ""
    keyj = "s.series_id = a.series_id AND " if key else ""
    keyp = "PARTITION BY s.series_id " if key else ""
    skey = "s.series_id, " if key else ""
    return f"""
{name}_agg AS (
  SELECT {keysel}CAST(date_trunc('{unit}', {ts}) AS DATE) AS period, {agg_sel}
  FROM {src} WHERE {where} GROUP BY ALL),
{name}_b AS (SELECT {keygrp}min(period) AS lo, max(period) AS hi FROM {name}_agg GROUP BY ALL),
{name}_sp AS (
  SELECT {keygrp}CAST(unnest(generate_series(lo, hi, {step})) AS DATE) AS period FROM {name}_b),
{name} AS (
  SELECT {skey}s.period,
    CAST(row_number() OVER ({keyp}ORDER BY s.period) AS INTEGER) AS t,
    CAST({season.replace('period', 's.period')} AS INTEGER) AS season,
    make_date(year(s.period), 1, 1) AS cycle, {cols}
  FROM {name}_sp s LEFT JOIN {name}_agg a ON {keyj}s.period = a.period)"""


def _complete(table, ts, unit):
    """Rows before the period that holds the day after the table's last day."""
    return (f"{ts} < (SELECT date_trunc('{unit}', CAST(max({ts}) AS DATE) + INTERVAL 1 DAY) FROM {table})")


MONTHLY = _series("ms", "orders", "o_orderpriority", "o_orderdate", {"y": "sum(o_totalprice)"},
                  "month", _complete("orders", "o_orderdate", "month"))
QUARTERLY = _series("qs", "orders", "o_orderpriority", "o_orderdate", {"y": "sum(o_totalprice)"},
                    "quarter", _complete("orders", "o_orderdate", "quarter"))
MULTI = _series("li", "lineitem", "l_returnflag", "l_shipdate", {
    "sum_price": "sum(l_extendedprice)", "sum_qty": "sum(l_quantity)",
    "avg_disc": "avg(l_discount)", "avg_tax": "avg(l_tax)",
    "n_items": "CAST(count(*) AS DOUBLE)"}, "month", _complete("lineitem", "l_shipdate", "month"))
REVENUE = _series("rv", "lineitem", None, "l_shipdate", {"x": "sum(l_extendedprice)"},
                  "month", _complete("lineitem", "l_shipdate", "month"))
QWIN = QUARTERLY + """,
qw AS (
  SELECT series_id, period, CAST(t - min(t) OVER (PARTITION BY series_id) + 1 AS INTEGER) AS t,
         season, cycle, y
  FROM qs WHERE period >= DATE '1997-01-01')"""

HOURLY = """
hr_agg AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS period,
         CAST(count(*) AS DOUBLE) AS y
  FROM events GROUP BY ALL),
hr_b AS (SELECT series_id, min(period) AS lo, max(period) AS hi FROM hr_agg GROUP BY ALL),
hr_sp AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS period FROM hr_b),
hr AS (
  SELECT s.series_id, s.period,
    CAST(row_number() OVER (PARTITION BY s.series_id ORDER BY s.period) AS INTEGER) AS t, a.y
  FROM hr_sp s LEFT JOIN hr_agg a ON s.series_id = a.series_id AND s.period = a.period)"""

ACF = MONTHLY + """,
st AS (SELECT series_id, avg(y) AS m, count(*) AS n FROM ms WHERE y IS NOT NULL GROUP BY 1),
dev AS (SELECT ms.series_id, t, y - st.m AS e FROM ms JOIN st USING (series_id) WHERE y IS NOT NULL),
den AS (SELECT series_id, sum(e*e) AS d FROM dev GROUP BY 1),
ks AS (SELECT series_id, n, unnest(generate_series(1, 24)) AS k FROM st),
num AS (
  SELECT a.series_id, b.k, sum(a.e * b.e) AS s
  FROM dev a JOIN (SELECT series_id, t, e, unnest(generate_series(1, 24)) AS k FROM dev) b
    ON a.series_id = b.series_id AND a.t = b.t + b.k
  GROUP BY ALL),
acf AS (
  SELECT ks.series_id, CAST(ks.k AS INTEGER) AS k,
         coalesce(num.s, 0.0) / nullif(den.d, 0) AS r, CAST(ks.n AS BIGINT) AS n
  FROM ks LEFT JOIN num ON ks.series_id = num.series_id AND ks.k = num.k
  JOIN den ON ks.series_id = den.series_id),
acfb AS (SELECT *, 2.0 / sqrt(CAST(n AS DOUBLE)) AS bound, abs(r) > 2.0 / sqrt(CAST(n AS DOUBLE)) AS significant FROM acf)"""

SEASON_COLS = ",\n  ".join(
    f"round(max(CASE WHEN season = {s} THEN y END), 2) AS s{s:02d}" for s in range(1, 13))
MULTI_UNION = "\nUNION ALL ".join(
    f"SELECT series_id, period, '{v}' AS variable, round(CAST({v} AS DOUBLE), 6) AS value FROM li"
    for v in ["sum_price", "sum_qty", "avg_disc", "avg_tax", "n_items"])
VARS = ["sum_price", "sum_qty", "avg_disc", "avg_tax", "n_items"]
CORR_UNION = "\nUNION ALL ".join(
    f"SELECT series_id, '{a}' AS var_a, '{b}' AS var_b, round(corr({a}, {b}), 6) AS r "
    f"FROM li GROUP BY series_id"
    for i, a in enumerate(VARS) for b in VARS[i + 1:])

PAIR_UNION = "\nUNION ALL ".join(
    f"SELECT series_id, period, '{a}' AS var_x, '{b}' AS var_y, round(CAST({a} AS DOUBLE), 6) AS x, "
    f"round(CAST({b} AS DOUBLE), 6) AS y FROM li"
    for i, a in enumerate(VARS) for b in VARS[i + 1:])

ORACLE = {
    "scatter_matrix": f"WITH {MULTI}\n{PAIR_UNION}",
    "monthly_series": f"WITH {MONTHLY}\nSELECT series_id, period, t, season, cycle, round(y, 2) AS y FROM ms",
    "quarterly_series": f"WITH {QUARTERLY}\nSELECT series_id, period, t, season, cycle, round(y, 2) AS y FROM qs",
    "series_window": f"WITH {QWIN}\nSELECT series_id, period, t, season, cycle, round(y, 2) AS y FROM qw",
    "series_gaps": f"""WITH {HOURLY},
runs AS (
  SELECT series_id, period, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g
  FROM hr WHERE y IS NULL)
SELECT series_id, CAST(min(period) AS TIMESTAMP) AS gap_start,
       CAST(max(period) AS TIMESTAMP) AS gap_end, CAST(count(*) AS BIGINT) AS n_missing
FROM runs GROUP BY series_id, g""",
    "facet_long": f"WITH {MULTI}\n{MULTI_UNION}",
    "seasonal_plot": f"WITH {MONTHLY}\nSELECT series_id, cycle,\n  {SEASON_COLS}\nFROM ms GROUP BY series_id, cycle",
    "seasonal_subseries": f"""WITH {MONTHLY}
SELECT series_id, season, period, round(y, 2) AS y,
       round(avg(y) OVER (PARTITION BY series_id, season), 4) AS season_mean
FROM ms""",
    "lag_pairs": f"""WITH {QWIN},
lagk AS (SELECT series_id, t + k AS t, k, y AS y_lag
         FROM qw, (SELECT unnest(generate_series(1, 9)) AS k))
SELECT qw.series_id, CAST(lagk.k AS INTEGER) AS k, qw.period, qw.season,
       round(qw.y, 2) AS y, round(lagk.y_lag, 2) AS y_lag
FROM qw JOIN lagk ON qw.series_id = lagk.series_id AND qw.t = lagk.t""",
    "scatter_pairs": f"""WITH {MONTHLY}, {REVENUE}
SELECT ms.series_id, ms.period, round(ms.y, 2) AS y, round(rv.x, 2) AS x
FROM ms JOIN rv ON ms.period = rv.period""",
    "corr_matrix": f"WITH {MULTI}\n{CORR_UNION}",
    "histogram": f"""WITH {MONTHLY},
st AS (SELECT series_id, min(y) AS lo, max(y) AS hi FROM ms GROUP BY 1),
binned AS (
  SELECT ms.series_id,
    CAST(CASE WHEN st.hi = st.lo THEN 1
         ELSE least(floor((y - st.lo) / ((st.hi - st.lo) / 10)) + 1, 10) END AS INTEGER) AS bin
  FROM ms JOIN st USING (series_id) WHERE y IS NOT NULL),
cnt AS (SELECT series_id, bin, count(*) AS n FROM binned GROUP BY ALL),
grid AS (SELECT series_id, lo, hi, CAST(unnest(generate_series(1, 10)) AS INTEGER) AS bin FROM st)
SELECT g.series_id, g.bin,
  round(g.lo + (g.bin - 1) * ((g.hi - g.lo) / 10), 2) AS lo,
  round(g.lo + g.bin * ((g.hi - g.lo) / 10), 2) AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt c ON g.series_id = c.series_id AND g.bin = c.bin""",
    "density": f"""WITH {MULTI},
obs AS (SELECT series_id, avg_disc AS v FROM li WHERE avg_disc IS NOT NULL),
st AS (
  SELECT series_id, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, count(*) AS n,
         quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
  FROM obs GROUP BY 1),
bw AS (
  SELECT *, 0.9 * (CASE WHEN (q3 - q1) / 1.34 > 0 THEN least(sd, (q3 - q1) / 1.34) ELSE sd END)
            * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st),
pts AS (
  SELECT series_id, h, n, g, lo + (hi - lo) * g / 31 AS x
  FROM bw, (SELECT unnest(generate_series(0, 31)) AS g))
SELECT p.series_id, CAST(p.g AS INTEGER) AS g, round(p.x, 6) AS x,
  round(sum(exp(-0.5 * ((p.x - o.v) / p.h) * ((p.x - o.v) / p.h)))
        / (p.n * p.h * sqrt(2 * pi())), 6) AS density
FROM pts p JOIN obs o ON p.series_id = o.series_id
GROUP BY p.series_id, p.g, p.x, p.h, p.n""",
    "acf": f"WITH {ACF}\nSELECT series_id, k, round(r, 6) AS r, n FROM acf",
    "acf_bounds": f"WITH {ACF}\nSELECT series_id, k, round(r, 6) AS r, n, round(bound, 6) AS bound, significant FROM acfb",
    "acf_signature": f"""WITH {ACF},
g AS (
  SELECT series_id,
    max(CASE WHEN k = 1 THEN r END) AS r1, max(CASE WHEN k = 11 THEN r END) AS rm1,
    max(CASE WHEN k = 12 THEN r END) AS rm, max(CASE WHEN k = 13 THEN r END) AS rp1,
    max(CASE WHEN k = 12 THEN bound END) AS bm, max(CASE WHEN k = 1 THEN bound END) AS b1,
    min(CASE WHEN k <= 12 THEN r END) AS minr,
    avg(CASE WHEN NOT significant THEN 1.0 ELSE 0.0 END) AS share_inside
  FROM acfb GROUP BY 1)
SELECT series_id, round(r1, 6) AS r1, round(rm, 6) AS rm, round(share_inside, 6) AS share_inside,
  (r1 > b1 AND minr > 0) AS trend,
  (rm > bm AND rm > coalesce(rm1, -2.0) AND rm > coalesce(rp1, -2.0)) AS seasonal,
  (share_inside >= 0.95) AS white_noise
FROM g""",
    "series_head": f"WITH {QUARTERLY}\nSELECT series_id, period, t, season, cycle, round(y, 2) AS y FROM qs WHERE t <= 6",
}

ORACLE["series_zero_runs"] = f"""WITH {HOURLY},
runs AS (
  SELECT series_id, period, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g
  FROM hr WHERE coalesce(y, 0) = 0)
SELECT series_id, CAST(min(period) AS TIMESTAMP) AS gap_start,
       CAST(max(period) AS TIMESTAMP) AS gap_end, CAST(count(*) AS BIGINT) AS n_missing
FROM runs GROUP BY series_id, g"""

# ISO weeks straight from the rows: isoyear and week, no calendar table
ORACLE["seasonal_plot_weekly"] = f"""WITH wk AS (
  SELECT o_orderpriority AS series_id, isoyear(o_orderdate) AS iso, week(o_orderdate) AS w,
         sum(o_totalprice) AS y
  FROM orders WHERE {_complete("orders", "o_orderdate", "week")} GROUP BY ALL)
SELECT series_id, make_date(iso, 1, 1) AS cycle,
  {", ".join(f"round(max(CASE WHEN w = {s} THEN y END), 2) AS s{s:02d}" for s in range(1, 54))}
FROM wk GROUP BY series_id, iso"""

ORACLE["monthly_series_flagged"] = f"""WITH {_series("ms", "orders", "o_orderpriority", "o_orderdate", {"y": "sum(o_totalprice)"}, "month", "true")}
SELECT series_id, period, t, season, cycle, round(y, 2) AS y,
       period < (SELECT date_trunc('month', CAST(max(o_orderdate) AS DATE) + INTERVAL 1 DAY) FROM orders) AS is_complete
FROM ms"""

# the sketch's quartiles are checked by their true ranks; the ends are exact
ORACLE["price_quartiles"] = """SELECT l_returnflag AS series_id, count(*) AS n,
  round(min(l_extendedprice), 2) AS lowest, round(max(l_extendedprice), 2) AS highest,
  true AS q1_near, true AS median_near, true AS q3_near
FROM lineitem GROUP BY 1"""

ORACLE["discount_quartiles"] = f"""WITH {MULTI}
SELECT series_id, count(avg_disc) AS n, round(min(avg_disc), 9) AS lowest, round(quantile_cont(avg_disc, 0.25), 9) AS q1,
  round(quantile_cont(avg_disc, 0.5), 9) AS median, round(quantile_cont(avg_disc, 0.75), 9) AS q3,
  round(max(avg_disc), 9) AS highest
FROM li GROUP BY series_id"""
