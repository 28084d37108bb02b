"""DuckDB SQL for the regression queries.

DuckDB has no matrix solver, so the oracles use closed forms that are exact
for these designs:
* model A (trend + seasonal dummies): within-season demeaning - slope
  b = S_ty / S_tt on season-centred data, season levels ybar_s - b tbar_s,
  leverage 1/n_s + (t - tbar_s)^2 / S_tt;
* model B (three predictors): centred normal equations solved by the
  explicit 3x3 inverse (cofactors);
* simple regressions: the regr_* aggregates;
* Student-t p-values by the incomplete-beta series, quantiles by unrolled
  Newton steps.
"""

from __future__ import annotations

import math

from wardcast.plans.common import sql_dec as dc
from wardcast.plans.common import sql_sig as sg
from wardcast.plans.oracle_series import MONTHLY, MULTI, QWIN, REVENUE


def _model_a(end=None, target="y", src="qw"):
    cut = f" AND period <= DATE '{end}'" if end else ""
    return f"""
d AS (SELECT series_id, period, t, season, {target} AS y FROM {src} WHERE y IS NOT NULL{cut}),
sm AS (SELECT series_id, season, avg(t) AS tbar, avg(y) AS ybar, count(*) AS ns FROM d GROUP BY ALL),
dd AS (SELECT d.*, sm.tbar, sm.ybar, sm.ns FROM d JOIN sm USING (series_id, season)),
bb AS (SELECT series_id, sum((t - tbar) * (y - ybar)) / sum((t - tbar) * (t - tbar)) AS b,
              sum((t - tbar) * (t - tbar)) AS stt, count(*) AS n, avg(y) AS ym,
              count(DISTINCT season) AS ms, max(t) AS tmax, max(period) AS last
       FROM dd GROUP BY 1),
al AS (SELECT sm.series_id, sm.season, sm.ybar - bb.b * sm.tbar AS alpha, sm.tbar, sm.ns
       FROM sm JOIN bb USING (series_id)),
fit AS (
  SELECT dd.series_id, dd.period, dd.t, dd.season, dd.y, al.alpha + bb.b * dd.t AS fitted,
         dd.y - (al.alpha + bb.b * dd.t) AS residual,
         1.0 / dd.ns + (dd.t - dd.tbar) * (dd.t - dd.tbar) / bb.stt AS hat
  FROM dd JOIN al USING (series_id, season) JOIN bb USING (series_id)),
gl AS (
  SELECT f.series_id, count(*) AS n, sum(residual * residual) AS sse,
         sum((y - bb.ym) * (y - bb.ym)) AS sst,
         avg(pow(residual / (1 - hat), 2)) AS cv, max(bb.ms) + 1 AS rnk
  FROM fit f JOIN bb USING (series_id) GROUP BY 1),
crit AS (
  SELECT *, rnk - 1 AS k, n - rnk AS df_resid, 1 - sse / sst AS r2,
    1 - (sse / sst) * (n - 1) / (n - rnk) AS adj_r2, sqrt(sse / (n - rnk)) AS sigma,
    n * ln(sse / n) + 2 * (rnk + 1) AS aic,
    CASE WHEN n - rnk - 2 > 0 THEN n * ln(sse / n) + 2 * (rnk + 1)
         + 2.0 * (rnk + 1) * (rnk + 2) / (n - rnk - 2) END AS aicc,
    n * ln(sse / n) + (rnk + 1) * ln(n) AS bic
  FROM gl)"""


def _future_a(h=8):
    return f"""
fut AS (
  SELECT bb.series_id, CAST(hh AS INTEGER) AS h,
         CAST(bb.last + to_months(CAST(3 * hh AS INTEGER)) AS DATE) AS period,
         CAST(bb.tmax + hh AS INTEGER) AS t
  FROM bb, (SELECT unnest(generate_series(1, {h})) AS hh)),
fc AS (
  SELECT fut.*, CAST(quarter(fut.period) AS INTEGER) AS season,
         al.alpha + bb.b * fut.t AS point,
         crit.sigma * sqrt(1 + 1.0 / al.ns + (fut.t - al.tbar) * (fut.t - al.tbar) / bb.stt) AS se
  FROM fut JOIN bb USING (series_id) JOIN crit USING (series_id)
  JOIN al ON al.series_id = fut.series_id AND al.season = quarter(fut.period))"""


A = QWIN + "," + _model_a()

COEF_A = A + """,
a1 AS (SELECT * FROM al WHERE season = 1),
coef AS (
  SELECT series_id, '(Intercept)' AS term, a1.alpha AS estimate,
         crit.sigma * sqrt(1.0 / a1.ns + a1.tbar * a1.tbar / bb.stt) AS std_error
  FROM a1 JOIN bb USING (series_id) JOIN crit USING (series_id)
  UNION ALL
  SELECT series_id, 'trend', bb.b, crit.sigma * sqrt(1.0 / bb.stt)
  FROM bb JOIN crit USING (series_id)
  UNION ALL
  SELECT al.series_id, 'season_' || al.season, al.alpha - a1.alpha,
         crit.sigma * sqrt(1.0 / al.ns + 1.0 / a1.ns + (al.tbar - a1.tbar) * (al.tbar - a1.tbar) / bb.stt)
  FROM al JOIN a1 USING (series_id) JOIN bb USING (series_id) JOIN crit USING (series_id)
  WHERE al.season > 1)"""


def _model_b(end=None):
    cut = f" AND period <= DATE '{end}'" if end else ""
    return f"""
b AS (
  SELECT a.series_id, a.period, a.t,
    100 * (a.sum_price / nullif(p.sum_price, 0) - 1) AS d_price,
    100 * (a.n_items / nullif(p.n_items, 0) - 1) AS d_items,
    100 * (a.avg_disc - p.avg_disc) AS d_disc, 100 * (a.avg_tax - p.avg_tax) AS d_tax
  FROM li a JOIN li p ON a.series_id = p.series_id AND a.t = p.t + 1),
bc AS (SELECT * FROM b WHERE d_price IS NOT NULL AND d_items IS NOT NULL
                         AND d_disc IS NOT NULL AND d_tax IS NOT NULL{cut}),
mb AS (SELECT series_id, count(*) AS n, avg(d_items) AS m1, avg(d_disc) AS m2,
              avg(d_tax) AS m3, avg(d_price) AS my, max(period) AS last FROM bc GROUP BY 1),
cb AS (
  SELECT bc.series_id,
    sum((d_items - m1) * (d_items - m1)) AS a11, sum((d_items - m1) * (d_disc - m2)) AS a12,
    sum((d_items - m1) * (d_tax - m3)) AS a13, sum((d_disc - m2) * (d_disc - m2)) AS a22,
    sum((d_disc - m2) * (d_tax - m3)) AS a23, sum((d_tax - m3) * (d_tax - m3)) AS a33,
    sum((d_items - m1) * (d_price - my)) AS c1, sum((d_disc - m2) * (d_price - my)) AS c2,
    sum((d_tax - m3) * (d_price - my)) AS c3
  FROM bc JOIN mb USING (series_id) GROUP BY 1),
dt AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a13 * a23)
                 + a13 * (a12 * a23 - a22 * a13) AS det FROM cb),
iv AS (
  SELECT series_id, c1, c2, c3,
    (a22 * a33 - a23 * a23) / det AS i11, (a13 * a23 - a12 * a33) / det AS i12,
    (a12 * a23 - a13 * a22) / det AS i13, (a11 * a33 - a13 * a13) / det AS i22,
    (a12 * a13 - a11 * a23) / det AS i23, (a11 * a22 - a12 * a12) / det AS i33
  FROM dt),
cf AS (
  SELECT iv.*, mb.n, mb.m1, mb.m2, mb.m3, mb.my, mb.last,
    i11 * c1 + i12 * c2 + i13 * c3 AS b1, i12 * c1 + i22 * c2 + i23 * c3 AS b2,
    i13 * c1 + i23 * c2 + i33 * c3 AS b3
  FROM iv JOIN mb USING (series_id)),
cf2 AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM cf),
fitb AS (
  SELECT bc.*, b0 + b1 * d_items + b2 * d_disc + b3 * d_tax AS fitted,
         d_price - (b0 + b1 * d_items + b2 * d_disc + b3 * d_tax) AS residual
  FROM bc JOIN cf2 USING (series_id)),
sgb AS (SELECT series_id, sqrt(sum(residual * residual) / (count(*) - 4)) AS sigma
        FROM fitb GROUP BY 1)"""


B = MULTI + "," + _model_b()


def _quad(x1, x2, x3):
    """(x - m)' inv (x - m) for the centred 3x3 inverse."""
    u1, u2, u3 = f"({x1} - m1)", f"({x2} - m2)", f"({x3} - m3)"
    return (f"(i11 * {u1} * {u1} + i22 * {u2} * {u2} + i33 * {u3} * {u3}"
            f" + 2 * i12 * {u1} * {u2} + 2 * i13 * {u1} * {u3} + 2 * i23 * {u2} * {u3})")


MODEL_C = MONTHLY + "," + REVENUE + """,
cd AS (SELECT ms.series_id, ms.period, ms.t, ms.y, rv.x FROM ms JOIN rv ON ms.period = rv.period),
creg AS (
  SELECT series_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
         regr_r2(y, x) AS r2, regr_count(y, x) AS n FROM cd GROUP BY 1),
cres AS (SELECT cd.series_id, cd.t, cd.y - (intercept + slope * cd.x) AS e FROM cd JOIN creg USING (series_id)),
cm AS (SELECT series_id, avg(e) AS em FROM cres GROUP BY 1),
cacf AS (
  SELECT a.series_id,
    sum(CASE WHEN p.t IS NOT NULL THEN (a.e - cm.em) * (p.e - cm.em) ELSE 0 END)
      / sum((a.e - cm.em) * (a.e - cm.em)) AS resid_acf1
  FROM cres a JOIN cm USING (series_id)
  LEFT JOIN cres p ON p.series_id = a.series_id AND p.t = a.t - 1
  GROUP BY 1)"""

BUCKET = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100"

ORACLE = {
    "ols_trend_season": f"""WITH {COEF_A}
SELECT series_id, term, {dc('estimate')} AS estimate, {dc('std_error')} AS std_error,
       {sg('estimate / std_error')} AS t_value
FROM coef""",
    "fitted_residuals": f"""WITH {A}
SELECT series_id, period, t, {dc('y')} AS y, {dc('fitted')} AS fitted,
       {dc('residual')} AS residual
FROM fit""",
    "actual_vs_fitted": f"""WITH {A}
SELECT series_id, period, season, {dc('y')} AS actual, {dc('fitted')} AS fitted FROM fit""",
    "resid_vs_fitted": f"""WITH {A}
SELECT series_id, {sg('corr(abs(residual), fitted)', 6)} AS abs_resid_fitted_corr
FROM fit GROUP BY 1""",
    "resid_fitted_pairs": f"""WITH {A}
SELECT series_id, period, {dc('fitted')} AS fitted, {dc('residual')} AS residual FROM fit""",
    "model_glance": f"""WITH {A}
SELECT series_id, CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k,
  CAST(df_resid AS INTEGER) AS df_resid, {sg('r2')} AS r2, {sg('adj_r2')} AS adj_r2,
  {sg('sigma')} AS sigma, {sg('aic')} AS aic, {sg('aicc')} AS aicc, {sg('bic')} AS bic,
  {sg('cv')} AS cv
FROM crit""",
    "ols_fourier": f"""WITH {A}
SELECT series_id, CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k, {sg('r2', 7)} AS r2,
  {sg('sigma', 7)} AS sigma, {sg('aicc', 7)} AS aicc
FROM crit""",
    "influence": f"""WITH {A},
inf AS (SELECT fit.*, residual / (crit.sigma * sqrt(1 - hat)) AS r, crit.rnk
        FROM fit JOIN crit USING (series_id))
SELECT series_id, period, {sg('hat', 7)} AS hat, {sg('r', 7)} AS std_resid,
  {sg('r * r * hat / (rnk * (1 - hat))', 7)} AS cooks_d
FROM inf""",
    "resid_diagnostics": f"""WITH {A},
em AS (SELECT series_id, avg(residual) AS m FROM fit GROUP BY 1),
ac AS (
  SELECT a.series_id,
    sum(CASE WHEN p.t IS NOT NULL THEN (a.residual - em.m) * (p.residual - em.m) ELSE 0 END)
      / sum((a.residual - em.m) * (a.residual - em.m)) AS resid_acf1,
    stddev_samp(a.residual) AS sd_resid, count(*) AS n
  FROM fit a JOIN em USING (series_id)
  LEFT JOIN fit p ON p.series_id = a.series_id AND p.t = a.t - 1
  GROUP BY 1)
SELECT series_id, CAST(n AS BIGINT) AS n, {sg('sd_resid', 7)} AS sd_resid,
  {sg('resid_acf1', 7)} AS resid_acf1
FROM ac""",
    "forecast_exante": f"""WITH {A}, {_future_a()}
SELECT series_id, h, period, t, season, {dc('point')} AS point, {dc('se')} AS se FROM fc""",
    "forecast_expost": f"""WITH {QWIN}, {_model_a(end='2000-04-01')},
test AS (SELECT series_id, period, t, season, y FROM qw WHERE period > DATE '2000-04-01'),
ep AS (
  SELECT test.series_id, test.period, test.y AS actual, al.alpha + bb.b * test.t AS point
  FROM test JOIN bb USING (series_id)
  JOIN al ON al.series_id = test.series_id AND al.season = test.season)
SELECT series_id, period, {dc('actual')} AS actual, {dc('point')} AS point,
  {dc('actual - point')} AS error
FROM ep""",
    "prediction_eval": f"""WITH {QWIN}, {_model_a(end='2000-04-01')},
test AS (SELECT series_id, period, t, season, y FROM qw WHERE period > DATE '2000-04-01'),
ep AS (
  SELECT test.series_id, test.y AS actual, test.y - (al.alpha + bb.b * test.t) AS e
  FROM test JOIN bb USING (series_id)
  JOIN al ON al.series_id = test.series_id AND al.season = test.season)
SELECT series_id, CAST(count(e) AS BIGINT) AS n, {dc('avg(e)')} AS me,
  {dc('sqrt(avg(e * e))')} AS rmse, {dc('avg(abs(e))')} AS mae,
  {sg('avg(abs(e / nullif(actual, 0)) * 100)', 7)} AS mape
FROM ep GROUP BY 1""",
    "transform_target": f"""WITH {QWIN},
lq AS (SELECT *, ln(y) AS log_y FROM qw), {_model_a(target='log_y', src='lq')}, {_future_a()}
SELECT series_id, h, period, {sg('point', 9)} AS point_log, {dc('exp(point)')} AS point FROM fc""",
    "ols_simple": f"""WITH {B}
SELECT series_id, {sg('regr_slope(d_price, d_items)')} AS slope,
  {sg('regr_intercept(d_price, d_items)')} AS intercept,
  {sg('regr_r2(d_price, d_items)')} AS r2,
  CAST(regr_count(d_price, d_items) AS BIGINT) AS n,
  {sg('sqrt(regr_syy(d_price, d_items) * (1 - regr_r2(d_price, d_items)) / (regr_count(d_price, d_items) - 2))')} AS sigma
FROM b GROUP BY 1""",
    "ols_multi": f"""WITH {B},
cc AS (SELECT cf2.*, sgb.sigma FROM cf2 JOIN sgb USING (series_id)),
coef AS (
  SELECT series_id, '(Intercept)' AS term, b0 AS estimate,
         sigma * sqrt(1.0 / n + {_quad('0', '0', '0')}) AS std_error FROM cc
  UNION ALL SELECT series_id, 'd_items', b1, sigma * sqrt(i11) FROM cc
  UNION ALL SELECT series_id, 'd_disc', b2, sigma * sqrt(i22) FROM cc
  UNION ALL SELECT series_id, 'd_tax', b3, sigma * sqrt(i33) FROM cc)
SELECT series_id, term, {sg('estimate', 7)} AS estimate, {sg('std_error', 7)} AS std_error,
  {sg('estimate / std_error', 7)} AS t_value
FROM coef""",
    "resid_vs_x": f"""WITH {B}
SELECT series_id, period, {sg('residual', 7)} AS residual, 'd_items' AS predictor, {sg('d_items', 7)} AS x FROM fitb
UNION ALL SELECT series_id, period, {sg('residual', 7)}, 'd_disc', {sg('d_disc', 7)} FROM fitb
UNION ALL SELECT series_id, period, {sg('residual', 7)}, 'd_tax', {sg('d_tax', 7)} FROM fitb""",
    "forecast_scenarios": f"""WITH {B},
scen AS (SELECT * FROM (VALUES ('up', 1.0, 0.5, 0.0), ('down', -1.0, -0.5, 0.0))
         AS s(scenario, x1, x2, x3)),
fut AS (
  SELECT cf2.*, sgb.sigma, CAST(hh AS INTEGER) AS h,
         CAST(last + to_months(CAST(hh AS INTEGER)) AS DATE) AS period
  FROM cf2 JOIN sgb USING (series_id), (SELECT unnest(generate_series(1, 4)) AS hh)),
fs AS (
  SELECT fut.series_id, scen.scenario, fut.h, fut.period,
    b0 + b1 * x1 + b2 * x2 + b3 * x3 AS point,
    sigma * sqrt(1 + 1.0 / n + {_quad('x1', 'x2', 'x3')}) AS se
  FROM fut, scen)
SELECT series_id, scenario, h, period, {sg('point', 7)} AS point, {sg('se', 7)} AS se FROM fs""",
    "spurious_check": f"""WITH {MODEL_C}
SELECT creg.series_id, {sg('r2', 7)} AS r2, CAST(n AS BIGINT) AS n,
  {sg('resid_acf1', 7)} AS resid_acf1,
  (r2 > 0.5 AND resid_acf1 > 2 / sqrt(CAST(n AS DOUBLE))) AS spurious
FROM creg JOIN cacf USING (series_id)""",
    "hash_split": f"""SELECT o_orderkey, CASE WHEN {BUCKET} < 80 THEN 'train' ELSE 'test' END AS split
FROM orders""",
    "screen_topk": f"""WITH q AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, o_orderpriority, o_totalprice, qty, {BUCKET} AS b
      FROM orders JOIN q ON o_orderkey = l_orderkey),
m AS (SELECT regr_slope(o_totalprice, qty) AS sl, regr_intercept(o_totalprice, qty) AS ic
      FROM d WHERE b < 80),
s AS (SELECT d.*, ic + sl * qty AS score FROM d, m WHERE b >= 80),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score DESC, o_orderkey) AS rnk FROM s)
SELECT o_orderpriority, CAST(rnk AS INTEGER) AS rank, o_orderkey, qty, {sg('score')} AS score
FROM r WHERE rnk <= 10""",
}


def _subsets_sql() -> str:
    """Every subset of model B's predictors in closed form: centred normal
    equations with the explicit 1x1 / 2x2 / 3x3 inverse, leverage
    1/n + (x - m)' A^-1 (x - m) for the leave-one-out CV."""
    from itertools import combinations
    names = ["d_items", "d_disc", "d_tax"]
    means = ["m1", "m2", "m3"]

    def a(j, k):
        j, k = sorted((j, k))
        return f"cb.a{j + 1}{k + 1}"

    def inv_entries(S):
        if len(S) == 1:
            (j,) = S
            return {(j, j): f"(1.0 / {a(j, j)})"}
        if len(S) == 2:
            j, k = S
            det = f"({a(j, j)} * {a(k, k)} - {a(j, k)} * {a(j, k)})"
            return {(j, j): f"({a(k, k)} / {det})", (k, k): f"({a(j, j)} / {det})",
                    (j, k): f"(-{a(j, k)} / {det})", (k, j): f"(-{a(j, k)} / {det})"}
        if len(S) == 3:
            return {(j, k): f"iv.i{min(j, k) + 1}{max(j, k) + 1}" for j in S for k in S}
        return {}

    ctes, refs = [], []
    for r in range(4):
        for S in combinations(range(3), r):
            label = "+".join(names[i] for i in S) or "(none)"
            inv = inv_entries(S)
            u = {j: f"(bc.{names[j]} - mb.{means[j]})" for j in S}
            b = {j: "(" + " + ".join(f"{inv[(j, k)]} * cb.c{k + 1}" for k in S) + ")" for j in S}
            fit = " + ".join(f"{b[j]} * {u[j]}" for j in S) or "0.0"
            quad = " + ".join(f"{u[j]} * {u[k]} * {inv[(j, k)]}" for j in S for k in S) or "0.0"
            name = f"sub{len(ctes)}"
            mask = sum(1 << j for j in S)
            ctes.append(f"""{name} AS (
  SELECT bc.series_id, '{label}' AS model, {mask} AS mask, {r + 1} AS rnk,
         bc.d_price - mb.my AS dy,
         (bc.d_price - mb.my) - ({fit}) AS e, 1.0 / mb.n + ({quad}) AS h
  FROM bc JOIN mb USING (series_id) JOIN cb USING (series_id) JOIN iv USING (series_id))""")
            refs.append(f"SELECT * FROM {name}")
    union = "\n  UNION ALL ".join(refs)
    return ",\n".join(ctes) + f""",
subs AS ({union}),
sg AS (
  SELECT series_id, model, mask, count(*) AS n, max(rnk) AS rnk, sum(e * e) AS sse,
         sum(dy * dy) AS sst, avg(pow(e / (1 - h), 2)) AS cv
  FROM subs GROUP BY series_id, model, mask),
sc AS (
  SELECT *, n * ln(sse / n) + 2 * (rnk + 1) AS aic,
    CASE WHEN n - rnk - 2 > 0 THEN n * ln(sse / n) + 2 * (rnk + 1)
         + 2.0 * (rnk + 1) * (rnk + 2) / (n - rnk - 2) END AS aicc,
    n * ln(sse / n) + (rnk + 1) * ln(n) AS bic,
    1 - (sse / sst) * (n - 1) / (n - rnk) AS adj_r2
  FROM sg)"""


ORACLE["all_subsets"] = f"""WITH {B},
{_subsets_sql()}
SELECT series_id, model, CAST(n AS BIGINT) AS n, CAST(rnk - 1 AS INTEGER) AS k,
  {sg('adj_r2', 7)} AS adj_r2, {sg('cv', 7)} AS cv, {sg('aic', 7)} AS aic,
  {sg('aicc', 7)} AS aicc, {sg('bic', 7)} AS bic,
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY aicc NULLS LAST, model) AS INTEGER)
    AS rank_aicc
FROM sc"""


def _stepwise_sql(direction: str) -> str:
    """Greedy AICc path over the subset table, unrolled for 3 predictors:
    each step moves to the best neighbour (one predictor fewer / more; ties
    by predictor position) and only while AICc strictly improves."""
    names = ["d_items", "d_disc", "d_tax"]
    start = 7 if direction == "backward" else 0
    if direction == "backward":
        nb = "(c.mask & p.mask) = c.mask AND bit_count(c.mask) = bit_count(p.mask) - 1"
        bit = "(p.mask - c.mask)"
    else:
        nb = "(c.mask & p.mask) = p.mask AND bit_count(c.mask) = bit_count(p.mask) + 1"
        bit = "(c.mask - p.mask)"
    changed = "CASE " + " ".join(f"WHEN {bit} = {1 << i} THEN '{n}'" for i, n in enumerate(names)) + " END"
    steps = [f"""st0 AS (SELECT series_id, 0 AS step, CAST(NULL AS VARCHAR) AS changed, model, mask, aicc
            FROM sc WHERE mask = {start})"""]
    for k in range(1, 4):
        steps.append(f"""st{k} AS (
  SELECT * FROM (
    SELECT p.series_id, {k} AS step, {changed} AS changed, c.model, c.mask, c.aicc AS aicc,
           p.aicc AS prev,
           row_number() OVER (PARTITION BY p.series_id ORDER BY c.aicc, {bit}) AS pick
    FROM st{k - 1} p JOIN sc c ON c.series_id = p.series_id AND {nb})
  WHERE pick = 1 AND aicc < prev)""")
    union = " UNION ALL ".join(
        f"SELECT series_id, step, changed, model, aicc FROM st{k}" for k in range(4))
    return ",\n".join(steps) + f",\npath AS ({union})"


for _dir, _name in (("backward", "stepwise"), ("forward", "stepwise_forward")):
    ORACLE[_name] = f"""WITH {B},
{_subsets_sql()},
{_stepwise_sql(_dir)}
SELECT series_id, CAST(step AS INTEGER) AS step, changed, model, {sg('aicc', 7)} AS aicc
FROM path"""


def _t_pvalue_sql(src: str, tcol: str, dfcol: str, idcols: list[str]) -> str:
    """Two-sided Student-t p-value P(|T_df| > |t|) = I_x(df/2, 1/2),
    x = df / (df + t^2), by the power series of the regularized incomplete
    beta: I_x(a,b) = x^a (1-x)^b / (a B(a,b)) * sum_n c_n with
    c_0 = 1, c_{n+1} = c_n (a+b+n)/(a+1+n) x.  When x is large the symmetric
    form 1 - I_{1-x}(b, a) is summed instead (fast convergence, and small
    p-values keep their relative accuracy)."""
    ids = ", ".join(idcols)
    return f"""
tp_in AS (
  SELECT {ids}, {dfcol} / ({dfcol} + {tcol} * {tcol}) AS x0, {dfcol} / 2.0 AS a0, 0.5 AS b0
  FROM {src}),
tp_par AS (
  SELECT {ids}, x0 > (a0 + 1) / (a0 + b0 + 2) AS swap,
         CASE WHEN x0 > (a0 + 1) / (a0 + b0 + 2) THEN 1 - x0 ELSE x0 END AS xx,
         CASE WHEN x0 > (a0 + 1) / (a0 + b0 + 2) THEN b0 ELSE a0 END AS aa,
         CASE WHEN x0 > (a0 + 1) / (a0 + b0 + 2) THEN a0 ELSE b0 END AS bb
  FROM tp_in),
tp_terms AS (
  SELECT {ids}, swap, xx, aa, bb, g.n,
         sum(CASE WHEN g.n = 0 THEN 0.0
                  ELSE ln((aa + bb + g.n - 1) / (aa + g.n)) + ln(xx) END)
           OVER (PARTITION BY {ids} ORDER BY g.n) AS lc
  FROM tp_par, generate_series(0, 600) AS g(n)),
tp AS (
  SELECT {ids},
    CASE WHEN any_value(swap)
         THEN 1 - exp(any_value(aa) * ln(any_value(xx)) + any_value(bb) * ln(1 - any_value(xx))
                      - ln(any_value(aa)) - (lgamma(any_value(aa)) + lgamma(any_value(bb))
                      - lgamma(any_value(aa) + any_value(bb)))) * sum(exp(lc))
         ELSE exp(any_value(aa) * ln(any_value(xx)) + any_value(bb) * ln(1 - any_value(xx))
                  - ln(any_value(aa)) - (lgamma(any_value(aa)) + lgamma(any_value(bb))
                  - lgamma(any_value(aa) + any_value(bb)))) * sum(exp(lc)) END AS p_value
  FROM tp_terms GROUP BY {ids})"""


ORACLE["coef_pvalues"] = f"""WITH {COEF_A},
ct AS (
  SELECT coef.series_id, coef.term, coef.estimate, coef.std_error,
         coef.estimate / coef.std_error AS t_value, CAST(crit.df_resid AS DOUBLE) AS dfr,
         CAST(crit.df_resid AS INTEGER) AS df_resid
  FROM coef JOIN crit USING (series_id)),
{_t_pvalue_sql('ct', 't_value', 'dfr', ['series_id', 'term'])}
SELECT ct.series_id, ct.term, {sg('estimate', 6)} AS estimate, {sg('std_error', 6)} AS std_error,
  {sg('t_value', 6)} AS t_value, ct.df_resid, {sg('tp.p_value', 6)} AS p_value
FROM ct JOIN tp USING (series_id, term)"""


def _t_quantile_sql(src: str, steps: int = 6) -> str:
    """Upper Student-t quantiles q with P(T <= q) = lvl for every (dfr, lvl)
    row of ``src``, without recursion: a Cornish-Fisher start refined by
    ``steps`` Newton steps unrolled as CTEs.  The two-sided tail
    I_x(df/2, 1/2) is the incomplete-beta power series (terms via lgamma),
    its derivative -2 * pdf(t)."""
    parts = [f"""tq0 AS (
  SELECT dfr, lvl,
    z + (z*z*z + z) / (4*dfr) + (5*pow(z,5) + 16*z*z*z + 3*z) / (96*dfr*dfr)
      + (3*pow(z,7) + 19*pow(z,5) + 17*z*z*z - 15*z) / (384*dfr*dfr*dfr) AS t
  FROM {src})"""]
    for k in range(1, steps + 1):
        parts.append(f"""tq{k}_p AS (
  SELECT dfr, lvl, t, x0 > (a0 + 1) / (a0 + 2.5) AS swap,
         CASE WHEN x0 > (a0 + 1) / (a0 + 2.5) THEN 1 - x0 ELSE x0 END AS xx,
         CASE WHEN x0 > (a0 + 1) / (a0 + 2.5) THEN 0.5 ELSE a0 END AS aa,
         CASE WHEN x0 > (a0 + 1) / (a0 + 2.5) THEN a0 ELSE 0.5 END AS bb
  FROM (SELECT dfr, lvl, t, dfr / (dfr + t * t) AS x0, dfr / 2.0 AS a0 FROM tq{k - 1})),
tq{k}_s AS (
  SELECT dfr, lvl, t, swap, xx, aa, bb,
         sum(exp(lgamma(aa + bb + g.n) - lgamma(aa + bb) + lgamma(aa + 1) - lgamma(aa + 1 + g.n)
                 + g.n * ln(xx))) AS s
  FROM tq{k}_p, range(0, 600) AS g(n) GROUP BY ALL),
tq{k} AS (
  SELECT dfr, lvl,
    t + ((CASE WHEN swap THEN 1 - pre * s ELSE pre * s END) - 2 * (1 - lvl))
        / (2 * exp(lgamma((dfr + 1) / 2) - lgamma(dfr / 2) - 0.5 * ln(dfr * pi())
                   - (dfr + 1) / 2 * ln(1 + t * t / dfr))) AS t
  FROM (SELECT *, exp(aa * ln(xx) + bb * ln(1 - xx) - ln(aa)
                      - (lgamma(aa) + lgamma(bb) - lgamma(aa + bb))) AS pre FROM tq{k}_s))""")
    return ",\n".join(parts) + f",\ntq AS (SELECT dfr, lvl, t AS q FROM tq{steps})"


# --- fixed values: standard normal quantiles for the Cornish-Fisher start ---
Z_START = {0.9: 1.2815515655446004, 0.975: 1.959963984540054}

ORACLE["forecast_intervals"] = f"""WITH {A}, {_future_a()},
lv AS (
  SELECT DISTINCT CAST(crit.df_resid AS DOUBLE) AS dfr, z.lvl, z.z
  FROM crit, (VALUES {", ".join(f"(CAST({k} AS DOUBLE), CAST({v!r} AS DOUBLE))"
                                for k, v in Z_START.items())}) AS z(lvl, z)),
{_t_quantile_sql('lv')},
fi AS (
  SELECT fc.series_id, fc.h, fc.period, fc.point, fc.se,
         fc.point - q80.q * fc.se AS lo80, fc.point + q80.q * fc.se AS hi80,
         fc.point - q95.q * fc.se AS lo95, fc.point + q95.q * fc.se AS hi95
  FROM fc JOIN crit USING (series_id)
  JOIN tq q80 ON q80.dfr = CAST(crit.df_resid AS DOUBLE) AND q80.lvl = CAST(0.9 AS DOUBLE)
  JOIN tq q95 ON q95.dfr = CAST(crit.df_resid AS DOUBLE) AND q95.lvl = CAST(0.975 AS DOUBLE))
SELECT series_id, h, period, {sg('point', 7)} AS point, {sg('se', 7)} AS se,
  {sg('lo80', 7)} AS lo80, {sg('hi80', 7)} AS hi80, {sg('lo95', 7)} AS lo95, {sg('hi95', 7)} AS hi95
FROM fi"""


def _bg_sql(order: int) -> str:
    """Breusch-Godfrey LM for model A without a general solver.

    Residuals e are orthogonal to X (intercept, trend, seasons), so by
    Frisch-Waugh the auxiliary R^2 is v' G^-1 v / e'e with v_j = sum e_t
    e_{t-j} (missing lags = 0) and G = L' M_X L, where M_X L are the lag
    columns with trend and season removed (within-season demeaning).  G is
    solved by an unrolled Cholesky factorisation; for even order the
    chi-square tail is exp(-x/2) * sum_{i < order/2} (x/2)^i / i!."""
    ks = range(1, order + 1)
    lag_cols = ", ".join(f"coalesce(l{j}.residual, 0.0) AS L{j}" for j in ks)
    lag_joins = "\n  ".join(
        f"LEFT JOIN fit l{j} ON l{j}.series_id = f.series_id AND l{j}.t = f.t - {j}" for j in ks)
    means = ", ".join(f"avg(L{j}) AS mL{j}" for j in ks)
    slopes = ", ".join(f"sum((lg.t - sm.tbar) * (L{j} - mL{j})) / any_value(bb.stt) AS b{j}" for j in ks)
    resid = ", ".join(f"L{j} - mL{j} - b{j} * (lg.t - sm.tbar) AS r{j}" for j in ks)
    gsum = ", ".join([f"sum(e * r{j}) AS v{j}" for j in ks]
                     + [f"sum(r{j} * r{k}) AS g{j}{k}" for j in ks for k in ks if k >= j])
    g = lambda j, k: f"g{min(j, k)}{max(j, k)}"
    layers, cols = [], []
    # Cholesky, one CTE layer per column of L
    prev = "bgs"
    for j in ks:
        exprs = []
        diag = " - ".join([g(j, j)] + [f"l{j}{m} * l{j}{m}" for m in range(1, j)])
        exprs.append(f"sqrt({diag}) AS l{j}{j}")
        layers.append(f"ch{j}a AS (SELECT *, {', '.join(exprs)} FROM {prev})")
        below = []
        for i in range(j + 1, order + 1):
            num = " - ".join([g(i, j)] + [f"l{i}{m} * l{j}{m}" for m in range(1, j)])
            below.append(f"({num}) / l{j}{j} AS l{i}{j}")
        layers.append(f"ch{j} AS (SELECT *{', ' if below else ''}{', '.join(below)} FROM ch{j}a)")
        prev = f"ch{j}"
    for i in ks:
        num = " - ".join([f"v{i}"] + [f"l{i}{m} * w{m}" for m in range(1, i)])
        layers.append(f"fw{i} AS (SELECT *, ({num}) / l{i}{i} AS w{i} FROM {prev})")
        prev = f"fw{i}"
    quad = " + ".join(f"w{i} * w{i}" for i in ks)
    tail = " + ".join(f"pow(lm / 2, {i}) / {math.factorial(i)}" for i in range(order // 2))
    return f"""
lg AS (
  SELECT f.series_id, f.t, f.season, f.residual AS e, {lag_cols}
  FROM fit f
  {lag_joins}),
lgm AS (SELECT series_id, season, {means} FROM lg GROUP BY series_id, season),
lgb AS (
  SELECT lg.series_id, {slopes}
  FROM lg JOIN lgm USING (series_id, season) JOIN sm USING (series_id, season)
  JOIN bb USING (series_id) GROUP BY lg.series_id),
lgr AS (
  SELECT lg.series_id, lg.e, {resid}
  FROM lg JOIN lgm USING (series_id, season) JOIN sm USING (series_id, season)
  JOIN lgb USING (series_id)),
bgs AS (SELECT series_id, count(*) AS n, sum(e * e) AS ee, {gsum} FROM lgr GROUP BY series_id),
{",".join(chr(10) + x for x in layers)},
bgq AS (SELECT series_id, n, n * ({quad}) / ee AS lm FROM {prev}),
bgp AS (SELECT *, exp(-lm / 2) * ({tail}) AS p_value FROM bgq)"""


ORACLE["breusch_godfrey"] = f"""WITH {A}, {_bg_sql(4)}
SELECT series_id, CAST(n AS BIGINT) AS n, CAST(4 AS INTEGER) AS "order",
  {sg('lm', 7)} AS lm, {sg('p_value', 7)} AS p_value
FROM bgp"""


LEVELS_SQL = ", ".join(f"(CAST({k} AS DOUBLE), CAST({v!r} AS DOUBLE))" for k, v in Z_START.items())

ORACLE["forecast_scenario_limits"] = f"""WITH {B},
scen AS (SELECT * FROM (VALUES ('up', 1.0, 0.5, 0.0), ('down', -1.0, -0.5, 0.0)) AS s(scenario, x1, x2, x3)),
lv AS (SELECT DISTINCT CAST(n - 4 AS DOUBLE) AS dfr, z.lvl, z.z FROM cf2, (VALUES {LEVELS_SQL}) AS z(lvl, z)),
{_t_quantile_sql('lv')},
fs AS (
  SELECT cf2.series_id, scenario, CAST(hh AS INTEGER) AS h, CAST(n - 4 AS DOUBLE) AS dfr,
    CAST(last + to_months(CAST(hh AS INTEGER)) AS DATE) AS period, b0 + b1 * x1 + b2 * x2 + b3 * x3 AS point,
    sigma * sqrt(1 + 1.0 / n + {_quad('x1', 'x2', 'x3')}) AS se
  FROM cf2 JOIN sgb USING (series_id), scen, (SELECT unnest(generate_series(1, 4)) AS hh))
SELECT series_id, scenario, h, period, {sg('point - a.q * se', 7)} AS lo80, {sg('point + a.q * se', 7)} AS hi80,
  {sg('point - b.q * se', 7)} AS lo95, {sg('point + b.q * se', 7)} AS hi95
FROM fs JOIN tq a ON a.dfr = fs.dfr AND a.lvl = CAST(0.9 AS DOUBLE)
JOIN tq b ON b.dfr = fs.dfr AND b.lvl = CAST(0.975 AS DOUBLE)"""

ORACLE["forecast_expost_realised"] = f"""WITH {MULTI},{_model_b(end='2000-04-01')},
ep AS (
  SELECT b.series_id, b.period, d_price AS actual, b0 + b1 * d_items + b2 * d_disc + b3 * d_tax AS point
  FROM b JOIN cf2 USING (series_id) WHERE b.period > DATE '2000-04-01')
SELECT series_id, period, {sg('actual', 6)} AS actual, {sg('point', 6)} AS point, {sg('actual - point', 6)} AS error
FROM ep"""

ORACLE["transform_limits"] = f"""WITH {QWIN},
sq AS (SELECT *, sqrt(y) AS sqrt_y FROM qw), {_model_a(target='sqrt_y', src='sq')}, {_future_a()},
lv AS (SELECT DISTINCT CAST(df_resid AS DOUBLE) AS dfr, z.lvl, z.z FROM crit, (VALUES {LEVELS_SQL}) AS z(lvl, z)),
{_t_quantile_sql('lv')},
li AS (
  SELECT fc.*, point - q * se AS lo, point + q * se AS hi
  FROM fc JOIN crit USING (series_id) JOIN tq ON dfr = CAST(df_resid AS DOUBLE) AND lvl = CAST(0.975 AS DOUBLE))
SELECT series_id, h, period, {sg('point * point', 7)} AS point,
  {sg('greatest(lo, 0.0) * greatest(lo, 0.0)', 7)} AS lo95, {sg('greatest(hi, 0.0) * greatest(hi, 0.0)', 7)} AS hi95
FROM li"""

ORACLE["resid_bundle"] = f"""WITH {A}, {_bg_sql(4)},
em AS (SELECT series_id, avg(residual) AS m, sum(residual * residual) AS ss, min(residual) AS lo, max(residual) AS hi
       FROM fit GROUP BY 1),
dv AS (SELECT series_id, t, residual, residual - m AS e FROM fit JOIN em USING (series_id)),
ks AS (SELECT unnest(generate_series(1, 8)) AS k),
ac AS (
  SELECT a.series_id, k, sum(a.e * coalesce(p.e, 0.0)) / (SELECT sum(x.e * x.e) FROM dv x WHERE x.series_id = a.series_id) AS r
  FROM dv a, ks LEFT JOIN dv p ON p.series_id = a.series_id AND p.t = a.t - k GROUP BY a.series_id, k),
gr AS (SELECT series_id, lo, hi, unnest(generate_series(1, 10)) AS bin FROM em),
hs AS (
  SELECT gr.series_id, bin, count(d.t) AS n FROM gr LEFT JOIN dv d ON d.series_id = gr.series_id
   AND least(floor((d.residual - lo) / ((hi - lo) / 10)) + 1, 10) = bin GROUP BY gr.series_id, bin)
SELECT series_id, 'acf' AS part, CAST(k AS INTEGER) AS idx, {sg('r', 7)} AS value FROM ac
UNION ALL SELECT series_id, 'hist', CAST(bin AS INTEGER), {sg('CAST(n AS DOUBLE)', 7)} FROM hs
UNION ALL SELECT series_id, 'bg', CAST(0 AS INTEGER), {sg('lm', 7)} FROM bgp
UNION ALL SELECT series_id, 'bg', CAST(1 AS INTEGER), {sg('p_value', 7)} FROM bgp"""

ORACLE["best_subsets"] = f"""SELECT series_id, model, k, aicc, rank_aicc FROM ({ORACLE["all_subsets"]}) WHERE rank_aicc <= 4"""

# the same polynomial through orthogonal columns about 1998, moved to the raw powers in closed form
ORACLE["ols_polynomial"] = f"""WITH {MONTHLY},
d AS (SELECT series_id, y, year(period) + (month(period) - 1) / 12.0 - 1998 AS s FROM ms WHERE y IS NOT NULL),
m AS (SELECT series_id, count(*) AS n, avg(s) AS m1, avg(s * s) AS m2, avg(s * s * s) AS m3, avg(y) AS my FROM d GROUP BY 1),
q1 AS (SELECT d.*, n, m1, m2, m3, my, s - m1 AS q1, s * s - m2 AS r2, s * s * s - m3 AS r3 FROM d JOIN m USING (series_id)),
c1 AS (SELECT series_id, sum(q1 * r2) / sum(q1 * q1) AS b, sum(q1 * r3) / sum(q1 * q1) AS dd FROM q1 GROUP BY 1),
q2 AS (SELECT q1.*, b, dd, r2 - b * q1 AS q2 FROM q1 JOIN c1 USING (series_id)),
c2 AS (SELECT series_id, sum(q2 * r3) / sum(q2 * q2) AS ee FROM q2 GROUP BY 1),
q3 AS (SELECT q2.*, ee, r3 - dd * q1 - ee * q2 AS q3 FROM q2 JOIN c2 USING (series_id)),
th AS (
  SELECT series_id, any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, any_value(my) AS my,
    any_value(b) AS b, any_value(dd) AS dd, any_value(ee) AS ee,
    sum(q1 * (y - my)) / sum(q1 * q1) AS t1, sum(q2 * (y - my)) / sum(q2 * q2) AS t2, sum(q3 * (y - my)) / sum(q3 * q3) AS t3,
    sum((y - my) * (y - my)) AS sst FROM q3 GROUP BY 1),
sse AS (
  SELECT series_id, sum((q3.y - q3.my - t1 * q1 - t2 * q2 - t3 * q3) ** 2) AS sse FROM q3 JOIN th USING (series_id) GROUP BY 1),
cs AS (
  SELECT *, t3 AS c3, t2 - t3 * ee AS c2, t1 - t2 * b + t3 * (ee * b - dd) AS c1,
    my - t1 * m1 + t2 * (b * m1 - m2) + t3 * (dd * m1 - m3 + ee * m2 - ee * b * m1) AS c0
  FROM th JOIN sse USING (series_id)),
raw AS (
  SELECT *, c3 AS b3, c2 - 3 * c3 * 1998 AS b2, c1 - 2 * c2 * 1998 + 3 * c3 * 1998.0 * 1998 AS b1,
    c0 - c1 * 1998 + c2 * 1998.0 * 1998 - c3 * 1998.0 * 1998 * 1998 AS b0 FROM cs)
SELECT series_id, n, CAST(3 AS INTEGER) AS k, {sg('1 - sse / sst', 4)} AS r2, {sg('sqrt(sse / (n - 4))', 4)} AS sigma,
  {sg('b0', 3)} AS b0, {sg('b1', 3)} AS b1, {sg('b2', 3)} AS b2, {sg('b3', 3)} AS b3
FROM raw"""
