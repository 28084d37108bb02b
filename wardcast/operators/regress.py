"""Least squares for many series at once.

Plan per fit:
1. Gram pass - one ``groupBy(keys)`` with means and centred co-moments
   (``avg``, ``covar_pop``, ``var_pop``: mergeable and free of the
   cancellation that raw sums of x_i x_j suffer when a mean is large against
   the spread).  Partial aggregation makes the shuffle one row per key per
   task, so a hot series costs no more than a cold one; the size is O(p^2)
   per key and independent of the number of observations.
2. Solve - ``mapInPandas`` over the Gram rows only (one row per series, no
   shuffle), all series of a batch at once: the centred system is scaled to
   correlations and inverted; only series with collinear terms go through
   the pivoted elimination that flags aliased terms as NULL like R's ``lm``.
   SSE, sigma, R^2 and the information criteria come from this row.
3. Residual pass - only where observations are asked for (fitted values,
   residuals, leverages, leave-one-out CV): the coefficient rows are joined
   back on the keys, by broadcast while they are few, else over salted keys,
   so that one long series is spread over many tasks either way.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.functions.stats import t_pvalue_udf
from wardcast.session import ship_package, stage_table

INTERCEPT = "(Intercept)"
ALIAS_TOL = 1e-9      # a term is aliased below this share of its centred sum of squares
CONST_TOL = 1e-24     # a column is constant below this share of its raw sum of squares
BROADCAST_KEYS = 200_000   # coefficient rows that may be broadcast after counting them
BROADCAST_BYTES = 32 << 20   # and their size in files
KEY_SALT = 32         # parts a key is split into beyond that


def _design_sql(xcols: list[str], intercept: bool) -> list[str]:
    """Design-matrix columns, centred by the ``mid`` array of the key."""
    cols = ["1.0D"] if intercept else []
    at = len(cols)
    return cols + [f"(CAST(`{c}` AS DOUBLE) - mid[{at + i}])" for i, c in enumerate(xcols)]


def _dot_sql(xs: list[str], arr: str = "betac") -> str:
    """x' b with aliased (NULL) coefficients contributing 0."""
    xv = f"array({', '.join(xs)})"
    return f"aggregate(zip_with({xv}, {arr}, (xq, bq) -> xq * coalesce(bq, 0D)), 0D, (sq, vq) -> sq + vq)"


def _quad_sql(xs: list[str], arr: str = "invc") -> str:
    """x' A x for a row-major p*p array column A, by array functions over the
    rows of A: the expression size stays linear in p."""
    p = len(xs)
    xv = f"array({', '.join(xs)})"
    row_dot = (f"aggregate(zip_with(slice({arr}, ri * {p} + 1, {p}), {xv}, (aq, xq) -> aq * xq), "
               f"0D, (sq, vq) -> sq + vq)")
    ax = f"transform(sequence(0, {p - 1}), ri -> {row_dot})"
    return f"aggregate(zip_with({xv}, {ax}, (xo, yo) -> xo * yo), 0D, (so, vo) -> so + vo)"


def _bytes(staged: DataFrame) -> int:
    """Size of a staged table by its files, as the optimizer knows it."""
    return int(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def attach(obs: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Join staged rows per key to many observations.  Rows that are few and
    small are broadcast; others are joined over salted keys, so a key with a large share
    of the observations does not end in one task, and an aggregate by key
    that follows is partial."""
    if not keys:
        return obs.crossJoin(F.broadcast(rows))   # one row
    if rows.count() <= BROADCAST_KEYS and _bytes(rows) <= BROADCAST_BYTES:
        return obs.join(F.broadcast(rows), keys)
    part = F.pmod(F.xxhash64(*obs.columns), F.lit(KEY_SALT)).cast("int").alias("_part")
    many = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(KEY_SALT - 1))).alias("_part"))
    return obs.select("*", part).join(many, [*keys, "_part"]).drop("_part")


RESERVED = {"n", "k", "rank", "ymean", "syy", "sxx", "sxy", "mid", "beta", "betac", "inv", "invc", "sse",
            "sst", "cv", "r2", "adj_r2", "sigma", "aic", "aicc", "bic", "df_resid",
            "sum_resid", "fitted", "residual", "hat", "term", "estimate", "std_error",
            "t_value", "p_value", "model", "rank_aicc", "step", "changed", "point", "se"}


def check_keys(keys: list[str], reserved=RESERVED) -> None:
    """Key columns must not collide with output column names."""
    bad = sorted(set(keys) & set(reserved))
    if bad:
        raise ValueError(f"key column(s) {bad} collide with output columns; rename them")


def complete_cases(df: DataFrame, y: str, xcols: list[str]) -> DataFrame:
    cond = F.col(y).isNotNull()
    for c in xcols:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def gram(df: DataFrame, keys: list[str], y: str, xcols: list[str],
         intercept: bool = True) -> DataFrame:
    """Per key: n, ymean, mid (means of the predictors), and the centred
    sums of squares and products sxx (row-major), sxy, syy.  Without an
    intercept mid is 0 and the sums are raw."""
    check_keys(keys)
    X = [f"CAST(`{c}` AS DOUBLE)" for c in xcols]
    d = complete_cases(df, y, xcols)
    yy = f"CAST(`{y}` AS DOUBLE)"

    def cross(u, v):
        if not intercept:
            return f"sum({u} * {v})"
        return f"var_pop({u}) * count(*)" if u == v else f"covar_pop({u}, {v}) * count(*)"

    p = len(X)
    aggs = ["count(*) AS n", f"avg({yy}) AS ymean", f"var_pop({yy}) * count(*) AS syy",
            f"sum({yy} * {yy}) AS yty"]
    name = {}
    for i in range(p):
        aggs += [f"avg({X[i]}) AS _m{i}", f"{cross(X[i], yy)} AS _xy{i}"]
        for j in range(i, p):
            aggs.append(f"{cross(X[i], X[j])} AS _xx{i}_{j}")
            name[(i, j)] = name[(j, i)] = f"_xx{i}_{j}"
    g = d.groupBy(*keys).agg(*[F.expr(a) for a in aggs])

    def arr(items):
        return f"array({', '.join(items)})" if items else "CAST(array() AS array<double>)"

    mids = arr([f"_m{i}" if intercept else "0D" for i in range(p)])
    return g.selectExpr(*[f"`{k}`" for k in keys], "n", "ymean", "syy", "yty", f"{mids} AS mid",
                        f"{arr([name[(i, j)] for i in range(p) for j in range(p)])} AS sxx",
                        f"{arr([f'_xy{i}' for i in range(p)])} AS sxy")


def _pivoted(S: np.ndarray, cand) -> list[int]:
    """Columns kept in order; one that the kept ones explain is aliased."""
    sel: list[int] = []
    for j in cand:
        if not np.isfinite(S[j, j]) or S[j, j] <= 0:
            continue
        left = S[j, j]
        if sel:
            c = S[sel, j]
            left -= c @ np.linalg.solve(S[np.ix_(sel, sel)], c)
        if left > ALIAS_TOL * S[j, j]:
            sel.append(j)
    return sel


def solve_batch(n, mid, sxx, sxy, subset=None):
    """Slopes (NaN where aliased), inverse of the kept block (0 elsewhere)
    and number of kept columns, for a stack of centred systems."""
    m, p = sxy.shape
    cand = list(range(p)) if subset is None else list(subset)
    beta, inv, rank = np.full((m, p), np.nan), np.zeros((m, p, p)), np.zeros(m, dtype=int)
    if not cand or not m:
        return beta, inv, rank
    diag = np.einsum("mii->mi", sxx).copy()
    diag[diag <= CONST_TOL * (diag + n[:, None] * mid ** 2)] = 0.0
    scale = np.sqrt(np.where(diag > 0, diag, 1.0))
    R = sxx / scale[:, :, None] / scale[:, None, :]
    R[np.broadcast_to((diag <= 0)[:, :, None], R.shape)] = 0.0
    R = np.where((diag <= 0)[:, None, :], 0.0, R)
    ix = np.ix_(range(m), cand, cand)
    sub = R[ix]
    ok = np.isfinite(sub).all(axis=(1, 2))
    ok[ok] = np.linalg.eigvalsh(sub[ok])[:, 0] > 1e-7
    full = np.flatnonzero(ok)
    if len(full):
        Ri = np.linalg.inv(sub[full])
        scaled = Ri / scale[full][:, cand][:, :, None] / scale[full][:, cand][:, None, :]
        inv[np.ix_(full, cand, cand)] = scaled
        beta[np.ix_(full, cand)] = np.einsum("mij,mj->mi", scaled, sxy[full][:, cand])
        rank[full] = len(cand)
    for r in np.flatnonzero(~ok):
        sel = _pivoted(np.nan_to_num(R[r]), cand)
        rank[r] = len(sel)
        if sel:
            Ai = np.linalg.inv(R[r][np.ix_(sel, sel)]) / np.outer(scale[r][sel], scale[r][sel])
            inv[r][np.ix_(sel, sel)] = Ai
            beta[r, sel] = Ai @ sxy[r, sel]
    return beta, inv, rank


def _stacks(pdf: pd.DataFrame):
    """n, ymean, total, mid, sxx, sxy of a batch of Gram rows as arrays."""
    p = len(pdf["sxy"].iloc[0])
    sxy = np.array([np.asarray(v, float) for v in pdf["sxy"]]).reshape(len(pdf), p)
    sxx = np.array([np.asarray(v, float) for v in pdf["sxx"]]).reshape(len(pdf), p, p)
    mid = np.array([np.asarray(v, float) for v in pdf["mid"]]).reshape(len(pdf), p)
    return pdf["n"].to_numpy(float), mid, sxx, sxy


def _sse(total, beta, sxx, sxy):
    b = np.nan_to_num(beta)
    return np.maximum(total - 2 * np.einsum("mi,mi->m", b, sxy) + np.einsum("mi,mij,mj->m", b, sxx, b), 0.0)


def _coef_rows(pdf: pd.DataFrame, keys: list[str], intercept: bool, subset=None) -> pd.DataFrame:
    """Coefficient rows of a batch of Gram rows."""
    n, mid, sxx, sxy = _stacks(pdf)
    beta, inv, rank = solve_batch(n, mid, sxx, sxy, subset)
    total = pdf["syy"].to_numpy(float) if intercept else pdf["yty"].to_numpy(float)
    return coefficient_frame(pdf, keys, n, mid, beta, inv, rank, pdf["ymean"].to_numpy(float),
                             pdf["syy"].to_numpy(float), _sse(total, beta, sxx, sxy), intercept)


def coefficient_frame(pdf, keys, n, mid, beta, inv, rank, ymean, syy, sse, intercept) -> pd.DataFrame:
    """betac/invc for the centred design, beta and inv for the original one."""
    out = pdf[keys].copy() if keys else pd.DataFrame(index=pdf.index)
    out["n"], out["rank"] = pdf["n"].to_numpy(), rank + int(intercept)
    out["ymean"], out["syy"], out["sse"] = ymean, syy, sse
    if intercept:
        m, p = beta.shape
        b0 = ymean - np.einsum("mi,mi->m", np.nan_to_num(beta), mid)
        cross = -np.einsum("mij,mj->mi", inv, mid)
        corner = 1.0 / n - np.einsum("mi,mi->m", cross, mid)
        invf, invc = np.zeros((m, p + 1, p + 1)), np.zeros((m, p + 1, p + 1))
        invf[:, 1:, 1:] = invc[:, 1:, 1:] = inv
        invf[:, 0, 1:] = invf[:, 1:, 0] = cross
        invf[:, 0, 0], invc[:, 0, 0] = corner, 1.0 / n
        betaf = np.concatenate([b0[:, None], beta], axis=1)
        betac = np.concatenate([ymean[:, None], beta], axis=1)
        mid = np.concatenate([np.zeros((m, 1)), mid], axis=1)
    else:
        betaf = betac = beta
        invf = invc = inv

    def lists(a):
        return [[None if np.isnan(v) else float(v) for v in row.ravel()] for row in a]

    out["mid"], out["beta"], out["betac"] = lists(mid), lists(betaf), lists(betac)
    out["inv"], out["invc"] = lists(invf), lists(invc)
    return out


_COEF_FIELDS = [("n", T.LongType()), ("rank", T.IntegerType()), ("ymean", T.DoubleType()),
                ("syy", T.DoubleType()), ("sse", T.DoubleType())] + [
    (c, T.ArrayType(T.DoubleType())) for c in ("mid", "beta", "betac", "inv", "invc")]


def solve(g: DataFrame, keys: list[str], intercept: bool = True) -> DataFrame:
    """Coefficient row per key (runs in tasks over Gram rows only)."""
    ship_package(g.sparkSession)
    schema = T.StructType([g.schema[k] for k in keys] + [T.StructField(c, t) for c, t in _COEF_FIELDS])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield _coef_rows(pdf, keys, intercept)[schema.fieldNames()]

    return g.mapInPandas(run, schema)


@dataclass
class OLSFit:
    """A fitted model for every key: ``coef_rows`` (one row per key with
    arrays), the design frame and the term names."""
    data: DataFrame
    keys: list[str]
    y: str
    xcols: list[str]
    intercept: bool
    coef_rows: DataFrame
    _glance: DataFrame | None = None

    @property
    def terms(self) -> list[str]:
        return ([INTERCEPT] if self.intercept else []) + list(self.xcols)

    @property
    def p(self) -> int:
        return len(self.terms)

    # -- per observation ----------------------------------------------------
    def _xs(self) -> list[str]:
        return _design_sql(self.xcols, self.intercept)

    def linear_predictor(self) -> Column:
        """x' b as one SQL expression over the joined mid and betac arrays."""
        return F.expr(_dot_sql(self._xs()))

    def quad_form(self) -> Column:
        """x' (X'X)^-1 x (leverage for observed x) over mid and invc."""
        return F.expr(_quad_sql(self._xs()))

    def predictors(self) -> DataFrame:
        """What prediction needs of each key: mid, betac, invc."""
        return self.coef_rows.select(*self.keys, "mid", "betac", "invc")

    def augment(self) -> DataFrame:
        """Observations with fitted, residual and leverage."""
        d = complete_cases(self.data, self.y, self.xcols)
        j = attach(d, self.coef_rows.select(*self.keys, "mid", "betac", "invc", "n", "rank"), self.keys)
        keep = [f"`{c}`" for c in j.columns if c not in ("mid", "betac", "invc")]
        fitted = _dot_sql(self._xs())
        return j.selectExpr(*keep, f"{fitted} AS fitted",
                            f"`{self.y}` - ({fitted}) AS residual",
                            f"{_quad_sql(self._xs())} AS hat")

    # -- per key ------------------------------------------------------------
    def summary(self) -> DataFrame:
        """One row per key from the Gram rows alone: n, k, r2, adj_r2, sigma,
        aic, aicc, bic, df_resid (R5, R6, R25, R28-R30); no pass over the data."""
        rows = self.coef_rows.select(*self.keys, "n", "rank", "sse", F.col("syy").alias("sst"))
        return with_criteria(rows, self.intercept)

    def glance(self) -> DataFrame:
        """``summary`` with the leave-one-out CV and the sum of residuals,
        which need the observations (R26).  Staged once per fit."""
        if self._glance is None:
            self._glance = stage_table(self._glance_plan(), "glance")
        return self._glance

    def _glance_plan(self) -> DataFrame:
        s = (self.augment().groupBy(*self.keys)
             .agg(F.sum("residual").alias("sum_resid"),
                  F.avg(F.pow(F.try_divide(F.col("residual"), 1 - F.col("hat")), 2)).alias("cv")))
        return self.summary().join(s, self.keys) if self.keys else self.summary().crossJoin(F.broadcast(s))

    def coefficients(self, with_p: bool = True) -> DataFrame:
        """Long table: term, estimate, std_error, t_value[, p_value]."""
        p = self.p
        names = F.array(*[F.lit(t) for t in self.terms])
        rows = (with_criteria(self.coef_rows.withColumn("sst", F.col("syy")), self.intercept)
                .select(*self.keys, "sigma", "df_resid",
                        F.posexplode(names).alias("i", "term"), "beta", "inv"))
        est = F.col("beta")[F.col("i")]
        var = F.col("inv")[F.col("i") * (p + 1)]
        se = F.when(est.isNotNull(), F.col("sigma") * F.sqrt(var))
        out = rows.select(*self.keys, "term", est.alias("estimate"), se.alias("std_error"),
                          F.try_divide(est, se).alias("t_value"), "df_resid")
        if with_p:
            out = out.withColumn("p_value", t_pvalue_udf(F.col("t_value"),
                                                          F.col("df_resid").cast("double")))
        return out.drop("df_resid") if not with_p else out


def with_criteria(s: DataFrame, intercept: bool = True) -> DataFrame:
    """Add fit statistics from n, rank (=k+1), sse, sst.

    R2 = 1 - SSE/SST; adj = 1-(1-R2)(T-1)/(T-k-1); sigma = sqrt(SSE/(T-k-1));
    AIC = T ln(SSE/T) + 2(k+2); AICc = AIC + 2(k+2)(k+3)/(T-k-3) (NULL when
    T-k-3 <= 0); BIC = T ln(SSE/T) + (k+2) ln T.
    """
    n = F.col("n").cast("double")
    kp1 = F.col("rank").cast("double")      # k predictors + intercept
    dfr = n - kp1
    ll = n * F.log(F.col("sse") / n)
    aic = ll + 2 * (kp1 + 1)
    denom = n - kp1 - 2
    return (s.withColumn("k", (F.col("rank") - (1 if intercept else 0)).cast("int"))
             .withColumn("df_resid", dfr.cast("int"))
             .withColumn("r2", 1 - F.try_divide(F.col("sse"), F.col("sst")))
             .withColumn("adj_r2", 1 - (1 - F.col("r2")) * F.try_divide(n - 1, dfr))
             .withColumn("sigma", F.sqrt(F.try_divide(F.col("sse"), dfr)))
             .withColumn("aic", aic)
             .withColumn("aicc", F.when(denom > 0, aic + 2 * (kp1 + 1) * (kp1 + 2) / denom))
             .withColumn("bic", ll + (kp1 + 1) * F.log(n)))


def fit(df: DataFrame, keys: list[str], y: str, xcols: list[str],
        intercept: bool = True) -> OLSFit:
    """Fit y ~ xcols (+ intercept) separately for every key."""
    g = gram(df, keys, y, xcols, intercept)
    return OLSFit(df, keys, y, list(xcols), intercept, stage_table(solve(g, keys, intercept), "coef"))


def simple_regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """y = a + b x per key with the built-in regression aggregates (R1, R5,
    R6, A11): slope, intercept, r2, n, residual standard error."""
    check_keys(keys, {"slope", "intercept", "r2", "n", "sigma"})
    g = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
        F.regr_syy(y, x).alias("_syy"))
    sse = F.col("_syy") * (1 - F.col("r2"))
    return g.select(*keys, "slope", "intercept", "r2", F.col("n").cast("bigint").alias("n"),
                    F.sqrt(F.try_divide(sse, F.col("n") - 2)).alias("sigma"))


# ---- residual diagnostics ------------------------------------------------------

def residual_acf1(aug: DataFrame, keys: list[str], resid: str = "residual") -> DataFrame:
    """Lag-1 autocorrelation of residuals per key (T11 formula)."""
    from wardcast.operators.series import acf
    return acf(aug.select(*keys, "t", resid), keys, resid, 1).select(
        *keys, F.col("r").alias("resid_acf1"))


def breusch_godfrey(fitm: OLSFit, order: int | None = None, m: int = 1) -> DataFrame:
    """Breusch-Godfrey LM test for residual autocorrelation up to ``order``
    (R9): regress e_t on X and e_{t-1..t-order} (missing lags = 0);
    LM = n R^2 ~ chi2(order).

    Without ``order`` every key takes its own: ``bg_order`` of its length for
    data with ``m`` periods a season.  One Gram pass with as many lags as the
    longest key needs serves all orders; each key is solved on its share."""
    from wardcast.functions.stats import chi2_sf_udf
    from wardcast.operators.features import distributed_lags
    keys = fitm.keys
    if order is None:
        longest = fitm.coef_rows.agg(F.max("n").alias("n")).first()["n"] or 0
    most = order or bg_order(m, longest)
    ship_package(fitm.data.sparkSession)
    aug = fitm.augment().select(*keys, "t", *fitm.xcols, F.col("residual").alias("_e"))
    lag_cols = [f"_e_lag{k}" for k in range(1, most + 1)]
    lagged = distributed_lags(aug, keys, "_e", most).fillna({c: 0.0 for c in lag_cols})
    g = gram(lagged, keys, "_e", fitm.xcols + lag_cols, fitm.intercept)
    schema = T.StructType([g.schema[k] for k in keys] + [
        T.StructField("n", T.LongType()), T.StructField("order", T.IntegerType()), T.StructField("r2", T.DoubleType())])
    x, with_mean, fixed = len(fitm.xcols), fitm.intercept, order

    def run(batches):
        for pdf in batches:
            orders = pdf["n"].map(lambda n: fixed or bg_order(m, n))
            for o, part in pdf.groupby(orders):
                out = _coef_rows(part, keys, with_mean, range(x + o))
                out["order"] = np.int32(o)
                out["r2"] = 1 - out["sse"] / out["syy"].where(out["syy"] > 0)
                yield out[schema.fieldNames()]

    lm = F.col("n") * F.col("r2")
    return g.mapInPandas(run, schema).select(*keys, "n", "order", lm.alias("lm"),
                                             chi2_sf_udf(lm, F.col("order").cast("double")).alias("p_value"))


def bg_order(m: int, n_obs: int) -> int:
    """Default order: 2m for seasonal data (10 otherwise), at most n/5."""
    lag = 2 * m if m > 1 else 10
    return max(1, min(lag, int(round(n_obs / 5))))


def influence(fitm: OLSFit) -> DataFrame:
    """Leverage, standardized residual and Cook's distance."""
    a = fitm.augment()
    g = stage_table(fitm.summary().select(*fitm.keys, "sigma"), "sigma")
    # leverage 1 (e.g. a season seen once) or a perfect fit: NULL, not an error
    omh = F.when(1 - F.col("hat") > 1e-10, 1 - F.col("hat"))
    r = F.try_divide(F.col("residual"), F.col("sigma") * F.sqrt(omh))
    cook = F.try_divide(r * r * F.col("hat"), F.col("rank") * omh)
    return attach(a, g, fitm.keys).select("*", r.alias("std_resid"), cook.alias("cooks_d"))


# ---- model selection -----------------------------------------------------------

def _subset_label(names, idx):
    return "+".join(names[i] for i in idx) if idx else "(none)"


def all_subsets(df: DataFrame, keys: list[str], y: str, xcols: list[str]) -> DataFrame:
    """Every subset of the predictors (intercept always in) ranked by AICc per
    key (R31/O4).  One Gram pass is shared by all subsets and gives every
    criterion but the leave-one-out CV; that takes one more pass in which an
    observation meets the subset inverses of its key and is averaged at once
    (partial aggregation by key and subset)."""
    ship_package(df.sparkSession)
    g = gram(df, keys, y, xcols, True)
    subsets = [tuple(c) for r in range(len(xcols) + 1) for c in combinations(range(len(xcols)), r)]
    schema = T.StructType([g.schema[k] for k in keys] + [T.StructField("model", T.StringType())]
                          + [T.StructField(c, t) for c, t in _COEF_FIELDS])

    def run(batches):
        for pdf in batches:
            for sub in subsets if len(pdf) else []:
                out = _coef_rows(pdf, keys, True, sub)
                out["model"] = _subset_label(xcols, sub)
                # columns left out of a subset count with coefficient 0
                yield out[schema.fieldNames()]

    models = stage_table(g.mapInPandas(run, schema), "subsets")
    X = _design_sql(xcols, True)
    d = complete_cases(df, y, xcols).select(*keys, y, *xcols)
    j = attach(d, models.select(*keys, "model", "mid", "betac", "invc"), keys)
    hat = F.expr(_quad_sql(X))
    e = F.expr(f"`{y}` - ({_dot_sql(X)})")
    cv = j.groupBy(*keys, "model").agg(F.avg(F.pow(F.try_divide(e, 1 - hat), 2)).alias("cv"))
    s = with_criteria(models.select(*keys, "model", "n", "rank", "sse", F.col("syy").alias("sst")), True)
    s = s.join(cv, [*keys, "model"])
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy(F.col("aicc").asc_nulls_last(), F.col("model"))
    return s.withColumn("rank_aicc", F.row_number().over(w).cast("int"))


def stepwise(df: DataFrame, keys: list[str], y: str, xcols: list[str],
             direction: str = "backward") -> DataFrame:
    """Stepwise selection by AICc (R32) on the Gram rows (no rescans of the
    data), all keys of a batch at each step together.

    * backward: start from all predictors, drop the one whose removal lowers
      AICc most, stop when no removal lowers it;
    * forward: start from the intercept-only model, add the predictor that
      lowers AICc most, stop when no addition lowers it.
    Output: one row per step (step 0 = start model) with the changed term.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    ship_package(df.sparkSession)
    g = gram(df, keys, y, xcols, True)
    schema = T.StructType([g.schema[k] for k in keys] + [
        T.StructField("step", T.IntegerType()), T.StructField("changed", T.StringType()),
        T.StructField("model", T.StringType()), T.StructField("aicc", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            n, mid, sxx, sxy = _stacks(pdf)
            syy = pdf["syy"].to_numpy(float)
            at, step, changed, inside, value = _steps(n, mid, sxx, sxy, syy, direction)
            out = pdf[keys].iloc[at].reset_index(drop=True) if keys else pd.DataFrame(index=range(len(at)))
            out["step"] = step.astype(np.int32)
            out["changed"] = [None if j < 0 else xcols[j] for j in changed]
            out["model"] = [_subset_label(xcols, np.flatnonzero(m).tolist()) for m in inside]
            out["aicc"] = value
            yield out[schema.fieldNames()]

    return g.mapInPandas(run, schema)


def _aicc_of(sse: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """AICc of models with k predictors and an intercept, NaN where undefined."""
    room = n - k - 3
    ok = (sse > 0) & (room > 0)
    safe = np.where(ok, sse, 1.0)
    return np.where(ok, n * np.log(safe / n) + 2 * (k + 2) + 2 * (k + 2) * (k + 3) / np.where(ok, room, 1.0), np.nan)


def _sweep(a: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sweep each matrix of a stack on its own row ``at``: the predictor comes
    in, or where ``out`` goes out again."""
    i = np.arange(len(a))
    col, pivot = a[i, :, at], a[i, at, at]
    b = a - col[:, :, None] * col[:, None, :] / pivot[:, None, None]
    edge = np.where(out, -1.0, 1.0)[:, None] * col / pivot[:, None]
    b[i, :, at], b[i, at, :] = edge, edge
    b[i, at, at] = -1.0 / pivot
    return b


def _steps(n, mid, sxx, sxy, syy, direction: str):
    """The steps of all keys of a batch: row of the key, number of the step,
    column changed (-1 at the start), predictors in the model, AICc.

    All keys take a step together: on the swept correlation matrices of
    predictors and y, the error without or with a predictor is its own minus
    or plus b_j^2 / a_jj.  Predictors that are constant or follow from earlier
    ones stay out of the arithmetic: they add nothing to a model's error or
    rank.  So a key whose predictors are dependent starts from (backward) and
    chooses among (forward) the independent ones it has in order; those left
    out are in no model."""
    m, p = sxy.shape
    diag = np.einsum("mii->mi", sxx).copy()
    diag[diag <= CONST_TOL * (diag + n[:, None] * mid ** 2)] = 0.0
    scale = np.sqrt(np.where(diag > 0, diag, 1.0))
    total = np.where(syy > 0, syy, 1.0)
    live = (diag > 0)[:, :, None] & (diag > 0)[:, None, :]
    a = np.zeros((m, p + 1, p + 1))
    a[:, :p, :p] = np.where(live, sxx / scale[:, :, None] / scale[:, None, :], 0.0)
    a[:, :p, p] = a[:, p, :p] = np.where(diag > 0, sxy / scale / np.sqrt(total)[:, None], 0.0)
    a[:, p, p] = np.where(syy > 0, 1.0, 0.0)
    usable = diag > 0
    full = a.copy()
    for j in range(p):                       # what the columns before leave of column j
        usable[:, j] &= full[:, j, j] > ALIAS_TOL
        rows = np.flatnonzero(usable[:, j])
        full[rows] = _sweep(full[rows], np.full(len(rows), j), np.zeros(len(rows), bool))
    inside = usable.copy() if direction == "backward" else np.zeros((m, p), bool)
    a = full if direction == "backward" else a
    best = _aicc_of(a[:, p, p] * total, n, inside.sum(axis=1))
    found = [(np.arange(m), np.zeros(m, int), np.full(m, -1), inside.copy(), best.copy())]
    open_, step = np.arange(m), 0
    while len(open_) and p:
        step += 1
        now, d, c = inside[open_], np.einsum("mii->mi", a[open_])[:, :p], a[open_][:, :p, p]
        may = now if direction == "backward" else usable[open_] & ~now & (d > ALIAS_TOL)
        change = np.where(may, c ** 2 / np.where(may, -d if direction == "backward" else d, 1.0), 0.0)
        sign = 1 if direction == "backward" else -1
        k = now.sum(axis=1)[:, None] - sign
        value = np.where(may, _aicc_of((a[open_, p, p][:, None] + sign * change) * total[open_][:, None], n[open_][:, None], k), np.nan)
        ranked = np.where(np.isnan(value), np.inf, value)
        pick = ranked.argmin(axis=1)
        won = ranked[np.arange(len(open_)), pick]
        go = np.isfinite(won) & (won < best[open_])
        open_, pick, won = open_[go], pick[go], won[go]
        a[open_] = _sweep(a[open_], pick, inside[open_, pick])
        inside[open_, pick] ^= True
        best[open_] = won
        found.append((open_, np.full(len(open_), step), pick, inside[open_].copy(), won))
    return tuple(np.concatenate(x) for x in zip(*found))


def stepwise_backward(df, keys, y, xcols):
    return stepwise(df, keys, y, xcols, "backward")
