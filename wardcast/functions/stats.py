"""Distribution functions for p-values and interval quantiles.

Spark has no Student-t or chi-square CDF, so these run as Arrow-batched
pandas UDFs on already-aggregated rows (one row per coefficient or per
series).  Implemented with numpy only (regularized incomplete beta and gamma
by continued fractions / series, Lentz's method).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_EPS = 1e-15
_TINY = 1e-300


def _lg(x):
    return _lgamma(np.asarray(x, dtype=float)).astype(float)


class NotConverged(ArithmeticError):
    """A series or continued fraction did not settle; no value is returned."""


def _betacf(a, b, x):
    # the number of terms needed grows with the square root of a and b
    iters = int(300 + 10 * math.sqrt(float(np.max(a + b))))
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < 4 * _EPS):
            return h
    raise NotConverged("incomplete beta")


def betainc(a, b, x):
    """Regularized incomplete beta I_x(a, b), vectorized."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float),
                                  np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lbt = _lg(am + bm) - _lg(am) - _lg(bm) + am * np.log(xm) + bm * np.log1p(-xm)
        bt = np.exp(lbt)
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = bt[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        flip = ~direct
        if flip.any():
            res[flip] = 1.0 - bt[flip] * _betacf(bm[flip], am[flip], 1.0 - xm[flip]) / bm[flip]
        out[mid] = res
    return out


def t_two_sided_p(t, df):
    """P(|T_df| > |t|)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_cdf(t, df):
    t = np.asarray(t, float)
    p2 = t_two_sided_p(t, df)
    return np.where(t >= 0, 1.0 - p2 / 2.0, p2 / 2.0)


def t_quantile(p, df):
    """Quantile of Student t by bisection on the CDF.  The bracket grows
    until it encloses the quantile, and halves until it is as narrow as
    double precision allows."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    ok = (df > 0) & (p > 0) & (p < 1)
    out = np.full(p.shape, np.nan)
    if not ok.any():
        return out
    pk, dk = p[ok], df[ok]
    # the upper tail is found from the lower one: 1 - p keeps no digits there
    tail = np.minimum(pk, 1.0 - pk)

    def above(t):    # P(T > t) > tail, for t >= 0
        return t_two_sided_p(t, dk) / 2.0 > tail

    hi = np.ones(pk.shape)
    while (wide := above(hi)).any() and np.isfinite(hi).all():
        hi = np.where(wide, hi * 4.0, hi)
    lo = np.zeros(pk.shape)
    while True:
        mid = (lo + hi) / 2.0
        if ((mid <= lo) | (mid >= hi) | (hi - lo <= 1e-15 * hi)).all():
            break
        up = above(mid)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    q = (lo + hi) / 2.0
    out[ok] = np.where(pk == 0.5, 0.0, np.where(pk > 0.5, q, -q))
    return out


def gammainc_upper(s, x):
    """Regularized upper incomplete gamma Q(s, x)."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    iters = int(500 + 20 * math.sqrt(float(np.nanmax(np.append(s, 1.0)))))
    out = np.full(x.shape, np.nan)
    ok = (s > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    ser = ok & (x > 0) & (x < s + 1)
    cf = ok & (x >= s + 1)
    if ser.any():
        ss, xs = s[ser], x[ser]
        ap, tot = ss.copy(), 1.0 / ss
        dl = tot.copy()
        for _ in range(iters):
            ap = ap + 1
            dl = dl * xs / ap
            tot = tot + dl
            if np.all(np.abs(dl) < np.abs(tot) * _EPS):
                break
        else:
            raise NotConverged("incomplete gamma series")
        p = tot * np.exp(-xs + ss * np.log(xs) - _lg(ss))
        out[ser] = 1.0 - p
    if cf.any():
        sc, xc = s[cf], x[cf]
        b = xc + 1.0 - sc
        c = np.full(xc.shape, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, iters + 1):
            an = -i * (i - sc)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1.0) < 4 * _EPS):
                break
        else:
            raise NotConverged("incomplete gamma fraction")
        out[cf] = np.exp(-xc + sc * np.log(xc) - _lg(sc)) * h
    return out


def chi2_sf(x, k):
    """P(chi2_k > x)."""
    return gammainc_upper(np.asarray(k, float) / 2.0, np.asarray(x, float) / 2.0)


# ---- Arrow-batched column wrappers -----------------------------------------

@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_p(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_quantile(p.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(float), k.to_numpy(float)))
