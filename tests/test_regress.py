"""Regression properties (G8-G14) and brute-force checks of the queries that
have no SQL oracle (p-values, intervals, Breusch-Godfrey, subsets, stepwise)."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from wardcast.functions import stats
from wardcast.operators import features as X
from wardcast.operators import forecast as FC
from wardcast.operators import regress as R

XS = ["x1", "x2", "x3"]


def design(seed=7, n=40, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    frames = []
    for k in keys:
        x = rng.normal(size=(n, 3))
        y = 1.5 + x @ np.array([2.0, -1.0, 0.0]) + rng.normal(scale=0.7, size=n)
        frames.append(pd.DataFrame({"key": k, "t": np.arange(1, n + 1), "x1": x[:, 0],
                                    "x2": x[:, 1], "x3": x[:, 2], "y": y}))
    return pd.concat(frames, ignore_index=True)


def ols_np(g, cols):
    Xm = np.column_stack([np.ones(len(g))] + [g[c].to_numpy() for c in cols])
    y = g["y"].to_numpy()
    b = np.linalg.solve(Xm.T @ Xm, Xm.T @ y)
    e = y - Xm @ b
    return Xm, y, b, e


@pytest.fixture(scope="module")
def pdf():
    return design()


@pytest.fixture(scope="module")
def fitm(spark, pdf):
    return R.fit(spark.createDataFrame(pdf), ["key"], "y", XS)


def test_coefficients_match_numpy(fitm, pdf):
    co = fitm.coefficients().toPandas()
    for k, g in pdf.groupby("key"):
        Xm, y, b, e = ols_np(g, XS)
        n, p = Xm.shape
        s2 = e @ e / (n - p)
        se = np.sqrt(np.diag(np.linalg.inv(Xm.T @ Xm)) * s2)
        mine = co[co.key == k].set_index("term").loc[["(Intercept)"] + XS]
        assert np.allclose(mine.estimate, b, rtol=1e-9)
        assert np.allclose(mine.std_error, se, rtol=1e-9)
        tv = b / se
        assert np.allclose(mine.p_value, stats.t_two_sided_p(tv, n - p), rtol=1e-7, atol=1e-12)


def test_residual_orthogonality_and_r2(fitm):
    a = fitm.augment().toPandas()
    g = fitm.glance().toPandas().set_index("key")
    for k, d in a.groupby("key"):
        e = d.residual.to_numpy()
        assert abs(e.sum()) < 1e-8                                   # G8
        for c in XS:
            assert abs((d[c] * e).sum()) < 1e-8
        r2 = np.corrcoef(d.y, d.fitted)[0, 1] ** 2                   # G9
        assert g.loc[k, "r2"] == pytest.approx(r2, rel=1e-9)


def test_information_criteria_identities(fitm):
    g = fitm.glance().toPandas()
    for _, r in g.iterrows():                                        # G11
        n, k, sse = r.n, r.k, r.sse
        assert r.adj_r2 == pytest.approx(1 - (1 - r.r2) * (n - 1) / (n - k - 1))
        aic = n * math.log(sse / n) + 2 * (k + 2)
        assert r.aic == pytest.approx(aic)
        assert r.aicc == pytest.approx(aic + 2 * (k + 2) * (k + 3) / (n - k - 3))
        assert r.bic == pytest.approx(n * math.log(sse / n) + (k + 2) * math.log(n))
        assert r.sigma == pytest.approx(math.sqrt(sse / (n - k - 1)))


def test_loo_cv_equals_deletion(fitm, pdf):
    g = fitm.glance().toPandas().set_index("key")
    for k, d in pdf.groupby("key"):                                  # G14
        errs = []
        for i in range(len(d)):
            tr = d.drop(d.index[i])
            _, _, b, _ = ols_np(tr, XS)
            x = np.r_[1.0, d.iloc[i][XS].to_numpy(float)]
            errs.append(d.iloc[i].y - x @ b)
        assert g.loc[k, "cv"] == pytest.approx(np.mean(np.square(errs)), rel=1e-9)


def test_r2_never_falls_when_adding_predictor(spark, pdf):
    df = spark.createDataFrame(pdf)
    prev = None
    for m in range(1, 4):                                            # G10
        r2 = {r["key"]: r["r2"] for r in rows(R.fit(df, ["key"], "y", XS[:m]).glance())}
        if prev:
            assert all(r2[k] >= prev[k] - 1e-12 for k in r2)
        prev = r2


def test_collinear_predictor_is_aliased(spark, pdf):
    d = pdf.assign(x4=pdf.x1 * 2.0 + pdf.x2)
    co = R.fit(spark.createDataFrame(d), ["key"], "y", XS + ["x4"]).coefficients().toPandas()
    x4 = co[co.term == "x4"]
    assert x4.estimate.isna().all() and x4.std_error.isna().all()
    full = co[co.term == "x1"].estimate.to_numpy()
    _, _, b, _ = ols_np(pdf[pdf.key == "a"], XS)
    assert full[list(co[co.term == "x1"].key).index("a")] == pytest.approx(b[1])


def test_small_sample_aicc_null_and_constant_series(spark):
    small = design(n=6, keys=("s",))
    g = rows(R.fit(spark.createDataFrame(small), ["key"], "y", XS).glance())[0]
    assert g["aicc"] is None                                         # T - k - 3 <= 0
    const = small.assign(y=5.0)
    gc = rows(R.fit(spark.createDataFrame(const), ["key"], "y", ["x1"]).glance())[0]
    assert gc["sse"] == pytest.approx(0.0, abs=1e-18)


def seasonal_frame(spark, n=24, m=4):
    rng = np.random.default_rng(3)
    t = np.arange(1, n + 1)
    season = (t - 1) % m + 1
    y = 10 + 0.5 * t + np.array([0, 3, -2, 5])[season - 1] + rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"key": "q", "t": t.astype(np.int32),
                                               "season": season.astype(np.int32), "y": y}))


def test_fourier_full_equals_seasonal_dummies(spark):
    df = seasonal_frame(spark)                                       # G13
    dm = X.season_dummies(X.trend(df), 4)
    fo = X.fourier(X.trend(df), 4, 2)
    a = rows(R.fit(dm, ["key"], "y", ["trend"] + X.season_dummy_names(4)).glance())[0]
    b = rows(R.fit(fo, ["key"], "y", ["trend"] + X.fourier_names(4, 2)).glance())[0]
    assert a["sse"] == pytest.approx(b["sse"], rel=1e-9)
    # Season coefficients are differences to season 1
    co = {r["term"]: r["estimate"] for r in rows(
        R.fit(dm, ["key"], "y", ["trend"] + X.season_dummy_names(4)).coefficients(with_p=False))}
    assert co["season_2"] == pytest.approx(3.0, abs=1.5)


def test_forecast_intervals_match_formula(spark, fitm, pdf):
    new = spark.createDataFrame(pd.DataFrame({"key": ["a"], "x1": [0.3], "x2": [-1.0], "x3": [2.0]}))
    f = rows(FC.forecast(fitm, new))[0]
    Xm, y, b, e = ols_np(pdf[pdf.key == "a"], XS)
    x = np.array([1.0, 0.3, -1.0, 2.0])
    n, p = Xm.shape
    s = math.sqrt(e @ e / (n - p))
    se = s * math.sqrt(1 + x @ np.linalg.inv(Xm.T @ Xm) @ x)
    q = stats.t_quantile(0.975, n - p)
    assert f["point"] == pytest.approx(x @ b) and f["se"] == pytest.approx(se)
    assert f["hi95"] == pytest.approx(x @ b + q * se, rel=1e-9)
    assert f["lo80"] == pytest.approx(x @ b - stats.t_quantile(0.9, n - p) * se, rel=1e-9)


def test_future_frame(spark):
    from datetime import date
    df = spark.createDataFrame([("a", date(2001, 4, 1), 18)], "series_id string, period date, t int")
    out = rows(FC.future_frame(df, ["series_id"], "quarter", 3), ["h"])
    assert [(r["period"], r["t"], r["season"]) for r in out] == [
        (date(2001, 7, 1), 19, 3), (date(2001, 10, 1), 20, 4), (date(2002, 1, 1), 21, 1)]


def test_breusch_godfrey_matches_numpy(spark, pdf):
    df = spark.createDataFrame(pdf)
    m = R.fit(df, ["key"], "y", XS)
    out = {r["key"]: r for r in rows(R.breusch_godfrey(m, 3))}
    for k, g in pdf.groupby("key"):
        Xm, y, b, e = ols_np(g, XS)
        lags = np.column_stack([np.r_[np.zeros(j), e[:-j]] for j in (1, 2, 3)])
        Z = np.column_stack([Xm, lags])
        c = np.linalg.lstsq(Z, e, rcond=None)[0]
        u = e - Z @ c
        r2 = 1 - (u @ u) / ((e - e.mean()) @ (e - e.mean()))
        assert out[k]["lm"] == pytest.approx(len(e) * r2, rel=1e-7)
        assert out[k]["p_value"] == pytest.approx(stats.chi2_sf(len(e) * r2, 3), rel=1e-7)


def _aicc(n, sse, kp1):
    aic = n * math.log(sse / n) + 2 * (kp1 + 1)
    return aic + 2 * (kp1 + 1) * (kp1 + 2) / (n - kp1 - 2)


def test_all_subsets_brute_force(spark, pdf):
    out = R.all_subsets(spark.createDataFrame(pdf), ["key"], "y", XS).toPandas()
    assert len(out) == 2 * 8
    for k, g in pdf.groupby("key"):
        exp = {}
        for r in range(4):
            for sub in itertools.combinations(XS, r):
                Xm, y, b, e = ols_np(g, list(sub))
                H = Xm @ np.linalg.inv(Xm.T @ Xm) @ Xm.T
                cv = np.mean((e / (1 - np.diag(H))) ** 2)
                exp["+".join(sub) if sub else "(none)"] = (_aicc(len(y), e @ e, len(sub) + 1), cv)
        mine = out[out.key == k].set_index("model")
        for model, (aicc, cv) in exp.items():
            assert mine.loc[model, "aicc"] == pytest.approx(aicc, rel=1e-9)
            assert mine.loc[model, "cv"] == pytest.approx(cv, rel=1e-9)
        best = min(exp, key=lambda m: exp[m][0])
        assert mine[mine.rank_aicc == 1].index[0] == best


def test_stepwise_backward_brute_force(spark, pdf):
    out = R.stepwise_backward(spark.createDataFrame(pdf), ["key"], "y", XS).toPandas()
    for k, g in pdf.groupby("key"):
        cur = list(XS)
        Xm, y, b, e = ols_np(g, cur)
        best = _aicc(len(y), e @ e, len(cur) + 1)
        path = ["+".join(cur)]
        while cur:
            trials = []
            for d in cur:
                rest = [c for c in cur if c != d]
                _, _, _, e2 = ols_np(g, rest)
                trials.append((_aicc(len(y), e2 @ e2, len(rest) + 1), d))
            val, d = min(trials)
            if not val < best:
                break
            cur.remove(d)
            best = val
            path.append("+".join(cur) if cur else "(none)")
        mine = out[out.key == k].sort_values("step")
        assert list(mine.model) == path
        assert mine.aicc.iloc[-1] == pytest.approx(best, rel=1e-9)


def test_stepwise_forward_brute_force(spark, pdf):
    out = R.stepwise(spark.createDataFrame(pdf), ["key"], "y", XS, "forward").toPandas()
    for k, g in pdf.groupby("key"):
        cur = []
        y = g["y"].to_numpy()
        e0 = y - y.mean()
        best = _aicc(len(y), e0 @ e0, 1)
        path = ["(none)"]
        while len(cur) < len(XS):
            trials = []
            for a in XS:
                if a in cur:
                    continue
                cand = [c for c in XS if c in cur + [a]]
                _, _, _, e2 = ols_np(g, cand)
                trials.append((_aicc(len(y), e2 @ e2, len(cand) + 1), XS.index(a), cand))
            val, _, cand = min(trials)
            if not val < best:
                break
            cur, best = cand, val
            path.append("+".join(cur))
        mine = out[out.key == k].sort_values("step")
        assert list(mine.model) == path
        assert mine.aicc.iloc[-1] == pytest.approx(best, rel=1e-9)


def test_simple_regression_builtin(spark, pdf):
    out = {r["key"]: r for r in rows(R.simple_regression(spark.createDataFrame(pdf), ["key"], "y", "x1"))}
    for k, g in pdf.groupby("key"):
        Xm, y, b, e = ols_np(g, ["x1"])
        assert out[k]["slope"] == pytest.approx(b[1]) and out[k]["intercept"] == pytest.approx(b[0])
        assert out[k]["sigma"] == pytest.approx(math.sqrt(e @ e / (len(y) - 2)))


def test_distribution_functions():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert stats.t_quantile(0.9, 13) == pytest.approx(1.350171, abs=1e-6)
    assert stats.t_quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-5)
    assert stats.t_two_sided_p(2.0, 5) == pytest.approx(0.1019395, abs=1e-7)
    assert stats.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_sf(0.0, 4) == 1.0
    assert float(stats.t_cdf(0.0, 7)) == pytest.approx(0.5)


def test_influence_with_unit_leverage(spark):
    # the only observation of season 4 has leverage 1
    t = list(range(1, 10))
    season = [1, 2, 3, 1, 2, 3, 1, 2, 4]
    y = [1.0, 2.5, 2.0, 1.4, 3.1, 2.2, 1.9, 3.3, 7.0]
    df = spark.createDataFrame(pd.DataFrame({"key": "k", "t": t, "season": season, "y": y}))
    m = R.fit(X.season_dummies(X.trend(df), 4), ["key"], "y", ["trend"] + X.season_dummy_names(4))
    out = {r["t"]: r for r in rows(R.influence(m))}
    assert out[9]["hat"] == pytest.approx(1.0) and out[9]["std_resid"] is None
    assert out[1]["cooks_d"] is not None


def test_wide_design_uses_array_path_and_matches_numpy(spark):
    # p = 13 design columns (> FLAT_MAX): dot products and leverages via array functions
    rng = np.random.default_rng(11)
    n, k = 60, 12
    x = rng.normal(size=(n, k))
    y = 0.5 + x @ rng.normal(size=k) + rng.normal(size=n)
    cols = [f"z{i}" for i in range(k)]
    pdf = pd.DataFrame(x, columns=cols).assign(key="w", t=np.arange(1, n + 1), y=y)
    m = R.fit(spark.createDataFrame(pdf), ["key"], "y", cols)
    assert len(m._xs()) > 8
    Xm = np.column_stack([np.ones(n), x])
    XtXi = np.linalg.inv(Xm.T @ Xm)
    b = XtXi @ Xm.T @ y
    e = y - Xm @ b
    h = np.einsum("ij,jk,ik->i", Xm, XtXi, Xm)
    g = rows(m.glance())[0]
    assert g["cv"] == pytest.approx(np.mean((e / (1 - h)) ** 2), rel=1e-9)
    a = m.augment().toPandas().sort_values("t")
    assert np.allclose(a.hat.to_numpy(), h, rtol=1e-9)
    new = spark.createDataFrame(pdf.iloc[:1].drop(columns=["y", "t"]))
    f = rows(FC.forecast(m, new, intervals=False))[0]
    s = math.sqrt(e @ e / (n - k - 1))
    assert f["se"] == pytest.approx(s * math.sqrt(1 + h[0]), rel=1e-9)


def test_key_names_colliding_with_outputs_are_rejected(spark, pdf):
    df = spark.createDataFrame(pdf.rename(columns={"key": "k"}))
    with pytest.raises(ValueError, match="collide"):
        R.fit(df, ["k"], "y", XS)
