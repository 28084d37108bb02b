"""QR fits, branch and bound, orders per key, joint Fourier bases, event tables and holiday calendars."""

import datetime as dt
import math
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardcast.operators import features as X
from wardcast.operators import regress as R
from wardcast.operators import subsets as B
from wardcast.operators import tsqr
from wardcast.plans.feature_plans import HOLIDAY_RULES


def exact_ls(x, y):
    """Least squares in rational arithmetic: coefficients and sum of squared errors."""
    rows = [[Fraction(1), *map(Fraction, r)] for r in x]
    p, ys = len(rows[0]), [Fraction(v) for v in y]
    a = [[sum(r[i] * r[j] for r in rows) for j in range(p)] + [sum(r[i] * v for r, v in zip(rows, ys))] for i in range(p)]
    for i in range(p):
        a[i] = [v / a[i][i] for v in a[i]]
        for j in range(p):
            if j != i:
                a[j] = [u - a[j][i] * v for u, v in zip(a[j], a[i])]
    b = [r[p] for r in a]
    return [float(v) for v in b], float(sum((v - sum(c * z for c, z in zip(b, r))) ** 2 for r, v in zip(rows, ys)))


def macro(seed, n=64):
    """Aggregates that grow together, as in the classic ill-conditioned employment data."""
    rng = np.random.default_rng(seed)
    year = 1947 + np.arange(n) / 4
    gnp = np.round(234289 + 20000 * (year - 1947) + rng.normal(size=n) * 30, 0)
    deflator = np.round(83 + gnp / 8000 + rng.normal(size=n) * 0.01, 4)
    people = np.round(107608 + 1500 * (year - 1947) + gnp / 1000 + rng.normal(size=n) * 3, 0)
    y = np.round(60323 - 15 * deflator - 0.03 * gnp + 1800 * (year - 1947) + rng.normal(size=n) * 300, 0)
    return np.column_stack([deflator, gnp, people, year, year ** 2]), y


XS = ["a", "b", "c", "d", "e"]


def test_qr_of_ill_conditioned_designs(spark):
    data = {key: macro(seed) for key, seed in (("p", 1), ("q", 2), (None, 3))}
    rows = [(key, *map(float, r), float(v)) for key, (x, y) in data.items() for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "key string, a double, b double, c double, d double, e double, y double").repartition(7)
    fit = tsqr.fit(df, ["key"], "y", XS)
    got = {r.key: r for r in fit.coef_rows.collect()}
    for key, (x, y) in data.items():
        b, sse = exact_ls(x.tolist(), y.tolist())
        assert got[key]["n"] == len(y) and got[key]["rank"] == 6
        assert got[key].beta == pytest.approx(b, rel=1e-6) and got[key].sse == pytest.approx(sse, rel=1e-8)
    # the same fit object gives the usual tables
    glance = {r.key: r for r in fit.glance().collect()}
    x, y = data["p"]
    b, sse = exact_ls(x.tolist(), y.tolist())
    assert glance["p"].sum_resid == pytest.approx(0, abs=1e-4) and glance["p"].sigma == pytest.approx(math.sqrt(sse / (len(y) - 6)), rel=1e-8)


def test_qr_of_raw_powers(spark):
    """A cubic in the calendar year: the normal equations lose a column, QR none."""
    rng = np.random.default_rng(1)
    t = [1947 + i / 4 for i in range(60)]
    rows = [(v, v * v, v ** 3, round(float(3 + 0.5 * v - 0.01 * v * v + rng.normal()), 3)) for v in t]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(5)
    b, sse = exact_ls([r[:3] for r in rows], [r[3] for r in rows])
    got = tsqr.fit(df, [], "y", ["a", "b", "c"]).coef_rows.first()
    assert got["rank"] == 4 and got.beta == pytest.approx(b, rel=1e-5) and got.sse == pytest.approx(sse, rel=1e-7)
    assert R.fit(df, [], "y", ["a", "b", "c"]).coef_rows.first()["rank"] < 4


def test_qr_agrees_on_ordinary_designs_and_aliases(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, rng.normal(size=3)), float(rng.normal())) for k in "ab" for _ in range(40)]
    df = spark.createDataFrame(rows, "key string, a double, b double, c double, y double")
    df = df.withColumn("twice", F.col("a") * 2 + 1).withColumn("same", F.lit(3.0)).repartition(6)
    xs = ["a", "b", "twice", "same", "c"]
    one = {(r.key, r.term): r for r in R.fit(df, ["key"], "y", xs).coefficients().collect()}
    for r in tsqr.fit(df, ["key"], "y", xs).coefficients().collect():
        want = one[r.key, r.term]
        assert (r.estimate is None) == (want.estimate is None) == (r.term in ("twice", "same"))
        if r.estimate is not None:
            assert (r.estimate, r.std_error, r.p_value) == pytest.approx((want.estimate, want.std_error, want.p_value), rel=1e-8)
    whole = tsqr.fit(df, [], "y", ["a", "b"]).coef_rows.first()
    assert whole["n"] == 80 and whole.beta == pytest.approx(R.fit(df, [], "y", ["a", "b"]).coef_rows.first().beta)


def test_qr_factors_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(tsqr, "HELD_KEYS", 2)
    monkeypatch.setattr(tsqr, "FAN", 3)
    df = spark.range(3000).select((F.col("id") % 10).cast("string").alias("key"), F.sin("id").alias("x"),
                                  F.cos(F.col("id") * 3).alias("y")).repartition(9)
    got = {r.key: r for r in tsqr.fit(df, ["key"], "y", ["x"]).coef_rows.collect()}
    want = {r.key: r for r in R.fit(df, ["key"], "y", ["x"]).coef_rows.collect()}
    assert len(got) == 10
    for k, r in got.items():
        assert r["n"] == 300 and r.beta == pytest.approx(want[k].beta, rel=1e-9) and r.sse == pytest.approx(want[k].sse, rel=1e-9)


# ---- branch and bound ----

def made(n, p, strong, common, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + common * rng.normal(size=(n, 1))
    y = x[:, :strong] @ rng.normal(size=strong) * 0.6 + rng.normal(size=n) + 10
    return x, y


def brute(x, y, top):
    n, p = x.shape
    out = []
    for k in range(p + 1):
        for c in combinations(range(p), k):
            d = np.column_stack([np.ones(n), x[:, c]])
            e = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
            out.append((B.aicc(float(e @ e), n, k), "+".join(f"x{i}" for i in c) or "(none)"))
    return sorted(out)[:top]


def test_best_subsets_match_brute_force(spark):
    rows, want = [], {}
    for key, (strong, common, seed) in {"a": (3, 0.0, 1), "b": (0, 0.0, 2), "c": (6, 2.0, 3)}.items():
        x, y = made(70, 10, strong, common, seed)
        rows += [(key, *map(float, r), float(v)) for r, v in zip(x, y)]
        want[key] = brute(x, y, 10)
    xs = [f"x{i}" for i in range(10)]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{x} double" for x in xs) + ", y double").repartition(4)
    got = B.best_subsets(df.withColumn("const", F.lit(1.0)).withColumn("copy", F.col("x0") * 3), ["key"], "y", [*xs, "const", "copy"], 10)
    got = got.orderBy("key", "rank_aicc").collect()
    for key, w in want.items():
        mine = [r for r in got if r.key == key]
        assert [r.model for r in mine] == [m for _, m in w]
        assert [r.aicc for r in mine] == pytest.approx([v for v, _ in w], rel=1e-9)
        assert [r.rank_aicc for r in mine] == list(range(1, 11))


def test_best_subsets_of_25_predictors(spark):
    """33 million models: a small part is visited, and the order of the predictors does not matter."""
    x, y = made(120, 25, 6, 0.5, 9)
    xs = [f"x{i}" for i in range(25)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in xs) + ", y double")
    one = B.best_subsets(df, [], "y", xs).orderBy("rank_aicc").collect()
    two = B.best_subsets(df, [], "y", xs[::-1]).orderBy("rank_aicc").collect()
    assert len(one) == 10 and [set(r.model.split("+")) for r in one] == [set(r.model.split("+")) for r in two]
    c, z = x - x.mean(0), y - y.mean()
    s = np.sqrt((c ** 2).sum(0))
    search = B.Search((c.T @ c) / np.outer(s, s), c.T @ z / s / math.sqrt(z @ z), 120.0, 10)
    best = search.run((), ())
    assert search.nodes < 50_000
    assert [r.aicc for r in one] == pytest.approx([v + 120 * math.log(z @ z) for v, _ in best], rel=1e-9)
    # no single predictor in or out improves the best model
    inside = {int(n[1:]) for n in one[0].model.split("+")}
    for j in range(25):
        cols = sorted(inside ^ {j})
        d = np.column_stack([np.ones(120), x[:, cols]])
        e = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
        assert B.aicc(float(e @ e), 120, len(cols)) >= one[0].aicc - 1e-9


def test_best_subsets_need_rows(spark):
    x, y = made(12, 10, 2, 0.0, 1)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"x{i} double" for i in range(10)) + ", y double")
    with pytest.raises(Exception, match="too few"):
        B.best_subsets(df, [], "y", [f"x{i}" for i in range(10)]).collect()
    flat = df.withColumn("y", F.lit(1.0))
    assert B.best_subsets(flat, [], "y", ["x0", "x1"]).collect() == []


# ---- Breusch-Godfrey ----

def test_each_key_takes_its_own_order(spark):
    rng = np.random.default_rng(8)
    rows = [(k, t, float(rng.normal())) for k, n in (("short", 12), ("long", 90)) for t in range(1, n + 1)]
    df = X.trend(spark.createDataFrame(rows, "key string, t int, y double"))
    both = {r.key: r for r in R.breusch_godfrey(R.fit(df, ["key"], "y", ["trend"]), m=4).collect()}
    for key, order in (("short", 2), ("long", 8)):
        one = R.breusch_godfrey(R.fit(df.filter(F.col("key") == key), ["key"], "y", ["trend"]), order).first()
        assert both[key].order == order == one.order
        assert (both[key].lm, both[key].p_value) == pytest.approx((one.lm, one.p_value), rel=1e-9)


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    """The bound of a broadcast is one of bytes too."""
    from wardcast.session import stage_table
    rows = stage_table(spark.range(50).select("id", F.array_repeat(F.rand(1), 500).alias("wide")), "wide")
    obs = spark.range(1000).select((F.col("id") % 50).alias("id"), F.col("id").alias("v"))
    monkeypatch.setattr(R, "BROADCAST_BYTES", 1000)
    j = R.attach(obs, rows, ["id"])
    assert "_part" in j._jdf.queryExecution().optimizedPlan().toString() and j.count() == 1000


# ---- several periods ----

def test_joint_basis_leaves_out_what_repeats(spark):
    f = X.fourier_frequencies({7: 3, 3.5: 1, 365.25: 2})
    assert [(m, j) for m, j, _ in f] == [("7", "1"), ("7", "2"), ("7", "3"), ("365_25", "1"), ("365_25", "2")]
    assert X.fourier_frequencies({2.5: 1, 5: 2})[0][2] == Fraction(2, 5) and len(X.fourier_frequencies({2.5: 1, 5: 2})) == 2
    assert X.fourier_multi_names({4: 2, 2: 1}) == ["sin_4_1", "cos_4_1", "cos_4_2"]
    with pytest.raises(ValueError, match="K must be"):
        X.fourier_frequencies({7: 4})
    df = X.fourier_multi(spark.range(1, 1500).select(F.col("id").cast("int").alias("t")), {7: 3, 3.5: 1, 30.4375: 2, 365.25: 4})
    m = np.array([tuple(r)[1:] for r in df.orderBy("t").collect()])
    assert np.linalg.matrix_rank(np.column_stack([np.ones(len(m)), m])) == m.shape[1] + 1 == 19
    t = np.arange(1, 1500)
    assert m[:, 6] == pytest.approx(np.sin(2 * np.pi * t / 30.4375), abs=1e-9)
    far = X.fourier_multi(spark.createDataFrame([(10 ** 9 + 3,)], "t int"), {365.25: 1}).first()
    assert far[1] == pytest.approx(math.sin(2 * math.pi * ((10 ** 9 + 3) * 4 % 1461) / 1461), abs=1e-12)


# ---- event tables ----

def test_event_shares(spark):
    T = lambda d, h=0, m=0: dt.datetime(2024, 2, d, h, m)
    spans = [("a", T(1, 6), T(1, 12)), ("a", T(1, 9), T(1, 18)), ("a", T(1, 18), T(1, 20)), ("a", T(2, 23), T(4, 1)),
             ("a", T(5), T(6)), ("b", T(3, 1), T(3, 1)), ("b", T(3, 4), T(3, 2)), ("b", None, T(9)), ("b", T(7, 0), T(7, 0, 36)),
             ("b", T(7, 0), T(7, 0, 36))]
    days = [(k, dt.date(2024, 2, d), d) for k in "ab" for d in range(1, 9)]
    ev = spark.createDataFrame(spans, "k string, s timestamp_ntz, e timestamp_ntz")
    df = spark.createDataFrame(days, "k string, period date, other int")
    got = {(r.k, r.other): r.event_share for r in X.event_shares(df, ev, ["k"], "s", "e", "day").collect()}
    want = {("a", 1): 14 / 24, ("a", 2): 1 / 24, ("a", 3): 1.0, ("a", 4): 1 / 24, ("a", 5): 1.0, ("b", 7): 36 / 1440}
    assert got == pytest.approx({(k, d): want.get((k, d), 0.0) for k in "ab" for d in range(1, 9)})
    months = spark.createDataFrame([("a", dt.date(2024, 2, 1), 0)], "k string, period date, other int")
    month = X.event_shares(months, ev, ["k"], "s", "e", "month").first().event_share
    assert month == pytest.approx((14 + 26 + 24) / (29 * 24))


def test_event_shares_random(spark):
    rng = np.random.default_rng(6)
    start = dt.datetime(2024, 1, 1)
    spans = [(start + dt.timedelta(seconds=int(rng.integers(0, 10 * 86400))), int(rng.integers(0, 40_000))) for _ in range(120)]
    minutes = np.zeros(12 * 86400, dtype=bool)
    for s, n in spans:
        at = int((s - start).total_seconds())
        minutes[at:at + n] = True
    ev = spark.createDataFrame([(s, s + dt.timedelta(seconds=n)) for s, n in spans], "s timestamp_ntz, e timestamp_ntz")
    hours = spark.createDataFrame([(start + dt.timedelta(hours=h),) for h in range(11 * 24)], "period timestamp_ntz")
    for unit, size, grid in (("hour", 3600, hours), ("day", 86400, hours.select(F.to_date("period").alias("period")).distinct())):
        got = [r.event_share for r in X.event_shares(grid, ev, [], "s", "e", unit).orderBy("period").collect()]
        assert got == pytest.approx([minutes[i * size:(i + 1) * size].mean() for i in range(len(got))], abs=1e-12)


# ---- holidays ----

def days_of(spark, rules, first, last):
    df = X.holidays(spark.createDataFrame(rules, X.HOLIDAY_SCHEMA), first, last)
    return sorted((r.region, r.name, r.day) for r in df.collect())


def test_holiday_rules(spark):
    D = dt.date
    got = days_of(spark, HOLIDAY_RULES, 1999, 2000)
    assert [d for r, n, d in got if r == "AFRICA"] == [D(2000, 12, 25), D(2000, 2, 29)]      # 25 Dec 1999 was a Saturday
    us = {n: [d for r, m, d in got if r == "AMERICA" and m == n] for n in {n for r, n, _ in got if r == "AMERICA"}}
    assert us["fourth thursday of november"] == [D(1999, 11, 25), D(2000, 11, 23)]
    assert us["last monday of may"] == [D(1999, 5, 31), D(2000, 5, 29)]
    assert us["fourth of july"] == [D(1999, 7, 5), D(2000, 7, 4)]                            # a Sunday in 1999
    assert us["new year"] == [D(1999, 1, 1), D(1999, 12, 31)]                                # 1 Jan 2000 was a Saturday
    assert [d for r, n, d in got if n == "good friday"] == [D(1999, 4, 2), D(2000, 4, 21)]
    assert [d for r, n, d in got if r == "ASIA" and n == "new year"] == [D(1999, 1, 1), D(2000, 1, 3)]
    assert [d for _, n, d in days_of(spark, HOLIDAY_RULES, 1990, 2010) if n == "first of october"] == [D(y, 10, 1) for y in range(1997, 2001)]
    fifth = [("x", "fifth friday of february", "nth", 2, None, 5, 4, None, None, None, None), ("x", "late", "fixed", 1, 1, None, None, None, None, 2050, None)]
    assert days_of(spark, fifth, 2000, 2030) == [("x", "fifth friday of february", D(2008, 2, 29))]


def test_regional_trading_days(spark):
    rules = spark.createDataFrame(HOLIDAY_RULES, X.HOLIDAY_SCHEMA)
    rows = [(r, dt.date(y, m, 1)) for r in ("AMERICA", "EUROPE", "MIDDLE EAST", None) for y in (1999, 2000) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "reg string, period date")
    got = {(r.reg, r.period): r for r in X.regional_trading_days(df, "reg", rules).collect()}
    assert len(got) == len(rows)
    off = {}
    for r, _, d in days_of(spark, HOLIDAY_RULES, 1998, 2001):
        off.setdefault(r, set()).add(d)
    for r, p in rows:
        days = [p + dt.timedelta(days=i) for i in range(31) if (p + dt.timedelta(days=i)).month == p.month]
        week = [d for d in days if d.weekday() < 5]
        lost = [d for d in week if d in off.get(r, ())]
        assert (got[r, p].trading_days, got[r, p].holidays) == (len(week) - len(lost), len(lost))
    assert got["AMERICA", dt.date(1999, 12, 1)].holidays == 2          # the 24th and, for 2000, the 31st
    assert X.regional_trading_days(df.limit(0), "reg", rules).collect() == []


# ---- stepwise ----

@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_stepwise_of_many_keys_at_once(spark, direction):
    """Each key's path equals that of refitting every trial, whatever the others do."""
    rng = np.random.default_rng(11)
    xs, rows = [f"x{i}" for i in range(6)], []
    for key in range(40):
        x, y = made(int(rng.integers(12, 60)), 6, int(rng.integers(0, 6)), float(rng.random()), 100 + key)
        rows += [(f"k{key}", *map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{c} double" for c in xs) + ", y double")
    got = {}
    for r in R.stepwise(df, ["key"], "y", xs, direction).orderBy("key", "step").collect():
        got.setdefault(r.key, []).append((r.changed, r.model, r.aicc))

    def score(x, y, cols):
        d = np.column_stack([np.ones(len(y)), x[:, sorted(cols)]])
        e = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
        return B.aicc(float(e @ e), len(y), len(cols))

    for key in got:
        data = np.array([r[1:] for r in rows if r[0] == key])
        x, y = data[:, :6], data[:, 6]
        now = list(range(6)) if direction == "backward" else []
        path = [(None, "+".join(f"x{j}" for j in now) or "(none)", score(x, y, now))]
        while True:
            trials = [(score(x, y, set(now) ^ {j}), j) for j in range(6) if (j in now) == (direction == "backward")]
            if not trials or not min(trials)[0] < path[-1][2]:
                break
            value, j = min(trials)
            now = sorted(set(now) ^ {j})
            path.append((f"x{j}", "+".join(f"x{i}" for i in now) or "(none)", value))
        assert [p[:2] for p in got[key]] == [p[:2] for p in path]
        assert [p[2] for p in got[key]] == pytest.approx([p[2] for p in path], rel=1e-8)


def test_stepwise_leaves_dependent_predictors_out(spark):
    x, y = made(50, 3, 2, 0.0, 4)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "x0 double, x1 double, x2 double, y double")
    more = df.withColumn("one", F.lit(2.0)).withColumn("copy", F.col("x0") - F.col("x1"))
    for direction in ("backward", "forward"):
        plain = R.stepwise(df, [], "y", ["x0", "x1", "x2"], direction).orderBy("step").collect()
        wide = R.stepwise(more, [], "y", ["one", "x0", "x1", "copy", "x2"], direction).orderBy("step").collect()
        if direction == "backward":
            assert [r.model for r in wide] == [r.model for r in plain]
        assert wide[-1].aicc <= plain[-1].aicc + 1e-9
    assert R.stepwise(df.withColumn("y", F.lit(1.0)), [], "y", ["x0"], "forward").count() == 1
