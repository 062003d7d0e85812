"""Forecast models against plain loops, planted series, and the runner with plug-ins that fail."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import backtest as B
from tidemark.plans import models as M
from tidemark.plans.models import autoregression, linear, regression, smoothing
from tidemark.plans.models.terms import with_terms

D = dt.date
WEEKS = [D(2021, 1, 4) + dt.timedelta(weeks=k) for k in range(170)]
DAYS = [D(2023, 1, 2) + dt.timedelta(days=k) for k in range(200)]


def tasks_of(spark, series, dates, train, horizon, extra=()):
    """One task for each named series, cut off after `train` dates."""
    rows = [("L", s, dates[train - 1], dates[k], float(v[k]), k >= train) for s, v in series.items() for k in range(min(len(v), train + horizon))]
    return spark.createDataFrame(rows + list(extra), "level string, series string, cutoff date, ds date, y double, is_test boolean").repartition(3)


def got_by(df, value="forecast"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.series, r.ds)):
        out.setdefault(r.series, []).append(r[value])
    return {s: np.array(v, float) for s, v in out.items()}


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(0)
    held = [1e-6, 0.3, 2.0, 0.5]
    x, y, own = rng.normal(size=(300, 4)), rng.normal(size=300), rng.integers(0, 3, 300)
    x[:, 0] = 1
    rows = spark.createDataFrame([(int(g), a.tolist(), float(b)) for g, a, b in zip(own, x, y, strict=True)], "g int, x array<double>, z double").repartition(4)
    for r in linear.ridge(rows, ["g"], held).collect():
        a, b = x[own == r.g], y[own == r.g]
        assert np.allclose(r.w, np.linalg.solve(a.T @ a + np.diag(held), a.T @ b), rtol=1e-8, atol=1e-10)
    assert linear.ridge(rows.where("false"), ["g"], held).count() == 0


@pytest.mark.parametrize("daily", [False, True])
def test_regressions_equal_numpy(spark, daily):
    dates, rng = (DAYS if daily else WEEKS), np.random.default_rng(1)
    series = {s: 200 + 50 * np.sin(np.arange(len(dates)) / 9 + k) + rng.normal(0, 5, len(dates)) for k, s in enumerate("ab")}
    train = 120 if daily else 110
    tasks = tasks_of(spark, series, dates, train, 20)
    for make, model in ((regression.calendar_rows, M.calendar_regression), (regression.trend_rows, M.trend_season)):
        rows, held = make(tasks, daily)
        plain = {}
        for r in sorted(rows.collect(), key=lambda r: (r.series, r.ds)):
            plain.setdefault(r.series, []).append((r.is_test, r.x, np.log1p(r.y)))
        got = got_by(model(tasks, daily, {}))
        for s, own in plain.items():
            test = np.array([t for t, _, _ in own])
            x, z = np.array([x for _, x, _ in own]), np.array([z for _, _, z in own])
            a, b = x[~test], z[~test]
            fit = x @ np.linalg.solve(a.T @ a + np.diag(held), a.T @ b)
            if model is M.calendar_regression:
                off = (z - fit)[~test]
                rho = np.clip((off[1:] * off[:-1]).sum() / (off**2).sum(), 0, 0.98)
                fit[test] += off[-1] * rho ** np.arange(1, test.sum() + 1)
            assert np.allclose(got[s], np.expm1(fit[test]), rtol=1e-6)


def test_yearly_waves_need_547_days(spark):
    x = {n: regression.trend_rows(tasks_of(spark, {"a": np.ones(n + 2)}, WEEKS, n, 2), False)[0].agg(F.sum(F.aggregate(F.slice("x", 18, 12), F.lit(0.0), lambda s, v: s + F.abs(v)))).first()[0] for n in (78, 80)}
    assert x[78] == 0 and x[80] > 0


def test_calendar_terms(spark):
    days = tasks_of(spark, {"a": np.ones(5)}, [D(2024, 12, 24) + dt.timedelta(days=k) for k in range(5)], 4, 1)
    assert [(r.eve, r.special_days, r.after) for r in with_terms(days, True).orderBy("ds").collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0)]
    week = tasks_of(spark, {"a": np.ones(2)}, [D(2024, 12, 23), D(2024, 12, 30)], 1, 1)
    assert [(r.special_days, r.year_end) for r in with_terms(week, False).orderBy("ds").collect()] == [(1, 1), (1, 1)]
    assert with_terms(week.where("false"), False).count() == 0


def plain_smoothing(v, h, season):
    m, best = 7 if season else 0, None
    for a in smoothing.LEVELS:
        for b in smoothing.TRENDS:
            for g in smoothing.SEASONS if season else (0.0,):
                for d in smoothing.DAMPS:
                    level, trend, error = v[: m or 2].mean(), 0.0, 0.0
                    s = list(v[:m] - v[:m].mean()) if m else [0.0]
                    for t, x in enumerate(v):
                        at = t % len(s)
                        hoped = level + d * trend
                        error += (x - hoped - s[at]) ** 2 if t >= m else 0
                        new = a * (x - s[at]) + (1 - a) * hoped
                        trend, level = b * (new - level) + (1 - b) * d * trend, new
                        s[at] = g * (x - level) + (1 - g) * s[at] if m else 0.0
                    if best is None or error < best[0] - 1e-12:
                        best = error, [level + trend * sum(d**i for i in range(1, k + 1)) + s[(len(v) + k - 1) % len(s)] for k in range(1, h + 1)]
    return np.maximum(np.expm1(best[1]), 0)


@pytest.mark.parametrize("daily", [False, True])
def test_smoothing_equals_a_plain_loop(spark, daily):
    rng = np.random.default_rng(3)
    dates = DAYS if daily else WEEKS
    series = {"a": 50 + np.arange(80) * 0.5 + rng.normal(0, 4, 80), "b": 10.0 + (np.arange(80) % 7 == 5) * 20 + rng.random(80), "short": np.full(22, 5.0) + rng.random(22)}
    got = got_by(M.damped_holt_winters(tasks_of(spark, {k: series[k] for k in "ab"}, dates, 66, 14), daily, {}))
    for s in "ab":
        assert np.allclose(got[s], plain_smoothing(np.log1p(series[s][:66]), 14, daily), rtol=1e-6)
    few = got_by(M.damped_holt_winters(tasks_of(spark, {"short": series["short"]}, dates, 15, 7), daily, {}))["short"]
    assert np.allclose(few, plain_smoothing(np.log1p(series["short"][:15]), 7, False), rtol=1e-6)


def test_weeks_have_no_season_of_seven(spark):
    v = 10.0 + (np.arange(80) % 7 == 5) * 20
    weeks = got_by(M.damped_holt_winters(tasks_of(spark, {"a": v}, WEEKS, 66, 14), False, {}))["a"]
    days = got_by(M.damped_holt_winters(tasks_of(spark, {"a": v}, DAYS, 66, 14), True, {}))["a"]
    assert np.ptp(weeks) < 3 and np.allclose(days, v[66:], rtol=0.05)


def plain_orders(v, lags=2, long=autoregression.LONG):
    """Every order's criterion by plain regressions on the common sample."""
    solve = lambda x, y, s: np.linalg.solve(x.T @ x + s * np.eye(x.shape[1]), x.T @ y)
    out, n = {}, len(v)
    z = {0: v, 1: np.r_[np.nan, np.diff(v)]}
    shock = {}
    for d in (0, 1):
        x = np.array([[z[d][t - k] for k in range(1, long + 1)] + [1.0 - d] for t in range(long + 1, n)])
        y = z[d][long + 1 :]
        shock[d] = np.r_[np.full(long + 1, np.nan), y - x @ solve(x, y, 1e-3)]
    for p, d, q in autoregression.GRID:
        rows = range(long + 1 + lags, n)
        x = np.array([[z[d][t - k] if k <= p else 0 for k in range(1, lags + 1)] + [shock[d][t - k] if k <= q else 0 for k in range(1, lags + 1)] + [1.0 - d] for t in rows])
        y = z[d][long + 1 + lags :]
        off = y - x @ solve(x, y, 1e-4)
        out[f"({p},{d},{q})"] = len(y) * np.log((off**2).mean()) + 2 * (p + q + 1 - d + 1)
    return out


def test_orders_equal_plain_regressions_and_tell_forms_apart(spark):
    rng = np.random.default_rng(8)
    e = rng.normal(0, 0.3, 170)
    ar, walk = np.zeros(170), np.zeros(170)
    for t in range(1, 170):
        ar[t] = 0.5 * ar[t - 1] + e[t]
        walk[t] = walk[t - 1] + e[t] - 0.6 * e[t - 1]
    series = {"ar": np.expm1(6 + ar), "walk": np.expm1(6 + walk)}
    tasks = tasks_of(spark, series, WEEKS, 150, 10)
    told, best = {}, {}
    for r in autoregression.orders(tasks).collect():
        told.setdefault(r.series, {})[r.order] = r.aic
    for s, v in series.items():
        want = plain_orders(np.log1p(v[:150]))
        best[s] = min(want, key=want.get)
        assert want.keys() == told[s].keys() and all(abs(told[s][k] - want[k]) < 1e-6 * abs(want[k]) for k in want)
    detail = {r.series: r.detail for r in M.arima_aic(tasks, False, {}).select("series", "detail").distinct().collect()}
    assert detail == best and detail["ar"][3] == "0"
    walk = got_by(M.arima_aic(tasks, False, {"grid": ((0, 1, 1),)}))["walk"]
    assert np.allclose(walk, walk[0])  # a walk with shocks has one level ahead
    got = got_by(M.arima_aic(tasks, False, {}))
    assert abs(np.log1p(got["ar"][-1]) - 6) < 0.4  # a stationary series goes back to its mean
    assert M.arima_aic(tasks_of(spark, {"s": np.ones(30)}, WEEKS, 20, 5), False, {}).count() == 0


def wape(got, want):
    return np.abs(got - want).sum() / want.sum()


def test_panel_trees_help_both_series_with_a_shared_effect(spark):
    """Sales double in weeks with holidays; each series has the effect, and an off-season a year ago says nothing of it."""
    rng = np.random.default_rng(2)
    flat = tasks_of(spark, {"a": np.ones(156)}, WEEKS, 143, 13)
    special = np.array([r.special_days > 0 for r in with_terms(flat, False).orderBy("ds").collect()])
    series = {s: size * (1 + 1.0 * special) * np.exp(rng.normal(0, 0.1, 156)) for s, size in (("a", 100), ("b", 1000))}
    tasks = tasks_of(spark, series, WEEKS, 143, 13)
    trees = got_by(M.calendar_boosting(tasks, False, {}))
    simple = got_by(B.seasonal_naive(tasks))
    for s, v in series.items():
        assert wape(trees[s], v[143:]) < wape(simple[s], v[143:]), s


def test_hybrid_beats_its_base_on_an_interaction(spark):
    """Weekends matter only in the first half of a month: no sum of both terms says so."""
    rng = np.random.default_rng(4)
    x = np.array([d.weekday() >= 5 and d.day <= 15 for d in DAYS])
    series = {s: size * (1 + 2.0 * x) * np.exp(rng.normal(0, 0.05, len(DAYS))) for s, size in (("a", 50), ("b", 500), ("c", 200))}
    tasks = tasks_of(spark, series, DAYS, 170, 30)
    base, both = got_by(M.trend_season(tasks, True, {})), got_by(M.hybrid_residual_boosting(tasks, True, {}))
    for s, v in series.items():
        assert wape(both[s], v[170:]) < 0.9 * wape(base[s], v[170:])


def test_every_model_is_finite_and_follows_a_level(spark):
    tasks = tasks_of(spark, {"flat": np.full(150, 50.0), "waves": 100 + 20 * np.sin(np.arange(150) / 8)}, WEEKS, 140, 10)
    run = M.run_models(tasks)
    assert M.failures_of(run).count() == 0
    rows = run.collect()
    assert len(rows) == 2 * 10 * len(M.CATALOGUE)
    for r in rows:
        assert r.forecast >= 0 and (abs(r.forecast - 50) < 2 if r.series == "flat" else abs(r.forecast - 100) < 100), r


def test_failures_are_rows_and_leave_others_alone(spark):
    grouped = lambda name, f: M.ForecastModel(name, 9, "", "", f, grouped=True)
    frame = lambda name, f: M.ForecastModel(name, 9, "", "", f)
    half = lambda t, daily, p: B.naive(t).where("series = 'a'")
    models = [
        grouped("raises", lambda y, ds, future, p: 1 / 0), grouped("nan", lambda y, ds, future, p: np.full(len(future), np.nan)), grouped("short", lambda y, ds, future, p: [1.0]),
        grouped("good", lambda y, ds, future, p: np.full(len(future), -1.0)), frame("no column", lambda t, daily, p: t.select("nowhere")), frame("half", half),
        frame("late", lambda t, daily, p: t.where("is_test").select(*B.TASK, "ds", F.raise_error(F.lit("at run time")).cast("double").alias("forecast"))),
        frame("twice", lambda t, daily, p: B.naive(t).union(B.naive(t))),
    ]
    tasks = tasks_of(spark, {"a": np.full(45, 5.0), "b": np.full(45, 6.0)}, WEEKS, 40, 5)
    run = M.run_models(tasks, models)
    bad = {(r.model, r.series): r.error for r in M.failures_of(run).collect()}
    assert set(bad) == {(m, s) for m in ("raises", "nan", "short", "no column", "late", "twice") for s in "ab"} | {("half", "b")}
    assert "ZeroDivisionError" in bad["raises", "a"] and "one forecast for each date" in bad["short", "a"] and "finite" in bad["nan", "b"]
    good = M.forecasts_of(run).collect()
    assert sorted((r.model, r.series, r.forecast, r.actual) for r in good) == sorted([("good", s, 0.0, v) for s, v in (("a", 5.0), ("b", 6.0)) for _ in range(5)] + [("half", "a", 5.0, 5.0)] * 5)
    assert M.run_models(tasks, []).count() == 0 and M.run_models(tasks.where("false"), models[:1] + models[5:6]).count() == 0


def test_start_cuts_only_models_without_full_history(spark):
    v = np.r_[np.full(60, 1000.0), np.full(60, 10.0)]
    tasks = tasks_of(spark, {"a": v}, WEEKS, 110, 10)
    seen = M.ForecastModel("seen", 9, "", "", lambda y, ds, future, p: np.full(len(future), len(y)), grouped=True)
    whole = M.ForecastModel("whole", 9, "", "", seen.fn, full_history=True, grouped=True)
    got = {r.model: r.forecast for r in M.run_models(tasks, [seen, whole], start=WEEKS[100]).collect()}
    assert got == {"seen": 10, "whole": 110}
    assert M.failures_of(M.run_models(tasks, [seen, M.CATALOGUE[4]], start=WEEKS[115])).count() == 1  # smoothing has nothing left
