import datetime as dt
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans import backtest as B
from tidemark.plans import forecast as P

D = dt.date
WEEKS = [D(2021, 1, 4) + dt.timedelta(weeks=k) for k in range(150)]


def test_tasks_need_history_and_sales(spark):
    rows = [("L", "long", w, 1.0) for w in WEEKS[:40]] + [("L", "zero", w, 0.0) for w in WEEKS[:40]] + [("L", "short", w, 1.0) for w in WEEKS[20:40]]
    series = spark.createDataFrame(rows, "level string, series string, ds date, y double")
    tasks = B.make_backtest_tasks(series, [WEEKS[34], WEEKS[39]], horizon_days=35, min_hist=26)
    assert {(r.series, r.cutoff) for r in tasks.select("series", "cutoff").distinct().collect()} == {("long", WEEKS[34])}


def test_choice_prefers_the_simplest_within_tolerance(spark):
    rows = [("A", "naive", 10.4), ("A", "combination", 10.0), ("A", "seasonal_naive", 12.0), ("B", "naive", 10.6), ("B", "combination", 10.0), ("C", "own", 1.0), ("C", "naive", None)]
    ranked = B.choose_parsimonious(spark.createDataFrame(rows, "level string, model string, wape double"))
    assert {(r.level, r.model) for r in ranked.where("chosen").collect()} == {("A", "naive"), ("B", "combination"), ("C", "own")}
    said = {r.level: r.justification for r in B.justify_choice(ranked).collect()}
    assert "Com combination o erro seria de 10.0%" in said["A"] and "1.6 pontos abaixo" in said["A"]


def test_months_of_weeks_by_days(spark):
    df = spark.createDataFrame([("s", D(2024, 1, 29), 70.0), ("s", D(2024, 2, 5), 7.0)], "series string, ds date, forecast double")
    got = {r.month: r.forecast for r in P.week_to_month(df, ["series"]).collect()}
    assert got == {D(2024, 1, 1): 30.0, D(2024, 2, 1): 47.0}


def test_reconciled_levels_meet_the_target(spark):
    rows = [("Total", "Total", 100.0), ("Marca", "a", 30.0), ("Marca", "b", 90.0)]
    monthly = spark.createDataFrame([(a, b, D(2024, 1, 1), v) for a, b, v in rows], "level string, series string, month date, forecast double")
    got = P.reconcile_to_total(monthly, P.reconciliation_target(monthly.where("level = 'Total'"))).groupBy("level").agg(F.sum("reconciled").alias("r"), F.sum("share_pct").alias("p")).collect()
    assert all(abs(r.r - 100) < 1e-9 and abs(r.p - 100) < 1e-9 for r in got)


def test_bias_needs_three_months_and_is_limited(spark):
    rows = [(D(2024, k, 1), 1, e, e) for k, e in ((1, 0.5), (2, 0.5), (3, 0.5))] + [(D(2024, 3, 1), 0, 9.0, 9.0)]
    judged = spark.createDataFrame(rows, "target_month date, horizon int, orders_error double, revenue_error double")
    assert tuple(P.bias_factors(judged).first()) == (3, 0.85, 0.85)
    assert tuple(P.bias_factors(judged.where("target_month < '2024-03-01'")).first()) == (2, 1.0, 1.0)
    assert tuple(P.bias_factors(judged.where("false")).first()) == (0, 1.0, 1.0)


def test_top_down_follows_the_parent_choice_by_generations(spark):
    """Grandchildren are split from what their parent level chose after its own top-down rows were in."""
    weeks = [date(2020, 1, 6) + timedelta(weeks=k) for k in range(80)]
    rows = [("Total", "Total", w, 100.0 + k) for k, w in enumerate(weeks)] + [("L1", s, w, (100.0 + k) * p) for k, w in enumerate(weeks) for s, p in (("a", 0.25), ("b", 0.75))] + [("L2", "x", w, (100.0 + k) * 0.1) for k, w in enumerate(weeks)]
    series = spark.createDataFrame(rows, "level string, series string, ds date, y double")
    of = spark.createDataFrame([("L1", "a", "Total"), ("L1", "b", "Total"), ("L2", "x", "a"), ("L2", "no such", "a")], "level string, child string, parent string")
    cutoffs = [weeks[60], weeks[66]]
    tasks = B.make_backtest_tasks(series, cutoffs, horizon_days=91, min_hist=26)
    got = B.with_top_down(B.naive(tasks), tasks, series, of, ({"L1": "Total"}, {"L2": "L1"}), B.cutoff_table(series, cutoffs))
    down = {(r.level, r.series, r.cutoff, r.ds): r.forecast for r in got.where("model = 'top_down'").collect()}
    assert {k[:2] for k in down} == {("L1", "a"), ("L1", "b"), ("L2", "x")}
    assert down["L1", "a", weeks[60], weeks[61]] == pytest.approx(160 * 0.25) and down["L2", "x", weeks[66], weeks[70]] == pytest.approx(16.6)
    final = {(r.level, r.series): r.model for r in P.forecast_levels(series, [weeks[-1] + timedelta(weeks=1)], B.choose_parsimonious(B.accuracy_metrics(B.to_monthly(got))), got, of, ({"L1": "Total"}, {"L2": "L1"}), models=()).collect()}
    assert set(final) == {("Total", "Total"), ("L1", "a"), ("L1", "b"), ("L2", "x")}
