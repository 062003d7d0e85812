"""Queries of backtests, model choice and forecasts."""

from __future__ import annotations

import itertools
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators import cubes as C
from tidemark.operators import kpis as K
from tidemark.plans import backtest as T
from tidemark.plans import models as M
from tidemark.plans import forecast as P
from tidemark.plans.models import smoothing
from tidemark.queries.base import CANON, Base
from tidemark.queries.products import CALENDAR, LABELLED, _cube
from tidemark.queries.sales import DAILY, MONTHLY, _daily, _money, _monthly, _query, _ratio
from tidemark.sources.stages import settle

END = date(2001, 7, 23)
CUTOFFS = tuple(END - timedelta(weeks=k) for k in (26, 20, 13))
DATES = [END + timedelta(weeks=k) for k in range(1, 22)]
#: Series of a level that stay by themselves (the rest are one), and the levels that can be split from another one, parents first.
TOP = {"UF": 10, "Marca": 12, "Produto": 25, "Subgrupo": 15}
GENERATIONS = ({"UF": "Regiao", "Subgrupo": "Grupo", "Marca": "Total"}, {"Produto": "Subgrupo"})
PARENTS = {child: parent for level_of in GENERATIONS for child, parent in level_of.items()}
#: Models that do not ask for all history learn from here on.
TRAIN_START = date(1999, 1, 4)
DAILY_END = date(2001, 7, 15)
DAILY_CUTOFFS = (date(2000, 4, 30), date(2000, 7, 31), date(2000, 10, 31), date(2001, 1, 14))


def weekly_series(b: Base):
    """(level, series, ds, y): weekly revenue without extremes of all levels, dense, up to the last complete week."""

    def make():
        levels = settle(C.aggregate_levels(_cube(b, "full")).where(F.col("week") <= F.lit(END)).select("level", "series", "week", "revenue"))
        most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOP.items() for x in kv]), F.col("level")), F.lit(1 << 30))
        kept = settle(C.informative_levels(settle(C.top_n_plus_others(levels, most))))
        return C.densify(kept, ["level", "series"], ["revenue"]).select("level", "series", F.col("week").alias("ds"), F.col("revenue").cast("double").alias("y"))

    return b.kept("series", make)


def _tasks(b: Base):
    return b.kept("tasks", lambda: T.make_backtest_tasks(weekly_series(b), CUTOFFS, horizon_days=91, end=END, min_hist=26))


def _basic(b: Base):
    return b.kept("baselines", lambda: T.baselines(_tasks(b)))


def _parents(b: Base):
    """(level, child, parent) of all levels that have a parent: the one with most of the child's revenue; Total of all but OUTROS."""

    def make():
        cube = b.kept("full_cube", lambda: _cube(b, "full").where("not is_extreme"))
        parts = []
        for child, parent in PARENTS.items():
            if C.LEVELS[parent]:
                of = T.child_to_parent_map(cube, C.LEVELS[child], C.LEVELS[parent])
            else:
                of = weekly_series(b).where((F.col("level") == child) & (F.col("series") != C.OTHERS)).select(F.col("series").alias("child"), F.lit(parent).alias("parent")).distinct()
            parts.append(of.select(F.lit(child).alias("level"), "child", "parent"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return b.kept("parents", make)


def _with_all(b: Base, rows):
    """Forecasts of single models, their combination and what parents give."""
    both = settle(rows.unionByName(T.combine_top(rows)))
    s = weekly_series(b)
    return T.with_top_down(both, _tasks(b), s, _parents(b), GENERATIONS, T.cutoff_table(s, CUTOFFS))


def _simple(b: Base):
    """The models that SQL can follow."""
    return b.kept("simple", lambda: _with_all(b, _basic(b)))


def _run(b: Base):
    """All models over all tasks, with failures."""
    return b.shared("run", lambda: M.run_models(_tasks(b), start=TRAIN_START))


def _full(b: Base):
    """All models."""
    return b.kept("full", lambda: _with_all(b, M.forecasts_of(_run(b))))


def _stumped(b: Base):
    """The run with two plug-ins that fail for some or all series, beside one that does not."""
    short = M.ForecastModel("steady_only", 9, "plug-in", "Só séries estáveis.", _steady, grouped=True)
    broken = M.ForecastModel("broken", 9, "plug-in", "Não roda.", lambda tasks, daily, p: tasks.select("no such column"))
    return M.failures_of(M.run_models(_tasks(b), [M.CATALOGUE[0], short, broken]))


def _steady(y, ds, future, p):
    """The mean of the last 13 points, for series that have sales in each of them."""
    if not (y[-13:] > 0).all():
        raise ValueError("weeks without sales")
    return [y[-13:].mean()] * len(future)


def _by_month(b: Base, rows=_simple):
    return b.kept(f"by_month{rows.__name__}", lambda: T.to_monthly(rows(b)))


def _ranked(b: Base, rows=_simple):
    return b.kept(f"ranked{rows.__name__}", lambda: T.choose_parsimonious(T.accuracy_metrics(_by_month(b, rows))))


def _shares(b: Base):
    s, of = weekly_series(b), _parents(b)
    out = None
    for child, parent in PARENTS.items():
        at = lambda df, level: df.where(F.col("level") == level)
        part = T.recent_share(at(s, child), at(s, parent), at(of, child).select("child", "parent"), T.cutoff_table(s, CUTOFFS)).withColumn("level", F.lit(child))
        out = part if out is None else out.unionByName(part)
    return out


def _final(b: Base):
    return b.kept("final", lambda: P.forecast_levels(weekly_series(b), DATES, _ranked(b, _full), _full(b), _parents(b), GENERATIONS, start=TRAIN_START))


def _granular(b: Base):
    bands = T.empirical_band(_by_month(b, _full))
    return P.granular_forecast(_final(b), weekly_series(b), bands, date(2001, 7, 1), date(2001, 8, 1), "v1", _headline(b))


def _base_monthly(b: Base):
    return b.kept("base_monthly", lambda: K.with_base_revenue(_monthly(b)).where("complete"))


def _history(b: Base):
    """A history of runs: what the month a year before would have said, with a bias of 8 %."""
    m = _base_monthly(b)
    runs = m.select(F.add_months("month", 12).alias("target_month"), (F.col("orders") * 1.08).alias("orders_raw"), (F.col("base_revenue") * 1.08).alias("revenue_raw"))
    return runs.where(F.col("target_month") >= F.lit(date(2000, 6, 1))).select(F.date_sub("target_month", 20).alias("run_date"), "target_month", F.lit(1).alias("horizon"), "orders_raw", "revenue_raw", F.col("revenue_raw").alias("revenue_final"))


def _judged(b: Base):
    return P.judged_history(_history(b), _base_monthly(b), date(2001, 7, 1))


def _daily_series(b: Base):
    daily = b.kept("daily", lambda: _daily(b)).select(F.lit("Total").alias("level"), F.lit("Total").alias("series"), "ds", F.col("orders").cast("double").alias("y"))
    return daily.where(F.col("ds") <= F.lit(DAILY_END))


def _daily_backtest(b: Base, models=M.CATALOGUE):
    def make():
        tasks = settle(T.make_backtest_tasks(_daily_series(b), DAILY_CUTOFFS, horizon_months=6, end=DAILY_END))
        rows = settle(P.all_models(tasks, models, daily=True, start=TRAIN_START))
        return rows.unionByName(T.combine_top(rows))

    return (b.shared if models else b.kept)(f"daily_backtest{len(models)}", make)


def _daily_ranked(b: Base, models=M.CATALOGUE):
    return b.kept(f"daily_ranked{len(models)}", lambda: T.choose_parsimonious(T.accuracy_metrics(T.to_monthly(_daily_backtest(b, models)))))


def _headline(b: Base, models=M.CATALOGUE):
    """Orders of the model that the daily backtest chooses, times the ticket. No models: of the baselines alone."""

    def make():
        m = _base_monthly(b)
        days = [DAILY_END + timedelta(days=1 + k) for k in range(108)]
        ahead = P.forecast_chosen(_daily_series(b), days, _daily_ranked(b, models), _daily_backtest(b, models), models, daily=True, start=TRAIN_START)
        orders = ahead.groupBy(F.trunc("ds", "month").alias("month")).agg(F.sum("forecast").alias("orders"))
        bands = T.empirical_band(T.chosen_rows(T.to_monthly(_daily_backtest(b, models)), _daily_ranked(b, models))).select("horizon", "band")
        raw = P.monthly_revenue_forecast(orders, P.ticket_forecast(m, 4), bands, m, P.expected_extremes(m), date(2001, 7, 1), DAILY_END)
        return P.apply_bias_and_bands(raw, _judged(b))

    return b.kept(f"headline{len(models)}", make)


def _record(b: Base, models=M.CATALOGUE):
    model = _daily_ranked(b, models).where("chosen").first()["model"]  # one row
    return P.run_record(_headline(b, models), date(2001, 8, 1), "v1", model)


def _rounded(rows):
    """Money without cents, factors and percentages to six places: what two engines' sums agree on."""
    fine = ("orders_factor", "revenue_factor", "orders_change_pct")
    return rows.select(*[F.round(c, 6 if c in fine else 0).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


RECENT = "CASE WHEN week > last - 182 THEN rev ELSE 0 END"
SERIES = f"""{LABELLED}, per AS (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS level, {dim or chr(39) + 'Total' + chr(39)} AS series, week, sum(rev) AS rev FROM before WHERE NOT is_extreme GROUP BY ALL" for name, dim in C.LEVELS.items()
) + f"""), upto AS MATERIALIZED (SELECT * FROM per WHERE week <= DATE '2001-07-23'), lastweek AS (SELECT max(week) AS last FROM upto),
score AS (SELECT level, series, sum({RECENT}) AS score FROM upto, lastweek GROUP BY ALL),
named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY level ORDER BY score DESC, series) <= CASE level {' '.join(f"WHEN '{k}' THEN {n}" for k, n in TOP.items())} ELSE 1000000000 END THEN series ELSE 'OUTROS' END AS name FROM score),
alive AS (SELECT level, name FROM named GROUP BY ALL HAVING sum(score) > 0),
summed AS (SELECT level, name AS series, week, sum(rev) AS rev FROM upto JOIN named USING (level, series) JOIN alive USING (level, name) GROUP BY ALL),
kept AS (SELECT * FROM summed WHERE level IN (SELECT level FROM summed GROUP BY level HAVING count(DISTINCT series) FILTER (WHERE NOT regexp_matches(series, '^SEM_(INFO|GRUPO|SUBGRUPO|MARCA)')) >= 2 OR level = 'Total')),
sp AS (SELECT CAST(unnest(generate_series((SELECT min(week) FROM kept), (SELECT max(week) FROM kept), INTERVAL 7 DAY)) AS DATE) AS ds),
series AS MATERIALIZED (SELECT level, series, ds, coalesce({_money('rev')}, 0) AS y FROM (SELECT DISTINCT level, series FROM kept) CROSS JOIN sp LEFT JOIN (SELECT level, series, week AS ds, rev FROM kept) USING (level, series, ds)),
cut AS (SELECT unnest([{', '.join(f"DATE '{c}'" for c in CUTOFFS)}]) AS cutoff),
t0 AS (SELECT level, series, cutoff, ds, y, ds > cutoff AS is_test FROM series, cut WHERE ds <= least(cutoff + 91, DATE '2001-07-23')),
tasks AS MATERIALIZED (SELECT * FROM t0 WINDOW k AS (PARTITION BY level, series, cutoff) QUALIFY count(*) FILTER (WHERE NOT is_test) OVER k >= 26 AND sum(CASE WHEN is_test THEN 0 ELSE y END) OVER k > 0 AND count(*) FILTER (WHERE is_test) OVER k > 0),
back AS (SELECT *, row_number() OVER (PARTITION BY level, series, cutoff ORDER BY ds DESC) AS back FROM tasks WHERE NOT is_test),
stats AS (SELECT level, series, cutoff, avg(y) FILTER (WHERE back <= 1) AS last, avg(y) FILTER (WHERE back <= 8) AS mean, count(*) AS n, sum(CASE WHEN back <= 8 THEN y ELSE 0 END) AS now8, sum(CASE WHEN back BETWEEN 53 AND 60 THEN y ELSE 0 END) AS then8 FROM back GROUP BY ALL),
test AS MATERIALIZED (SELECT t.*, (year(t.ds) - year(t.cutoff)) * 12 + month(t.ds) - month(t.cutoff) AS horizon, coalesce(b.y, s.last) AS base, last, mean, CASE WHEN n >= 60 AND then8 > 0 THEN least(greatest(now8 / then8, 0.5), 2.0) ELSE 1.0 END AS factor
    FROM tasks t JOIN stats s USING (level, series, cutoff) LEFT JOIN back b ON b.level = t.level AND b.series = t.series AND b.cutoff = t.cutoff AND b.ds = t.ds - 364 WHERE t.is_test),
basic AS MATERIALIZED (SELECT level, series, cutoff, ds, 'naive' AS model, greatest(last, 0) AS forecast, y AS actual, horizon FROM test UNION ALL SELECT level, series, cutoff, ds, 'moving_average', greatest(mean, 0), y, horizon FROM test
    UNION ALL SELECT level, series, cutoff, ds, 'seasonal_naive', greatest(base, 0), y, horizon FROM test UNION ALL SELECT level, series, cutoff, ds, 'seasonal_growth', greatest(base * factor, 0), y, horizon FROM test),
err AS (SELECT level, series, cutoff, model, sum(abs(forecast - actual)) AS ae, sum(actual) AS r FROM basic GROUP BY ALL),
oth AS (SELECT c.level, c.series, c.cutoff, e.model, sum(e.ae) AS ae, sum(e.r) AS r FROM (SELECT DISTINCT level, series, cutoff FROM err) c JOIN err e ON e.level = c.level AND e.series = c.series AND e.cutoff <> c.cutoff GROUP BY ALL),
wt AS (SELECT *, 1 / greatest(ae / greatest(r, 1e-9), 1e-6) AS w FROM oth QUALIFY row_number() OVER (PARTITION BY level, series, cutoff ORDER BY round(greatest(ae / greatest(r, 1e-9), 1e-6), 9), model) <= 3),
comb AS (SELECT level, series, cutoff, ds, 'combination' AS model, sum(forecast * w) / sum(w) AS forecast, max(actual) AS actual, max(horizon) AS horizon FROM basic JOIN wt USING (level, series, cutoff, model) GROUP BY ALL),
simple0 AS MATERIALIZED (SELECT * FROM basic UNION ALL SELECT * FROM comb)"""


def _rank_sql(rows: str, tag: str = "") -> str:
    """Months, errors and ranking of the forecasts in `rows`."""
    return f"""months{tag} AS MATERIALIZED (SELECT level, series, cutoff, model, CAST(date_trunc('month', ds) AS DATE) AS month, sum(forecast) AS forecast, sum(actual) AS actual, max(horizon) AS horizon FROM {rows} GROUP BY ALL),
acc{tag} AS (SELECT level, model, {_ratio('sum(abs(forecast - actual))', 'sum(actual)')} * 100 AS wape, avg(CASE WHEN actual > 0 THEN abs(forecast - actual) / actual END) * 100 AS mape, ({_ratio('sum(forecast)', 'sum(actual)')} - 1) * 100 AS bias, count(*) AS n FROM months{tag} GROUP BY ALL),
rk0{tag} AS (SELECT *, CAST(CASE model WHEN 'seasonal_growth' THEN 1 WHEN 'combination' THEN 6 WHEN 'top_down' THEN 6 ELSE 0 END AS INT) AS complexity, min(wape) OVER (PARTITION BY level) AS best,
    max(CASE WHEN model = 'seasonal_naive' THEN wape END) OVER (PARTITION BY level) - wape AS gain FROM acc{tag}),
rk1{tag} AS (SELECT *, wape <= best * 1.05 AS eligible FROM rk0{tag}),
ranked{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY level ORDER BY eligible DESC, complexity, round(wape, 9), model) = 1 AS chosen FROM rk1{tag})"""


SHARES = ", cp AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{c}' AS level, child, arg_max(parent, (m, parent)) AS parent FROM (SELECT {C.LEVELS[c]} AS child, {C.LEVELS[p]} AS parent, {_money('sum(rev)')} AS m FROM before WHERE NOT is_extreme GROUP BY ALL) GROUP BY 2" if C.LEVELS[p]
    else f"SELECT DISTINCT '{c}', series, '{p}' FROM series WHERE level = '{c}' AND series <> 'OUTROS'" for c, p in PARENTS.items()
) + f"""), tot AS (SELECT level, series, cutoff, sum(y) AS s FROM series, cut WHERE ds <= cutoff AND ds > cutoff - 91 GROUP BY ALL),
shares AS MATERIALIZED (SELECT cp.level, child, cp.parent, p.level AS parent_level, p.cutoff, CASE WHEN p.s > 0 THEN coalesce(c.s, 0) / p.s ELSE 0 END AS share FROM cp
    JOIN tot p ON p.series = parent AND p.level = CASE cp.level {' '.join(f"WHEN '{c}' THEN '{p}'" for c, p in PARENTS.items())} END LEFT JOIN tot c ON c.level = cp.level AND c.series = child AND c.cutoff = p.cutoff)"""
TREE = SERIES + SHARES + "".join(
    f""", {_rank_sql(f'simple{g}', str(g))}, td{g} AS (SELECT t.level, t.series, t.cutoff, t.ds, 'top_down' AS model, greatest(p.forecast * share, 0) AS forecast, t.y AS actual, t.horizon FROM test t
    JOIN shares s ON s.level = t.level AND s.child = t.series AND s.cutoff = t.cutoff JOIN simple{g} p ON p.level = s.parent_level AND p.series = s.parent AND p.cutoff = t.cutoff AND p.ds = t.ds
    JOIN ranked{g} r ON r.chosen AND r.level = p.level AND r.model = p.model WHERE t.level IN ({', '.join(f"'{c}'" for c in level_of)})),
simple{g + 1} AS MATERIALIZED (SELECT * FROM simple{g} UNION ALL SELECT * FROM td{g})""" for g, level_of in enumerate(GENERATIONS)
) + f", simple AS (SELECT * FROM simple{len(GENERATIONS)}), {_rank_sql('simple')}"
BASEM = f"""{MONTHLY}, bm AS (SELECT *, revenue - coalesce(extreme_revenue, 0) AS base_revenue FROM monthly WHERE complete),
hist AS (SELECT CAST(month + INTERVAL 12 MONTH AS DATE) AS target_month, orders * 1.08 AS orders_raw, base_revenue * 1.08 AS revenue_raw FROM bm WHERE month + INTERVAL 12 MONTH >= DATE '2000-06-01'),
judged AS (SELECT h.*, 1 AS horizon, target_month - 20 AS run_date, h.orders_raw / bm.orders - 1 AS orders_error, h.revenue_raw / bm.base_revenue - 1 AS revenue_error, bm.base_revenue AS revenue_actual FROM hist h JOIN bm ON bm.month = target_month WHERE target_month < DATE '2001-07-01')"""

TASK_COLUMNS = "level, series, cutoff"
NUMBERED = f"""numbered AS MATERIALIZED (SELECT {TASK_COLUMNS}, ds, is_test, ln(1 + greatest(CAST(y AS DOUBLE), 0)) AS z, row_number() OVER (PARTITION BY {TASK_COLUMNS}, is_test ORDER BY ds) AS t FROM tasks)"""


def _smoothing_sql(rows: str = "numbered", tag: str = "") -> str:
    """The damped trend without a season, all factors side by side, one point after the other."""
    grid = ", ".join(f"({i}, {a}, {b}, {d})" for i, (a, b, d) in enumerate(itertools.product(smoothing.LEVELS, smoothing.TRENDS, smoothing.DAMPS)))
    return f"""grid{tag}(i, a, b, d) AS (VALUES {grid}),
fold{tag} AS (SELECT {TASK_COLUMNS}, i, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(d AS DOUBLE) AS d, CAST(0 AS BIGINT) AS t, avg(z) FILTER (WHERE t <= 2) AS lv, CAST(0 AS DOUBLE) AS tr, CAST(0 AS DOUBLE) AS err
        FROM {rows}, grid{tag} WHERE NOT is_test GROUP BY {TASK_COLUMNS}, i, a, b, d
    UNION ALL SELECT f.level, f.series, f.cutoff, i, a, b, d, v.t, a * z + (1 - a) * (lv + d * tr), b * (a * z + (1 - a) * (lv + d * tr) - lv) + (1 - b) * d * tr, err + (z - (lv + d * tr)) * (z - (lv + d * tr))
        FROM fold{tag} f JOIN {rows} v ON v.level = f.level AND v.series = f.series AND v.cutoff = f.cutoff AND v.t = f.t + 1 AND NOT v.is_test),
best{tag} AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY {TASK_COLUMNS}) AS n FROM fold{tag}) WHERE t = n QUALIFY row_number() OVER (PARTITION BY {TASK_COLUMNS} ORDER BY err, i) = 1),
smooth{tag} AS (SELECT r.level, r.series, r.cutoff, r.ds, r.t AS h, lv + tr * d * (1 - d ** r.t) / (1 - d) AS z FROM {rows} r JOIN best{tag} b USING ({TASK_COLUMNS}) WHERE r.is_test)"""


def _waves_sql(order: int) -> str:
    return ", ".join(f"{f}({k} * 2 * pi() * (dayofyear(ds) + 3) / 365.25)" for k in range(1, order + 1) for f in ("sin", "cos"))


def _regression_sql(x: str, strength: list[float]) -> str:
    """Weekly rows with calendar terms, sums of products, and elimination; `fitted` has each row's fit."""
    size, es = len(strength), "special_days, black_friday, year_end"
    held = "[" + ", ".join(f"{s:.10f}" for s in strength) + "]"
    own = f"PARTITION BY {TASK_COLUMNS}"
    return f"""{NUMBERED}, {CALENDAR[5:]},
terms AS (SELECT CAST(date_trunc('week', ds) AS DATE) AS ds, count(*) FILTER (WHERE is_holiday) AS special_days, max(CAST(is_black_friday AS INT)) AS black_friday, max(CAST(is_year_end AS INT)) AS year_end FROM cal GROUP BY 1),
placed AS (SELECT r.*, {', '.join(f"coalesce({e}, 0) AS {e}" for e in es.split(', '))}, min(ds) FILTER (WHERE NOT is_test) OVER ({own}) AS t0, greatest(max(ds) FILTER (WHERE NOT is_test) OVER ({own}) - t0, 1) AS span FROM numbered r LEFT JOIN terms USING (ds)),
rows AS MATERIALIZED (SELECT {TASK_COLUMNS}, ds, is_test, z, t, CAST([{x}] AS DOUBLE[]) AS x FROM placed),
sums AS (SELECT {TASK_COLUMNS}, i, j, sum(x[i] * x[j]) + CASE WHEN i = j THEN any_value({held}[i]) ELSE 0 END AS s, sum(x[i] * z) AS xz FROM rows, range(1, {size + 1}) a(i), range(1, {size + 1}) b(j) WHERE NOT is_test GROUP BY {TASK_COLUMNS}, i, j),
matrix AS (SELECT {TASK_COLUMNS}, list(r ORDER BY i) AS m FROM (SELECT {TASK_COLUMNS}, i, list_append(list(s ORDER BY j), any_value(xz)) AS r FROM sums GROUP BY {TASK_COLUMNS}, i) GROUP BY {TASK_COLUMNS}),
cleared AS (SELECT {TASK_COLUMNS}, 0 AS k, m FROM matrix UNION ALL
    SELECT {TASK_COLUMNS}, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda q: q / m[k + 1][k + 1]) ELSE list_transform(r, lambda q, j: q - r[k + 1] * (m[k + 1][j] / m[k + 1][k + 1])) END) FROM cleared WHERE k < {size}),
weights AS MATERIALIZED (SELECT {TASK_COLUMNS}, list_transform(m, lambda r: r[{size + 1}]) AS w FROM cleared WHERE k = {size}),
fitted AS (SELECT r.*, list_sum(list_transform(list_zip(x, w), lambda q: q[1] * q[2])) AS fit FROM rows r JOIN weights USING ({TASK_COLUMNS}))"""


EVENT_TERMS = "special_days, black_friday, year_end"
CALENDAR_X = f"1, {_waves_sql(3)}, {EVENT_TERMS}, (ds - cutoff) / 365.25"
TREND_X = f"1, (ds - t0) / span, {', '.join(f'greatest((ds - t0) / span - {0.8 * (k + 1) / 13!r}, 0)' for k in range(12))}, {EVENT_TERMS}, " + ", ".join(f"CASE WHEN span >= 547 THEN {w} ELSE 0 END" for w in _waves_sql(6).split(", "))
LOGGED = "SELECT level, series, cutoff, ds, round(least(greatest({z}, 0), 50), 4) AS log_forecast"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _logged(rows):
    """Forecasts as rounded logs, in which two engines' sums agree."""
    return rows.select(*T.TASK, "ds", F.round(F.log1p("forecast"), 4).alias("log_forecast"))


QUERIES = {
    "weekly_series": _query(weekly_series),
    "backtest_tasks": _query(_tasks),
    "naive": _query(lambda b: T.naive(_tasks(b))),
    "moving_average": _query(lambda b: T.moving_average(_tasks(b), 8)),
    "seasonal_naive": _query(lambda b: T.seasonal_naive(_tasks(b))),
    "seasonal_growth": _query(lambda b: T.seasonal_growth(_tasks(b), 52, 8)),
    "combination": _query(lambda b: T.combine_top(_basic(b))),
    "monthly_backtest": _query(lambda b: _by_month(b)),
    "accuracy_metrics": _query(lambda b: T.accuracy_metrics(_by_month(b))),
    "accuracy_by_horizon": _query(lambda b: T.accuracy_metrics(_by_month(b), ("level", "model", "horizon"))),
    "model_choice": _query(_ranked),
    "choice_reasons": _query(lambda b: T.justify_choice(_ranked(b))),
    "level_benchmark": _query(lambda b: T.level_benchmark_table(_ranked(b))),
    "empirical_band": _query(lambda b: T.empirical_band(_by_month(b))),
    "bottom_up_coherence": _query(lambda b: T.bottom_up_coherence(T.chosen_rows(_by_month(b), _ranked(b)), T.chosen_rows(_by_month(b), _ranked(b)).where(F.col("level") == "Total"))),
    "child_to_parent": _query(_parents),
    "recent_share": _query(_shares),
    "top_down": _query(lambda b: _simple(b).where(F.col("model") == T.TOP_DOWN)),
    "week_to_month": _query(lambda b: P.week_to_month(weekly_series(b), ["level", "series"], "y")),
    "monthly_actuals": _query(lambda b: P.monthly_actuals(weekly_series(b), b.options.as_of)),
    "expected_extremes": _query(lambda b: P.expected_extremes(_base_monthly(b))),
    "judged_history": _query(lambda b: _judged(b).select("target_month", "orders_error", "revenue_error")),
    "history_bias": _query(lambda b: P.history_bias(_judged(b))),
    "bias_factors": _query(lambda b: P.bias_factors(_judged(b))),
    "forecast_accuracy": _query(lambda b: P.forecast_accuracy_report(_history(b), _base_monthly(b)).select("target_month", "revenue_actual", "error_pct")),
    "damped_holt_winters": _query(lambda b: _logged(M.damped_holt_winters(_tasks(b), False, {}))),
    "calendar_regression": _query(lambda b: _logged(M.calendar_regression(_tasks(b), False, {}))),
    "trend_season_regression": _query(lambda b: _logged(M.trend_season(_tasks(b), False, {}))),
    "fitted_models": _query(_run),
    "fit_failures": _query(_stumped),
    "ticket_forecast": _query(lambda b: P.ticket_forecast(_base_monthly(b), 4).withColumn("ticket", F.round("ticket", 4))),
    "full_model_choice": _query(lambda b: _ranked(b, _full)),
    "full_level_benchmark": _query(lambda b: T.level_benchmark_table(_ranked(b, _full))),
    "daily_model_choice": _query(_daily_ranked),
    "chosen_forecast": _query(_final),
    "granular_forecast": _query(_granular),
    "actuals_and_forecasts": _query(lambda b: P.actuals_and_forecasts(P.monthly_actuals(weekly_series(b), b.options.as_of), _granular(b), "Marca")),
    "headline_forecast": _query(_headline),
    "headline_explained": _query(lambda b: P.explain_forecast(_headline(b))),
    "simple_headline_forecast": _query(lambda b: _rounded(_headline(b, ()))),
    "simple_headline_explained": _query(lambda b: P.explain_forecast(_headline(b, ()))),
    "simple_run_record": _query(lambda b: _rounded(_record(b, ()))),
    "simple_run_history": _query(lambda b: _rounded(P.append_run(_history(b), _record(b, ())).select("run_date", "target_month", "horizon", "revenue_final"))),
    "run_record": _query(_record),
    "run_history": _query(lambda b: P.append_run(_history(b), _record(b)).select("run_date", "target_month", "horizon", "revenue_final")),
}
S, R = f"{CANON}{SERIES}", f"{CANON}{TREE}"
TICKETS = f"""tm AS (SELECT month AS ds, base_revenue / (orders - coalesce(extreme_orders, 0)) AS y FROM bm),
tn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ds) AS n, count(*) OVER () AS c FROM tm WHERE y > 0),
cuts AS (SELECT n AS known, ds AS cutoff, n = c AS final FROM tn WHERE n = c OR (n >= greatest(c - 4, 6) AND n < c)),
numbered AS MATERIALIZED (SELECT 'Ticket' AS level, known AS series, cutoff, ds, n > known AS is_test, ln(y) AS z, y, CASE WHEN n > known THEN 1 ELSE n END AS t, final FROM tn JOIN cuts ON n <= CASE WHEN final THEN known ELSE known + 1 END
    UNION ALL SELECT 'Ticket', known, cutoff, CAST(cutoff + to_months(CAST(h AS INT)) AS DATE), TRUE, NULL, NULL, h, TRUE FROM cuts, range(1, 5) r(h) WHERE final), {_smoothing_sql()},
means AS (SELECT series, avg(y) FILTER (WHERE t > series - 3) AS mean_3, avg(y) FILTER (WHERE t > series - 6) AS mean_6 FROM numbered WHERE NOT is_test GROUP BY 1),
made AS (SELECT s.series, h, exp(s.z) AS damped_trend, mean_3, mean_6, y AS actual FROM smooth s JOIN means USING (series) JOIN numbered q ON q.series = s.series AND q.ds = s.ds AND q.is_test),
errs AS (SELECT coalesce(avg(abs(mean_3 / actual - 1)), 'inf') AS e3, coalesce(avg(abs(mean_6 / actual - 1)), 'inf') AS e6, coalesce(avg(abs(damped_trend / actual - 1)), 'inf') AS e FROM made WHERE actual IS NOT NULL),
best_method AS (SELECT CASE WHEN e < least(e3, e6) * 0.95 THEN 'damped_trend' WHEN e6 < e3 THEN 'mean_6' ELSE 'mean_3' END AS method FROM errs),
tickets AS (SELECT CAST(h - 1 AS INT) AS step, CASE method WHEN 'damped_trend' THEN damped_trend WHEN 'mean_6' THEN mean_6 ELSE mean_3 END AS ticket, method FROM made, best_method WHERE actual IS NULL)"""


def _daily_baselines(rows: str, known: str) -> str:
    """Four baselines by days; rows: what is forecast, known: what is known, with `back`, both by cutoff."""
    return f"""(SELECT cutoff, ds, y, unnest(['naive', 'moving_average', 'seasonal_naive', 'seasonal_growth']) AS model, unnest([greatest(l7, 0), greatest(l28, 0), greatest(base, 0), greatest(base * factor, 0)]) AS forecast FROM (
    SELECT r.cutoff, r.ds, r.y, l7, l28, coalesce(k.y, l7) AS base, CASE WHEN n >= 420 AND then56 > 0 THEN least(greatest(now56 / then56, 0.5), 2.0) ELSE 1.0 END AS factor FROM {rows} r
    JOIN (SELECT cutoff, count(*) AS n, avg(y) FILTER (WHERE back <= 7) AS l7, avg(y) FILTER (WHERE back <= 28) AS l28, sum(CASE WHEN back <= 56 THEN y ELSE 0 END) AS now56, sum(CASE WHEN back BETWEEN 365 AND 420 THEN y ELSE 0 END) AS then56 FROM {known} GROUP BY 1) s USING (cutoff)
    LEFT JOIN {known} k ON k.cutoff = r.cutoff AND k.ds = r.ds - 364))"""


HEADLINE = f"""{BASEM}{DAILY}, {TICKETS}, dy AS MATERIALIZED (SELECT ds, CAST(orders AS DOUBLE) AS y FROM daily WHERE ds <= DATE '{DAILY_END}'),
dcut AS (SELECT unnest([{', '.join(f"DATE '{c}'" for c in DAILY_CUTOFFS)}]) AS cutoff),
dknown AS MATERIALIZED (SELECT cutoff, ds, y, row_number() OVER (PARTITION BY cutoff ORDER BY ds DESC) AS back FROM dy, dcut WHERE ds <= cutoff),
dtest AS (SELECT cutoff, ds, y FROM dy, dcut WHERE ds > cutoff AND ds <= least(CAST(cutoff + INTERVAL 6 MONTH AS DATE), DATE '{DAILY_END}')),
dbasic AS MATERIALIZED (SELECT 'Total' AS level, 'Total' AS series, *, y AS actual, (year(ds) - year(cutoff)) * 12 + month(ds) - month(cutoff) AS horizon FROM {_daily_baselines('dtest', 'dknown')}),
derr AS MATERIALIZED (SELECT cutoff, model, sum(abs(forecast - actual)) AS ae, sum(actual) AS r FROM dbasic GROUP BY ALL),
dwt AS (SELECT c.cutoff, e.model, 1 / greatest(sum(e.ae) / greatest(sum(e.r), 1e-9), 1e-6) AS w FROM dcut c JOIN derr e ON e.cutoff <> c.cutoff GROUP BY c.cutoff, e.model QUALIFY row_number() OVER (PARTITION BY c.cutoff ORDER BY round(greatest(sum(e.ae) / greatest(sum(e.r), 1e-9), 1e-6), 9), e.model) <= 3),
dall AS MATERIALIZED (SELECT level, series, cutoff, ds, model, forecast, actual, horizon FROM dbasic UNION ALL SELECT 'Total', 'Total', cutoff, ds, 'combination', sum(forecast * w) / sum(w), max(actual), max(horizon) FROM dbasic JOIN dwt USING (cutoff, model) GROUP BY cutoff, ds), {_rank_sql('dall', '_d')},
fknown AS MATERIALIZED (SELECT (SELECT max(ds) FROM dy) AS cutoff, ds, y, row_number() OVER (ORDER BY ds DESC) AS back FROM dy), fdays AS (SELECT (SELECT max(ds) FROM dy) AS cutoff, DATE '{DAILY_END}' + CAST(k AS INT) AS ds, NULL AS y FROM range(1, 109) r(k)),
fbase AS MATERIALIZED (SELECT * FROM {_daily_baselines('fdays', 'fknown')}),
fweights AS (SELECT model, 1 / greatest(sum(ae) / greatest(sum(r), 1e-9), 1e-6) AS w FROM derr GROUP BY 1 QUALIFY row_number() OVER (ORDER BY round(greatest(sum(ae) / greatest(sum(r), 1e-9), 1e-6), 9), model) <= 3),
fall AS (SELECT ds, model, forecast FROM fbase UNION ALL SELECT ds, 'combination', sum(forecast * w) / sum(w) FROM fbase JOIN fweights USING (model) GROUP BY ds),
ahead AS (SELECT CAST(date_trunc('month', ds) AS DATE) AS month, sum(forecast) AS orders FROM fall JOIN (SELECT model FROM ranked_d WHERE chosen) USING (model) GROUP BY 1),
hbands AS (SELECT horizon AS h, quantile_cont(abs({_ratio('forecast', 'actual')} - 1), 0.8) AS band FROM months_d JOIN (SELECT model FROM ranked_d WHERE chosen) USING (model) GROUP BY 1),
ext AS (SELECT avg(x) AS extreme_mean, quantile_cont(x, 0.1) AS extreme_p10, quantile_cont(x, 0.9) AS extreme_p90 FROM (SELECT extreme_revenue AS x FROM bm ORDER BY month DESC LIMIT 6)),
now AS (SELECT orders AS o, base_revenue AS r, extreme_revenue AS x FROM bm WHERE month = DATE '2001-07-01'),
steps AS (SELECT a.month, CAST((year(a.month) - 2001) * 12 + month(a.month) - 7 AS INT) AS horizon, a.orders, ticket, method, 16.0 / 31.0 AS rest FROM ahead a JOIN tickets ON step = (year(a.month) - 2001) * 12 + month(a.month) - 7),
raw AS (SELECT s.month, horizon, s.orders + CASE WHEN horizon = 0 THEN coalesce((SELECT o FROM now), 0) ELSE 0 END AS orders, y.orders AS orders_year_ago, s.ticket, method, s.orders * s.ticket + CASE WHEN horizon = 0 THEN coalesce((SELECT r FROM now), 0) ELSE 0 END AS v1,
    band * CASE WHEN horizon = 0 THEN rest ELSE 1 END AS band, """ + ", ".join(f"CASE WHEN horizon = 0 AND (SELECT x FROM now) IS NOT NULL THEN (SELECT x FROM now) + {c} * rest ELSE {c} END AS {c}" for c in ("extreme_mean", "extreme_p10", "extreme_p90")) + f"""
    FROM steps s, ext LEFT JOIN hbands ON h = least(greatest(horizon, (SELECT min(h) FROM hbands)), (SELECT max(h) FROM hbands)) LEFT JOIN bm y ON y.month + INTERVAL 12 MONTH = s.month),
fac AS (SELECT CASE WHEN (SELECT count(DISTINCT target_month) FROM judged) >= 3 THEN least(greatest(1 / (1 + avg(orders_error)), 0.85), 1.15) ELSE 1 END AS orders_factor,
    CASE WHEN (SELECT count(DISTINCT target_month) FROM judged) >= 3 THEN least(greatest(1 / (1 + avg(revenue_error)), 0.85), 1.15) ELSE 1 END AS revenue_factor FROM (SELECT * FROM judged ORDER BY target_month DESC LIMIT 6)),
realb AS (SELECT horizon, CASE WHEN count(*) >= 3 THEN quantile_cont(abs(revenue_error), 0.8) END AS real_band FROM judged GROUP BY 1),
fixed AS (SELECT r.* EXCLUDE (orders, v1, band), fac.*, v1 AS v1_raw, orders AS orders_raw, orders * CASE WHEN r.horizon >= 1 THEN orders_factor ELSE 1 END AS orders, v1 * CASE WHEN r.horizon >= 1 THEN revenue_factor ELSE 1 END AS v1,
    CASE WHEN r.horizon >= 1 THEN coalesce(real_band, band) ELSE band END AS band FROM raw r, fac LEFT JOIN realb ON realb.horizon = r.horizon),
headline AS MATERIALIZED (SELECT * EXCLUDE (band), v1 * (1 - band) AS v1_low, v1 * (1 + band) AS v1_high, v1 + extreme_mean AS v2, v1 * (1 - band) + extreme_p10 AS v2_low, v1 * (1 + band) + extreme_p90 AS v2_high, ({_ratio('orders', 'orders_year_ago')} - 1) * 100 AS orders_change_pct FROM fixed),
record AS (SELECT DATE '2001-08-01' AS run_date, 'v1' AS version, month AS target_month, horizon, orders_raw, v1_raw AS revenue_raw, orders AS orders_final, v1 AS revenue_final, v1_low AS revenue_low, v1_high AS revenue_high, v2 AS revenue_v2,
    CASE WHEN horizon >= 1 THEN orders_factor ELSE 1 END AS orders_factor, CASE WHEN horizon >= 1 THEN revenue_factor ELSE 1 END AS revenue_factor, (SELECT model FROM ranked_d WHERE chosen) AS orders_model, method AS ticket_method FROM headline)"""


def _money_sql(column: str) -> str:
    return f"'R$ ' || replace(format('{{:,}}', CAST(round_even({column}, 0) AS BIGINT)), ',', '.')"


def _rounded_sql(table: str, whole: str, fine: str = "orders_factor, revenue_factor", plain: str = "") -> str:
    parts = [f"round({c}, 0) AS {c}" for c in whole.split(", ")] + [f"round({c}, 6) AS {c}" for c in fine.split(", ") if c] + [plain]
    return f"{_recursive(CANON + HEADLINE)} SELECT {', '.join(p for p in parts if p)} FROM {table}"


ORACLES = {
    "simple_headline_forecast": _rounded_sql("headline", "orders, ticket, v1, v1_low, v1_high, extreme_mean, extreme_p10, extreme_p90, v1_raw, orders_raw, v2, v2_low, v2_high", "orders_factor, revenue_factor, orders_change_pct", "month, horizon, orders_year_ago, method"),
    "simple_headline_explained": f"""{_recursive(CANON + HEADLINE)} SELECT month, 'Em ' || ['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'][month(month)] || '/' || year(month) || ', esperamos cerca de '
        || replace(format('{{:,}}', CAST(round_even(orders, 0) AS BIGINT)), ',', '.') || ' pedidos e ' || {_money_sql('v1')} || ' sem pedidos extremos (entre ' || {_money_sql('v1_low')} || ' e ' || {_money_sql('v1_high')} || '); com extremos, ' || {_money_sql('v2')} || '.' AS explanation FROM headline""",
    "simple_run_record": _rounded_sql("record", "orders_raw, revenue_raw, orders_final, revenue_final, revenue_low, revenue_high, revenue_v2", plain="run_date, version, target_month, horizon, orders_model, ticket_method"),
    "simple_run_history": _rounded_sql("(SELECT run_date, target_month, horizon, revenue_final FROM record UNION ALL SELECT CAST(target_month - 20 AS DATE), target_month, 1, revenue_raw FROM hist WHERE target_month - 20 <> DATE '2001-08-01')", "revenue_final", "", "run_date, target_month, horizon"),
    "damped_holt_winters": _recursive(f"{S}, {NUMBERED}, {_smoothing_sql()} {LOGGED.format(z='z')} FROM smooth"),
    "trend_season_regression": _recursive(f"{S}, {_regression_sql(TREND_X, [1e-6] * 2 + [2.0] * 12 + [0.5] * 15)} {LOGGED.format(z='fit')} FROM fitted WHERE is_test"),
    "calendar_regression": _recursive(f"""{S}, {_regression_sql(CALENDAR_X, [1e-6] + [0.3] * 10)}, off AS (SELECT {TASK_COLUMNS}, ds, z - fit AS off, lag(z - fit) OVER (PARTITION BY {TASK_COLUMNS} ORDER BY ds) AS before FROM fitted WHERE NOT is_test),
        carried AS (SELECT {TASK_COLUMNS}, least(greatest(sum(off * before) / greatest(sum(off * off), 1e-12), 0), 0.98) AS rho, arg_max(off, ds) AS last FROM off GROUP BY ALL)
        {LOGGED.format(z='fit + last * rho ** t')} FROM fitted JOIN carried USING ({TASK_COLUMNS}) WHERE is_test"""),
    "ticket_forecast": _recursive(f"{CANON}{BASEM}, {TICKETS} SELECT step, round(ticket, 4) AS ticket, method FROM tickets"),
    "weekly_series": f"{S} SELECT * FROM series",
    "backtest_tasks": f"{S} SELECT * FROM tasks",
    **{m: f"{S} SELECT * FROM basic WHERE model = '{m}'" for m in ("naive", "moving_average", "seasonal_naive", "seasonal_growth")},
    "combination": f"{S} SELECT * FROM comb",
    "monthly_backtest": f"{R} SELECT * FROM months",
    "accuracy_metrics": f"{R} SELECT * FROM acc",
    "accuracy_by_horizon": f"{R} SELECT level, model, horizon, {_ratio('sum(abs(forecast - actual))', 'sum(actual)')} * 100 AS wape, avg(CASE WHEN actual > 0 THEN abs(forecast - actual) / actual END) * 100 AS mape, ({_ratio('sum(forecast)', 'sum(actual)')} - 1) * 100 AS bias, count(*) AS n FROM months GROUP BY ALL",
    "model_choice": f"{R} SELECT * FROM ranked",
    "choice_reasons": f"""{R}, c AS (SELECT r.level, r.model, r.wape, r.gain, b.model AS best_model, b.wape AS best_wape FROM ranked r JOIN (SELECT level, arg_min(model, (round(wape, 9), model)) AS model, min(wape) AS wape FROM ranked GROUP BY 1) b USING (level) WHERE chosen)
        SELECT level, model AS chosen, concat_ws(' ', printf('Fica o modelo %s, com %.1f%% de erro.', model, wape), CASE WHEN model <> best_model THEN printf('Com %s o erro seria de %.1f%%, pouco menor, mas com um modelo mais complexo.', best_model, best_wape) END,
        CASE WHEN gain IS NOT NULL AND model <> 'seasonal_naive' THEN CASE WHEN gain > 0 THEN printf('São %.1f pontos abaixo de %s.', gain, 'seasonal_naive') ELSE printf('Não melhora %s, que pode bastar.', 'seasonal_naive') END END) AS justification FROM c""",
    "level_benchmark": f"{R} SELECT level, max(CASE WHEN chosen THEN model END) AS chosen, max(CASE WHEN chosen THEN wape END) AS wape, max(CASE WHEN model = 'seasonal_naive' THEN wape END) AS reference_wape, arg_min(model, (round(wape, 9), model)) AS best_model, min(wape) AS best_wape, count(*) AS models FROM ranked GROUP BY 1",
    "empirical_band": f"{R} SELECT level, model, horizon, quantile_cont(abs({_ratio('forecast', 'actual')} - 1), 0.8) AS band FROM months GROUP BY ALL",
    "bottom_up_coherence": f"""{R}, ch AS (SELECT months.* FROM months JOIN ranked USING (level, model) WHERE chosen), sm AS (SELECT level, cutoff, month, sum(forecast) AS forecast FROM ch GROUP BY ALL), re AS (SELECT cutoff, month, sum(actual) AS actual FROM ch WHERE level = 'Total' GROUP BY ALL)
        SELECT level, {_ratio('sum(abs(forecast - actual))', 'sum(actual)')} * 100 AS wape FROM sm JOIN re USING (cutoff, month) GROUP BY 1""",
    "child_to_parent": f"{S}{SHARES} SELECT * FROM cp",
    "recent_share": f"{S}{SHARES} SELECT level, child, parent, cutoff, share FROM shares",
    "top_down": f"{R} SELECT * FROM simple WHERE model = 'top_down'",
    "week_to_month": f"{S}, d AS (SELECT level, series, CAST(date_trunc('month', ds + CAST(k AS INT)) AS DATE) AS month, y / 7 AS y FROM series, (SELECT unnest(range(7)) AS k)) SELECT level, series, month, sum(y) AS y FROM d GROUP BY ALL",
    "monthly_actuals": f"{S}, d AS (SELECT level, series, CAST(date_trunc('month', ds + CAST(k AS INT)) AS DATE) AS month, y / 7 AS y FROM series, (SELECT unnest(range(7)) AS k)) SELECT level, series, month, sum(y) AS actual FROM d WHERE month < DATE '2001-08-01' AND month >= DATE '2000-08-01' GROUP BY ALL",
    "expected_extremes": f"{CANON}{BASEM}, l AS (SELECT extreme_revenue AS x FROM bm ORDER BY month DESC LIMIT 6) SELECT avg(x) AS extreme_mean, quantile_cont(x, 0.1) AS extreme_p10, quantile_cont(x, 0.9) AS extreme_p90 FROM l",
    "judged_history": f"{CANON}{BASEM} SELECT target_month, orders_error, revenue_error FROM judged",
    "history_bias": f"{CANON}{BASEM} SELECT CAST(1 AS INT) AS horizon, count(*) AS n, avg(orders_error) * 100 AS orders_bias, avg(abs(orders_error)) * 100 AS orders_abs, avg(revenue_error) * 100 AS revenue_bias, avg(abs(revenue_error)) * 100 AS revenue_abs FROM judged",
    "bias_factors": f"""{CANON}{BASEM}, a AS (SELECT * FROM judged ORDER BY target_month DESC LIMIT 6) SELECT (SELECT count(DISTINCT target_month) FROM judged) AS months, least(greatest(1 / (1 + avg(orders_error)), 0.85), 1.15) AS orders_factor,
        least(greatest(1 / (1 + avg(revenue_error)), 0.85), 1.15) AS revenue_factor FROM a""",
    "forecast_accuracy": f"{CANON}{BASEM} SELECT target_month, base_revenue AS revenue_actual, (revenue_raw / base_revenue - 1) * 100 AS error_pct FROM hist JOIN bm ON bm.month = target_month",
}
