"""Queries of single parts that the others do not show by themselves, and of final forecasts that SQL can follow."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.config import REGIONS
from tidemark.functions import clean_state, half_up, region_of_state, series_key
from tidemark.operators import cubes as C
from tidemark.plans import backtest as T
from tidemark.plans import forecast as P
from tidemark.queries.base import CANON, Base
from tidemark.queries.forecasts import BASEM, DATES, END, GENERATIONS, PARENTS, TREE, _by_month, _history, _parents, _ranked, _simple, _tasks, weekly_series
from tidemark.queries.products import LABELLED, _cube
from tidemark.queries.sales import DAILY, _daily, _query, _ratio
from tidemark.sources import latest_run

RERUN, START, CURRENT = date(2001, 8, 1), date(2000, 1, 1), date(2001, 7, 1)


def _rerun(b: Base):
    """The history's last run again, and a run of its own date."""
    last = latest_run(_history(b)).withColumn("revenue_final", F.col("revenue_final") * 1.1)
    return last.unionByName(last.withColumn("run_date", F.lit(RERUN)))


def _final(b: Base):
    return b.kept("simple_final", lambda: P.forecast_levels(weekly_series(b), DATES, _ranked(b), _simple(b), _parents(b), GENERATIONS, models=()))


def _granular(b: Base):
    return b.kept("simple_granular", lambda: P.granular_forecast(_final(b), weekly_series(b), T.empirical_band(_by_month(b)), CURRENT, RERUN, "v1"))


HIST = f"""{BASEM}, h AS (SELECT CAST(target_month - 20 AS DATE) AS run_date, target_month, 1 AS horizon, CAST(orders_raw AS DOUBLE) AS orders_raw, revenue_raw, revenue_raw AS revenue_final FROM hist), newest AS (SELECT * FROM h WHERE run_date = (SELECT max(run_date) FROM h))"""
CHILDREN = ", ".join(f"'{c}'" for c in PARENTS)
FINAL = f""", fback AS (SELECT *, row_number() OVER (PARTITION BY level, series ORDER BY ds DESC) AS back FROM series),
fstats AS (SELECT level, series, avg(y) FILTER (WHERE back <= 1) AS last, avg(y) FILTER (WHERE back <= 8) AS mean, count(*) AS n, sum(CASE WHEN back <= 8 THEN y ELSE 0 END) AS now8, sum(CASE WHEN back BETWEEN 53 AND 60 THEN y ELSE 0 END) AS then8 FROM fback GROUP BY ALL),
fdates AS (SELECT CAST(unnest(generate_series(DATE '{DATES[0]}', DATE '{DATES[-1]}', INTERVAL 7 DAY)) AS DATE) AS ds),
ftest AS (SELECT s.level, s.series, d.ds, coalesce(b.y, last) AS base, last, mean, CASE WHEN n >= 60 AND then8 > 0 THEN least(greatest(now8 / then8, 0.5), 2.0) ELSE 1.0 END AS factor
    FROM fstats s CROSS JOIN fdates d LEFT JOIN fback b ON b.level = s.level AND b.series = s.series AND b.ds = d.ds - 364),
fbasic AS MATERIALIZED (SELECT level, series, ds, unnest(['naive', 'moving_average', 'seasonal_naive', 'seasonal_growth']) AS model, unnest([greatest(last, 0), greatest(mean, 0), greatest(base, 0), greatest(base * factor, 0)]) AS forecast FROM ftest),
fw AS (SELECT level, series, model, 1 / greatest(sum(ae) / greatest(sum(r), 1e-9), 1e-6) AS w FROM err GROUP BY level, series, model QUALIFY row_number() OVER (PARTITION BY level, series ORDER BY round(greatest(sum(ae) / greatest(sum(r), 1e-9), 1e-6), 9), model) <= 3),
fahead AS MATERIALIZED (SELECT * FROM fbasic UNION ALL SELECT level, series, ds, 'combination', sum(forecast * w) / sum(w) FROM fbasic JOIN fw USING (level, series, model) GROUP BY ALL),
picked AS (SELECT level, model FROM ranked WHERE chosen),
spare AS (SELECT level, arg_min(model, (complexity, round(wape, 9), model)) AS model FROM ranked WHERE eligible AND model NOT IN ('top_down', 'combination') GROUP BY 1),
ftot AS (SELECT level, series, sum(y) AS s FROM series WHERE ds > DATE '{END}' - 91 GROUP BY ALL),
fshares AS (SELECT cp.level, child, cp.parent, p.level AS parent_level, CASE WHEN p.s > 0 THEN coalesce(c.s, 0) / p.s ELSE 0 END AS share FROM cp JOIN picked k ON k.level = cp.level AND k.model = 'top_down' JOIN fstats f ON f.level = cp.level AND f.series = child
    JOIN ftot p ON p.series = parent AND p.level = CASE cp.level {' '.join(f"WHEN '{c}' THEN '{p}'" for c, p in PARENTS.items())} END LEFT JOIN ftot c ON c.level = cp.level AND c.series = child),
fdone0 AS MATERIALIZED (SELECT a.* FROM fahead a JOIN picked USING (level, model) WHERE level NOT IN ({CHILDREN}))""" + "".join(
    f""", fdown{g} AS (SELECT s.level, child AS series, p.ds, 'top_down' AS model, greatest(p.forecast * share, 0) AS forecast FROM fshares s JOIN fdone{g} p ON p.level = parent_level AND p.series = parent WHERE s.level IN ({', '.join(f"'{c}'" for c in level_of)})),
fdone{g + 1} AS MATERIALIZED (SELECT * FROM fdone{g} UNION ALL SELECT a.* FROM fahead a JOIN picked USING (level, model) WHERE level IN ({', '.join(f"'{c}'" for c in level_of)}) UNION ALL SELECT * FROM fdown{g}
    UNION ALL SELECT a.* FROM fahead a JOIN spare s ON s.level = a.level AND s.model = a.model JOIN picked k ON k.level = a.level AND k.model = 'top_down'
    WHERE a.level IN ({', '.join(f"'{c}'" for c in level_of)}) AND NOT EXISTS (SELECT 1 FROM fdown{g} d WHERE d.level = a.level AND d.series = a.series))""" for g, level_of in enumerate(GENERATIONS)
) + f""", final AS (SELECT * FROM fdone{len(GENERATIONS)})"""
GRANULAR = f"""{FINAL}, fm AS (SELECT level, series, model, CAST(date_trunc('month', ds + CAST(k AS INT)) AS DATE) AS month, sum(forecast / 7) AS forecast FROM final, (SELECT unnest(range(7)) AS k) GROUP BY ALL),
am AS (SELECT level, series, CAST(date_trunc('month', ds + CAST(k AS INT)) AS DATE) AS month, sum(y / 7) AS actual FROM series, (SELECT unnest(range(7)) AS k) GROUP BY ALL),
bands AS (SELECT level, model, horizon, quantile_cont(abs({_ratio('forecast', 'actual')} - 1), 0.8) AS band FROM months GROUP BY ALL), ends AS (SELECT level, model, min(horizon) AS lo, max(horizon) AS hi FROM bands GROUP BY ALL),
banded AS (SELECT fm.*, least(greatest((year(month) - 2001) * 12 + month(month) - 7, lo), hi) AS horizon FROM fm LEFT JOIN ends USING (level, model)),
rows AS (SELECT b.level, b.series, b.month, b.model, b.forecast + coalesce(actual, 0) AS forecast, b.forecast * (1 - band) + coalesce(actual, 0) AS low, b.forecast * (1 + band) + coalesce(actual, 0) AS high
    FROM banded b LEFT JOIN bands ON bands.level = b.level AND bands.model = b.model AND bands.horizon = b.horizon LEFT JOIN am ON am.level = b.level AND am.series = b.series AND am.month = b.month AND b.month = DATE '{CURRENT}'),
granular AS (SELECT r.*, {_ratio('r.forecast', 's.s')} * t.forecast AS reconciled, {_ratio('r.forecast', 's.s')} * 100 AS share_pct, DATE '{RERUN}' AS run_date, 'v1' AS version
    FROM rows r JOIN (SELECT level, month, sum(forecast) AS s FROM rows GROUP BY ALL) s USING (level, month) LEFT JOIN (SELECT month, forecast FROM rows WHERE level = 'Total') t USING (month))"""
TYPES = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"

QUERIES = {
    "regions_by_state": _query(lambda b: b.orders.groupBy(region_of_state(F.substring(clean_state(F.col("state")), 1, 2)).alias("region")).agg(F.count("*").alias("orders"))),
    "daily_rounded": _query(lambda b: _daily(b).select("ds", half_up(F.col("revenue"), 1).alias("revenue"), half_up(F.col("extreme_revenue"), 0).alias("extreme_revenue"))),
    "series_keys": _query(lambda b: _cube(b, "geo").groupBy(series_key(F.col("region"), F.col("state"), F.col("channel")).alias("series")).agg(F.sum("units").alias("units"))),
    "training_window": _query(lambda b: T.training_window(_tasks(b), START).groupBy("level", "cutoff", "is_test").agg(F.count("*").alias("points"), F.min("ds").alias("first_ds"))),
    "history_upsert": _query(lambda b: P.append_run(_history(b), _rerun(b))),
    "latest_run": _query(lambda b: latest_run(_history(b))),
    "simple_final_forecast": _query(lambda b: _final(b).drop("cutoff")),
    "simple_granular_forecast": _query(_granular),
    "simple_actuals_and_forecasts": _query(lambda b: P.actuals_and_forecasts(P.monthly_actuals(weekly_series(b), b.options.as_of), _granular(b), "Marca")),
    "geo_cube_levels": _query(lambda b: C.aggregate_levels(_cube(b, "geo"), with_extremes=True).groupBy("level").agg(F.count_distinct("series").alias("series"), F.sum("units").alias("units"))),
}
ORACLES = {
    "schema_table": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", column_name AS \"column\", {TYPES} AS type, CAST(row_number() OVER () AS INT) AS position FROM (DESCRIBE SELECT * FROM {t})" for t in ("orders", "lineitem")),
    "regions_by_state": f"{CANON} SELECT CASE {' '.join(f'WHEN code IN ({str(list(states))[1:-1]}) THEN {name!r}' for name, states in REGIONS.items())} ELSE 'SEM_INFO' END AS region, count(*) AS orders FROM (SELECT left(upper(trim(state)), 2) AS code FROM o) GROUP BY 1",
    "daily_rounded": f"{CANON}{DAILY} SELECT ds, CAST(round(CAST(revenue AS DECIMAL(18,2)), 1) AS DOUBLE) AS revenue, CAST(round(CAST(extreme_revenue AS DECIMAL(18,2)), 0) AS DOUBLE) AS extreme_revenue FROM daily",
    "series_keys": f"{CANON}{LABELLED} SELECT concat_ws(' | ', region, state, channel) AS series, sum(units) AS units FROM before GROUP BY 1",
    "training_window": f"{CANON}{TREE} SELECT level, cutoff, is_test, count(*) AS points, min(ds) AS first_ds FROM tasks WHERE is_test OR ds >= DATE '{START}' GROUP BY ALL",
    "history_upsert": f"""{CANON}{HIST}, again AS (SELECT run_date, target_month, horizon, round(orders_raw, 4) AS orders_raw, round(revenue_raw, 4) AS revenue_raw, round(revenue_final * 1.1, 4) AS revenue_final FROM newest)
        SELECT * FROM h WHERE run_date NOT IN (SELECT run_date FROM again) UNION ALL SELECT * FROM again UNION ALL SELECT DATE '{RERUN}', target_month, horizon, orders_raw, revenue_raw, revenue_final FROM again""",
    "latest_run": f"{CANON}{HIST} SELECT * FROM newest",
    "simple_final_forecast": f"{CANON}{TREE}{FINAL} SELECT * FROM final",
    "simple_granular_forecast": f"{CANON}{TREE}{GRANULAR} SELECT * FROM granular",
    "simple_actuals_and_forecasts": f"""{CANON}{TREE}{GRANULAR} SELECT level, series, month, actual, NULL AS forecast, NULL AS low, NULL AS high, NULL AS reconciled FROM am WHERE level = 'Marca' AND month < DATE '2001-08-01' AND month >= DATE '2000-08-01'
        UNION ALL SELECT level, series, month, NULL, forecast, low, high, reconciled FROM granular WHERE level = 'Marca'""",
    "geo_cube_levels": f"{CANON}{LABELLED} " + " UNION ALL ".join(f"SELECT '{n}' AS level, count(DISTINCT {d or 1}) AS series, sum(units) AS units FROM before" for n, d in C.LEVELS.items() if d is None or d in C.GEO_DIMS),
}
