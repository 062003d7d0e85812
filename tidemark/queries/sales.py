"""Queries of the order base and of monthly, daily and calendar tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import kpis as K
from tidemark.operators import orders as O
from tidemark.operators import sketches as Q
from tidemark.queries.base import CANON, OPTIONS, Base
from tidemark.sources import schema_table

DBL = "CAST({} AS DOUBLE)"


def _money(cents: str) -> str:
    """Whole cents as a double, the same as of the decimal."""
    return f"CAST(CAST({cents} AS DECIMAL(30,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN CAST({b} AS DOUBLE) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def _periods(spark):
    rows = [("spring", date(2000, 3, 1), date(2000, 3, 14), date(2000, 2, 1), date(2000, 2, 28)), ("black friday", date(1999, 11, 24), date(1999, 11, 29), date(1999, 10, 20), date(1999, 11, 16)), ("early", date(1995, 1, 10), date(1995, 1, 20), date(1994, 12, 1), date(1994, 12, 20)), ("late", date(2001, 7, 20), date(2001, 8, 20), date(2001, 6, 1), date(2001, 6, 20))]
    return spark.createDataFrame(rows, "name string, start date, end date, ref_start date, ref_end date")


def _monthly(b: Base):
    return K.monthly_kpis(b.base, b.flags, b.options)


def _daily(b: Base):
    return K.daily_series(b.marks, b.options.as_of)


def _money_lines(df):
    """Decimals as doubles, for comparison."""
    return df.select(*[F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes])


MONTHLY = f""", large AS (SELECT quantile_disc(value_cents, 0.99) AS lim FROM flags), months AS (
    SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, count(*) AS orders, sum(value_cents) AS rev, sum(units) AS units, sum(list_cents) AS lst, sum(lines) AS lines, sum(discounted_lines) AS disc, sum(new_cents) AS newc,
        quantile_disc(value_cents, 0.5) AS q50, quantile_disc(value_cents, 0.9) AS q90, max(value_cents) AS mx, count(*) FILTER (WHERE value_cents > lim) AS large_orders, coalesce(sum(value_cents) FILTER (WHERE value_cents > lim), 0) AS large_rev,
        count(*) FILTER (WHERE is_extreme) AS extreme_orders, coalesce(sum(value_cents) FILTER (WHERE is_extreme), 0) AS ext, count(*) FILTER (WHERE in_group) AS group_orders, count(DISTINCT order_date) AS active_days, max(order_date) AS last_date
    FROM flags, large GROUP BY 1
), dp AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, count(DISTINCT product_id) AS distinct_products FROM base GROUP BY 1),
monthly AS (
    SELECT month, CAST(year(month) AS INT) AS year, CAST(month(month) AS INT) AS month_number, CAST(quarter(month) AS INT) AS quarter, orders, {_money("rev")} AS revenue, {_ratio(_money("rev"), "orders")} AS ticket, units, {_ratio("units", "orders")} AS units_per_order,
        {_ratio(_money("rev"), "units")} AS unit_price, {_ratio(_money("lst"), "units")} AS unit_list_price, {_ratio(_money("lst - rev"), _money("lst"))} * 100 AS discount_pct, {_ratio("disc", "lines")} * 100 AS discounted_lines_pct, distinct_products,
        {_ratio(_money("newc"), _money("rev"))} * 100 AS new_products_pct, {_money("q50")} AS median_order, {_money("q90")} AS p90_order, {_money("mx")} AS largest_order, large_orders, {_ratio(_money("large_rev"), _money("rev"))} * 100 AS large_pct,
        {_ratio(_money("rev - large_rev"), "orders - large_orders")} AS ticket_without_large, {_ratio("lines", "orders")} AS lines_per_order, extreme_orders, {_money("ext")} AS extreme_revenue, group_orders,
        {_ratio(_money("rev - ext"), "orders - extreme_orders")} AS ticket_without_extremes, active_days, CAST(day(last_day(month)) AS INT) AS days_in_month, last_day(month) < DATE '2001-08-01' AS complete, last_date
    FROM months LEFT JOIN dp USING (month)
)"""
DAILY = f""", per_day AS (
    SELECT order_date AS ds, count(*) AS n, sum(value_cents) AS rev, sum(units) AS u, sum(list_cents) AS lst, count(*) FILTER (WHERE is_extreme) AS xo, coalesce(sum(value_cents) FILTER (WHERE is_extreme), 0) AS xr
    FROM flags WHERE order_date < DATE '2001-08-01' GROUP BY 1
), spine AS (SELECT CAST(unnest(generate_series((SELECT min(ds) FROM per_day), DATE '2001-07-31', INTERVAL 1 DAY)) AS DATE) AS ds),
daily AS (
    SELECT ds, CAST(dayofweek(ds) + 1 AS INT) AS weekday, coalesce(n, 0) AS orders, coalesce({_money("rev")}, 0) AS revenue, coalesce(u, 0) AS units, {_ratio(_money("rev"), "n")} AS ticket,
        {_ratio(_money("lst - rev"), _money("lst"))} * 100 AS discount_pct, coalesce(xo, 0) AS extreme_orders, coalesce({_money("xr")}, 0) AS extreme_revenue
    FROM spine LEFT JOIN per_day USING (ds)
)"""
SITUATION = """, all_orders AS (
    SELECT order_id, min(order_date) AS order_date, sum(total_cents) AS value_cents FROM i WHERE order_date IS NOT NULL GROUP BY 1
), situation AS (
    SELECT a.*, CASE WHEN v.order_id IS NOT NULL THEN 'VALIDO' WHEN k.id IS NOT NULL THEN 'REMOVIDO_STATUS_OU_TESTE' ELSE 'FORA_DA_BASE_B2C' END AS situation
    FROM all_orders a LEFT JOIN valid v USING (order_id) LEFT JOIN (SELECT DISTINCT id FROM o) k ON k.id = a.order_id
)"""


def _profile_sql(key: str, name: str) -> str:
    return f"""{CANON}{DAILY} SELECT {key} AS {name}, count(*) AS days, avg(orders) AS orders_mean, {_ratio("sum(revenue)", "sum(orders)")} AS ticket,
    {_ratio("avg(orders)", "(SELECT avg(orders) FROM daily)")} * 100 AS index, {_ratio("sum(revenue)", "(SELECT sum(revenue) FROM daily)")} * 100 AS revenue_pct FROM daily GROUP BY 1"""


def _query(make):
    return lambda spark, sf_dir: make(Base(spark, sf_dir))


def _impact(b: Base):
    return K.cleaning_impact(b.items, b.orders, b.valid, b.options)


IMPACT = f""", lim AS (SELECT quantile_disc(value_cents, 0.99) AS lim FROM situation), impact AS (
    SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, situation, count(*) AS orders, {_money("sum(value_cents)")} AS revenue, count(*) FILTER (WHERE value_cents > lim) AS atypical_orders,
        {_money("coalesce(sum(value_cents) FILTER (WHERE value_cents > lim), 0)")} AS atypical_revenue FROM situation, lim GROUP BY 1, 2
)"""
W = "CAST(date_trunc('week', ds) AS DATE)"


def _trailing_sql(days: int) -> str:
    spans = {"": ("last - {d}", "last"), "_before": ("last - {e}", "last - {d}"), "_year_ago": ("ya - {d}", "ya")}
    sums = ", ".join(f"sum({m}) FILTER (WHERE ds > {lo.format(d=days, e=2 * days)} AND ds <= {hi.format(d=days, e=2 * days)}) AS {m}{n}" for n, (lo, hi) in spans.items() for m in ("orders", "revenue"))
    cols = ", ".join(f"orders{n}, revenue{n}, {_ratio(f'revenue{n}', f'orders{n}')} AS ticket{n}" for n in spans)
    t = {n: _ratio(f"revenue{n}", f"orders{n}") for n in spans}
    changes = ", ".join(f"({_ratio(m if m != 'ticket' else t[''], f'{m}{n}' if m != 'ticket' else t[n])} - 1) * 100 AS {m}_change{n}" for n in ("_before", "_year_ago") for m in ("orders", "revenue", "ticket"))
    return f"{CANON}{DAILY}, l AS (SELECT max(ds) AS last, CAST(max(ds) - INTERVAL 12 MONTH AS DATE) AS ya FROM daily), s AS (SELECT last, {sums} FROM daily, l GROUP BY last) SELECT CAST({days} AS INT) AS days, last, {cols}, {changes} FROM s"


QUERIES = {
    "valid_rows": _query(lambda b: O.filter_valid_rows(b.orders, b.options.rules)),
    "valid_orders": _query(lambda b: b.valid),
    "quantiles_by_period": _query(lambda b: Q.quantiles_by_period(Q.value_sketches(b.marks))),
    "base_items": _query(lambda b: _money_lines(b.base)),
    "first_sale": _query(lambda b: O.first_sale(b.base)),
    "order_totals": _query(lambda b: _money_lines(b.totals)),
    "extreme_orders": _query(lambda b: b.marks.select("order_id", "in_group", "is_extreme")),
    "lines_with_extremes": _query(lambda b: b.lines.groupBy("is_extreme").agg(F.count("*").alias("lines"), F.sum("units").alias("units"))),
    "product_dimension": _query(lambda b: b.products.drop("updated")),
    "order_situation": _query(lambda b: _money_lines(O.line_situation(b.items, b.orders, b.valid))),
    "schema_table": _query(lambda b: schema_table(b.spark, {"orders": b.spark.read.parquet(f"{b.sf_dir}/orders.parquet"), "lineitem": b.spark.read.parquet(f"{b.sf_dir}/lineitem.parquet")})),
    "monthly_kpis": _query(_monthly),
    "monthly_base_revenue": _query(lambda b: K.with_base_revenue(_monthly(b)).select("month", "base_revenue", "base_ticket")),
    "daily_series": _query(_daily),
    "data_quality_report": _query(lambda b: K.data_quality_report(b.items)),
    "origin_split": _query(lambda b: K.origin_split(b.base)),
    "largest_orders": _query(lambda b: K.largest_orders(b.base, b.options.as_of)),
    "cleaning_impact": _query(_impact),
    "nonconcluded_pct": _query(lambda b: K.nonconcluded_pct(_impact(b))),
    "channel_split": _query(lambda b: K.channel_split(b.marks)),
    "trailing_30": _query(lambda b: K.trailing_window_compare(_daily(b), 30)),
    "trailing_7": _query(lambda b: K.trailing_window_compare(_daily(b), 7)),
    "yoy_change": _query(lambda b: K.yoy_change(_monthly(b), date(1997, 1, 1))),
    "seasonality_index": _query(lambda b: K.seasonality_index(_monthly(b))),
    "weekly_rollup": _query(lambda b: K.weekly_rollup(_daily(b), date(1996, 1, 1))),
    "weekday_profile": _query(lambda b: K.weekday_profile(_daily(b))),
    "monthday_profile": _query(lambda b: K.monthday_profile(_daily(b))),
    "month_bands": _query(lambda b: K.month_bands(_daily(b))),
    "weekday_month_heatmap": _query(lambda b: K.weekday_month_heatmap(_daily(b))),
    "ytd_by_year": _query(lambda b: K.ytd_by_year(_monthly(b))),
    "mtd_vs_last_year": _query(lambda b: K.mtd_vs_last_year(_daily(b))),
    "special_periods_lift": _query(lambda b: K.special_periods_lift(_daily(b), _periods(b.spark), 1.0)),
    "top_days": _query(lambda b: K.top_rows(_daily(b), "orders", 10, "ds")),
    "top_weeks": _query(lambda b: K.top_rows(K.weekly_rollup(_daily(b)), "revenue", 6, "week")),
    "top_months": _query(lambda b: K.top_rows(_monthly(b).select("month", "revenue", "orders"), "revenue", 6, "month")),
}
LINES = f"order_id, product_id, units, {_money('list_cents')} AS list_price, {_money('unit_cents')} AS unit_price, {_money('total_cents')} AS total_price, origin, order_date, updated"
M = "CAST(date_trunc('month', order_date) AS DATE) AS month"
ORACLES = {
    "valid_rows": f"{CANON} SELECT * FROM o WHERE (status IS NULL OR status NOT IN ('P')) AND (professional_id IS NULL OR professional_id NOT IN (7, 21)) AND (customer_id IS NULL OR customer_id NOT IN (3, 11))",
    "valid_orders": f"{CANON} SELECT * FROM valid",
    "base_items": f"{CANON} SELECT {LINES}, has_professional, state FROM base",
    "first_sale": f"{CANON} SELECT * FROM firsts",
    "order_totals": f"{CANON} SELECT order_id, order_date, has_professional, state, {_money('value_cents')} AS value, {_money('list_cents')} AS list_value, units, lines, discounted_lines, {_money('new_cents')} AS new_value FROM totals",
    "extreme_orders": f"{CANON} SELECT order_id, in_group, is_extreme FROM flags",
    "lines_with_extremes": f"{CANON} SELECT is_extreme, count(*) AS lines, sum(units) AS units FROM lines GROUP BY 1",
    "product_dimension": f"{CANON} SELECT * FROM p",
    "order_situation": f"{CANON}{SITUATION} SELECT order_id, order_date, {_money('value_cents')} AS value, situation FROM situation",
    "monthly_kpis": f"{CANON}{MONTHLY} SELECT * FROM monthly",
    "monthly_base_revenue": f"{CANON}{MONTHLY} SELECT month, revenue - coalesce(extreme_revenue, 0) AS base_revenue, {_ratio('revenue - coalesce(extreme_revenue, 0)', 'orders - extreme_orders')} AS base_ticket FROM monthly",
    "daily_series": f"{CANON}{DAILY} SELECT * FROM daily",
    "data_quality_report": f"""{CANON} SELECT {M}, count(*) AS lines, count(DISTINCT (order_id, product_id)) AS order_products, count(*) FILTER (WHERE abs(total_cents - unit_cents * units) > 1) AS unfit_totals, {_money('sum(total_cents)')} AS total,
        {_money('sum(unit_cents * units)')} AS unit_total, count(*) FILTER (WHERE unit_cents < list_cents) AS discounted_lines, count(*) FILTER (WHERE total_cents <= 0 OR units <= 0) AS zero_lines, max(updated) AS last_update FROM i GROUP BY 1""",
    "origin_split": f"{CANON} SELECT {M}, coalesce(origin, 'SEM_INFO') AS origin, count(DISTINCT order_id) AS orders, count(*) AS lines, sum(units) AS units, {_money('sum(total_cents)')} AS revenue, {_ratio(_money('sum(total_cents)'), 'count(DISTINCT order_id)')} AS ticket FROM base GROUP BY 1, 2",
    "largest_orders": f"""{CANON} SELECT order_id, min(order_date) AS order_date, count(*) AS lines, sum(units) AS units, {_money('sum(total_cents)')} AS value, {_ratio(_money('sum(total_cents)'), 'sum(units)')} AS value_per_unit,
        coalesce(string_agg(DISTINCT origin, ', ' ORDER BY origin), '') AS origins FROM base WHERE order_date >= DATE '2001-08-01' - 60 AND order_date < DATE '2001-08-01' GROUP BY 1 ORDER BY sum(total_cents) DESC, 1 LIMIT 50""",
    "cleaning_impact": f"{CANON}{SITUATION}{IMPACT} SELECT * FROM impact",
    "nonconcluded_pct": f"{CANON}{SITUATION}{IMPACT} SELECT month, 100 - {_ratio('coalesce(sum(orders) FILTER (WHERE situation = $$VALIDO$$), 0)', 'sum(orders)')} * 100 AS nonconcluded_pct FROM impact GROUP BY 1".replace("$$", "'"),
    "channel_split": f"{CANON} SELECT {M}, CASE WHEN has_professional THEN 'COM_NUTRICIONISTA' ELSE 'SEM_NUTRICIONISTA' END AS channel, count(*) AS orders, {_money('sum(value_cents)')} AS revenue, {_ratio(_money('sum(value_cents)'), 'count(*)')} AS ticket, count(*) FILTER (WHERE is_extreme) AS extreme_orders FROM flags GROUP BY 1, 2",
    "trailing_30": _trailing_sql(30),
    "trailing_7": _trailing_sql(7),
    "yoy_change": f"{CANON}{MONTHLY} SELECT a.month, " + ", ".join(f"({_ratio(f'a.{m}', f'b.{m}')} - 1) * 100 AS {m}_yoy_pct" for m in ("orders", "revenue", "ticket")) + " FROM monthly a JOIN monthly b ON a.month = b.month + INTERVAL 12 MONTH WHERE a.complete AND b.complete AND a.month >= DATE '1997-01-01'",
    "seasonality_index": f"{CANON}{MONTHLY} SELECT month, year, {_ratio('orders', 'avg(orders) OVER (PARTITION BY year)')} * 100 AS index FROM monthly WHERE complete",
    "weekly_rollup": f"""{CANON}{DAILY}, w AS (SELECT {W} AS week, sum(orders) AS orders, sum(revenue) AS revenue FROM daily GROUP BY 1 HAVING count(*) = 7), w2 AS (SELECT * FROM w WHERE week + 6 >= DATE '1996-01-01')
        SELECT week, orders, revenue, {_ratio('revenue', 'orders')} AS ticket, CASE WHEN count(*) OVER four = 4 THEN avg(orders) OVER four END AS orders_mean_4, CASE WHEN count(*) OVER four = 4 THEN avg(revenue) OVER four END AS revenue_mean_4
        FROM w2 WINDOW four AS (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "weekday_profile": _profile_sql("CAST(isodow(ds) - 1 AS INT)", "weekday"),
    "monthday_profile": _profile_sql("CAST(day(ds) AS INT)", "day"),
    "month_bands": _profile_sql("CASE WHEN day(ds) <= 5 THEN '01-05' WHEN day(ds) <= 10 THEN '06-10' WHEN day(ds) <= 15 THEN '11-15' WHEN day(ds) <= 20 THEN '16-20' WHEN day(ds) <= 25 THEN '21-25' ELSE '26-31' END", "band"),
    "weekday_month_heatmap": f"{CANON}{DAILY} SELECT CAST(g.d AS INT) AS weekday, " + ", ".join(f"avg(orders) FILTER (WHERE month(ds) = {m}) AS m{m}" for m in range(1, 13)) + " FROM (SELECT unnest(range(7)) AS d) g LEFT JOIN daily ON isodow(ds) - 1 = g.d GROUP BY 1",
    "ytd_by_year": f"{CANON}{MONTHLY} SELECT year, sum(orders) AS orders, sum(revenue) AS revenue, count(*) AS months FROM monthly WHERE complete AND month_number <= (SELECT month(max(month)) FROM monthly WHERE complete) GROUP BY 1",
    "mtd_vs_last_year": f"""{CANON}{DAILY}, s AS (SELECT DATE '2001-07-31' AS last, sum(orders) FILTER (WHERE ds >= DATE '2001-07-01') AS orders, sum(revenue) FILTER (WHERE ds >= DATE '2001-07-01') AS revenue,
        sum(orders) FILTER (WHERE ds BETWEEN DATE '2000-07-01' AND DATE '2000-07-31') AS orders_year_ago, sum(revenue) FILTER (WHERE ds BETWEEN DATE '2000-07-01' AND DATE '2000-07-31') AS revenue_year_ago FROM daily)
        SELECT *, ({_ratio('orders', 'orders_year_ago')} - 1) * 100 AS orders_change, ({_ratio('revenue', 'revenue_year_ago')} - 1) * 100 AS revenue_change FROM s""",
    "special_periods_lift": f"""{CANON}{DAILY}, per(name, "start", "end", ref_start, ref_end) AS (VALUES ('spring', DATE '2000-03-01', DATE '2000-03-14', DATE '2000-02-01', DATE '2000-02-28'), ('black friday', DATE '1999-11-24', DATE '1999-11-29', DATE '1999-10-20', DATE '1999-11-16')),
        m AS (SELECT name, "start", "end", avg(orders) FILTER (WHERE ds BETWEEN "start" AND "end") AS orders_mean, avg(orders) FILTER (WHERE ds BETWEEN ref_start AND ref_end) AS ref_mean FROM per, daily GROUP BY 1, 2, 3)
        SELECT *, ({_ratio('orders_mean', 'ref_mean')} - 1) * 100 AS lift_pct FROM m WHERE ref_mean >= 1""",
    "top_days": f"{CANON}{DAILY} SELECT * FROM daily ORDER BY orders DESC, ds LIMIT 10",
    "top_weeks": f"""{CANON}{DAILY}, w AS (SELECT {W} AS week, sum(orders) AS orders, sum(revenue) AS revenue FROM daily GROUP BY 1 HAVING count(*) = 7), x AS (
        SELECT week, orders, revenue, {_ratio('revenue', 'orders')} AS ticket, CASE WHEN count(*) OVER four = 4 THEN avg(orders) OVER four END AS orders_mean_4, CASE WHEN count(*) OVER four = 4 THEN avg(revenue) OVER four END AS revenue_mean_4
        FROM w WINDOW four AS (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT * FROM x ORDER BY revenue DESC, week LIMIT 6""",
    "top_months": f"{CANON}{MONTHLY} SELECT month, revenue, orders FROM monthly ORDER BY revenue DESC, month LIMIT 6",
}
assert OPTIONS.as_of == date(2001, 8, 1)  # the SQL above has it spelt out
