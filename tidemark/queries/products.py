"""Queries of cubes, levels, the calendar, baskets and cannibalization."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import label_missing, week_of
from tidemark.operators import basket as B
from tidemark.operators import calendar as D
from tidemark.operators import cannibal as X
from tidemark.operators import cubes as C
from tidemark.operators import kpis as K
from tidemark.plans import incremental as I
from tidemark.queries.base import CANON, Base
from tidemark.queries.sales import DAILY, _daily, _money, _money_lines, _query, _ratio
from tidemark.sources.bucketed import stored, stored_dir
from tidemark.sources.stages import settle


def _labelled(b: Base):
    return C.labelled_lines(b.lines, b.products, b.regions)


def _cube(b: Base, kind: str):
    return C.weekly_cube(_labelled(b), kind, b.options.as_of)


def _levels(b: Base):
    cube = _cube(b, "full")
    return C.aggregate_levels(cube)


def brand_grid(b: Base):
    """Brands within their makers, of which a brand's name tells the first seven letters."""
    return b.kept("brand_grid", lambda: X.weekly_grid(_cube(b, "product").withColumn("maker", F.substring("brand", 1, 7)), "brand", "maker"))


def _product_weeks(b: Base):
    """(product_id, week, subgroup, units, revenue, list_revenue): lines are dealt out by product once, and all that groups by it follows
    where they lie. Labels are met by sums."""
    measures = {"units": F.col("units"), "revenue": F.col("total_price"), "list_revenue": F.coalesce("list_price", "unit_price") * F.col("units")}
    lines = _before(b).select("product_id", week_of(F.col("order_date")).alias("week"), *[c.alias(m) for m, c in measures.items()])
    sums = lines.repartition(int(b.spark.conf.get("spark.sql.shuffle.partitions")), "product_id").groupBy("product_id", "week").agg(*[F.sum(m).alias(m) for m in measures])
    labels = b.products.select("product_id", label_missing(F.col("subgroup"), "SEM_SUBGRUPO").alias("subgroup"))
    return sums.join(labels, "product_id", "left").withColumn("subgroup", label_missing(F.col("subgroup"), "SEM_SUBGRUPO"))


def _before(b: Base):
    return b.base.where(F.col("order_date") < F.lit(b.options.as_of))


def product_sums(b: Base):
    """(weekly sums, weeks) of products within their subgroups, those that sold in 20 weeks or more."""

    def make():
        rows, _ = X.weekly_sums(_product_weeks(b), "product_id", "subgroup", 20)
        return stored(rows), settle(C.week_spine(_before(b).select(week_of(F.col("order_date")).alias("week"))))

    return b._once("product_sums", make)


def _product_peaks(b: Base):
    return b.kept("product_peaks", lambda: X.sparse_peaks(*product_sums(b)))


def _based(b: Base):
    return b.kept("based", lambda: X.with_baselines(brand_grid(b)))


def _peaks(b: Base):
    return X.detect_peaks(_based(b))


def _summary(b: Base, peaks=_peaks):
    return X.peak_summary(peaks(b)).withColumn("reading", X.rate_reading(F.col("rate"), F.col("episodes")))


def _pairs(b: Base):
    return X.peak_pairs(_peaks(b), _based(b))


#: Lines from here on come late in `incremental_cube`.
LATE = date(2001, 6, 1)


def _incremental(b: Base):
    """The product cube of the lines before LATE, then brought up to date with the rest: what a full build gives."""
    late = F.coalesce(F.col("order_date") >= F.lit(LATE), F.lit(False))
    where = stored_dir(b.spark)
    before = I.full_state(b.items.where(~late), b.orders, b.options, new_value=False)
    I.write_cube(I.cube_of(before, b.products, b.regions, "product", b.options), where)
    after, weeks = I.refreshed(before, b.items, b.orders, I.changed_orders(b.items.where(late), b.orders.limit(0)), b.options)
    I.overwrite_weeks(I.cube_of(after, b.products, b.regions, "product", b.options, weeks), weeks, where)
    return I.read_cube(b.spark, where)


def _lift(b: Base):
    return B.basket_lift(B.basket_pairs(b.lines, b.options.as_of))


LABELLED = """, labelled AS (
    SELECT order_id, order_date, CAST(date_trunc('week', order_date) AS DATE) AS week, is_extreme, product_id, coalesce(name, 'produto ' || product_id) AS product, coalesce(brand, 'SEM_MARCA') AS brand, coalesce(grp, 'SEM_GRUPO') AS grp,
        coalesce(subgroup, 'SEM_SUBGRUPO') AS subgroup, CASE WHEN has_professional THEN 'COM_NUTRICIONISTA' ELSE 'SEM_NUTRICIONISTA' END AS channel, coalesce(origin, 'SEM_INFO') AS origin, coalesce(lines.state, 'SEM_INFO') AS state,
        coalesce(region, 'SEM_INFO') AS region, units, total_cents AS rev, list_cents * units AS lst
    FROM lines LEFT JOIN p USING (product_id) LEFT JOIN regions ON regions.state = lines.state
), before AS (SELECT * FROM labelled WHERE order_date < DATE '2001-08-01')"""
SUMS = f"units, {_money('rev')} AS revenue, {_money('lst')} AS list_revenue"


def _cube_sql(kind: str) -> str:
    keys = ", ".join(["week", *C.KINDS[kind], "is_extreme"])
    return f"{CANON}{LABELLED}, c AS (SELECT {keys}, count(DISTINCT order_id) AS orders, sum(units) AS units, sum(rev) AS rev, sum(lst) AS lst FROM before GROUP BY {keys}) SELECT {keys}, orders, {SUMS} FROM c"


LEVELS = f"""{LABELLED}, per AS (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS level, {dim or chr(39) + 'Total' + chr(39)} AS series, week, sum(units) AS units, sum(rev) AS rev, sum(lst) AS lst FROM before WHERE NOT is_extreme GROUP BY 1, 2, 3" for name, dim in C.LEVELS.items()
) + f"), levels AS (SELECT level, series, week, {SUMS} FROM per)"
NOISE = f""", wk AS (SELECT datediff('day', min(week), max(week)) // 7 + 1 AS n FROM levels), s AS (SELECT level, series, sum(revenue) AS s, sum(revenue * revenue) AS ss, any_value(n) AS n FROM levels, wk GROUP BY 1, 2),
    cv AS (SELECT level, s, sqrt(greatest((ss - n * (s / n) * (s / n)) / (n - 1), 0)) / (s / n) AS cv FROM s) SELECT level, count(*) AS series, {_ratio('sum(cv * s)', 'sum(s)')} AS weighted_cv FROM cv GROUP BY 1"""
TOP = """, m AS (SELECT max(week) AS last FROM levels), score AS (SELECT level, series, sum(CASE WHEN week > last - 182 THEN revenue ELSE 0 END) AS score FROM levels, m GROUP BY 1, 2),
    named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY level ORDER BY score DESC, series) <= 6 THEN series ELSE 'OUTROS' END AS kept FROM score),
    alive AS (SELECT level, kept FROM named GROUP BY 1, 2 HAVING sum(score) > 0)
    SELECT level, kept AS series, week, sum(revenue) AS revenue FROM levels JOIN named USING (level, series) JOIN alive USING (level, kept) GROUP BY 1, 2, 3"""
def _grid_sql(item: str, group: str, least: int = 0, start: str = "0001-01-01") -> str:
    return f"""{LABELLED}, cb AS (SELECT {item} AS item, week, sum(units) AS units, sum(rev) AS rev, sum(lst) AS lst FROM before GROUP BY 1, 2),
ofgrp AS (SELECT item, arg_max(grp, k) AS grp FROM (SELECT item, grp, (sum(rev), grp) AS k FROM (SELECT {item} AS item, {group} AS grp, rev FROM before) GROUP BY item, grp) GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series((SELECT min(week) FROM cb), (SELECT max(week) FROM cb), INTERVAL 7 DAY)) AS DATE) AS week),
grid AS (SELECT item, grp, week, coalesce(CAST(units AS DOUBLE), 0) AS units, coalesce({_money('rev')}, 0) AS revenue, coalesce({_money('lst')}, 0) AS list_revenue
    FROM (SELECT item FROM cb GROUP BY item HAVING count(*) FILTER (WHERE units > 0) >= {least}) CROSS JOIN sp LEFT JOIN cb USING (item, week) JOIN ofgrp USING (item)),
g1 AS (SELECT *, sum(units) OVER (PARTITION BY grp, week) - units AS rest, count(*) OVER (PARTITION BY grp, week) AS members, 1 - {_ratio('revenue', 'list_revenue')} AS discount FROM grid),
based AS (SELECT *, """ + ", ".join(f"CASE WHEN count({c}) OVER w >= 6 THEN quantile_cont({c}, 0.5) OVER w END AS {c}_base" for c in ("units", "discount", "rest")) + """ FROM g1 WINDOW w AS (PARTITION BY item ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
bf AS (SELECT y, CAST(make_date(y, 11, 1) AS DATE) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 22 AS INT) AS friday FROM (SELECT DISTINCT year(week) AS y FROM grid)),
peaks AS (SELECT item, grp, week, units, units_base, units - units_base AS gain, rest - rest_base AS rest_change, (discount - discount_base) * 100 AS discount_change FROM based JOIN bf ON bf.y = year(week)
    WHERE members >= 2 AND week >= DATE '""" + start + """' AND units_base > 0 AND units >= 1.5 * units_base AND units - units_base >= 5 AND NOT (week - friday BETWEEN -10 AND 3 OR (month(week) = 12 AND day(week) >= 16) OR (month(week) = 1 AND day(week) <= 7))),
summary AS (SELECT item, grp, count(*) AS episodes, sum(gain) AS gain, sum(rest_change) AS rest_change, -sum(rest_change) / sum(gain) AS rate, (1 + sum(rest_change) / sum(gain)) * 100 AS incremental_pct, avg(discount_change) AS discount_change,
    array_to_string(list_slice(list_reverse_sort(list(strftime(week, '%Y-%m-%d'))), 1, 6), ', ') AS weeks FROM peaks WHERE rest_change IS NOT NULL GROUP BY 1, 2),
toprank AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY sum(units) DESC, item) AS rank FROM grid WHERE week >= DATE '""" + start + """' GROUP BY 1, 2),
others AS (SELECT b.grp, b.week, b.item AS other, b.units - b.units_base AS other_change FROM based b JOIN toprank USING (grp, item) WHERE rank <= 40 AND units_base IS NOT NULL),
own AS (SELECT grp, item, count(*) AS episodes, sum(gain) AS gain FROM peaks GROUP BY 1, 2),
changed AS (SELECT p.grp, p.item, o.other, sum(other_change) AS other_change FROM peaks p JOIN others o ON o.grp = p.grp AND o.week = p.week AND o.other <> p.item GROUP BY 1, 2, 3),
pairs AS (SELECT own.grp, own.item, t.item AS other, episodes, gain, coalesce(c.other_change, 0) AS other_change, (0.0 - coalesce(c.other_change, 0)) / gain AS rate
    FROM own JOIN toprank t ON t.grp = own.grp AND t.item <> own.item AND t.rank <= 40 LEFT JOIN changed c ON c.grp = own.grp AND c.item = own.item AND c.other = t.item),
sym AS (SELECT least(item, other) AS item_a, greatest(item, other) AS item_b, sum(rate * episodes) / sum(episodes) AS pair_rate, sum(episodes) AS episodes FROM pairs WHERE rate IS NOT NULL AND episodes >= 3 GROUP BY 1, 2),
ld AS (SELECT item, week, ln(1 + units) - lag(ln(1 + units)) OVER (PARTITION BY item ORDER BY week) AS change FROM grid),
st AS (SELECT week, ln(1 + sum(units)) - lag(ln(1 + sum(units))) OVER (ORDER BY week) AS store_change FROM grid GROUP BY 1),
res AS (SELECT item, week, change - store_change AS residual FROM ld JOIN st USING (week) WHERE change IS NOT NULL AND store_change IS NOT NULL),
cand AS (SELECT x.item AS item_a, y.item AS item_b FROM toprank x JOIN toprank y ON x.grp = y.grp AND x.item < y.item AND x.rank <= 40 AND y.rank <= 40),
corrs AS (SELECT item_a, item_b, corr(a.residual, b.residual) AS corr FROM cand JOIN res a ON a.item = item_a JOIN res b ON b.item = item_b AND b.week = a.week GROUP BY 1, 2)"""


GRID, PRODUCT_GRID = _grid_sql("brand", "left(brand, 7)"), _grid_sql("product_id", "subgroup", 20)
READING = """CASE WHEN episodes < 3 OR rate IS NULL THEN 'inconclusivo' WHEN rate >= 0.5 THEN 'canibalização forte' WHEN rate >= 0.2 THEN 'canibalização moderada' WHEN rate > -0.2 THEN 'canibalização baixa'
    ELSE 'o grupo cresceu junto' END"""


def _basket_sql(lines: str, key: str) -> str:
    return f""", recent AS (SELECT * FROM {lines} WHERE order_date >= DATE '2001-08-01' - 365 AND order_date < DATE '2001-08-01'),
    toplist AS (SELECT {key} AS pid FROM recent GROUP BY 1 ORDER BY sum(total_cents) DESC, 1 LIMIT 150), dist AS (SELECT DISTINCT order_id, {key} AS pid FROM recent WHERE NOT is_extreme),
    among AS (SELECT * FROM dist WHERE pid IN (SELECT pid FROM toplist)), single AS (SELECT pid, count(*) AS n FROM among GROUP BY 1),
    bpairs AS (SELECT a.pid AS product_a, b.pid AS product_b, count(*) AS together FROM among a JOIN among b ON a.order_id = b.order_id AND a.pid < b.pid GROUP BY 1, 2),
    basket AS (SELECT product_a, product_b, together, sa.n AS orders_a, sb.n AS orders_b, (SELECT count(DISTINCT order_id) FROM dist) AS total_orders FROM bpairs JOIN single sa ON sa.pid = product_a JOIN single sb ON sb.pid = product_b),
    lifts AS (SELECT *, CAST(together AS DOUBLE) * total_orders / (CAST(orders_a AS DOUBLE) * orders_b) AS lift FROM basket)"""


EASTER = """(SELECT y, make_date(y, CAST((h + m - 7 * n + 114) // 31 AS INT), CAST((h + m - 7 * n + 114) % 31 + 1 AS INT)) AS easter FROM (
    SELECT *, (a + 11 * h + 22 * m) // 451 AS n FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS m FROM (SELECT *, c // 4 AS i, c % 4 AS k, (19 * a + b - d - g + 15) % 30 AS h FROM (
    SELECT *, (b - f + 1) // 3 AS g FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (y // 100) // 4 AS d, (y // 100) % 4 AS e, (y // 100 + 8) // 25 AS f FROM (SELECT unnest(range(1993, 2005)) AS y)))))))"""
CALENDAR = f"""WITH es AS {EASTER}, ds AS (SELECT CAST(unnest(generate_series(DATE '1994-12-31', DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS ds),
hol AS (SELECT ds, (month(ds), day(ds)) IN ((1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25)) OR ds = easter - 2 AS h FROM ds JOIN es ON y = year(ds)),
cal AS (
    SELECT d.ds, d.h AS is_holiday, e.h AS is_eve, a.h AS is_after, to_friday = 0 AS is_black_friday, abs(to_friday) <= 3 AS near_black_friday, (month(d.ds) = 12 AND day(d.ds) >= 20) OR (month(d.ds) = 1 AND day(d.ds) <= 2) AS is_year_end,
        d.ds - easter BETWEEN -48 AND -46 AS is_carnival, d.ds - easter BETWEEN -6 AND 0 AS is_holy_week, CAST(isodow(d.ds) - 1 AS INT) AS weekday, day(d.ds) <= 5 AS is_month_start, last_day(d.ds) - d.ds < 3 AS is_month_end,
        sin(2 * pi() * dayofyear(d.ds) / 365.25) AS annual_sin, cos(2 * pi() * dayofyear(d.ds) / 365.25) AS annual_cos
    FROM (SELECT *, ds - (CAST(make_date(year(ds), 11, 1) AS DATE) + CAST((11 - isodow(make_date(year(ds), 11, 1))) % 7 + 22 AS INT)) AS to_friday FROM hol) d JOIN hol e ON e.ds = d.ds + 1 JOIN hol a ON a.ds = d.ds - 1 JOIN es ON y = year(d.ds)
)"""


def _calendar(b: Base):
    days = _daily(b).agg(F.min("ds"), F.max("ds")).first()
    return D.calendar_dimension(b.spark, *days)


CAL_DAYS = f"{CALENDAR} , {(CANON + DAILY).strip()[5:]}"

QUERIES = {
    "cube_product": _query(lambda b: _money_lines(_cube(b, "product"))),
    "incremental_cube": _query(lambda b: _money_lines(_incremental(b))),
    "cube_geo": _query(lambda b: _money_lines(_cube(b, "geo"))),
    "cube_full": _query(lambda b: _money_lines(_cube(b, "full"))),
    "levels": _query(lambda b: _money_lines(_levels(b))),
    "informative_levels": _query(lambda b: C.informative_levels(_levels(b)).groupBy("level").agg(F.count_distinct("series").alias("series"))),
    "concentration": _query(lambda b: C.concentration(_cube(b, "product"))),
    "noise_by_level": _query(lambda b: C.noise_by_level(_levels(b))),
    "top_n_plus_others": _query(lambda b: _money_lines(C.top_n_plus_others(_levels(b), 6))),
    "share_over_total": _query(lambda b: C.share_over_total(_levels(b), ["level", "week"]).select("level", "series", "week", "share_pct")),
    "top_growth": _query(lambda b: C.top_growth(_levels(b), "Marca", as_of=b.options.as_of)),
    "product_attributes": _query(lambda b: C.product_attributes(_cube(b, "product"))),
    "catalog_counts": _query(lambda b: C.catalog_counts(C.product_attributes(_cube(b, "product")))),
    "active_products": _query(lambda b: C.active_products(_cube(b, "product"), 20)),
    "last_complete_week": _query(lambda b: _daily(b).select("ds", C.last_complete_week(F.col("ds")).alias("week"))),
    "calendar": _query(_calendar),
    "weekly_calendar": _query(lambda b: D.weekly_calendar_features(_calendar(b))),
    "holiday_vs_workday": _query(lambda b: K.holiday_vs_workday(_daily(b), _calendar(b))),
    "top_basket_products": _query(lambda b: B.top_basket_products(b.lines, b.options.as_of)),
    "basket_pairs": _query(lambda b: B.basket_pairs(b.lines, b.options.as_of)),
    "basket_lift": _query(_lift),
    "weekly_grid": _query(brand_grid),
    "baselines": _query(lambda b: _based(b).drop("group_units", "members")),
    "peaks": _query(lambda b: X.detect_peaks(_based(b), alone=True)),
    "peak_summary": _query(_summary),
    "group_cannibalization": _query(lambda b: X.group_cannibalization(_summary(b))),
    "peak_pairs": _query(_pairs),
    "pair_rates": _query(lambda b: X.pair_rate_symmetric(_pairs(b))),
    "product_peaks": _query(_product_peaks),
    "product_cannibalization": _query(lambda b: _summary(b, _product_peaks)),
    "product_pair_rates": _query(lambda b: X.pair_rate_symmetric(X.sparse_peak_pairs(_product_peaks(b), *product_sums(b)))),
    "log_diff_residual": _query(lambda b: X.log_diff_residual(brand_grid(b))),
    "weekly_corr": _query(lambda b: X.weekly_corr(X.log_diff_residual(brand_grid(b)), X.candidate_pairs(brand_grid(b)))),
}
ORACLES = {
    "cube_product": _cube_sql("product"),
    "incremental_cube": _cube_sql("product"),
    "cube_geo": _cube_sql("geo"),
    "cube_full": _cube_sql("full"),
    "levels": f"{CANON}{LEVELS} SELECT * FROM levels",
    "informative_levels": f"{CANON}{LEVELS} SELECT level, count(DISTINCT series) AS series FROM levels GROUP BY 1 HAVING count(DISTINCT series) FILTER (WHERE NOT regexp_matches(series, '^SEM_(INFO|GRUPO|SUBGRUPO|MARCA)')) >= 2 OR level = 'Total'",
    "concentration": f"""{CANON}{LABELLED}, per AS (SELECT subgroup, product_id, {_money('sum(rev)')} AS r FROM before GROUP BY 1, 2), sh AS (SELECT *, r / {_money("tot")} * 100 AS share FROM per JOIN (SELECT subgroup, sum(rev) AS tot FROM before GROUP BY 1) USING (subgroup))
        SELECT subgroup, sum(share * share) AS hhi, count(*) AS products, max(share) AS max_share, arg_max(product_id, (share, product_id)) AS leader FROM sh GROUP BY 1""",
    "noise_by_level": f"{CANON}{LEVELS}{NOISE}",
    "top_n_plus_others": f"{CANON}{LEVELS}{TOP}",
    "share_over_total": f"{CANON}{LEVELS} SELECT level, series, week, {_ratio('revenue', 'sum(revenue) OVER (PARTITION BY level, week)')} * 100 AS share_pct FROM levels",
    "top_growth": f"""{CANON}{LEVELS}, s AS (SELECT series, sum(CASE WHEN date_trunc('month', week) BETWEEN DATE '2001-05-01' AND DATE '2001-07-01' THEN revenue ELSE 0 END) AS now,
        sum(CASE WHEN date_trunc('month', week) BETWEEN DATE '2000-05-01' AND DATE '2000-07-01' THEN revenue ELSE 0 END) AS before FROM levels WHERE level = 'Marca' GROUP BY 1)
        SELECT series, now, before, now - before AS gain, ({_ratio('now', 'before')} - 1) * 100 AS change_pct, now / (SELECT sum(now) FROM s) * 100 AS share_pct FROM s ORDER BY gain DESC, series LIMIT 10""",
    "product_attributes": f"{CANON}{LABELLED}, w AS (SELECT product_id, week, product, brand, grp, subgroup, sum(rev) AS r FROM before GROUP BY ALL) SELECT product_id, product, brand, grp, subgroup FROM w QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY r DESC, week DESC) = 1",
    "catalog_counts": f"{CANON}{LABELLED} SELECT grp, subgroup, count(DISTINCT product_id) AS products FROM before GROUP BY 1, 2",
    "active_products": f"{CANON}{LABELLED}, w AS (SELECT product_id, week, sum(units) AS u FROM before GROUP BY 1, 2) SELECT product_id, count(*) FILTER (WHERE u > 0) AS weeks FROM w GROUP BY 1 HAVING count(*) FILTER (WHERE u > 0) >= 20",
    "last_complete_week": f"{CANON}{DAILY} SELECT ds, CAST(date_trunc('week', ds + 1) AS DATE) - 7 AS week FROM daily",
    "calendar": f"{CAL_DAYS} SELECT * FROM cal WHERE ds BETWEEN (SELECT min(ds) FROM daily) AND (SELECT max(ds) FROM daily)",
    "weekly_calendar": f"""{CAL_DAYS}, c AS (SELECT *, CAST(date_trunc('week', ds) AS DATE) AS week FROM cal WHERE ds BETWEEN (SELECT min(ds) FROM daily) AND (SELECT max(ds) FROM daily))
        SELECT week, CAST((week - (SELECT min(week) FROM c)) // 7 AS INT) AS trend, CAST(month(week + 3) AS INT) AS month, count(*) FILTER (WHERE is_holiday) AS holidays, max(CAST(is_black_friday AS INT)) AS black_friday, max(CAST(is_year_end AS INT)) AS year_end,
        count(*) FILTER (WHERE is_month_start) AS month_start_days, """ + ", ".join(f"{f}({k} * (2 * pi() * dayofyear(week + 3) / 365.25)) AS {f}{k}" for k in (1, 2) for f in ("sin", "cos")) + " FROM c GROUP BY week",
    "holiday_vs_workday": f"{CAL_DAYS} SELECT avg(orders) FILTER (WHERE is_holiday) AS holiday_mean, avg(orders) FILTER (WHERE NOT is_holiday AND isodow(ds) < 6) AS workday_mean, avg(orders) AS mean FROM daily JOIN cal USING (ds)",
    "top_basket_products": f"{CANON}{_basket_sql('lines', 'product_id')} SELECT pid AS product_id FROM toplist",
    "basket_pairs": f"{CANON}{_basket_sql('lines', 'product_id')} SELECT * FROM basket",
    "basket_lift": f"{CANON}{_basket_sql('lines', 'product_id')} SELECT * FROM lifts",
    "weekly_grid": f"{CANON}{GRID} SELECT * FROM grid",
    "baselines": f"{CANON}{GRID} SELECT * EXCLUDE (members) FROM based",
    "peaks": f"{CANON}{GRID.replace('members >= 2 AND ', '')} SELECT * FROM peaks",
    "peak_summary": f"{CANON}{GRID} SELECT *, {READING} AS reading FROM summary",
    "product_peaks": f"{CANON}{PRODUCT_GRID} SELECT * FROM peaks",
    "product_cannibalization": f"{CANON}{PRODUCT_GRID} SELECT *, {READING} AS reading FROM summary",
    "product_pair_rates": f"{CANON}{PRODUCT_GRID} SELECT * FROM sym",
    "group_cannibalization": f"""{CANON}{GRID} SELECT grp, count(*) AS items, -sum(rest_change) / sum(gain) AS rate, CASE WHEN -sum(rest_change) / sum(gain) >= 0.4 THEN 'evitar promoções simultâneas'
        WHEN -sum(rest_change) / sum(gain) >= 0.2 THEN 'alternar promoções' ELSE 'promoções somam vendas' END AS recommendation FROM summary WHERE episodes >= 3 GROUP BY 1""",
    "peak_pairs": f"{CANON}{GRID} SELECT * FROM pairs",
    "pair_rates": f"{CANON}{GRID} SELECT * FROM sym",
    "log_diff_residual": f"{CANON}{GRID} SELECT * FROM res",
    "weekly_corr": f"{CANON}{GRID} SELECT * FROM corrs",
}
