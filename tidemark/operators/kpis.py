"""Monthly, daily and calendar tables of the clean base, and what is read off them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Options
from tidemark.functions import change_pct, channel_label, month_of, pct, ratio, week_of
from tidemark.operators.orders import line_situation


def _total(condition: Column, value: str = "value") -> Column:
    return F.sum(F.when(condition, F.col(value)).otherwise(0))


#: Cents of a step in which the first count of a quantile goes.
STEP = 10_000


def exact_quantiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, str], column: str = "value") -> DataFrame:
    """(keys, a column for each of `wanted`): the smallest value of whole cents with at least that share, a decimal text above 0, of a group's values.

    Values are counted by steps first, then single values within those steps only that hold a quantile. So a window holds no more rows than
    a group has steps, or a step has cents, however many values there are. Nulls do not count; keys may be null. A group
    without values has no row, except that without keys there always is one.
    """
    group = [F.col(c) for c in keys]
    cents = (F.col(column) * 100).cast("long")
    at = F.floor(F.col("cents") / STEP)
    counts = rows.select(*keys, cents.alias("cents")).groupBy(*keys, "cents").agg(F.count("*").alias("n"))
    steps = counts.where("cents is not null").groupBy(*keys, at.alias("step")).agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group)
    upto = lambda c: F.sum("n").over(whole.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    placed = steps.select(*keys, "step", "n", upto("step").alias("upto"), F.sum("n").over(whole).alias("total"))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.ceil(F.col("total") * F.lit(q).cast("decimal(9,8)")).cast("long").alias("rank")) for k, q in wanted.items()]))
    held = placed.select("*", ranks.alias("q")).where((F.col("q.rank") <= F.col("upto")) & (F.col("q.rank") > F.col("upto") - F.col("n")))
    held = held.select(*[F.col(c).alias(f"of_{c}") for c in keys], F.col("step").alias("of_step"), F.col("q.name").alias("name"), (F.col("q.rank") - F.col("upto") + F.col("n")).alias("rank"))
    same = lambda df, prefix: reduce(and_, [df[c].eqNullSafe(F.col(f"{prefix}{c}")) for c in keys], F.lit(True))
    single = counts.withColumn("step", at)
    near = single.join(F.broadcast(held), same(single, "of_") & (single["step"] == F.col("of_step")))  # a row a group and quantile
    within = F.sum("n").over(Window.partitionBy(*group, "name").orderBy("cents").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("within", within).where((F.col("rank") <= F.col("within")) & (F.col("rank") > F.col("within") - F.col("n")))
    kind = rows.schema[column].dataType
    value = (F.col("cents").cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(kind)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, value)).alias(k) for k in wanted])


def value_quantile(totals: DataFrame, q: str, name: str = "limit") -> DataFrame:
    """One row: the q-quantile of all orders' values."""
    return exact_quantiles(totals, (), {name: q})


def monthly_kpis(base: DataFrame, flags: DataFrame, options: Options) -> DataFrame:
    """Thirty figures for each month of orders. Distinct products count by their line's month. Ratios are not rounded."""
    large = value_quantile(flags, "0.99")
    orders = flags.crossJoin(F.broadcast(large)).withColumn("month", month_of(F.col("order_date")))  # one row
    is_large, extreme = F.col("value") > F.col("limit"), F.col("is_extreme")
    products = base.groupBy(month_of(F.col("order_date")).alias("month")).agg(F.count_distinct("product_id").alias("distinct_products"))
    quantiles = exact_quantiles(orders, ["month"], {"median_order": "0.5", "p90_order": "0.9"})
    sums = orders.groupBy("month").agg(
        F.count("*").alias("orders"), F.sum("value").alias("revenue"), F.sum("units").alias("units"), F.sum("list_value").alias("list_revenue"), F.sum("lines").alias("lines"),
        F.sum("discounted_lines").alias("discounted_lines"), F.sum("new_value").alias("new_revenue"), F.max("value").alias("largest_order"),
        F.count_if(is_large).alias("large_orders"), _total(is_large).alias("large_revenue"), F.count_if(extreme).alias("extreme_orders"), _total(extreme).alias("extreme_revenue"),
        F.count_if("in_group").alias("group_orders"), F.count_distinct("order_date").alias("active_days"), F.max("order_date").alias("last_date"),
    )
    c = F.col
    days = F.dayofmonth(F.last_day("month"))
    return sums.join(products, "month", "left").join(quantiles.withColumnRenamed("month", "own"), F.col("month").eqNullSafe(F.col("own")), "left").select(
        "month", F.year("month").alias("year"), F.month("month").alias("month_number"), F.quarter("month").alias("quarter"), "orders", c("revenue").cast("double"), ratio(c("revenue"), c("orders")).alias("ticket"), "units",
        ratio(c("units"), c("orders")).alias("units_per_order"), ratio(c("revenue"), c("units")).alias("unit_price"), ratio(c("list_revenue"), c("units")).alias("unit_list_price"), pct(c("list_revenue") - c("revenue"), c("list_revenue")).alias("discount_pct"),
        pct(c("discounted_lines"), c("lines")).alias("discounted_lines_pct"), "distinct_products", pct(c("new_revenue"), c("revenue")).alias("new_products_pct"), c("median_order").cast("double"), c("p90_order").cast("double"), c("largest_order").cast("double"),
        "large_orders", pct(c("large_revenue"), c("revenue")).alias("large_pct"), ratio(c("revenue") - c("large_revenue"), c("orders") - c("large_orders")).alias("ticket_without_large"), ratio(c("lines"), c("orders")).alias("lines_per_order"),
        "extreme_orders", c("extreme_revenue").cast("double"), "group_orders", ratio(c("revenue") - c("extreme_revenue"), c("orders") - c("extreme_orders")).alias("ticket_without_extremes"), "active_days", days.alias("days_in_month"),
        (F.last_day("month") < F.lit(options.as_of)).alias("complete"), "last_date",
    )


def with_base_revenue(monthly: DataFrame) -> DataFrame:
    """Revenue and ticket without extreme orders."""
    return monthly.withColumn("base_revenue", F.col("revenue") - F.coalesce("extreme_revenue", F.lit(0.0))).withColumn("base_ticket", ratio(F.col("base_revenue"), F.col("orders") - F.coalesce("extreme_orders", F.lit(0))))


def day_spine(days: DataFrame, as_of: date, column: str = "ds") -> DataFrame:
    """All days from the first of `days` to the one before as_of; none if there are none."""
    bounds = days.agg(F.min(column).alias("lo")).where(F.col("lo") < F.lit(as_of))
    return bounds.select(F.explode(F.sequence("lo", F.date_sub(F.lit(as_of), 1))).alias(column))


def daily_series(flags: DataFrame, as_of: date) -> DataFrame:
    """Every day from the first order to the one before as_of: sums are 0 on days without orders, ratios null."""
    extreme = F.col("is_extreme")
    days = flags.where(F.col("order_date") < F.lit(as_of)).groupBy(F.col("order_date").alias("ds")).agg(
        F.count("*").alias("orders"), F.sum("value").alias("revenue"), F.sum("units").alias("units"), F.sum("list_value").alias("list_revenue"), F.count_if(extreme).alias("extreme_orders"), _total(extreme).alias("extreme_revenue")
    )
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return day_spine(days, as_of).join(days, "ds", "left").select(
        "ds", F.dayofweek("ds").alias("weekday"), zero("orders", "long"), zero("revenue", "double"), zero("units", "long"), ratio(F.col("revenue"), F.col("orders")).alias("ticket"),
        pct(F.col("list_revenue") - F.col("revenue"), F.col("list_revenue")).alias("discount_pct"), zero("extreme_orders", "long"), zero("extreme_revenue", "double"),
    )


def data_quality_report(items: DataFrame) -> DataFrame:
    """Per month of raw lines: how many, distinct order and product pairs, totals that do not fit, discounts, zeros."""
    product = F.col("unit_price") * F.col("units")
    return items.where("order_date is not null").groupBy(month_of(F.col("order_date")).alias("month")).agg(
        F.count("*").alias("lines"), F.count_distinct(F.struct("order_id", "product_id")).alias("order_products"), F.count_if(F.abs(F.col("total_price") - product) > 0.01).alias("unfit_totals"),
        F.sum("total_price").cast("double").alias("total"), F.sum(product).cast("double").alias("unit_total"), F.count_if(F.col("unit_price") < F.col("list_price")).alias("discounted_lines"),
        F.count_if((F.col("total_price") <= 0) | (F.col("units") <= 0)).alias("zero_lines"), F.max("updated").alias("last_update"),
    )


def origin_split(base: DataFrame) -> DataFrame:
    """Month and origin; an order with lines of two origins counts in both."""
    keys = [month_of(F.col("order_date")).alias("month"), F.coalesce("origin", F.lit("SEM_INFO")).alias("origin")]
    per_order = base.groupBy(*keys, "order_id").agg(F.count("*").alias("lines"), F.sum("units").alias("units"), F.sum("total_price").alias("revenue"))
    return per_order.groupBy("month", "origin").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("units").alias("units"), F.sum("revenue").cast("double").alias("revenue"), ratio(F.sum("revenue"), F.count("*")).alias("ticket"))


def largest_orders(base: DataFrame, as_of: date, days: int = 60, n: int = 50) -> DataFrame:
    """The n dearest orders of the last days, with their origins; ties go to the smaller id."""
    recent = base.where((F.col("order_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("order_date") < F.lit(as_of)))
    orders = recent.groupBy("order_id").agg(
        F.min("order_date").alias("order_date"), F.count("*").alias("lines"), F.sum("units").alias("units"), F.sum("total_price").cast("double").alias("value"),
        ratio(F.sum("total_price"), F.sum("units")).alias("value_per_unit"), F.array_join(F.sort_array(F.collect_set("origin")), ", ").alias("origins"),
    )
    return orders.orderBy(F.desc("value"), "order_id").limit(n)


def cleaning_impact(items: DataFrame, orders: DataFrame, valid: DataFrame, options: Options) -> DataFrame:
    """Month and situation of all orders, with those above the 99 % quantile of all."""
    all_ = line_situation(items, orders, valid)
    limit = value_quantile(all_, "0.99")
    odd = F.col("value") > F.col("limit")
    return all_.crossJoin(F.broadcast(limit)).groupBy(month_of(F.col("order_date")).alias("month"), "situation").agg(  # one row
        F.count("*").alias("orders"), F.sum("value").cast("double").alias("revenue"), F.count_if(odd).alias("atypical_orders"), _total(odd).cast("double").alias("atypical_revenue")
    )


def channel_split(flags: DataFrame) -> DataFrame:
    return flags.groupBy(month_of(F.col("order_date")).alias("month"), channel_label(F.col("has_professional")).alias("channel")).agg(
        F.count("*").alias("orders"), F.sum("value").cast("double").alias("revenue"), ratio(F.sum("value"), F.count("*")).alias("ticket"), F.count_if("is_extreme").alias("extreme_orders")
    )


def nonconcluded_pct(impact: DataFrame) -> DataFrame:
    """Share of each month's orders that do not count."""
    return impact.groupBy("month").agg((100 - pct(F.sum(F.when(F.col("situation") == "VALIDO", F.col("orders")).otherwise(0)), F.sum("orders"))).alias("nonconcluded_pct"))


def trailing_window_compare(daily: DataFrame, days: int) -> DataFrame:
    """One row: the last days, those before, and the same ones a year earlier."""
    last = daily.agg(F.max("ds").alias("last"))
    rows = daily.crossJoin(F.broadcast(last))  # one row
    year_ago = F.add_months("last", -12)
    spans = {"": (F.date_sub("last", days), F.col("last")), "_before": (F.date_sub("last", 2 * days), F.date_sub("last", days)), "_year_ago": (F.date_sub(year_ago, days), year_ago)}
    sums = [F.sum(F.when((F.col("ds") > lo) & (F.col("ds") <= hi), F.col(m))).alias(f"{m}{name}") for name, (lo, hi) in spans.items() for m in ("orders", "revenue")]
    c = F.col
    got = rows.groupBy("last").agg(*sums)
    for name in spans:
        got = got.withColumn(f"ticket{name}", ratio(c(f"revenue{name}"), c(f"orders{name}")))
    return got.select(F.lit(days).alias("days"), "last", *[f"{m}{name}" for name in spans for m in ("orders", "revenue", "ticket")], *[change_pct(c(m), c(f"{m}{name}")).alias(f"{m}_change{name}") for name in ("_before", "_year_ago") for m in ("orders", "revenue", "ticket")])


def yoy_change(monthly: DataFrame, start: date | None = None) -> DataFrame:
    """Complete months against the same month a year before."""
    done = monthly.where("complete")
    before = done.select(F.add_months("month", 12).alias("month"), F.col("orders").alias("orders_before"), F.col("revenue").alias("revenue_before"), F.col("ticket").alias("ticket_before"))
    rows = done.join(before, "month")
    rows = rows.where(F.col("month") >= F.lit(start)) if start else rows
    return rows.select("month", *[change_pct(F.col(m), F.col(f"{m}_before")).alias(f"{m}_yoy_pct") for m in ("orders", "revenue", "ticket")])


def seasonality_index(monthly: DataFrame) -> DataFrame:
    """Each complete month's orders against the mean month of its year, 100 for the mean."""
    done = monthly.where("complete").select("month", F.year("month").alias("year"), "orders")
    mean = done.groupBy("year").agg(F.avg("orders").alias("mean"))
    return done.join(mean, "year").select("month", "year", pct(F.col("orders"), F.col("mean")).alias("index"))


def weekly_rollup(daily: DataFrame, start: date | None = None) -> DataFrame:
    """Complete weeks (all seven days there) with the mean of four weeks, null for the first three. start: no week that ends before."""
    weeks = daily.groupBy(week_of(F.col("ds")).alias("week")).agg(F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"), F.count("*").alias("days")).where("days = 7").drop("days")
    weeks = weeks.where(F.date_add("week", 6) >= F.lit(start)) if start else weeks
    four = Window.orderBy("week").rowsBetween(-3, 0)  # one row a week: a few hundred rows
    mean = lambda m: F.when(F.count(m).over(four) == 4, F.avg(m).over(four))
    return weeks.select("week", "orders", "revenue", ratio(F.col("revenue"), F.col("orders")).alias("ticket"), mean("orders").alias("orders_mean_4"), mean("revenue").alias("revenue_mean_4"))


def _profile(daily: DataFrame, key: Column, name: str) -> DataFrame:
    overall = daily.agg(F.avg("orders").alias("mean"), F.sum("revenue").alias("all_revenue"))
    groups = daily.groupBy(key.alias(name)).agg(F.avg("orders").alias("orders_mean"), F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"), F.count("*").alias("days"))
    return groups.crossJoin(F.broadcast(overall)).select(  # one row
        name, "days", "orders_mean", ratio(F.col("revenue"), F.col("orders")).alias("ticket"), pct(F.col("orders_mean"), F.col("mean")).alias("index"), pct(F.col("revenue"), F.col("all_revenue")).alias("revenue_pct")
    )


def weekday_profile(daily: DataFrame) -> DataFrame:
    """Monday is 0."""
    return _profile(daily, F.weekday("ds"), "weekday")


def monthday_profile(daily: DataFrame) -> DataFrame:
    return _profile(daily, F.dayofmonth("ds"), "day")


def month_bands(daily: DataFrame) -> DataFrame:
    """Days of the month in bands up to 5, 10, 15, 20, 25 and 31."""
    day = F.dayofmonth("ds")
    label = F.when(day <= 5, "01-05").when(day <= 10, "06-10").when(day <= 15, "11-15").when(day <= 20, "16-20").when(day <= 25, "21-25").otherwise("26-31")
    return _profile(daily, label, "band")


def weekday_month_heatmap(daily: DataFrame) -> DataFrame:
    """Mean orders by weekday (Monday 0) and month, m1 to m12, up to the end of the last complete month; null for what never was."""
    last = daily.agg(F.max("ds").alias("last")).select(F.when(F.last_day("last") == F.col("last"), F.col("last")).otherwise(F.date_sub(F.trunc("last", "month"), 1)).alias("until"))
    rows = daily.crossJoin(F.broadcast(last)).where("ds <= until")  # one row
    grid = daily.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    wide = rows.groupBy(F.weekday("ds").alias("weekday")).agg(*[F.avg(F.when(F.month("ds") == m, F.col("orders"))).alias(f"m{m}") for m in range(1, 13)])
    return grid.join(wide, "weekday", "left")


def ytd_by_year(monthly: DataFrame) -> DataFrame:
    """Sums of complete months up to the last complete one's number, by year."""
    last = monthly.where("complete").agg(F.month(F.max("month")).alias("until"))
    rows = monthly.where("complete").crossJoin(F.broadcast(last)).where(F.month("month") <= F.col("until"))  # one row
    return rows.groupBy("year").agg(F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"), F.count("*").alias("months"))


def mtd_vs_last_year(daily: DataFrame) -> DataFrame:
    """The last month so far against the same days a year before."""
    last = daily.agg(F.max("ds").alias("last"))
    rows = daily.crossJoin(F.broadcast(last))  # one row
    now = (F.col("ds") >= F.trunc("last", "month")) & (F.col("ds") <= F.col("last"))
    year_ago = F.add_months("last", -12)
    then = (F.col("ds") >= F.trunc(year_ago, "month")) & (F.col("ds") <= year_ago)
    got = rows.groupBy("last").agg(*[F.sum(F.when(when, F.col(m))).alias(f"{m}{name}") for name, when in (("", now), ("_year_ago", then)) for m in ("orders", "revenue")])
    return got.select("last", "orders", "revenue", "orders_year_ago", "revenue_year_ago", change_pct(F.col("orders"), F.col("orders_year_ago")).alias("orders_change"), change_pct(F.col("revenue"), F.col("revenue_year_ago")).alias("revenue_change"))


def special_periods_lift(daily: DataFrame, periods: DataFrame, least: float = 10.0) -> DataFrame:
    """Mean orders of each period (name, start, end, ref_start, ref_end) against its reference days. Periods that are not
    over, or whose reference begins before the data or has less than `least` orders a day, are left out."""
    bounds = daily.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    inside = lambda a, b: (F.col("ds") >= F.col(a)) & (F.col("ds") <= F.col(b))
    kept = periods.crossJoin(F.broadcast(bounds)).where("end <= hi and ref_start >= lo").drop("lo", "hi")  # one row
    rows = daily.join(F.broadcast(kept), inside("start", "end") | inside("ref_start", "ref_end"))  # a few periods
    got = rows.groupBy("name", "start", "end").agg(F.avg(F.when(inside("start", "end"), F.col("orders"))).alias("orders_mean"), F.avg(F.when(inside("ref_start", "ref_end"), F.col("orders"))).alias("ref_mean"))
    return got.where(F.col("ref_mean") >= least).withColumn("lift_pct", change_pct(F.col("orders_mean"), F.col("ref_mean")))


def holiday_vs_workday(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row: mean orders on holidays, on other days from Monday to Friday, and on all."""
    days = daily.join(calendar.select("ds", "is_holiday"), "ds", "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))
    work = ~F.col("is_holiday") & (F.weekday("ds") < 5)
    return days.agg(F.avg(F.when(F.col("is_holiday"), F.col("orders"))).alias("holiday_mean"), F.avg(F.when(work, F.col("orders"))).alias("workday_mean"), F.avg("orders").alias("mean"))


def top_rows(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n rows with the most of `by`; of equal ones those with the smaller `tie`."""
    return df.orderBy(F.desc_nulls_last(by), tie).limit(n)
