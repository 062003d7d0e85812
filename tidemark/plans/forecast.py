"""From chosen models to final tables: refits, months, reconciliation, the headline forecast and its history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clip, money_text, month_label, month_of, ratio
from tidemark.plans import backtest as B
from tidemark.plans import models as M
from tidemark.sources import merge_run
from tidemark.sources.stages import settle


def future_tasks(series: DataFrame, dates: Sequence[date]) -> DataFrame:
    """One task for each series with all it has, cut off at its last point, and the dates to come, of which there are few."""
    last = series.groupBy("level", "series").agg(F.max("ds").alias("cutoff"))
    known = series.join(last, ["level", "series"]).select(*B.TASK, "ds", F.col("y").cast("double").alias("y"), F.lit(False).alias("is_test"))
    to_come = series.sparkSession.createDataFrame([(d,) for d in dates], "ds date")
    ahead = last.crossJoin(F.broadcast(to_come)).where("ds > cutoff").select(*B.TASK, "ds", F.lit(None).cast("double").alias("y"), F.lit(True).alias("is_test"))
    return known.unionByName(ahead)


def all_models(tasks: DataFrame, models: Sequence[M.ForecastModel] = M.CATALOGUE, daily: bool = False, start: date | None = None) -> DataFrame:
    """Forecasts of the models for all tasks, failures left out; of the baselines alone if there are no models."""
    return M.forecasts_of(M.run_models(tasks, models, daily, start)) if models else B.baselines(tasks, daily)


def ahead_forecasts(series: DataFrame, dates: Sequence[date], backtested: DataFrame, models: Sequence[M.ForecastModel] = M.CATALOGUE, daily: bool = False, start: date | None = None) -> DataFrame:
    """Every model's forecasts of the dates, fitted to all data, and the combination with weights from all cutoffs."""
    ahead = settle(all_models(future_tasks(series, dates), models, daily, start))
    return settle(ahead.unionByName(B.combine_all(ahead, backtested)))


def chosen_ahead(ahead: DataFrame, ranked: DataFrame, parents: DataFrame | None = None, shares: DataFrame | None = None) -> DataFrame:
    """(level, series, cutoff, ds, model, forecast) of each level's chosen model.

    Under top_down (parents: (parent, ds, forecast), shares: (child, parent, share)) a series without a parent falls back on its
    level's simplest eligible model.
    """
    columns = [*B.TASK, "ds", "model", "forecast"]
    picked = ranked.where("chosen").select("level", "model")
    out = ahead.join(F.broadcast(picked), ["level", "model"], "left_semi").select(*columns)  # a row a level
    if parents is None or shares is None:
        return out
    plain = F.when(~F.col("model").isin(B.TOP_DOWN, B.COMBINATION) & F.col("eligible"), F.struct("complexity", F.round("wape", 9).alias("wape"), "model"))
    spare = ranked.groupBy("level").agg(F.min(plain).alias("s")).select("level", F.coalesce("s.model", F.lit(B.REFERENCE)).alias("model"))
    downs = F.broadcast(picked.where(F.col("model") == B.TOP_DOWN).select("level"))  # a row a level
    of = ahead.select(*B.TASK).distinct().join(downs, "level", "left_semi")
    shared = of.join(shares.drop("cutoff"), of["series"] == shares["child"]).join(parents.select("parent", "ds", F.col("forecast").alias("p")), "parent")
    shared = shared.select(*B.TASK, "ds", F.lit(B.TOP_DOWN).alias("model"), F.greatest(F.col("p") * F.col("share"), F.lit(0.0)).alias("forecast"))
    rest = ahead.join(of.select("level", "series"), ["level", "series"], "left_semi").join(shared.select("level", "series").distinct(), ["level", "series"], "left_anti")
    return out.unionByName(shared).unionByName(rest.join(F.broadcast(spare), ["level", "model"], "left_semi").select(*columns))


def forecast_levels(series: DataFrame, dates: Sequence[date], ranked: DataFrame, backtested: DataFrame, of: DataFrame, generations: Sequence[Mapping[str, str]], models: Sequence[M.ForecastModel] = M.CATALOGUE, start: date | None = None) -> DataFrame:
    """chosen_ahead() of all levels, parents before their children. of: (level, child, parent)."""
    ahead = ahead_forecasts(series, dates, backtested, models, start=start)
    at = lambda df, level: df.where(F.col("level") == level)
    children = [child for level_of in generations for child in level_of]
    done = settle(chosen_ahead(ahead.where(~F.col("level").isin(*children)), ranked))
    last = series.groupBy().agg(F.max("ds").alias("cutoff"))  # one row
    for level_of in generations:
        got = done
        for child, parent in level_of.items():
            shares = B.recent_share(at(series, child), at(series, parent), at(of, child).select("child", "parent"), last)
            got = got.unionByName(chosen_ahead(at(ahead, child), at(ranked, child), at(done, parent).withColumnRenamed("series", "parent"), shares))
        done = settle(got)
    return done


def forecast_chosen(series: DataFrame, dates: Sequence[date], ranked: DataFrame, backtested: DataFrame, models: Sequence[M.ForecastModel] = M.CATALOGUE, daily: bool = False, parents: DataFrame | None = None, shares: DataFrame | None = None, start: date | None = None) -> DataFrame:
    """chosen_ahead() of ahead_forecasts(), for levels without parents or with those given."""
    return chosen_ahead(ahead_forecasts(series, dates, backtested, models, daily, start), ranked, parents, shares)


def week_to_month(weekly: DataFrame, keys: Sequence[str], value: str = "forecast") -> DataFrame:
    """Weeks (ds: Monday) dealt to months by days, a seventh each; a week touches two months at most, so no days are made."""
    first, last = month_of(F.col("ds")), month_of(F.date_add("ds", 6))
    days_after = F.when(first == last, 0).otherwise(F.dayofmonth(F.date_add("ds", 6)))
    parts = F.array(F.struct(first.alias("month"), (F.col(value) * (7 - days_after) / 7).alias("v")), F.struct(last.alias("month"), (F.col(value) * days_after / 7).alias("v")))
    rows = weekly.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.month", "p.v").where("v <> 0 or month is not null")
    return rows.groupBy(*keys, "month").agg(F.sum("v").alias(value))


def monthly_actuals(series: DataFrame, as_of: date, months: int = 12) -> DataFrame:
    """(level, series, month, actual) of the last full months before as_of."""
    until = month_of(F.lit(as_of))
    rows = week_to_month(series.select("level", "series", "ds", F.col("y").cast("double").alias("actual")), ["level", "series"], "actual")
    return rows.where((F.col("month") < until) & (F.col("month") >= F.add_months(until, -months)))


def with_bands(monthly: DataFrame, bands: DataFrame, current: date) -> DataFrame:
    """low and high from the band of the month's horizon, or of the nearest horizon there is."""
    h = F.lit(B.horizon_month(F.col("month"), F.lit(current)))
    ends = bands.groupBy("level", "model").agg(F.min("horizon").alias("lo"), F.max("horizon").alias("hi"))
    rows = monthly.join(F.broadcast(ends), ["level", "model"], "left").withColumn("horizon", F.least(F.greatest(h, "lo"), "hi"))  # a row a level and model
    rows = rows.join(F.broadcast(bands), ["level", "model", "horizon"], "left")
    return rows.withColumn("low", F.col("forecast") * (1 - F.col("band"))).withColumn("high", F.col("forecast") * (1 + F.col("band"))).drop("lo", "hi", "band", "horizon")


def reconcile_to_total(monthly: DataFrame, target: DataFrame) -> DataFrame:
    """reconciled and share_pct: each level's months scaled to the target (month, target). Sums by level and month are joined
    back; no level sits in one task."""
    sums = monthly.groupBy("level", "month").agg(F.sum("forecast").alias("level_sum"))
    rows = monthly.join(sums, ["level", "month"]).join(F.broadcast(target), "month", "left")  # a row a month
    return rows.withColumn("reconciled", ratio(F.col("forecast"), F.col("level_sum")) * F.col("target")).withColumn("share_pct", ratio(F.col("forecast"), F.col("level_sum")) * 100).drop("level_sum", "target")


def reconciliation_target(total_monthly: DataFrame, headline: DataFrame | None = None) -> DataFrame:
    """(month, target): the Total's forecast, replaced by the headline forecast (month, v1) where that has the month."""
    total = total_monthly.select("month", F.col("forecast").alias("t"))
    if headline is None:
        return total.select("month", F.col("t").alias("target"))
    return total.join(headline.select("month", "v1"), "month", "left").select("month", F.coalesce("v1", "t").alias("target"))


def granular_forecast(chosen: DataFrame, series: DataFrame, bands: DataFrame, current: date, run_date: date, version: str, headline: DataFrame | None = None) -> DataFrame:
    """Weekly forecasts as months with bands, the current month with what it had so far, reconciled to the total."""
    months = week_to_month(chosen, ["level", "series", "model"])
    so_far = week_to_month(series.select("level", "series", "ds", F.col("y").cast("double").alias("so_far")), ["level", "series"], "so_far").where(F.col("month") == F.lit(current))
    banded = with_bands(months, bands, current).join(so_far, ["level", "series", "month"], "left")
    add = [(F.col(c) + F.coalesce("so_far", F.lit(0.0))).alias(c) for c in ("forecast", "low", "high")]
    rows = banded.select("level", "series", "month", "model", *add)
    target = reconciliation_target(rows.where(F.col("level") == "Total"), headline)
    return reconcile_to_total(rows, target).withColumn("run_date", F.lit(run_date)).withColumn("version", F.lit(version))


# -- the headline: orders times ticket -------------------------------------------------------------------------------


def ticket_tasks(monthly: DataFrame, horizon: int, backtests: int = 4, least: int = 6) -> DataFrame:
    """Tasks over months with a ticket: one month ahead of each of the last `backtests` (at least `least` months known), and
    `horizon` months ahead of all of them. series: how many months are known. monthly: (month, base_ticket), a row a month."""
    own = Window.orderBy("ds")  # a row a month
    months = monthly.where("base_ticket > 0").select(F.col("month").alias("ds"), F.col("base_ticket").cast("double").alias("y"))
    months = settle(months.withColumn("n", F.row_number().over(own)).withColumn("all", F.count("*").over(Window.partitionBy())))
    cuts = months.where((F.col("n") == F.col("all")) | ((F.col("n") >= F.greatest(F.col("all") - backtests, F.lit(least))) & (F.col("n") < F.col("all")))).select(F.col("n").alias("known"), F.col("ds").alias("cutoff"), (F.col("n") == F.col("all")).alias("last"))
    met = months.join(F.broadcast(cuts), F.col("n") <= F.when(F.col("last"), F.col("known")).otherwise(F.col("known") + 1))
    past = met.select(F.lit("Ticket").alias("level"), F.format_string("%04d", "known").alias("series"), "cutoff", "ds", "y", (F.col("n") > F.col("known")).alias("is_test"))
    ahead = cuts.where("last").select(F.lit("Ticket").alias("level"), F.format_string("%04d", "known").alias("series"), "cutoff", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return past.unionByName(ahead.select(*B.TASK, F.add_months("cutoff", F.col("h")).alias("ds"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("is_test")))


def ticket_forecast(monthly: DataFrame, horizon: int, tolerance: float = 0.05, backtests: int = 4) -> DataFrame:
    """(step, ticket, method): means of three and six months and a damped trend on logs; the trend only if its mean error over
    one-step backtests is less than 95 % of the better mean's. Without backtests the mean of three; without months no rows."""
    tasks = settle(ticket_tasks(monthly, horizon, backtests))
    trend = M.damped_holt_winters(tasks.withColumn("y", F.col("y") - 1), False, {}).withColumn("forecast", F.col("forecast") + 1)  # log1p of one less is the log
    actual = tasks.where("is_test").select(*B.TASK, "ds", F.col("y").alias("actual"))
    means = [B.moving_average(tasks, n, f"mean_{n}").select(*B.TASK, "ds", "model", "forecast") for n in (3, 6)]
    rows = settle(means[0].unionByName(means[1]).unionByName(trend.select(*B.TASK, "ds", F.lit("damped_trend").alias("model"), "forecast")).join(actual, [*B.TASK, "ds"]))
    none = F.lit(float("inf"))
    error = lambda m: F.coalesce(F.avg(F.when(F.col("model") == m, F.abs(F.col("forecast") / F.col("actual") - 1))), none)
    errors = rows.groupBy().agg(error("mean_3").alias("e3"), error("mean_6").alias("e6"), error("damped_trend").alias("e"))  # one row
    best = F.when(F.col("e") < F.least("e3", "e6") * (1 - tolerance), "damped_trend").when(F.col("e6") < F.col("e3"), "mean_6").otherwise("mean_3")
    final = rows.where("actual is null").join(F.broadcast(errors.select(best.alias("method"))), F.col("method") == F.col("model"))
    return final.select((F.months_between("ds", "cutoff").cast("int") - 1).alias("step"), F.col("forecast").alias("ticket"), "method")


def expected_extremes(monthly: DataFrame, since: date | None = None, last: int = 6) -> DataFrame:
    """One row: mean and 10 % and 90 % quantiles of monthly extreme revenue since a date, or of the last months."""
    rows = monthly.where(F.col("month") >= F.lit(since)) if since else monthly.orderBy(F.desc("month")).limit(last)
    x = F.col("extreme_revenue")
    return rows.agg(F.avg(x).alias("extreme_mean"), F.percentile(x, F.lit(0.1)).alias("extreme_p10"), F.percentile(x, F.lit(0.9)).alias("extreme_p90"))


def monthly_revenue_forecast(orders: DataFrame, tickets: DataFrame, bands: DataFrame, monthly: DataFrame, extremes: DataFrame, current: date, last_day: date) -> DataFrame:
    """Headline months: orders (month, orders, of days to come), tickets by step, bands (horizon, band), this month's so-far from
    `monthly`, extremes added for the second version. All inputs have a row a month or fewer."""
    end = F.last_day(F.lit(current))
    rest = F.datediff(end, F.lit(last_day)) / F.dayofmonth(end)
    step = B.horizon_month(F.col("month"), F.lit(current)).alias("horizon")
    ends = bands.agg(F.min("horizon").alias("lo"), F.max("horizon").alias("hi"))
    so_far = monthly.where(F.col("month") == F.lit(current)).select("month", F.col("orders").alias("orders_so_far"), F.col("base_revenue").alias("revenue_so_far"), F.col("extreme_revenue").alias("extreme_so_far"))
    year_ago = monthly.select(F.add_months("month", 12).alias("month"), F.col("orders").alias("orders_year_ago"))
    rows = orders.select("month", "orders", step).join(tickets.withColumnRenamed("step", "horizon"), "horizon").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(extremes))  # one row each
    rows = rows.withColumn("h", F.least(F.greatest("horizon", "lo"), "hi")).join(F.broadcast(bands.toDF("h", "band")), "h", "left").join(F.broadcast(so_far), "month", "left").join(F.broadcast(year_ago), "month", "left")
    now = F.col("horizon") == 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    band = F.col("band") * F.when(now, rest).otherwise(1.0)
    v1 = F.col("orders") * F.col("ticket") + zero("revenue_so_far")
    ext = {c: F.when(now & F.col("extreme_so_far").isNotNull(), F.col("extreme_so_far") + F.col(c) * rest).otherwise(F.col(c)) for c in ("extreme_mean", "extreme_p10", "extreme_p90")}
    return rows.select(
        "month", "horizon", (F.col("orders") + zero("orders_so_far")).alias("orders"), "orders_year_ago", "ticket", "method", v1.alias("v1"), (v1 * (1 - band)).alias("v1_low"), (v1 * (1 + band)).alias("v1_high"), *[e.alias(c) for c, e in ext.items()]
    )


def judged_history(history: DataFrame, actuals: DataFrame, current: date) -> DataFrame:
    """Past forecasts of closed months with what came: relative errors of orders and revenue. actuals: (month, orders, base_revenue)."""
    met = history.join(actuals.select(F.col("month").alias("target_month"), F.col("orders").alias("orders_actual"), F.col("base_revenue").alias("revenue_actual")), "target_month")
    met = met.where((F.col("target_month") < F.lit(current)) & (F.col("run_date") < F.last_day("target_month")))
    return met.withColumn("orders_error", ratio(F.col("orders_raw"), F.col("orders_actual")) - 1).withColumn("revenue_error", ratio(F.col("revenue_raw"), F.col("revenue_actual")) - 1)


def history_bias(judged: DataFrame) -> DataFrame:
    """By horizon: how many, mean and mean absolute errors in percent."""
    p = lambda c: (F.avg(c) * 100).alias
    e, a = F.col("orders_error"), F.col("revenue_error")
    return judged.groupBy("horizon").agg(F.count("*").alias("n"), p(e)("orders_bias"), p(F.abs(e))("orders_abs"), p(a)("revenue_bias"), p(F.abs(a))("revenue_abs"))


def bias_factors(judged: DataFrame, window: int = 6, least: int = 3, limit: float = 0.15) -> DataFrame:
    """One row: factors for orders and revenue from the last target months, at horizon 1 or more; 1 with too few months."""
    rows = judged.where("horizon >= 1").withColumn("age", F.dense_rank().over(Window.orderBy(F.desc("target_month"))))  # a row a run and month
    got = rows.agg(F.count_distinct("target_month").alias("months"), *[F.avg(F.when(F.col("age") <= window, F.col(f"{m}_error"))).alias(f"{m}_bias") for m in ("orders", "revenue")])
    factor = lambda m: F.when(F.col("months") >= least, clip(F.try_divide(F.lit(1.0), 1 + F.col(f"{m}_bias")), 1 - limit, 1 + limit)).otherwise(1.0)
    return got.select("months", *[F.coalesce(factor(m), F.lit(1.0)).alias(f"{m}_factor") for m in ("orders", "revenue")])


def apply_bias_and_bands(headline: DataFrame, judged: DataFrame, least: int = 3) -> DataFrame:
    """The headline with months to come corrected, bands from real errors where there are enough, and V2 with extremes."""
    real = judged.groupBy("horizon").agg(F.when(F.count("*") >= least, F.percentile(F.abs(F.col("revenue_error")), F.lit(0.8))).alias("real_band"))
    rows = headline.crossJoin(F.broadcast(bias_factors(judged, least=least))).join(F.broadcast(real), "horizon", "left")  # a row; a row a horizon
    later, c = F.col("horizon") >= 1, F.col
    rows = rows.withColumn("v1_raw", c("v1")).withColumn("orders_raw", c("orders")).withColumn("orders", c("orders") * F.when(later, c("orders_factor")).otherwise(1.0))
    for v in ("v1", "v1_low", "v1_high"):
        rows = rows.withColumn(v, c(v) * F.when(later, c("revenue_factor")).otherwise(1.0))
    has = later & c("real_band").isNotNull()
    rows = rows.withColumn("v1_low", F.when(has, c("v1") * (1 - c("real_band"))).otherwise(c("v1_low"))).withColumn("v1_high", F.when(has, c("v1") * (1 + c("real_band"))).otherwise(c("v1_high")))
    v2 = {"v2": ("v1", "extreme_mean"), "v2_low": ("v1_low", "extreme_p10"), "v2_high": ("v1_high", "extreme_p90")}
    for name, (a, b) in v2.items():
        rows = rows.withColumn(name, c(a) + c(b))
    return rows.withColumn("orders_change_pct", (ratio(c("orders"), c("orders_year_ago")) - 1) * 100).drop("real_band", "months")


def run_record(final: DataFrame, run_date: date, version: str, model: str) -> DataFrame:
    """The rows that a run adds to the history."""
    c = F.col
    later = c("horizon") >= 1
    return final.select(
        F.lit(run_date).alias("run_date"), F.lit(version).alias("version"), c("month").alias("target_month"), "horizon", "orders_raw", c("v1_raw").alias("revenue_raw"), c("orders").alias("orders_final"), c("v1").alias("revenue_final"),
        c("v1_low").alias("revenue_low"), c("v1_high").alias("revenue_high"), c("v2").alias("revenue_v2"), F.when(later, c("orders_factor")).otherwise(1.0).alias("orders_factor"), F.when(later, c("revenue_factor")).otherwise(1.0).alias("revenue_factor"),
        F.lit(model).alias("orders_model"), c("method").alias("ticket_method"),
    )


def append_run(history: DataFrame, record: DataFrame) -> DataFrame:
    """The history with this run in place of an earlier one of the same date."""
    return merge_run(history, record)


def explain_forecast(final: DataFrame) -> DataFrame:
    """(month, explanation): one sentence a month."""
    text = F.concat(
        F.lit("Em "), month_label(F.col("month")), F.lit(", esperamos cerca de "), F.translate(F.format_number("orders", 0), ",", "."), F.lit(" pedidos e "), money_text(F.col("v1")), F.lit(" sem pedidos extremos (entre "),
        money_text(F.col("v1_low")), F.lit(" e "), money_text(F.col("v1_high")), F.lit("); com extremos, "), money_text(F.col("v2")), F.lit("."),
    )
    return final.select("month", text.alias("explanation"))


def forecast_accuracy_report(history: DataFrame, actuals: DataFrame) -> DataFrame:
    """Past final forecasts against what came."""
    met = history.join(actuals.select(F.col("month").alias("target_month"), F.col("base_revenue").alias("revenue_actual")), "target_month")
    return met.select("run_date", "target_month", "horizon", "revenue_final", "revenue_actual", ((ratio(F.col("revenue_final"), F.nullif(F.col("revenue_actual"), F.lit(0.0))) - 1) * 100).alias("error_pct"))


def actuals_and_forecasts(actuals: DataFrame, forecasts: DataFrame, level: str, series: str | None = None) -> DataFrame:
    """One table of (level, series, month, actual, forecast, low, high, reconciled); forecasts of the last run only."""
    last = forecasts.join(F.broadcast(forecasts.agg(F.max("run_date").alias("run_date"))), "run_date", "left_semi")  # one row
    keep: Column = F.col("level") == level
    keep = keep & (F.col("series") == series) if series else keep
    a = actuals.where(keep).select("level", "series", "month", "actual")
    f = last.where(keep).select("level", "series", "month", "forecast", "low", "high", "reconciled")
    return a.unionByName(f, allowMissingColumns=True)
