"""Backtests of many series at once, all as long tables.

series: (level, series, ds, y), dense. tasks: (level, series, cutoff, ds, y, is_test): what was known at a cutoff and what
came then. forecasts: (level, series, cutoff, ds, model, forecast, actual, horizon).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clip, ratio
from tidemark.sources.stages import settle

TASK = ["level", "series", "cutoff"]
#: How simple a model is: the lower the simpler. Unknown ones count as 9.
COMPLEXITY = {
    "naive": 0, "moving_average": 0, "seasonal_naive": 0, "seasonal_growth": 1, "damped_holt_winters": 2, "arima_aic": 2, "calendar_regression": 3,
    "trend_season_regression": 3, "calendar_boosting": 4, "hybrid_residual_boosting": 5, "combination": 6, "top_down": 6,
}
REFERENCE, COMBINATION, TOP_DOWN = "seasonal_naive", "combination", "top_down"


def cutoff_table(df: DataFrame, cutoffs: Sequence[date]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in cutoffs], "cutoff date")


def make_backtest_tasks(series: DataFrame, cutoffs: Sequence[date], horizon_months: int = 0, horizon_days: int = 0, end: date | None = None, min_hist: int = 30) -> DataFrame:
    """Tasks for every series and cutoff with at least min_hist points up to the cutoff, a positive sum of them, and points after
    it. The cutoffs, a few dates, are broadcast."""
    until = F.date_add(F.add_months("cutoff", horizon_months), horizon_days)
    until = F.least(until, F.lit(end)) if end else until
    rows = series.crossJoin(F.broadcast(cutoff_table(series, cutoffs))).where(F.col("ds") <= until).withColumn("is_test", F.col("ds") > F.col("cutoff"))
    good = rows.groupBy(*TASK).agg(F.count_if(~F.col("is_test")).alias("n"), F.sum(F.when(~F.col("is_test"), F.col("y")).otherwise(0)).alias("s"), F.count_if("is_test").alias("m"))
    return rows.join(good.where((F.col("n") >= min_hist) & (F.col("s") > 0) & (F.col("m") > 0)).select(*TASK), TASK, "left_semi").select(*TASK, "ds", "y", "is_test")


def training_window(tasks: DataFrame, start: date | None) -> DataFrame:
    """Without training points before start; test points stay."""
    return tasks if start is None else tasks.where(F.col("is_test") | (F.col("ds") >= F.lit(start)))


def horizon_month(ds: Column, cutoff: Column) -> Column:
    """How many calendar months ds is after the cutoff's."""
    return (F.year(ds) - F.year(cutoff)) * 12 + F.month(ds) - F.month(cutoff)


def _forecasts(test: DataFrame, model: str, value: Column) -> DataFrame:
    return test.select(*TASK, "ds", F.lit(model).alias("model"), F.greatest(value, F.lit(0.0)).alias("forecast"), F.col("y").cast("double").alias("actual"), horizon_month(F.col("ds"), F.col("cutoff")).alias("horizon"))


def _back(tasks: DataFrame) -> DataFrame:
    """Training points numbered from the last, 1."""
    rank = F.row_number().over(Window.partitionBy(*TASK).orderBy(F.desc("ds")))
    return tasks.where(~F.col("is_test")).withColumn("back", rank)


def _last_mean(tasks: DataFrame, window: int, name: str) -> DataFrame:
    return _back(tasks).where(F.col("back") <= window).groupBy(*TASK).agg(F.avg("y").alias(name))


def moving_average(tasks: DataFrame, window: int, model: str = "moving_average") -> DataFrame:
    """The mean of the last points. The naive forecast is that of a day's week, or of one week."""
    test = tasks.where("is_test").join(_last_mean(tasks, window, "mean"), TASK)
    return _forecasts(test, model, F.col("mean"))


def naive(tasks: DataFrame, window: int = 1) -> DataFrame:
    return moving_average(tasks, window, "naive")


def _seasonal(tasks: DataFrame, lag_days: int, reserve: int) -> DataFrame:
    known = tasks.where(~F.col("is_test")).select(*TASK, F.date_add("ds", lag_days).alias("ds"), F.col("y").alias("then"))
    test = tasks.where("is_test").join(known, [*TASK, "ds"], "left").join(_last_mean(tasks, reserve, "mean"), TASK)
    return test.withColumn("base", F.coalesce(F.col("then").cast("double"), "mean"))


def seasonal_naive(tasks: DataFrame, lag_days: int = 364, reserve: int = 1) -> DataFrame:
    """What was one lag earlier; where that is not known at the cutoff, the naive forecast."""
    return _forecasts(_seasonal(tasks, lag_days, reserve), "seasonal_naive", F.col("base"))


def seasonal_growth(tasks: DataFrame, lag: int, window: int, lag_days: int = 364, reserve: int = 1, limits: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """seasonal_naive times how the last `window` points compare with those `lag` points earlier, within limits; without that
    much history, or with nothing then, as it is."""
    within = lambda lo, hi: F.sum(F.when(F.col("back").between(lo, hi), F.col("y")).otherwise(0)).cast("double")
    growth = _back(tasks).groupBy(*TASK).agg(F.count("*").alias("n"), within(1, window).alias("now"), within(lag + 1, lag + window).alias("then_sum"))
    factor = F.when((F.col("n") >= lag + window) & (F.col("then_sum") > 0), clip(F.try_divide("now", "then_sum"), *limits)).otherwise(1.0)
    rows = _seasonal(tasks, lag_days, reserve).join(growth.select(*TASK, factor.alias("factor")), TASK)
    return _forecasts(rows, "seasonal_growth", F.col("base") * F.col("factor"))


def baselines(tasks: DataFrame, daily: bool = False) -> DataFrame:
    """The four simple models, all built-in."""
    k = {"naive": 7, "mean": 28, "lag": 364, "growth": 56} if daily else {"naive": 1, "mean": 8, "lag": 52, "growth": 8}
    parts = [naive(tasks, k["naive"]), moving_average(tasks, k["mean"]), seasonal_naive(tasks, 364, k["naive"]), seasonal_growth(tasks, k["lag"], k["growth"], 364, k["naive"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_monthly(forecasts: DataFrame) -> DataFrame:
    """Sums by calendar month of ds (of the Monday, for weeks)."""
    return forecasts.groupBy(*TASK, "model", F.trunc("ds", "month").alias("month")).agg(F.sum("forecast").alias("forecast"), F.sum("actual").alias("actual"), F.max("horizon").alias("horizon"))


def accuracy_metrics(forecasts: DataFrame, by: Sequence[str] = ("level", "model")) -> DataFrame:
    """WAPE, MAPE (over positive actuals), bias, all in percent, and how many."""
    error = F.abs(F.col("forecast") - F.col("actual"))
    r, p = F.sum("actual"), F.sum("forecast")
    return forecasts.groupBy(*by).agg(
        (ratio(F.sum(error), r) * 100).alias("wape"), (F.avg(F.when(F.col("actual") > 0, F.try_divide(error, F.col("actual")))) * 100).alias("mape"), ((ratio(p, r) - 1) * 100).alias("bias"), F.count("*").alias("n")
    )


def empirical_band(monthly: DataFrame, q: float = 0.8) -> DataFrame:
    """The q-quantile of the relative error by level, model and horizon."""
    e = F.abs(ratio(F.col("forecast"), F.col("actual")) - 1)
    return monthly.groupBy("level", "model", "horizon").agg(F.percentile(e, F.lit(q)).alias("band"))


def _weights(errors: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """errors: (keys, model, ae, r). Weights by inverse error of the best `top` models; errors that differ beyond the ninth decimal only
    are ties, which go to the smaller name."""
    error = F.greatest(F.col("ae") / F.greatest(F.col("r"), F.lit(1e-9)), F.lit(1e-6))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(error, 9), "model"))
    return errors.withColumn("w", 1 / error).withColumn("rank", rank).where(F.col("rank") <= top).select(*keys, "model", "w")


def _errors(forecasts: DataFrame) -> DataFrame:
    rows = forecasts.where(~F.col("model").isin(COMBINATION, TOP_DOWN))
    return rows.groupBy(*TASK, "model").agg(F.sum(F.abs(F.col("forecast") - F.col("actual"))).alias("ae"), F.sum("actual").alias("r"))


def _blend(forecasts: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    met = forecasts.where(~F.col("model").isin(COMBINATION, TOP_DOWN)).join(weights, [*keys, "model"])
    return met.groupBy(*TASK, "ds").agg((F.sum(F.col("forecast") * F.col("w")) / F.sum("w")).alias("forecast"), F.max("actual").alias("actual"), F.max("horizon").alias("horizon")).withColumn("model", F.lit(COMBINATION))


def combine_top(forecasts: DataFrame, top: int = 3) -> DataFrame:
    """The weighted mean of each series' best models; a cutoff's weights come from the other cutoffs: sums over all less its
    own. A series with one cutoff has none. Returns the combination's rows only."""
    own = _errors(forecasts)
    all_ = own.groupBy("level", "series", "model").agg(F.sum("ae").alias("ae_all"), F.sum("r").alias("r_all"), F.count("*").alias("n"))
    cutoffs = own.select(*TASK).distinct()
    others = (
        all_.join(cutoffs, ["level", "series"]).join(own, [*TASK, "model"], "left")
        .withColumn("left", F.col("n") - F.when(F.col("ae").isNotNull(), 1).otherwise(0)).where("left > 0")
        .select(*TASK, "model", (F.col("ae_all") - F.coalesce("ae", F.lit(0.0))).alias("ae"), (F.col("r_all") - F.coalesce("r", F.lit(0.0))).alias("r"))
    )
    return _blend(forecasts, _weights(others, TASK, top), TASK).select(*forecasts.columns)


def combine_all(forecasts: DataFrame, errors_of: DataFrame, top: int = 3) -> DataFrame:
    """The combination for forecasts beyond the backtest, with weights from all cutoffs of `errors_of`."""
    sums = _errors(errors_of).groupBy("level", "series", "model").agg(F.sum("ae").alias("ae"), F.sum("r").alias("r"))
    return _blend(forecasts, _weights(sums, ["level", "series"], top), ["level", "series"]).select(*forecasts.columns)


def child_to_parent_map(cube: DataFrame, child: str, parent: str, measure: str = "revenue") -> DataFrame:
    """(child, parent): for each child the parent with most of the measure; ties go to the greater name."""
    sums = cube.groupBy(F.col(child).alias("child"), F.col(parent).alias("parent")).agg(F.sum(measure).alias("m"))
    return sums.groupBy("child").agg(F.max_by("parent", F.struct("m", "parent")).alias("parent"))


def recent_share(children: DataFrame, parents: DataFrame, of: DataFrame, cutoffs: DataFrame, weeks: int = 13) -> DataFrame:
    """(child, parent, cutoff, share): a child's part of its parent's sum over the weeks up to a cutoff; 0 if that is not positive."""
    inside = (F.col("ds") <= F.col("cutoff")) & (F.col("ds") > F.date_sub("cutoff", 7 * weeks))
    total = lambda df, name, into: df.crossJoin(F.broadcast(cutoffs)).where(inside).groupBy(F.col("series").alias(name), "cutoff").agg(F.sum("y").cast("double").alias(into))  # noqa: E731  a few cutoffs
    c, p = total(children, "child", "c"), total(parents, "parent", "p")
    met = of.join(p, "parent").join(c, ["child", "cutoff"], "left")
    return met.select("child", "parent", "cutoff", F.when(F.col("p") > 0, F.coalesce("c", F.lit(0.0)) / F.col("p")).otherwise(0.0).alias("share"))


def top_down(child_tasks: DataFrame, parent_forecasts: DataFrame, shares: DataFrame) -> DataFrame:
    """A child's forecast as its share of its parent's. parent_forecasts: of one level, with the chosen model's rows only."""
    p = parent_forecasts.select(F.col("series").alias("parent"), "cutoff", "ds", F.col("forecast").alias("parent_forecast"))
    test = child_tasks.where("is_test").withColumn("child", F.col("series")).join(shares, ["child", "cutoff"]).join(p, ["parent", "cutoff", "ds"])
    return _forecasts(test, TOP_DOWN, F.col("parent_forecast") * F.col("share"))


def with_top_down(forecasts: DataFrame, tasks: DataFrame, series: DataFrame, of: DataFrame, generations: Sequence[Mapping[str, str]], cutoffs: DataFrame, weeks: int = 13) -> DataFrame:
    """forecasts and, for levels that have a parent, rows of top_down from what the parent level's choice forecasts.

    generations: child level -> parent level, parents chosen before their children ({"Grupo"'s children}, then theirs): as many
    rounds as the hierarchy is deep. of: (level, child, parent).
    """
    for level_of in generations:
        chosen = settle(chosen_rows(forecasts, choose_parsimonious(accuracy_metrics(to_monthly(forecasts)))))
        for child, parent in level_of.items():
            at = lambda df, level: df.where(F.col("level") == level)
            shares = recent_share(at(series, child), at(series, parent), at(of, child).select("child", "parent"), cutoffs, weeks)
            forecasts = forecasts.unionByName(top_down(at(tasks, child), at(chosen, parent), shares))
        forecasts = settle(forecasts)
    return forecasts


def choose_parsimonious(metrics: DataFrame, complexity: dict[str, int] | None = None, tolerance: float = 0.05, reference: str = REFERENCE) -> DataFrame:
    """metrics (level, model, wape, ...) with complexity, eligible, gain over the reference in points, chosen.

    Among models within the tolerance of a level's least error the simplest is chosen; ties go to the smaller error, then name.
    """
    known = F.create_map(*[F.lit(x) for kv in (complexity or COMPLEXITY).items() for x in kv])
    level = Window.partitionBy("level")  # a few models a level
    rows = metrics.where("wape is not null").withColumn("complexity", F.coalesce(F.try_element_at(known, F.col("model")), F.lit(9)))
    rows = rows.withColumn("best", F.min("wape").over(level)).withColumn("eligible", F.col("wape") <= F.col("best") * (1 + tolerance))
    rows = rows.withColumn("gain", F.max(F.when(F.col("model") == reference, F.col("wape"))).over(level) - F.col("wape"))
    first = F.row_number().over(level.orderBy(F.desc("eligible"), "complexity", F.round("wape", 9), "model"))
    return rows.withColumn("chosen", first == 1)


def justify_choice(ranked: DataFrame, reference: str = REFERENCE) -> DataFrame:
    """(level, chosen, justification): the choice in a sentence or two."""
    best = F.min_by("model", F.struct(F.round("wape", 9), "model"))
    one = ranked.groupBy("level").agg(F.max(F.when(F.col("chosen"), F.struct("model", "wape", "gain"))).alias("c"), best.alias("best_model"), F.min("wape").alias("best"))
    c = F.col("c")
    text = F.concat_ws(
        " ", F.format_string("Fica o modelo %s, com %.1f%% de erro.", c["model"], c["wape"]),
        F.when(c["model"] != F.col("best_model"), F.format_string("Com %s o erro seria de %.1f%%, pouco menor, mas com um modelo mais complexo.", F.col("best_model"), F.col("best"))),
        F.when(c["gain"].isNotNull() & (c["model"] != reference), F.when(c["gain"] > 0, F.format_string("São %.1f pontos abaixo de %s.", c["gain"], F.lit(reference))).otherwise(F.format_string("Não melhora %s, que pode bastar.", F.lit(reference)))),
    )
    return one.select("level", F.col("c.model").alias("chosen"), text.alias("justification"))


def chosen_rows(forecasts: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of each level's chosen model."""
    return forecasts.join(F.broadcast(ranked.where("chosen").select("level", "model")), ["level", "model"], "left_semi")  # a row a level


def bottom_up_coherence(chosen_monthly: DataFrame, total: DataFrame) -> DataFrame:
    """WAPE of the sum of each level's chosen forecasts against the total's actuals (cutoff, month, actual)."""
    sums = chosen_monthly.groupBy("level", "cutoff", "month").agg(F.sum("forecast").alias("forecast"))
    real = total.groupBy("cutoff", "month").agg(F.sum("actual").alias("actual"))
    return sums.join(real, ["cutoff", "month"]).groupBy("level").agg((ratio(F.sum(F.abs(F.col("forecast") - F.col("actual"))), F.sum("actual")) * 100).alias("wape"))


def level_benchmark_table(ranked: DataFrame, reference: str = REFERENCE) -> DataFrame:
    """For each level the chosen model, its error, the reference's, and the best one regardless of simplicity."""
    pick = lambda c: F.max(F.when(F.col("chosen"), F.col(c)))
    return ranked.groupBy("level").agg(
        pick("model").alias("chosen"), pick("wape").alias("wape"), F.max(F.when(F.col("model") == reference, F.col("wape"))).alias("reference_wape"),
        F.min_by("model", F.struct(F.round("wape", 9), "model")).alias("best_model"), F.min("wape").alias("best_wape"), F.count("*").alias("models"),
    )
