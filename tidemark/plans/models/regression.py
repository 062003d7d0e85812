"""Regressions on the calendar, all tasks at once, without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.backtest import TASK
from tidemark.plans.models.linear import dot, ridge
from tidemark.plans.models.terms import back_to_scale, waves, weekdays, with_terms
from tidemark.sources.stages import settle

EVENTS = ("special_days", "black_friday", "year_end")
#: Days of history from which a yearly wave is fitted (the reference rule).
YEARLY = 547


def _array(columns) -> F.Column:
    return F.array(*[c.cast("double") for c in columns])


def calendar_rows(tasks: DataFrame, daily: bool, order: int = 3, strength: float = 0.3) -> tuple[DataFrame, list[float]]:
    """Rows with x for calendar_regression, and the strength of each term: level, waves, events, years since the cutoff, weekdays."""
    x = [F.lit(1.0), *waves(daily, order), *[F.col(c) for c in EVENTS], F.datediff("ds", "cutoff") / 365.25, *weekdays(daily)]
    return with_terms(tasks, daily).withColumn("x", _array(x)), [1e-6] + [strength] * (len(x) - 1)


def trend_rows(tasks: DataFrame, daily: bool, knots: int = 12, strength: float = 0.5, knot_strength: float = 2.0) -> tuple[DataFrame, list[float]]:
    """Rows with x for trend_season: level, slope, changes of slope over the first four fifths of history, events, yearly waves
    (0 below YEARLY days of history), weekdays."""
    known = F.when(~F.col("is_test"), F.col("ds"))
    own = Window.partitionBy(*TASK)
    rows = with_terms(tasks, daily).withColumn("_t0", F.min(known).over(own)).withColumn("_span", F.greatest(F.datediff(F.max(known).over(own), "_t0"), F.lit(1)))
    at = F.datediff("ds", "_t0") / F.col("_span")
    yearly = (F.col("_span") >= YEARLY).cast("double")
    bends = [F.greatest(at - 0.8 * (k + 1) / (knots + 1), F.lit(0.0)) for k in range(knots)]
    rest = [*[F.col(c) for c in EVENTS], *[w * yearly for w in waves(daily, 10 if daily else 6)], *weekdays(daily)]
    return rows.withColumn("x", _array([F.lit(1.0), at, *bends, *rest])).drop("_t0", "_span"), [1e-6, 1e-6] + [knot_strength] * knots + [strength] * len(rest)


def fitted(rows: DataFrame, strength: list[float]) -> DataFrame:
    """rows with `fit`, by weights of each task's known rows."""
    weights = ridge(rows.where(~F.col("is_test")), TASK, strength)
    return rows.join(weights, TASK).withColumn("fit", dot(F.col("x"), F.col("w"))).drop("w", "x")


def calendar_regression(tasks: DataFrame, daily: bool, params: dict) -> DataFrame:
    """Waves, events, a slope and weekdays; the last error is carried on and dies out as fast as errors did."""
    rows = settle(fitted(*calendar_rows(tasks, daily, params.get("fourier", 3), params.get("ridge", 0.3))))
    off = rows.where(~F.col("is_test")).withColumn("off", F.col("z") - F.col("fit")).withColumn("before", F.lag("off").over(Window.partitionBy(*TASK).orderBy("ds")))
    rho = F.least(F.greatest(F.sum(F.col("off") * F.col("before")) / F.greatest(F.sum(F.col("off") * F.col("off")), F.lit(1e-12)), F.lit(0.0)), F.lit(0.98))
    carried = off.groupBy(*TASK).agg(F.coalesce(rho, F.lit(0.0)).alias("rho"), F.max_by("off", "ds").alias("last"))
    future = rows.where("is_test").join(carried, TASK)
    return future.select(*TASK, "ds", back_to_scale(F.col("fit") + F.col("last") * F.pow("rho", "t")).alias("forecast"))


def trend_season(tasks: DataFrame, daily: bool, params: dict) -> DataFrame:
    """A trend that bends where it must, events, yearly waves with enough history, weekdays for days."""
    rows = fitted(*trend_rows(tasks, daily, params.get("changepoints", 12)))
    return rows.where("is_test").select(*TASK, "ds", back_to_scale(F.col("fit")).alias("forecast"))
