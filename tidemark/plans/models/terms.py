"""Training and future rows of tasks with calendar terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import calendar_dimension, weekly_calendar_features
from tidemark.plans.backtest import TASK


def logged(y: str = "y") -> Column:
    return F.log1p(F.greatest(F.col(y).cast("double"), F.lit(0.0)))


def back_to_scale(z: Column) -> Column:
    """What log1p was taken of, never below 0 nor beyond what a double holds."""
    return F.greatest(F.expm1(F.least(z, F.lit(50.0))), F.lit(0.0))


def waves(daily: bool, order: int) -> list[Column]:
    """Sines and cosines of the day of the year, of a week's middle for weeks."""
    angle = 2 * F.pi() * (F.dayofyear("ds") + (0 if daily else 3)) / 365.25
    return [f(k * angle) for k in range(1, order + 1) for f in (F.sin, F.cos)]


def weekdays(daily: bool) -> list[Column]:
    return [(F.weekday("ds") == k).cast("double") for k in range(7)] if daily else []


def with_terms(tasks: DataFrame, daily: bool) -> DataFrame:
    """tasks with z (the log), t (place among the known or the future rows, from 1) and calendar columns: special_days, black_friday,
    year_end, and eve, after, month_start, month_end for days; days at the month's start for weeks.

    The calendar has a row a day or week between the first and the last date, and is broadcast.
    """
    first, last = tasks.agg(F.min("ds"), F.max("ds")).first()
    rows = tasks.withColumn("z", logged()).withColumn("t", F.row_number().over(Window.partitionBy(*TASK, "is_test").orderBy("ds")))
    if first is None:
        first = last = "2000-01-03"
    days = calendar_dimension(tasks.sparkSession, F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), 6))
    if daily:
        number = lambda c: F.col(c).cast("double")
        terms = days.select("ds", number("is_holiday").alias("special_days"), number("near_black_friday").alias("black_friday"), number("is_year_end").alias("year_end"), number("is_eve").alias("eve"), number("is_after").alias("after"), number("is_month_start").alias("month_start"), number("is_month_end").alias("month_end"))
    else:
        weeks = weekly_calendar_features(days, 1)
        terms = weeks.select(F.col("week").alias("ds"), *[F.col(a).cast("double").alias(b) for a, b in (("holidays", "special_days"), ("black_friday", "black_friday"), ("year_end", "year_end"), ("month_start_days", "month_start"))])
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in terms.columns if c != "ds"}  # dates that are no Mondays have no terms
    return rows.join(F.broadcast(terms), "ds", "left").withColumns(zero)
