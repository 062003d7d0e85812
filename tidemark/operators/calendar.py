"""A calendar of days with holidays and sales events, and weekly features made of it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import week_of

#: Fixed national holidays of Brazil (month, day, name).
FIXED = ((1, 1, "Confraternização Universal"), (4, 21, "Tiradentes"), (5, 1, "Dia do Trabalho"), (9, 7, "Independência"), (10, 12, "Nossa Senhora Aparecida"), (11, 2, "Finados"), (11, 15, "Proclamação da República"), (12, 25, "Natal"))
#: Consciência Negra is national since this year.
BLACK_AWARENESS = (11, 20, "Consciência Negra", 2024)
#: Days from Easter (name, offset).
MOVING = (("Sexta-feira Santa", -2),)


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the anonymous computus."""
    div, mod = (lambda a, b: F.floor(a / b)), (lambda a, b: F.pmod(a, F.lit(b)))
    a, b, c = mod(year, 19), div(year, 100), mod(year, 100)
    d, e = div(b, 4), mod(b, 4)
    f = div(b + 8, 25)
    g = div(b - f + 1, 3)
    h = mod(19 * a + b - d - g + 15, 30)
    i, k = div(c, 4), mod(c, 4)
    m = mod(32 + 2 * e + 2 * i - h - k, 7)
    n = div(a + 11 * h + 22 * m, 451)
    month, day = div(h + m - 7 * n + 114, 31), mod(h + m - 7 * n + 114, 31) + 1
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def black_friday(year: Column) -> Column:
    """The day after the fourth Thursday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "THU"), 22)


def calendar_dimension(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row for each day from start to end: holiday, eve, day after, sales events, weekdays, month's ends, annual wave."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("ds"))
    year, month, day = F.year("ds"), F.month("ds"), F.dayofmonth("ds")
    pascha = easter(year)

    def holiday(d: Column) -> Column:
        y, m, n = F.year(d), F.month(d), F.dayofmonth(d)
        fixed = F.lit(False)
        for a, b, _ in FIXED:
            fixed = fixed | ((m == a) & (n == b))
        a, b, _, since = BLACK_AWARENESS
        moving = F.lit(False)
        for _, offset in MOVING:
            moving = moving | (d == F.date_add(easter(y), offset))
        return fixed | ((m == a) & (n == b) & (y >= since)) | moving

    to_friday = F.datediff("ds", black_friday(year))
    since_easter = F.datediff("ds", pascha)
    angle = 2 * F.pi() * F.dayofyear("ds") / 365.25
    return days.select(
        "ds", holiday(F.col("ds")).alias("is_holiday"), holiday(F.date_add("ds", 1)).alias("is_eve"), holiday(F.date_sub("ds", 1)).alias("is_after"), (to_friday == 0).alias("is_black_friday"),
        F.abs(to_friday).between(0, 3).alias("near_black_friday"), (((month == 12) & (day >= 20)) | ((month == 1) & (day <= 2))).alias("is_year_end"), since_easter.between(-48, -46).alias("is_carnival"),
        since_easter.between(-6, 0).alias("is_holy_week"), F.weekday("ds").alias("weekday"), (day <= 5).alias("is_month_start"), (F.datediff(F.last_day("ds"), "ds") < 3).alias("is_month_end"), F.sin(angle).alias("annual_sin"), F.cos(angle).alias("annual_cos"),
    )


def weekly_calendar_features(calendar: DataFrame, order: int = 2) -> DataFrame:
    """One row for each Monday: Fourier terms of its Thursday's day of the year, month, counts of special days."""
    weeks = calendar.groupBy(week_of(F.col("ds")).alias("week")).agg(
        F.count_if("is_holiday").alias("holidays"), F.max(F.col("is_black_friday").cast("int")).alias("black_friday"), F.max(F.col("is_year_end").cast("int")).alias("year_end"), F.count_if("is_month_start").alias("month_start_days")
    )
    angle = 2 * F.pi() * F.dayofyear(F.date_add("week", 3)) / 365.25
    waves = [f(k * angle).alias(f"{name}{k}") for k in range(1, order + 1) for name, f in (("sin", F.sin), ("cos", F.cos))]
    first = calendar.agg(F.min(week_of(F.col("ds"))).alias("first"))
    return weeks.crossJoin(F.broadcast(first)).select("week", (F.datediff("week", "first") / 7).cast("int").alias("trend"), F.month(F.date_add("week", 3)).alias("month"), "holidays", "black_friday", "year_end", "month_start_days", *waves)  # one row
