"""Damped Holt-Winters as a fold over each series' ordered values, the grid of factors side by side."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.backtest import TASK
from tidemark.plans.models.linear import bound
from tidemark.plans.models.terms import back_to_scale, logged

#: Factors of level, trend, season and damping that are tried.
LEVELS, TRENDS, SEASONS, DAMPS = (0.1, 0.3, 0.6, 0.9), (0.0, 0.05, 0.2), (0.05, 0.2), (0.8, 0.95)
PERIOD, LEAST = 7, 16


def smoothed(values: Column, season: bool) -> Column:
    """The state after the last value, with the factors of the least squared error one step ahead: level, trend, damp, and the
    season's offsets as a queue whose head is the next one's."""
    m = PERIOD if season else 0
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g"), F.lit(d).alias("d")) for a, b, g, d in itertools.product(LEVELS, TRENDS, SEASONS if season else (0.0,), DAMPS)])
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(x), F.lit(1))
    first = F.slice(values, 1, m or 2)
    offsets = F.transform(first, lambda v: v - mean(first)) if season else F.array(F.lit(0.0))
    start = F.struct(mean(first).alias("level"), F.lit(0.0).alias("trend"), offsets.alias("season"), F.lit(0.0).alias("error"), F.lit(0).alias("n"))

    def run(c: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            head, hoped = F.get(s["season"], F.lit(0)), s["level"] + c["d"] * s["trend"]

            def then(level: Column) -> Column:
                queue = F.concat(F.slice(s["season"], 2, m - 1), F.array(c["g"] * (x - level) + (1 - c["g"]) * head)) if season else s["season"]
                off = x - hoped - head
                return F.struct(
                    level.alias("level"), (c["b"] * (level - s["level"]) + (1 - c["b"]) * c["d"] * s["trend"]).alias("trend"), queue.alias("season"),
                    (s["error"] + F.when(s["n"] >= m, off * off).otherwise(0.0)).alias("error"), (s["n"] + 1).alias("n"),
                )

            return bound(c["a"] * (x - head) + (1 - c["a"]) * hoped, then)

        return F.aggregate(values, start, step)

    tried = F.transform(grid, lambda c, i: bound(run(c), lambda s: F.struct(s["error"].alias("error"), i.alias("i"), s["level"].alias("level"), s["trend"].alias("trend"), c["d"].alias("damp"), s["season"].alias("season"))))
    return F.array_min(tried)


def damped_holt_winters(tasks: DataFrame, daily: bool, params: dict) -> DataFrame:
    """Level and damped trend; a season of seven only for days, and only with at least LEAST of them. Weeks have none."""
    known = tasks.where(~F.col("is_test")).groupBy(*TASK).agg(F.transform(F.array_sort(F.collect_list(F.struct("ds", logged().alias("z")))), lambda p: p["z"]).alias("v"))
    enough = F.size("v") >= LEAST
    parts = [known.where(~enough if daily else F.lit(True)).withColumn("s", smoothed(F.col("v"), False)).drop("v")]
    if daily:
        parts.append(known.where(enough).withColumn("s", smoothed(F.col("v"), True)).drop("v"))
    states = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return ahead(tasks, states)


def ahead(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """Forecasts of the future rows, in the order of their dates, from each task's state."""
    dates = tasks.where("is_test").groupBy(*TASK).agg(F.array_sort(F.collect_list("ds")).alias("dates"))
    rows = dates.join(states, TASK).select(*TASK, "s", F.posexplode("dates").alias("h", "ds"))
    d = F.col("s.damp")
    z = F.col("s.level") + F.col("s.trend") * d * (1 - F.pow(d, F.col("h") + 1)) / (1 - d) + F.get(F.col("s.season"), F.col("h") % F.size("s.season"))
    return rows.select(*TASK, "ds", back_to_scale(z).alias("forecast"))
