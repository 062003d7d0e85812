"""ARIMA orders by two regressions: a long autoregression gives the shocks, then each order regresses on lags and shocks.

All orders are judged on one common sample, in errors of the same one step ahead, so their criteria compare whether they difference or not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.backtest import TASK
from tidemark.plans.models.linear import bound, dot, ridge
from tidemark.plans.models.terms import back_to_scale, logged
from tidemark.sources.stages import settle

#: Orders (lags, differences, shocks), the reference's.
GRID = ((1, 1, 1), (0, 1, 1), (1, 1, 0), (2, 1, 2), (1, 0, 1), (2, 0, 1))
LONG, LEAST = 8, 12
OWN = [*TASK, "d"]


def _lags(column: str, n: int, keys: list[str]) -> list[Column]:
    return [F.lag(column, k).over(Window.partitionBy(*keys).orderBy("ds")) for k in range(1, n + 1)]


def _with_shocks(tasks: DataFrame) -> DataFrame:
    """Known rows of both forms (d: 0 as they are, 1 differences) with z, v, n (place, from 1), shock."""
    own = Window.partitionBy(*TASK).orderBy("ds")
    known = tasks.where(~F.col("is_test")).withColumn("v", logged()).withColumn("n", F.row_number().over(own)).withColumn("change", F.col("v") - F.lag("v").over(own))
    forms = F.array(F.struct(F.lit(0).alias("d"), F.col("v").alias("z")), F.struct(F.lit(1).alias("d"), F.col("change").alias("z")))
    rows = known.select(*TASK, "ds", "v", "n", F.explode(forms).alias("f")).select(*TASK, "ds", "v", "n", "f.*").where("z is not null")
    rows = settle(rows.withColumn("x", F.array(*_lags("z", LONG, OWN), F.when(F.col("d") == 0, 1.0).otherwise(0.0))))
    full = rows.where(F.col("n") > LONG + 1)
    weights = ridge(full, OWN, [1e-3] * (LONG + 1))
    return rows.join(weights, OWN).withColumn("shock", F.when(F.col("n") > LONG + 1, F.col("z") - dot(F.col("x"), F.col("w")))).drop("x", "w")


def orders(tasks: DataFrame, grid=GRID, lags: int = 2) -> DataFrame:
    """(task, d, order, w, aic, points, and the last values) of every order with at least LEAST points in the common sample.

    w has a weight for each of `lags` lags, as many shocks, and the level; those an order lacks are 0.
    """
    rows = _with_shocks(tasks)
    names = [f"z{k}" for k in range(lags)] + [f"e{k}" for k in range(lags)]
    rows = rows.withColumns(dict(zip(names, _lags("z", lags, OWN) + _lags("shock", lags, OWN), strict=True)))
    sample = settle(rows.where(F.col("n") > LONG + 1 + lags))
    tried = []
    for i, (p, d, q) in enumerate(grid):
        use = [F.col(f"z{k}") if k < p else F.lit(0.0) for k in range(lags)] + [F.col(f"e{k}") if k < q else F.lit(0.0) for k in range(lags)] + [F.lit(1.0 - d)]
        tried.append(F.when(F.col("d") == d, F.struct(F.lit(i).alias("i"), F.lit(f"({p},{d},{q})").alias("order"), F.lit(p + q + 1 - d).alias("terms"), F.array(*use).alias("x"))))
    keys = [*OWN, "i", "order", "terms"]
    long = sample.select(*OWN, "ds", "v", "z", F.explode(F.array_compact(F.array(*tried))).alias("o")).select(*OWN, "ds", "v", "z", "o.*")
    rest = long.join(ridge(long, keys, [1e-4] * (2 * lags + 1)), keys).withColumn("rest", F.col("z") - dot(F.col("x"), F.col("w")))
    ends = lambda c: F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ds", c)))), 1, lags), lambda s: s[c])
    told = rest.groupBy(*keys).agg(F.count("*").alias("points"), F.sum(F.col("rest") * F.col("rest")).alias("error"), F.first("w").alias("w"), F.max_by("v", "ds").alias("v"), ends("z").alias("last_z"), ends("rest").alias("last_rest")).where(F.col("points") >= LEAST)
    aic = F.col("points") * F.log(F.greatest(F.col("error") / F.col("points"), F.lit(1e-12))) + 2 * (F.col("terms") + 1)
    return told.withColumn("aic", aic)


def recursion(state: Column, steps: Column, lags: int = 2) -> Column:
    """Forecasts one after the other, each from the lags before it; shocks to come are 0."""
    w = lambda k: F.get(state["w"], F.lit(k))
    start = F.struct(state["last_z"].alias("z"), state["last_rest"].alias("e"), state["v"].alias("v"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        parts = [w(k) * F.get(s["z"], F.lit(k)) + w(lags + k) * F.get(s["e"], F.lit(k)) for k in range(lags)]
        hat = F.least(F.greatest(reduce(lambda a, b: a + b, parts) + w(2 * lags), F.lit(-50.0)), F.lit(50.0))

        def then(z: Column) -> Column:
            value = F.when(state["d"] == 1, s["v"] + z).otherwise(z)
            return F.struct(F.concat(F.array(z), F.slice(s["z"], 1, lags - 1)).alias("z"), F.concat(F.array(F.lit(0.0)), F.slice(s["e"], 1, lags - 1)).alias("e"), value.alias("v"), F.concat(s["out"], F.array(value)).alias("out"))

        return bound(hat, then)

    return F.aggregate(F.sequence(F.lit(1), steps), start, step)["out"]


def arima_aic(tasks: DataFrame, daily: bool, params: dict) -> DataFrame:
    """The order of the lowest criterion (ties: first of the grid) forecasts; it is told in `detail`. A constant only without
    differences. Series too short for the common sample have no forecast."""
    state = F.struct("aic", "i", "d", "order", "w", "v", "last_z", "last_rest")
    best = orders(tasks, params.get("grid", GRID)).groupBy(*TASK).agg(F.min(F.struct("aic", "i")).alias("k"), F.min_by(state, F.struct("aic", "i")).alias("s")).drop("k")
    dates = tasks.where("is_test").groupBy(*TASK).agg(F.array_sort(F.collect_list("ds")).alias("dates"))
    rows = dates.join(best, TASK).withColumn("values", recursion(F.col("s"), F.size("dates")))
    long = rows.select(*TASK, F.col("s.order").alias("detail"), F.explode(F.arrays_zip("dates", "values")).alias("p"))
    return long.select(*TASK, F.col("p.dates").alias("ds"), back_to_scale(F.col("p.values")).alias("forecast"), "detail")
