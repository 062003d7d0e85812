"""Gradient-boosted trees over the panel of all series: one ensemble for each cutoff, of what was known then.

Series share calendar effects, so all learn from each other; each one's own size is taken off first and is known to the trees by a few figures.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.backtest import TASK
from tidemark.plans.models.regression import fitted, trend_rows
from tidemark.plans.models.terms import back_to_scale, waves, with_terms
from tidemark.sources.stages import settle

EXTRA = ("special_days", "black_friday", "year_end", "month_start")
DAYS_ONLY = ("eve", "after", "month_end")


def panel(rows: DataFrame, daily: bool, trend: bool) -> DataFrame:
    """rows (of with_terms) with weight, centre and the vector `features`: calendar, the series' own figures, and with `trend` the date.

    The centre is the mean of z with the weights of points, which halve every 180 days.
    """
    age = F.datediff("cutoff", "ds")
    rows = rows.withColumn("weight", F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / 180.0))
    known, late = ~F.col("is_test"), age < 56
    mean = lambda v, w: F.sum(v * w) / F.sum(w)
    z, w = F.col("z"), F.col("weight")
    own = rows.where(known).groupBy(*TASK).agg(
        mean(z, w).alias("centre"), F.coalesce(F.stddev_pop(z), F.lit(0.0)).alias("spread"), F.avg((F.col("y") <= 0).cast("double")).alias("empty"),
        (F.coalesce(F.avg(F.when(late, z)), mean(z, w)) - mean(z, w)).alias("lately"), (F.coalesce(F.avg(F.when(age.between(336, 391), z)), mean(z, w)) - mean(z, w)).alias("year_ago"),
    )
    columns = [*waves(daily, 2), F.month("ds"), *[F.col(c) for c in EXTRA + (DAYS_ONLY if daily else ())], *[F.col(c) for c in ("centre", "spread", "empty", "lately", "year_ago")]]
    columns += [F.weekday("ds"), F.dayofmonth("ds")] if daily else []
    columns += [-age / 7.0] if trend else []
    return rows.join(own, TASK).withColumn("features", array_to_vector(F.array(*[c.cast("double") for c in columns])))


def boosted(rows: DataFrame, label: str, into: str, rounds: int, depth: int, rate: float, seed: int) -> DataFrame:
    """Future rows with the ensembles' predictions, those of each cutoff from its own known rows."""
    learner = GBTRegressor(featuresCol="features", labelCol=label, weightCol="weight", predictionCol=into, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=5, maxBins=64, seed=seed)
    out = None
    for (cutoff,) in rows.select("cutoff").distinct().orderBy("cutoff").collect():  # a few cutoffs
        own = rows.where(F.col("cutoff") == F.lit(cutoff))
        got = learner.fit(own.where(~F.col("is_test") & F.col(label).isNotNull())).transform(own.where("is_test"))
        out = got if out is None else out.unionByName(got)
    return rows.where("is_test").withColumn(into, F.lit(0.0)) if out is None else out


def calendar_boosting(tasks: DataFrame, daily: bool, params: dict) -> DataFrame:
    """Trees on the calendar and the series' figures, for what lies above or below each series' centre."""
    rows = settle(panel(with_terms(tasks, daily), daily, True).withColumn("label", F.col("z") - F.col("centre")))
    got = boosted(rows, "label", "up", params.get("rounds", 20), params.get("depth", 3), params.get("rate", 0.25), params.get("seed", 42))
    return got.select(*TASK, "ds", back_to_scale(F.col("centre") + F.col("up")).alias("forecast"))


def hybrid_residual_boosting(tasks: DataFrame, daily: bool, params: dict) -> DataFrame:
    """trend_season, and trees on what it leaves."""
    base = fitted(*trend_rows(tasks, daily, params.get("changepoints", 12)))
    rows = settle(panel(base, daily, False).withColumn("left", F.col("z") - F.col("fit")))
    got = boosted(rows, "left", "up", params.get("rounds", 15), params.get("depth", 3), params.get("rate", 0.25), params.get("seed", 42))
    return got.select(*TASK, "ds", back_to_scale(F.col("fit") + F.col("up")).alias("forecast"))
