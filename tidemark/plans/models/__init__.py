"""The catalogue of forecast models, and the runner of any of them over all tasks.

A model is a frame function (tasks, daily, params) -> (level, series, cutoff, ds, forecast and, if it likes, detail), or a
grouped function (y, ds, future, params) -> forecasts of one series in numpy, for plug-ins that Spark's functions cannot express.
Neither form can fail the others: what a model does not deliver is a row that says so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import backtest as B
from tidemark.plans.backtest import TASK, horizon_month, training_window
from tidemark.plans.models.autoregression import arima_aic
from tidemark.plans.models.boosting import calendar_boosting, hybrid_residual_boosting
from tidemark.plans.models.regression import calendar_regression, trend_season
from tidemark.plans.models.smoothing import damped_holt_winters
from tidemark.sources.stages import settle


@dataclass(frozen=True)
class ForecastModel:
    """full_history: its training data are not cut at the run's `start`. grouped: which of the two forms fn has."""

    name: str
    complexity: int
    family: str
    explanation: str
    fn: Callable
    params: dict = field(default_factory=dict)
    full_history: bool = False
    grouped: bool = False


#: How many points the simple models look back at: the last ones, their mean, the lag of a year, the growth, by days and by weeks.
POINTS = {True: {"naive": 7, "mean": 28, "lag": 364, "growth": 56}, False: {"naive": 1, "mean": 8, "lag": 52, "growth": 8}}

CATALOGUE = (
    ForecastModel("naive", 0, "base", "Repete o último período.", lambda t, daily, p: B.naive(t, POINTS[daily]["naive"])),
    ForecastModel("moving_average", 0, "base", "Média dos últimos períodos.", lambda t, daily, p: B.moving_average(t, POINTS[daily]["mean"])),
    ForecastModel("seasonal_naive", 0, "base", "Repete o período de um ano antes.", lambda t, daily, p: B.seasonal_naive(t, 364, POINTS[daily]["naive"]), full_history=True),
    ForecastModel("seasonal_growth", 1, "base", "Um ano antes, vezes o crescimento recente.", lambda t, daily, p: B.seasonal_growth(t, POINTS[daily]["lag"], POINTS[daily]["growth"], 364, POINTS[daily]["naive"]), full_history=True),
    ForecastModel("damped_holt_winters", 2, "suavização", "Nível e tendência recentes, com tendência que perde força.", damped_holt_winters),
    ForecastModel("arima_aic", 2, "autorregressivo", "Continua o comportamento recente da série.", arima_aic),
    ForecastModel("calendar_regression", 3, "regressão", "Efeitos de calendário e o último erro.", calendar_regression),
    ForecastModel("trend_season_regression", 3, "aditivo", "Tendência com mudanças, sazonalidade e eventos.", trend_season),
    ForecastModel("calendar_boosting", 4, "aprendizado de máquina", "Árvores sobre o calendário de todas as séries.", calendar_boosting),
    ForecastModel("hybrid_residual_boosting", 5, "híbrido", "Modelo aditivo e árvores sobre o que sobra.", hybrid_residual_boosting),
)


def _grouped(tasks: DataFrame, model: ForecastModel) -> DataFrame:
    """A grouped model over all tasks; what it raises is in `error`, in a row without a date."""

    def run(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values("ds")
        test = task["is_test"].to_numpy(bool)
        ds, y = task["ds"].to_numpy("datetime64[D]"), task["y"].to_numpy(float)
        key = task.iloc[0][TASK]
        try:
            with np.errstate(all="ignore"):
                got = np.asarray(model.fn(np.maximum(y[~test], 0), ds[~test], ds[test], model.params), float)
            if got.shape != (test.sum(),):
                raise ValueError("not one forecast for each date")
            rows = pd.DataFrame({"ds": task["ds"][test].to_numpy(), "forecast": got, "error": None})
        except Exception as ex:  # a series that a plug-in cannot fit is reported, not fatal
            rows = pd.DataFrame({"ds": [None], "forecast": [None], "error": [f"{type(ex).__name__}: {ex}"[:200]]})
        return rows.assign(level=key["level"], series=key["series"], cutoff=key["cutoff"])[[*TASK, "ds", "forecast", "error"]]

    return tasks.withColumn("y", F.col("y").cast("double")).groupBy(*TASK).applyInPandas(run, "level string, series string, cutoff date, ds date, forecast double, error string")


def _delivered(tasks: DataFrame, model: ForecastModel, daily: bool) -> DataFrame:
    """(task, ds, forecast, detail, error) of one model, written, so that what fails fails here."""
    got = _grouped(tasks, model) if model.grouped else model.fn(tasks, daily, model.params)
    text = lambda name: (F.col(name) if name in got.columns else F.lit(None)).cast("string").alias(name)
    return settle(got.select(*TASK, "ds", F.col("forecast").cast("double").alias("forecast"), text("detail"), text("error")))


def run_models(tasks: DataFrame, models: Sequence[ForecastModel] = CATALOGUE, daily: bool = False, start: date | None = None) -> DataFrame:
    """(level, series, cutoff, ds, model, forecast, actual, horizon, detail, error) of every model for every task.

    A task for which a model gives no finite forecast for each date, or two for one, has one row with the error and no forecast; a model that
    raises has such a row for every task. The others go on. Forecasts are never below 0. `start` cuts the training data of models
    that do not ask for full history; a task that has nothing left is such a failure too.
    """
    tasks = settle(tasks)
    wanted = tasks.where("is_test").select(*TASK, "ds", F.col("y").cast("double").alias("actual"))
    each = wanted.groupBy(*TASK).agg(F.count("*").alias("dates"))
    out = None
    for m in models:
        try:
            got = _delivered(tasks if m.full_history else training_window(tasks, start), m, daily)
        except Exception as ex:  # a model that cannot run is reported for every task
            said = f"{type(ex).__name__}: {ex}".splitlines()[0][:200]
            rows = each.select(*TASK, *[F.lit(None).cast(t).alias(n) for n, t in (("ds", "date"), ("forecast", "double"), ("actual", "double"), ("detail", "string"))], F.lit(said).alias("error"))
        else:
            finite = F.col("forecast").isNotNull() & ~F.isnan("forecast") & (F.abs("forecast") < float("inf"))
            met = wanted.join(got.where("ds is not null"), [*TASK, "ds"])
            sound = met.groupBy(*TASK).agg(F.count_if(finite).alias("finite"), F.count("*").alias("n")).join(each, TASK).where("finite = dates and n = dates").select(*TASK)
            good = met.join(sound, TASK, "left_semi").select(*TASK, "ds", F.greatest("forecast", F.lit(0.0)).alias("forecast"), "actual", "detail", F.lit(None).cast("string").alias("error"))
            why = got.groupBy(*TASK).agg(F.max("error").alias("why"))
            bad = each.join(sound, TASK, "left_anti").join(why, TASK, "left").select(*TASK, *[F.lit(None).cast(t).alias(n) for n, t in (("ds", "date"), ("forecast", "double"), ("actual", "double"), ("detail", "string"))], F.coalesce("why", F.lit("not a finite forecast for each date")).alias("error"))
            rows = good.unionByName(bad)
        rows = rows.withColumn("model", F.lit(m.name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = each.limit(0).select(*TASK, *[F.lit(None).cast(t).alias(n) for n, t in (("ds", "date"), ("forecast", "double"), ("actual", "double"), ("detail", "string"), ("error", "string"), ("model", "string"))])
    return out.withColumn("horizon", horizon_month(F.col("ds"), F.col("cutoff"))).select(*TASK, "ds", "model", "forecast", "actual", "horizon", "detail", "error")


def forecasts_of(run: DataFrame) -> DataFrame:
    return run.where("error is null").drop("error", "detail")


def failures_of(run: DataFrame) -> DataFrame:
    return run.where("error is not null").select(*TASK, "model", "error")
