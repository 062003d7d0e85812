"""Quantiles that merge: one KLL sketch for each day and channel; months, quarters and the whole come from merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import channel_label, month_of

#: Size of a sketch: the error in rank is then about half a percent.
K = 400


def value_sketches(flags: DataFrame, k: int = K) -> DataFrame:
    """(ds, channel, sketch) of order values, a few kilobytes a row; days that have not changed need not be made again. Orders without a
    value are left out."""
    return flags.groupBy(F.col("order_date").alias("ds"), channel_label(F.col("has_professional")).alias("channel")).agg(F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: Sequence[Column] = (), quantiles: Sequence[float] = (0.5, 0.9, 0.99), k: int = K) -> DataFrame:
    """(by, orders, p50, ...) from merged sketches; without `by` one row for all. The counts are exact, the quantiles near."""
    merged = sketches.where(F.kll_sketch_get_n_double("sketch") > 0).groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("merged"))
    names = [c for c in merged.columns if c != "merged"]
    return merged.select(*names, F.kll_sketch_get_n_double("merged").alias("orders"), *[F.kll_sketch_get_quantile_double("merged", F.lit(q)).alias(f"p{q * 100:g}") for q in quantiles])


def quantiles_by_period(sketches: DataFrame) -> DataFrame:
    """(period, start, orders, p50, p90, p99) of months, quarters and the whole, each from the same daily sketches."""
    day = F.col("ds")
    parts = [merged_quantiles(sketches, [F.lit(name).alias("period"), start.alias("start")]) for name, start in (("month", month_of(day)), ("quarter", F.trunc(day, "quarter")), ("all", F.lit(None).cast("date")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
