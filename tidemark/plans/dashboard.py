"""The dashboard's data as one nested JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(df: DataFrame, order: str, name: str) -> DataFrame:
    """One row: the rows of a small result as a sorted list of structs."""
    rest = [c for c in df.columns if c != order]
    return df.agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))


def as_map(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """One row: a map from the key to a value."""
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))).alias(name))


def heat_rows(heat: DataFrame) -> DataFrame:
    """One row: the 7 x 12 means, by weekday and month, null where there is none."""
    months = F.array(*[F.col(f"m{m}") for m in range(1, 13)])
    return heat.select("weekday", months.alias("v")).agg(F.transform(F.sort_array(F.collect_list(F.struct("weekday", "v"))), lambda r: r["v"]).alias("heat"))


def dashboard_document(sections: dict[str, DataFrame]) -> DataFrame:
    """(json) of one-row sections, each with one column; all are aggregates of a few hundred rows at most."""
    parts = list(sections.values())
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.crossJoin(F.broadcast(p))  # one row each
    return joined.select(F.to_json(F.struct(*joined.columns), {"ignoreNullFields": "false"}).alias("json"))
