"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import STATE_REGION

MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def clean_state(state: Column) -> Column:
    return F.upper(F.trim(state.cast("string")))


def channel_label(flag: Column, what: str = "NUTRICIONISTA") -> Column:
    """COM_… where the flag holds, SEM_… elsewhere (also for null)."""
    return F.when(flag, f"COM_{what}").otherwise(f"SEM_{what}")


def region_of_state(state: Column, regions: Mapping[str, str] = STATE_REGION) -> Column:
    """The state's region; SEM_INFO for states that have none. The mapping is a fixed, small table."""
    known = F.create_map(*[F.lit(x) for x in chain(*regions.items())])
    return F.coalesce(F.try_element_at(known, state), F.lit("SEM_INFO"))


def label_missing(value: Column, label: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(label))


def product_label(name: Column, product_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("produto "), product_id.cast("string")))


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision; null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100


def change_pct(now: Column, before: Column) -> Column:
    return (ratio(now, before) - 1) * 100


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounded half away from zero, as decimals are."""
    return F.round(x.cast("decimal(38,12)"), digits).cast("double")


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def week_of(day: Column) -> Column:
    """The Monday of the day's week."""
    return F.date_trunc("week", day).cast("date")


def month_label(day: Column) -> Column:
    """For example: março/2025."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat(F.get(names, F.month(day) - 1), F.lit("/"), F.year(day).cast("string"))


def money_text(x: Column) -> Column:
    """Whole currency units the Brazilian way: R$ 1.234.567."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(x.cast("double"), 0), ",", "."))


def number_text(x: Column, digits: int = 1) -> Column:
    """1.234,5"""
    return F.translate(F.format_number(x.cast("double"), digits), ",.", ".,")


def series_key(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)
