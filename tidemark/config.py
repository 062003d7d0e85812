"""Options of the jobs. All of them are parameters; defaults are those of a store that sells to consumers."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

#: States by region of Brazil (fixed values).
REGIONS = {
    "NORTE": ("AC", "AM", "AP", "PA", "RO", "RR", "TO"),
    "NORDESTE": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"),
    "CENTRO-OESTE": ("DF", "GO", "MS", "MT"),
    "SUDESTE": ("ES", "MG", "RJ", "SP"),
    "SUL": ("PR", "RS", "SC"),
}
STATE_REGION = {state: region for region, states in REGIONS.items() for state in states}


@dataclass(frozen=True)
class OrderRules:
    """Rows of orders that do not count: values that exclude a row. A null is in no list."""

    statuses: tuple[str, ...] = ()
    professionals: tuple[int, ...] = ()
    customers: tuple[int, ...] = ()
    emails: tuple[str, ...] = ()


@dataclass(frozen=True)
class ExtremeRule:
    """An order is extreme above `value`, or as one of `group_size` like orders within `group_days` days.

    Like orders have the same value (to `unit`), number of lines and, unless `same_units` is off, units; only orders of at least
    `group_value` and `group_lines` lines count for groups.
    """

    value: float = 5000.0
    group_size: int = 2
    group_days: int = 7
    group_value: float = 1000.0
    group_lines: int = 2
    unit: float = 0.01
    same_units: bool = True


@dataclass(frozen=True)
class Options:
    as_of: date
    rules: OrderRules = field(default_factory=OrderRules)
    extremes: ExtremeRule = field(default_factory=ExtremeRule)
    new_product_days: int = 90
    dedup_items: bool = True
