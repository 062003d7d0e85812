"""Weekly cubes after a late batch: only what the batch can have changed is cleaned, flagged and summed again.

A late line or order changes its own order. A product whose first sale moves changes the orders that hold it. An order whose value
moves can make or break groups of like orders. Weeks that hold lines of such orders, before or after, are remade and replace
their partitions; all others keep their files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Options
from tidemark.functions import week_of
from tidemark.operators import cubes as C
from tidemark.operators import orders as O
from tidemark.sources.bucketed import bucketed, remove, stored
from tidemark.sources.stages import settle

#: Rows of ids that are broadcast at most, some 100 MB; more are joined by an exchange.
IDS = 6_000_000


@dataclass(frozen=True)
class State:
    """Clean lines and order flags, as base_items() and flag_extremes() make them of all rows. Both lie by order; after a late batch they are
    views of what was stored before and of what the batch changed."""

    lines: DataFrame
    flags: DataFrame
    #: lines with is_extreme of their order, joined where both lie.
    marked: DataFrame


def _by_order(df: DataFrame, dealt: bool = True) -> DataFrame:
    return bucketed(df, "order_id", dealt=dealt)[0]


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def full_state(items: DataFrame, orders: DataFrame, options: Options, new_value: bool = True) -> State:
    """new_value: whether flags tell the revenue of products new then, for which lines meet their product's first sale; no cube needs it."""
    lines = _by_order(O.base_items(_dealt(items, "order_id"), O.valid_orders(orders, options.rules), options.dedup_items))
    totals = O.order_totals(lines, options.new_product_days) if new_value else O.plain_totals(lines)
    flags = _by_order(O.flag_extremes(totals, options.extremes))
    return State(lines, flags, O.with_extremes(lines, flags))


def changed_orders(late_items: DataFrame, late_orders: DataFrame) -> DataFrame:
    """(order_id) of every order that a late line or a late row of orders names; null ids are none."""
    return late_items.select("order_id").union(late_orders.select(F.col("id"))).where("order_id is not null").distinct()


def _in(df: DataFrame, keys: DataFrame, on, how: str = "left_semi") -> DataFrame:
    return df.join(keys, on, how)


def _small(keys: DataFrame) -> DataFrame:
    """keys, settled, and broadcast if they are few."""
    keys = settle(keys)
    return F.broadcast(keys) if keys.count() <= IDS else keys


def refreshed(before: State, items: DataFrame, orders: DataFrame, changed: DataFrame, options: Options) -> tuple[State, DataFrame]:
    """(the state of all rows, weeks to be remade). items and orders hold all rows, late ones included; those of orders that did not
    change are not cleaned again. Changes of products and regions are not followed: they need a full build."""
    changed = _small(changed)
    own = O.base_items(_dealt(_in(items, changed, "order_id"), "order_id"), O.valid_orders(_in(orders.withColumn("order_id", F.col("id")), changed, "order_id").drop("order_id"), options.rules), options.dedup_items)
    own = _by_order(own)
    others = lambda df: _in(df, changed, "order_id", "left_anti")
    lines = others(before.lines).unionByName(own)

    plain = [c for c in before.flags.columns if c not in ("in_group", "is_extreme")]
    if "new_value" in plain:
        touched = settle(_in(before.lines, changed, "order_id").select("product_id").union(own.select("product_id")).distinct())
        old, new = O.first_sale(_in(before.lines, touched, "product_id")), O.first_sale(_in(lines, touched, "product_id"))
        moved = old.withColumnRenamed("first_date", "was").join(new, "product_id", "full").where("not (was <=> first_date)").select("product_id")
        affected = _small(changed.union(_in(lines, moved, "product_id").select("order_id")).distinct())
        rows = settle(_in(lines, affected, "order_id"))
        dated = rows.join(O.first_sale(_in(lines, rows.select("product_id").distinct(), "product_id")), "product_id", "left")
        remade = O.order_totals(dated, options.new_product_days)
    else:
        affected, remade = changed, O.plain_totals(own)
    remade = _by_order(remade.select(*plain), dealt="new_value" not in plain)
    totals = _in(before.flags.select(*plain), affected, "order_id", "left_anti").unionByName(remade)

    rule = options.extremes
    kind = ["like_value", "lines", *(["units"] if rule.same_units else [])]
    like = lambda df: df.withColumn("like_value", F.floor(F.col("value").cast("double") / rule.unit + 0.5))
    kinds = _small(like(_in(before.flags.select(*plain), affected, "order_id").union(remade)).select(*kind).distinct())
    anew = _by_order(O.flag_extremes(_in(like(totals), kinds, kind).select(*plain), rule).select(*before.flags.columns))
    same = _in(_in(before.flags, changed, "order_id", "left_anti"), anew.select("order_id"), "order_id", "left_anti")
    flags = same.unionByName(anew)

    now, then = anew.select("order_id", "is_extreme"), before.flags.select("order_id", F.col("is_extreme").alias("was"))
    flipped = now.join(then, "order_id", "left").where("not (is_extreme <=> was)").select("order_id").union(changed).distinct()
    flipped = _small(flipped)
    weeks = reduce(DataFrame.union, [_in(df, flipped, "order_id").select(week_of(F.col("order_date")).alias("week")) for df in (before.lines, lines)]).distinct()
    newly = anew.select("order_id", F.col("is_extreme").alias("newly"))
    marked = others(before.marked).join(newly, "order_id", "left").withColumn("is_extreme", F.coalesce("newly", "is_extreme")).drop("newly")
    return State(lines, flags, marked.unionByName(O.with_extremes(own, anew))), settle(weeks)


def cube_of(state: State, products: DataFrame, regions: DataFrame, kind: str, options: Options, weeks: DataFrame | None = None) -> DataFrame:
    """The weekly cube of all lines, or of those in `weeks`, a row for each of which is broadcast. Lines go by product once, without labels, and are
    labelled and summed where they lie."""
    lines = state.marked if weeks is None else _in(state.marked.withColumn("week", week_of(F.col("order_date"))), F.broadcast(weeks), "week").drop("week")
    lines = lines.where(F.col("order_date") < F.lit(options.as_of)).select("order_id", "order_date", "product_id", "is_extreme", "has_professional", "origin", "state", "units", "list_price", "unit_price", "total_price")
    if "product_id" in C.KINDS[kind]:
        lines = _dealt(lines.drop(*[c for c in ("origin", "state") if c not in C.KINDS[kind]]), "product_id").withColumns({c: F.lit(None).cast("string") for c in ("origin", "state") if c not in C.KINDS[kind]})
    return C.weekly_cube(C.labelled_lines(lines, products, regions), kind, options.as_of)


def write_cube(cube: DataFrame, where: str) -> None:
    """A folder with a partition for each week."""
    cube.repartition("week").write.partitionBy("week").mode("overwrite").parquet(where)


def overwrite_weeks(cube: DataFrame, weeks: DataFrame, where: str) -> None:
    """The cube of `weeks` in place of these weeks' partitions; weeks that have no rows any more are removed. Others are not touched."""
    cube = stored(cube)
    cube.repartition("week").write.partitionBy("week").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(where)
    for r in weeks.join(cube.select("week").distinct(), "week", "left_anti").collect():  # weeks, of which there are few
        remove(cube.sparkSession, f"{where}/week={r.week}")


def read_cube(spark, where: str) -> DataFrame:
    return spark.read.parquet(where)
