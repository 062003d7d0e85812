"""From raw orders and lines to clean lines, order totals and flags of extreme orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ExtremeRule, OrderRules
from tidemark.functions import clean_state


def _not_in(column: str, values: Sequence) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*values) if values else F.lit(True)


def filter_valid_rows(orders: DataFrame, rules: OrderRules) -> DataFrame:
    """Rows in none of the four lists of exclusions. Values are compared as they are, nulls pass."""
    return orders.where(_not_in("status", rules.statuses) & _not_in("professional_id", rules.professionals) & _not_in("customer_id", rules.customers) & _not_in("email", rules.emails))


def valid_orders(orders: DataFrame, rules: OrderRules) -> DataFrame:
    """(order_id, has_professional, state), one row for each id with at least one valid row; of several states the greatest."""
    return (
        filter_valid_rows(orders, rules).where("id is not null").groupBy(F.col("id").alias("order_id"))
        .agg(F.bool_or(F.col("professional_id").isNotNull()).alias("has_professional"), F.max(clean_state(F.col("state"))).alias("state"))
    )


def dedup_items(items: DataFrame) -> DataFrame:
    """The latest line of each order and product; of equally late ones the dearest, then the one with most units."""
    latest = Window.partitionBy("order_id", "product_id").orderBy(F.desc_nulls_last("updated"), F.desc_nulls_last("total_price"), F.desc_nulls_last("units"), F.asc_nulls_last("origin"))
    return items.withColumn("latest", F.row_number().over(latest)).where("latest = 1").drop("latest")


def base_items(items: DataFrame, valid: DataFrame, dedup: bool = True) -> DataFrame:
    """Dated lines of valid orders. Joined by order first, so that the dedup, by order and product, needs no second exchange."""
    joined = items.where("order_date is not null").join(valid, "order_id")
    return dedup_items(joined) if dedup else joined


def first_sale(base: DataFrame) -> DataFrame:
    return base.groupBy("product_id").agg(F.min("order_date").alias("first_date"))


def with_first_sale(base: DataFrame) -> DataFrame:
    """base with first_date, the day its product first sold."""
    return base.join(first_sale(base), "product_id", "left")


def plain_totals(base: DataFrame) -> DataFrame:
    """order_totals() without new_value: no exchange but that by order."""
    return base.groupBy("order_id").agg(
        F.min("order_date").alias("order_date"), F.max("has_professional").alias("has_professional"), F.max("state").alias("state"),
        F.sum("total_price").alias("value"), F.sum(F.coalesce("list_price", "unit_price") * F.col("units")).alias("list_value"),
        F.sum("units").alias("units"), F.count("*").alias("lines"), F.count_if(F.col("unit_price") < F.col("list_price")).alias("discounted_lines"),
    )


def with_new_value(totals: DataFrame, base: DataFrame, new_days: int = 90) -> DataFrame:
    """totals with new_value, revenue of products new then. Only what tells new lines goes by product, and only sums come back."""
    is_new = F.datediff("order_date", "first_date") <= new_days
    dated = base.select("order_id", "product_id", "order_date", "total_price").join(first_sale(base), "product_id").where(is_new)
    sums = dated.groupBy("order_id").agg(F.sum(F.when(is_new, F.col("total_price")).otherwise(0)).alias("new_value"), F.count("*").alias("new_lines"))
    none = F.lit(0).cast(sums.schema["new_value"].dataType)
    value = F.when(F.col("new_lines") == F.col("lines"), F.col("new_value")).otherwise(F.coalesce("new_value", none))  # null if all lines are new and without a price
    return totals.join(sums, "order_id", "left").withColumn("new_value", value).drop("new_lines")


def order_totals(base: DataFrame, new_days: int = 90) -> DataFrame:
    """One row for each order: date, value, list value, units, lines, discounted lines, revenue of products new then. A base that has
    first_date already needs no exchange but that by order."""
    if "first_date" not in base.columns:
        return with_new_value(plain_totals(base), base, new_days)
    is_new = F.datediff("order_date", "first_date") <= new_days
    return base.groupBy("order_id").agg(
        F.min("order_date").alias("order_date"), F.max("has_professional").alias("has_professional"), F.max("state").alias("state"),
        F.sum("total_price").alias("value"), F.sum(F.coalesce("list_price", "unit_price") * F.col("units")).alias("list_value"),
        F.sum("units").alias("units"), F.count("*").alias("lines"), F.count_if(F.col("unit_price") < F.col("list_price")).alias("discounted_lines"),
        F.sum(F.when(is_new, F.col("total_price")).otherwise(0)).alias("new_value"),
    )


def flag_extremes(totals: DataFrame, rule: ExtremeRule) -> DataFrame:
    """totals with in_group and is_extreme.

    Only orders that can be in a group are windowed, and these as counts by key and day, so that a very common kind of
    order makes a window of days and not of orders. Only ids and keys of orders are dealt out by key; totals have a row an order and
    stay where they lie.
    """
    rounded = F.floor(F.col("value").cast("double") / rule.unit + 0.5)
    key = ["like_value", "lines", *(["units"] if rule.same_units else [])]
    keyed = totals.withColumn("like_value", rounded)
    can = (F.col("value") >= rule.group_value) & (F.col("lines") >= rule.group_lines)
    days = keyed.where(can).groupBy(*key, "order_date").count()
    near = Window.partitionBy(*key).orderBy(F.unix_date("order_date")).rangeBetween(-rule.group_days, rule.group_days)
    groups = days.withColumn("alike", F.sum("count").over(near)).where(F.col("alike") >= rule.group_size).select(*key, "order_date", F.lit(True).alias("found"))
    found = keyed.where(can).select("order_id", *key, "order_date").join(groups, [*key, "order_date"]).select("order_id", "found")
    return (
        totals.join(found, "order_id", "left").withColumn("in_group", F.coalesce("found", F.lit(False)))
        .withColumn("is_extreme", F.col("in_group") | (F.col("value") > rule.value))
        .select(*totals.columns, "in_group", "is_extreme")
    )


def with_extremes(base: DataFrame, flags: DataFrame) -> DataFrame:
    """Lines with is_extreme of their order; orders without totals are not extreme."""
    return base.join(flags.select("order_id", "is_extreme"), "order_id", "left").withColumn("is_extreme", F.coalesce("is_extreme", F.lit(False)))


def product_dimension(products: DataFrame) -> DataFrame:
    """One row for each product id: the latest; of equally late ones the first by name, brand, group and subgroup."""
    one = Window.partitionBy("product_id").orderBy(F.desc_nulls_last("updated"), F.asc_nulls_last("name"), F.asc_nulls_last("brand"), F.asc_nulls_last("grp"), F.asc_nulls_last("subgroup"))
    rows = products.where("product_id is not null").withColumn("product_id", F.col("product_id").cast("string"))
    return rows.withColumn("first", F.row_number().over(one)).where("first = 1").drop("first")


def line_situation(items: DataFrame, orders: DataFrame, valid: DataFrame) -> DataFrame:
    """One row for each order of dated lines: date, value and whether it counts, was taken out, or is not among the orders."""
    totals = items.where("order_date is not null").groupBy("order_id").agg(F.min("order_date").alias("order_date"), F.sum("total_price").alias("value"))
    known = orders.select(F.col("id").alias("order_id")).distinct().withColumn("is_known", F.lit(True))
    good = valid.select("order_id").withColumn("is_valid", F.lit(True))
    label = F.when(F.col("is_valid"), "VALIDO").when(F.col("is_known"), "REMOVIDO_STATUS_OU_TESTE").otherwise("FORA_DA_BASE_B2C")
    return totals.join(good, "order_id", "left").join(known, "order_id", "left").select("order_id", "order_date", "value", label.alias("situation"))
