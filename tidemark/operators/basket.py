"""Which products are bought together."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ratio


def top_basket_products(lines: DataFrame, as_of: date, days: int = 365, top: int = 150) -> DataFrame:
    """The products with most revenue in the window, extreme orders among it; ties go to the smaller id."""
    recent = lines.where((F.col("order_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("order_date") < F.lit(as_of)))
    return recent.groupBy("product_id").agg(F.sum("total_price").alias("revenue")).orderBy(F.desc("revenue"), "product_id").limit(top).select("product_id")


def basket_pairs(lines: DataFrame, as_of: date, days: int = 365, top: int = 150, max_products: int | None = None) -> DataFrame:
    """(product_a < product_b, together, orders_a, orders_b, total_orders) over orders of the window that are not extreme.

    Each order's products are gathered once and its pairs made from them, so pairs need no self-join. Extreme orders,
    the very large ones, are out and products are among the top only, which bounds a basket; max_products can leave out larger
    baskets, off by default. The total counts all orders of the window.
    """
    recent = lines.where((F.col("order_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("order_date") < F.lit(as_of)) & ~F.col("is_extreme"))
    distinct = recent.select("order_id", "product_id").distinct()
    among = distinct.join(F.broadcast(top_basket_products(lines, as_of, days, top)), "product_id", "left_semi")  # at most `top` rows
    baskets = among.groupBy("order_id").agg(F.sort_array(F.collect_set("product_id")).alias("products"))
    baskets = baskets.where(F.size("products") <= max_products) if max_products else baskets
    pairs = F.flatten(F.transform("products", lambda a, i: F.transform(F.slice("products", i + 2, F.size("products")), lambda b: F.struct(a.alias("product_a"), b.alias("product_b")))))
    together = baskets.select(F.explode(pairs).alias("pair")).groupBy("pair.product_a", "pair.product_b").agg(F.count("*").alias("together"))
    single = among.groupBy("product_id").agg(F.count("*").alias("n"))
    total = distinct.agg(F.count_distinct("order_id").alias("total_orders"))
    return (
        together.join(F.broadcast(single.toDF("product_a", "orders_a")), "product_a").join(F.broadcast(single.toDF("product_b", "orders_b")), "product_b")  # at most `top` rows
        .crossJoin(F.broadcast(total)).select("product_a", "product_b", "together", "orders_a", "orders_b", "total_orders")  # one row
    )


def basket_lift(pairs: DataFrame, least: int | None = None) -> DataFrame:
    """How many times as often two products meet as they would by chance; least: pairs that met so often at least."""
    rows = pairs.where(F.col("together") >= least) if least else pairs
    return rows.withColumn("lift", ratio(F.col("together").cast("double") * F.col("total_orders"), F.col("orders_a").cast("double") * F.col("orders_b")))
