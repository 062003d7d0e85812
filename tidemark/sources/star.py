"""The canonical tables as views over a star schema of orders, line items, parts and customers.

Money is computed in whole cents, so that sums are the same however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, region); a nation stands for a state."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("state"), F.col("r_name").alias("region"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent and high priority orders stand for those with a professional."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_custkey")).alias("professional_id"),
        F.col("o_custkey").alias("customer_id"), F.lit(None).cast("string").alias("email"), F.col("n_name").alias("state"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    units = F.col("l_quantity").cast("long")
    rows = lines.select("*", units.alias("units"), F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)").alias("list_cents"))
    rows = rows.withColumn("unit_cents", F.expr("(list_cents * (100 - cast(round(l_discount * 100) as bigint))) div 100"))
    money = lambda c: (c.cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)")
    return rows.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").cast("string").alias("product_id"), "units", money(F.col("list_cents")).alias("list_price"), money(F.col("unit_cents")).alias("unit_price"),
        money(F.col("unit_cents") * F.col("units")).alias("total_price"), F.when(F.col("l_returnflag") == "A", "1P").when(F.col("l_returnflag") == "R", "3P").alias("origin"),
        F.col("l_shipdate").cast("date").alias("order_date"), F.col("l_linenumber").alias("updated"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("grp"),
        F.concat("p_type", F.lit("/"), F.floor((F.col("p_size") - 1) / 10).cast("string")).alias("subgroup"), F.lit(None).cast("timestamp").alias("updated"),
    )
