"""Weekly cubes and the series of every level that are read off them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import change_pct, channel_label, label_missing, pct, product_label, ratio, week_of

PRODUCT_DIMS = ("product_id", "product", "brand", "grp", "subgroup", "channel")
GEO_DIMS = ("channel", "origin", "state", "region")
KINDS = {"product": PRODUCT_DIMS, "geo": GEO_DIMS, "full": (*PRODUCT_DIMS, "origin", "state", "region")}
MEASURES = ("orders", "units", "revenue", "list_revenue")
#: Levels and the dimension of each (None: everything in one series).
LEVELS: dict[str, str | None] = {"Total": None, "Canal": "channel", "Origem": "origin", "Regiao": "region", "UF": "state", "Grupo": "grp", "Subgrupo": "subgroup", "Marca": "brand", "Produto": "product"}
OTHERS = "OUTROS"


def labelled_lines(lines: DataFrame, products: DataFrame, regions: DataFrame) -> DataFrame:
    """Clean lines with the labels of all dimensions; what is missing gets a SEM_ label. Regions are a fixed small table."""
    joined = lines.join(products.drop("updated"), "product_id", "left").join(F.broadcast(regions), "state", "left")
    return joined.select(
        "order_id", "order_date", week_of(F.col("order_date")).alias("week"), "is_extreme", "product_id", product_label(F.col("name"), F.col("product_id")).alias("product"),
        label_missing(F.col("brand"), "SEM_MARCA").alias("brand"), label_missing(F.col("grp"), "SEM_GRUPO").alias("grp"), label_missing(F.col("subgroup"), "SEM_SUBGRUPO").alias("subgroup"),
        channel_label(F.col("has_professional")).alias("channel"), label_missing(F.col("origin"), "SEM_INFO").alias("origin"), label_missing(F.col("state"), "SEM_INFO").alias("state"),
        label_missing(F.col("region"), "SEM_INFO").alias("region"), "units", F.col("total_price").alias("revenue"), (F.coalesce("list_price", "unit_price") * F.col("units")).alias("list_revenue"),
    )


def weekly_cube(labelled: DataFrame, kind: str, as_of: date) -> DataFrame:
    """Week and dimensions of the kind: distinct orders, units, revenue, list revenue of lines before as_of.

    Orders are counted in two steps, by order first; they do not add up over dimensions.
    """
    keys = ["week", *KINDS[kind], "is_extreme"]
    per_order = labelled.where(F.col("order_date") < F.lit(as_of)).groupBy(*keys, "order_id").agg(*[F.sum(m).alias(m) for m in MEASURES[1:]])
    return per_order.groupBy(*keys).agg(F.count("*").alias("orders"), *[F.sum(m).alias(m) for m in MEASURES[1:]])


def aggregate_levels(cube: DataFrame, levels: Mapping[str, str | None] | None = None, measures: Sequence[str] = ("units", "revenue", "list_revenue"), with_extremes: bool = False) -> DataFrame:
    """(level, series, week, measures) of all levels whose dimension the cube has, in one pass with grouping sets."""
    levels = {k: d for k, d in (levels or LEVELS).items() if d is None or d in cube.columns}
    rows = cube if with_extremes else cube.where(~F.col("is_extreme"))
    dims = [d for d in levels.values() if d]
    sets = [["week", d] if d else ["week"] for d in levels.values()]
    got = rows.groupingSets([[F.col(c) for c in s] for s in sets], "week", *dims).agg(*[F.sum(m).alias(m) for m in measures], F.grouping_id("week", *dims).alias("gid"))
    width = len(dims)
    level, series = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, d in levels.items():
        gid = (1 << width) - 1 - (1 << (width - 1 - dims.index(d)) if d else 0)  # a bit is 1 for a dimension left out
        level = F.when(F.col("gid") == gid, name).otherwise(level)
        series = F.when(F.col("gid") == gid, F.col(d) if d else F.lit("Total")).otherwise(series)
    return got.select(level.alias("level"), series.alias("series"), "week", *measures)


def informative_levels(series: DataFrame, least: int = 2) -> DataFrame:
    """Without levels that have fewer than `least` series with a label of their own; Total stays."""
    own = F.count_distinct(F.when(~F.col("series").rlike("^SEM_(INFO|GRUPO|SUBGRUPO|MARCA)"), F.col("series")))
    kept = series.groupBy("level").agg(own.alias("n")).where((F.col("n") >= least) | (F.col("level") == "Total"))
    return series.join(F.broadcast(kept.select("level")), "level", "left_semi")  # a row a level


def week_spine(series: DataFrame, week: str = "week") -> DataFrame:
    """Every Monday from the first to the last; none for an empty table."""
    bounds = series.agg(F.min(week).alias("lo"), F.max(week).alias("hi")).where("lo is not null")
    return bounds.select(F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias(week))


def densify(series: DataFrame, keys: Sequence[str], measures: Sequence[str], week: str = "week") -> DataFrame:
    """Every series with every week, 0 where there was nothing. The spine has a row a week and is broadcast."""
    grid = series.select(*keys).distinct().crossJoin(F.broadcast(week_spine(series, week)))
    return grid.join(series, [*keys, week], "left").select(*keys, week, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def concentration(cube: DataFrame) -> DataFrame:
    """Herfindahl index of each subgroup over products' revenue shares in percent; products, greatest share and who has it."""
    per = cube.groupBy("subgroup", "product_id").agg(F.sum("revenue").alias("revenue"), F.max("product").alias("product"))
    total = per.groupBy("subgroup").agg(F.sum("revenue").alias("total"), F.count("*").alias("products"))
    share = pct(F.col("revenue"), F.col("total"))
    return per.join(total, "subgroup").withColumn("share", share).groupBy("subgroup").agg(
        F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("products").alias("products"), F.max("share").alias("max_share"), F.max_by("product_id", F.struct("share", "product_id")).alias("leader")
    )


def noise_by_level(series: DataFrame) -> DataFrame:
    """Coefficient of variation of weekly revenue, weeks without sales counted as 0, averaged by revenue within each level."""
    weeks = series.agg((F.datediff(F.max("week"), F.min("week")) / 7 + 1).cast("long").alias("n"))
    x = F.col("revenue").cast("double")
    sums = series.groupBy("level", "series").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss")).crossJoin(F.broadcast(weeks))  # one row
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.try_divide(F.col("ss") - F.col("n") * mean * mean, (F.col("n") - 1).cast("double")), F.lit(0.0)))
    cvs = sums.withColumn("cv", ratio(std, mean)).where("cv is not null")
    return cvs.groupBy("level").agg(F.count("*").alias("series"), ratio(F.sum(F.col("cv") * F.col("s")), F.sum("s")).alias("weighted_cv"))


def top_n_plus_others(series: DataFrame, n: Column | int, weeks: int | None = 26, measure: str = "revenue", others: str = OTHERS) -> DataFrame:
    """The n series of each level with most in the last `weeks` (None: in all), the rest summed up as OUTROS; then series with
    nothing in those weeks go. Ties go to the smaller name."""
    n = F.lit(n) if isinstance(n, int) else n
    last = series.agg(F.max("week").alias("last"))
    rows = series.crossJoin(F.broadcast(last))  # one row
    recent = F.when(F.col("week") > F.date_sub("last", 7 * weeks), F.col(measure)).otherwise(0) if weeks else F.col(measure)
    score = rows.groupBy("level", "series").agg(F.sum(recent).alias("score"))
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("score"), "series"))
    named = score.withColumn("kept", F.when(rank <= n, F.col("series")).otherwise(others))
    alive = named.groupBy("level", "kept").agg(F.sum("score").alias("score")).where("score > 0").select("level", "kept")
    joined = series.join(named.select("level", "series", "kept"), ["level", "series"]).join(alive, ["level", "kept"], "left_semi")
    return joined.groupBy("level", F.col("kept").alias("series"), "week").agg(F.sum(measure).alias(measure))


def share_over_total(series: DataFrame, keys: Sequence[str], measure: str = "revenue") -> DataFrame:
    """Each row's share, in percent, of its group's sum."""
    total = series.groupBy(*keys).agg(F.sum(measure).alias("total"))
    return series.join(total, list(keys)).withColumn("share_pct", pct(F.col(measure), F.col("total"))).drop("total")


def top_growth(series: DataFrame, level: str, months: int = 3, n: int = 10, as_of: date | None = None, measure: str = "revenue") -> DataFrame:
    """Series of a level by what they gained in the last complete months against the same months a year before."""
    rows = series.where(F.col("level") == level).withColumn("month", F.trunc("week", "month"))
    last = rows.agg(F.trunc(F.lit(as_of) if as_of else F.date_add(F.max("week"), 7), "month").alias("until"))
    rows = rows.crossJoin(F.broadcast(last))  # one row
    span = lambda back: (F.col("month") >= F.add_months("until", -months - back)) & (F.col("month") < F.add_months("until", -back))
    x = F.col(measure).cast("double")
    sums = rows.groupBy("series").agg(F.sum(F.when(span(0), x).otherwise(0.0)).alias("now"), F.sum(F.when(span(12), x).otherwise(0.0)).alias("before"))
    total = sums.agg(F.sum("now").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select(  # one row
        "series", "now", "before", (F.col("now") - F.col("before")).alias("gain"), change_pct(F.col("now"), F.col("before")).alias("change_pct"), pct(F.col("now"), F.col("total")).alias("share_pct")
    ).orderBy(F.desc("gain"), "series").limit(n)


def product_attributes(cube: DataFrame) -> DataFrame:
    """Name, brand, group and subgroup of each product's best week by revenue; of equal weeks the later."""
    weeks = cube.groupBy("product_id", "week", "product", "brand", "grp", "subgroup").agg(F.sum("revenue").alias("revenue"))
    best = weeks.groupBy("product_id").agg(F.max_by(F.struct("product", "brand", "grp", "subgroup"), F.struct("revenue", "week", "product", "brand", "grp", "subgroup")).alias("a"))
    return best.select("product_id", "a.*")


def catalog_counts(attributes: DataFrame) -> DataFrame:
    return attributes.groupBy("grp", "subgroup").agg(F.count("*").alias("products"))


def active_products(cube: DataFrame, min_weeks: int = 20, start: date | None = None) -> DataFrame:
    """Products that sold in at least `min_weeks` weeks since start."""
    rows = cube.where(F.col("week") >= F.lit(start)) if start else cube
    weeks = rows.groupBy("product_id", "week").agg(F.sum("units").alias("units"))
    return weeks.groupBy("product_id").agg(F.count_if(F.col("units") > 0).alias("weeks")).where(F.col("weeks") >= min_weeks)


def last_complete_week(day: Column) -> Column:
    """The Monday of the last week that is over on the day, which may be its Sunday."""
    return F.date_sub(week_of(F.date_add(day, 1)), 7)
