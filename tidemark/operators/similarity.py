"""How alike products are: features, neighbours, clusters, and whether the catalogue's groups agree with them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ratio
from tidemark.operators.cubes import active_products
from tidemark.operators.neighbours import knn_neighbours
from tidemark.sources.bucketed import bucketed, stored
from tidemark.sources.stages import settle

FEATURES = ("log_price", "discount", "professional_share", "trend", "cv", "q1", "q2", "q3", "q4")
CURVES = ("curve1", "curve2", "curve3", "curve4")


def product_features(cube: DataFrame, item: str = "product_id", as_of: date | None = None, fill: bool = True) -> DataFrame:
    """(item, FEATURES, units): price, discount, share sold with a professional, trend of the last 13 weeks, variation, quarters.

    fill: a feature that an item lacks gets the median of those that have it.
    """
    rows = cube.where(F.col("week") < F.lit(as_of)) if as_of else cube
    number = lambda c: F.col(c).cast("double")
    weeks = rows.groupBy(F.col(item).alias("item"), "week").agg(*[F.sum(number(m)).alias(m) for m in ("units", "revenue", "list_revenue")], F.sum(F.when(F.col("channel").startswith("COM_"), number("revenue")).otherwise(0.0)).alias("with_professional"))
    span = weeks.agg(F.max("week").alias("last"), (F.datediff(F.max("week"), F.min("week")) / 7 + 1).alias("n"))
    at = weeks.crossJoin(F.broadcast(span))  # one row
    part = lambda lo, hi: F.sum(F.when((F.col("week") > F.date_sub("last", 7 * lo)) & (F.col("week") <= F.date_sub("last", 7 * hi)), F.col("units")).otherwise(0.0))
    quarter = lambda q: ratio(F.sum(F.when(F.quarter("week") == q, F.col("units")).otherwise(0.0)), F.sum("units")).alias(f"q{q}")
    got = at.groupBy("item", "n").agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue"), F.sum("list_revenue").alias("list_revenue"), F.sum("with_professional").alias("with_professional"),
        F.sum(F.col("units") * F.col("units")).alias("squares"), part(13, 0).alias("now"), part(26, 13).alias("before"), *[quarter(q) for q in (1, 2, 3, 4)],
    )
    mean = F.col("units") / F.col("n")
    std = F.sqrt(F.greatest(F.try_divide(F.col("squares") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)))
    price = ratio(F.col("revenue"), F.col("units"))
    out = got.select(
        "item", F.when(price > 0, F.log(price)).alias("log_price"), (1 - ratio(F.col("revenue"), F.col("list_revenue"))).alias("discount"), ratio(F.col("with_professional"), F.col("revenue")).alias("professional_share"),
        (F.log1p("now") - F.log1p("before")).alias("trend"), ratio(std, mean).alias("cv"), "q1", "q2", "q3", "q4", "units",
    )
    return fill_medians(out, FEATURES) if fill else out


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    medians = df.agg(*[F.percentile(c, F.lit(0.5)).alias(f"{c}_median") for c in columns])
    rows = df.crossJoin(F.broadcast(medians))  # one row
    return rows.select(*[F.coalesce(c, f"{c}_median", F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their population deviation; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])
    rows = df.crossJoin(F.broadcast(stats))  # one row
    z = lambda c: F.when(F.col(f"{c}_std") > 1e-12, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(0.0).alias(c)
    return rows.select(*[z(c) if c in columns else F.col(c) for c in df.columns])


def curve_components(cube: DataFrame, item: str = "product_id", components: int = 4) -> DataFrame:
    """(item, curve1, ...): principal components of each item's standardised monthly units. Signs are arbitrary; no items, no components."""
    monthly = cube.groupBy(F.col(item).alias("item"), F.trunc("week", "month").alias("week")).agg(F.sum(F.col("units").cast("double")).alias("units"))
    months = [r.week for r in monthly.select("week").distinct().orderBy("week").collect()]  # a row a month
    wide = monthly.groupBy("item").pivot("week", months).agg(F.first("units")).na.fill(0.0)
    names = [f"m{i}" for i in range(len(months))]
    wide = wide.toDF("item", *names)
    values = F.array(*names)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(names)
    rows = wide.withColumn("mean", mean).withColumn("std", F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / len(names) - F.col("mean") * F.col("mean")))
    scaled = rows.select("item", *[F.coalesce(F.try_divide(F.col(n) - F.col("mean"), F.when(F.col("std") > 1e-9, F.col("std"))), F.lit(0.0)).alias(n) for n in names])
    k = min(components, len(names))
    if not k:
        return scaled.select("item")
    vectors = stored(VectorAssembler(inputCols=names, outputCol="v").transform(scaled).select("item", "v"))  # several passes read it
    got = PCA(k=k, inputCol="v", outputCol="p").fit(vectors).transform(vectors)
    return got.select("item", *[vector_to_array("p")[i].alias(f"curve{i + 1}") for i in range(k)])


def similarity_profile(cube: DataFrame, as_of: date | None = None, start: date | None = None, least_weeks: int = 20) -> DataFrame:
    """(item, FEATURES, CURVES), standardised: what neighbours of products are found on. Products that sold in at least `least_weeks`
    weeks from `start` on and before `as_of`, by those weeks only; gaps get the median. Signs of curves are arbitrary, distances are not."""
    rows = cube.where(F.col("week") >= F.lit(start)) if start else cube
    rows = rows.where(F.col("week") < F.lit(as_of)) if as_of else rows
    rows = bucketed(rows.join(active_products(rows, least_weeks).select("product_id"), "product_id", "left_semi"), "product_id", dealt=True)[0]
    curves = curve_components(rows, "product_id", len(CURVES))
    curves = curves.withColumns({c: F.lit(0.0) for c in CURVES if c not in curves.columns})
    return standardise(product_features(rows).join(curves, "item"), [*FEATURES, *CURVES])


def with_group_flags(neighbours: DataFrame, attributes: DataFrame) -> DataFrame:
    """neighbours with same_group and same_brand; attributes: (item, grp, brand)."""
    a, b = attributes.toDF("item", "grp", "brand"), attributes.toDF("neighbour", "other_grp", "other_brand")
    return neighbours.join(a, "item").join(b, "neighbour").select("item", "neighbour", "distance", "rank", (F.col("grp") == F.col("other_grp")).alias("same_group"), (F.col("brand") == F.col("other_brand")).alias("same_brand"))


def catalog_consistency(features: DataFrame, columns: Sequence[str], groups: DataFrame, k: int = 3, folds: int = 5) -> DataFrame:
    """One row: how often the k nearest items of other folds vote for an item's own group, and how often chance would.

    Groups of fewer than three items are left out. Folds go by rank of a hash within each group, so all groups are in all.
    """
    of = groups.toDF("item", "grp")
    sizes = of.groupBy("grp").count().where("count >= 3")
    kept = of.join(sizes.select("grp"), "grp", "left_semi").select("item", "grp")
    fold = F.pmod(F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("item"), "item")), F.lit(folds))
    folded = kept.withColumn("fold", fold)
    near = knn_neighbours(features.select("item", *columns).join(folded, "item"), columns, k, apart="fold")
    own, vote = kept.toDF("item", "own"), kept.toDF("neighbour", "vote")
    top = near.join(vote, "neighbour").join(own, "item")  # by item last: votes are counted and ranked where they lie
    votes = top.groupBy("item", "own", "vote").agg(F.count("*").alias("n"), F.min("distance").alias("d"))
    won = votes.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "d", "vote"))).where("place = 1")
    shares = kept.groupBy("grp").count().withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy())).agg(F.sum(F.col("p") * F.col("p")).alias("chance"))  # a row a group
    return won.agg(F.avg((F.col("own") == F.col("vote")).cast("double")).alias("accuracy"), F.count("*").alias("items")).crossJoin(F.broadcast(shares))


def kmeans_profiles(features: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(3, 9), seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((item, cluster), (cluster, items, mean of each feature, examples)) with the number of clusters of the best silhouette
    (squared Euclidean)."""
    vectors = settle(VectorAssembler(inputCols=list(columns), outputCol="v").transform(features))
    judge = ClusteringEvaluator(featuresCol="v", predictionCol="cluster")
    best = max(((judge.evaluate(got), -k, got) for k in ks for got in [KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(vectors).transform(vectors)]), key=lambda t: t[:2])[2]
    profile = best.groupBy("cluster").agg(F.count("*").alias("items"), *[F.avg(c).alias(c) for c in columns], F.slice(F.sort_array(F.collect_set("item")), 1, 3).alias("examples"))
    return best.select("item", "cluster"), profile


def brand_profile(features: DataFrame, attributes: DataFrame, columns: Sequence[str] = ("log_price", "discount", "professional_share", "trend")) -> DataFrame:
    """Features of brands, weighted by units, and the share of each group in a brand's units (one row a brand and group).

    attributes: (item, brand, grp).
    """
    w = F.col("units") + 1e-9
    rows = features.join(attributes.toDF("item", "brand", "grp"), "item")
    means = rows.groupBy("brand").agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in columns], F.sum("units").alias("all_units"))
    mix = rows.groupBy("brand", "grp").agg(F.sum("units").alias("units"))
    return mix.join(means, "brand").select("brand", "grp", *columns, ratio(F.col("units"), F.col("all_units")).alias("mix_share"))


def brand_clusters(profile: DataFrame, k: int, columns: Sequence[str] = ("log_price", "discount", "professional_share", "trend"), seed: int = 7, least: int = 4) -> DataFrame:
    """(brand, cluster, columns, mix) of brand_profile()'s brands, grouped by their features and shares of groups, all standardised.

    mix: share by group, 0 where a brand has none of it. At most one cluster fewer than there are brands; with fewer than `least` brands no
    rows. A brand without a feature has the median.
    """
    groups = [r.grp for r in profile.select("grp").distinct().orderBy("grp").collect()]  # a row a group of the catalogue
    names = [f"mix{i}" for i in range(len(groups))]
    wide = profile.groupBy("brand", *columns).pivot("grp", groups).agg(F.first("mix_share")).toDF("brand", *columns, *names).na.fill(0.0, names)
    wide = settle(fill_medians(wide, columns))
    brands = wide.count()
    mix = F.map_from_arrays(F.array(*[F.lit(g) for g in groups]), F.array(*names)) if groups else F.create_map().cast("map<string,double>")
    plain = wide.select("brand", *columns, mix.alias("mix"))
    if brands < least:
        return plain.select("brand", F.lit(0).alias("cluster"), *columns, "mix").limit(0)
    features = [*columns, *names]
    vectors = VectorAssembler(inputCols=features, outputCol="v").transform(standardise(wide, features)).select("brand", "v")
    found = KMeans(k=max(2, min(k, brands - 1)), seed=seed, featuresCol="v", predictionCol="cluster").fit(vectors).transform(vectors)
    return plain.join(found.select("brand", "cluster"), "brand").select("brand", "cluster", *columns, "mix")
