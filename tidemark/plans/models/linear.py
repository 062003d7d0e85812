"""Ridge regressions of many groups at once: sums of products by one aggregate, then a small solve over arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, then) -> Column:
    """then(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), then), 0)


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def normal_sums(rows: DataFrame, keys: Sequence[str], size: int, x: str = "x", y: str = "z") -> DataFrame:
    """(keys, term, products, target): row `term` of X'X as an array of `size` sums, and X'y there. Series of any length sum up in parts."""
    long = rows.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.posexplode(F.col(x)).alias("term", "_v"))
    sums = [F.sum(F.col("_v") * F.get(F.col("_x"), F.lit(j))).alias(f"_s{j}") for j in range(size)]
    return long.groupBy(*keys, "term").agg(*sums, F.sum(F.col("_v") * F.col("_y")).alias("target")).select(*keys, "term", F.array(*[f"_s{j}" for j in range(size)]).alias("products"), "target")


def solved(matrix: Column, size: int) -> Column:
    """The solution of a symmetric positive system whose rows carry their right-hand side at the end, by elimination."""

    def step(m: Column, k: Column) -> Column:
        pivot = F.transform(F.get(m, k), lambda v: v / F.get(F.get(m, k), k))
        clear = lambda p: F.transform(m, lambda row, i: F.when(i == k, p).otherwise(F.zip_with(row, p, lambda a, b: a - F.get(row, k) * b)))
        return bound(pivot, clear)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def ridge(rows: DataFrame, keys: Sequence[str], strength: Sequence[float], x: str = "x", y: str = "z") -> DataFrame:
    """(keys, w): weights of least squares of y on the array x by group, `strength` of each weight's square added."""
    size = len(strength)
    held = F.array(*[F.lit(float(s)) for s in strength])
    gathered = normal_sums(rows, keys, size, x, y).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("term", "products", "target"))).alias("m"))
    row = lambda r: F.concat(F.transform(r["products"], lambda v, j: F.when(j == r["term"], v + F.get(held, j)).otherwise(v)), F.array(r["target"]))
    return gathered.select(*keys, solved(F.transform("m", row), size).alias("w"))
