"""Centroid clustering in exact integers, with bounds that spare most vectors most distances.

Every vector carries the distance to its own centroid and a lower bound on that to any other. When centroids move, all vectors of a cluster lie
in a sphere about its old centroid; for each other centroid, plane geometry over that sphere and the two ends of the move
says how much nearer the centroid can have come to any point of it, which is less than the full move unless the sphere lies
right in its way. The bound is loosened by the most of these. Vectors whose bounds no longer tell are compared with all
centroids in integers. Sums by cluster are an aggregate; only the centroids and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remove, shared_dir

#: Integer components are held within this, so that squared distances of thousands of components fit a long.
MOST = 1 << 24
#: What rounding of a bound may amount to, relative and absolute; far beyond what doubles lose.
SLACK = 1e-9


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has exactly `size` components, none null or non-finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & good, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, the product as a double; beyond MOST it stays at MOST."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-MOST)), F.lit(MOST)).cast("int"))


def nearer(centres: np.ndarray, moved: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much any other centroid can have come nearer to a point of its sphere (its old centre, its radius).

    For a centroid that went from a to b let the origin be their midpoint, y along the move and x across it, in the plane of
    both and the sphere's centre; the sphere's rim there is a circle. What a point at (x, y) gains is the difference of its distances to two foci: it is
    at most twice y, and at most |b - a| times the sine of the point's angle over the x axis, as hyperbolas lie inside their asymptotes.
    Points below the x axis gain nothing. The greatest angle of the circle is that of its tangent from the origin.
    """
    k = len(centres)
    out = np.zeros(k)
    for j in range(k):
        way = moved[j] - centres[j]
        far = float(np.sqrt(way @ way))
        if not far:
            continue
        rel = centres - (centres[j] + moved[j]) / 2
        y = rel @ way / far
        x = np.sqrt(np.maximum((rel * rel).sum(1) - y * y, 0))
        away = np.hypot(x, y)
        outside = (away > radius) & (x > radius)  # else the circle meets the y axis
        reach = np.where(outside, np.sqrt(np.maximum(away**2 - radius**2, 0)), 1)
        sine = np.where(outside, (y * reach + x * radius) / np.maximum(away, 1e-300) ** 2, 1)
        gain = np.minimum(far * np.clip(sine, 0, 1), np.clip(2 * (y + radius), 0, far))
        out = np.maximum(out, np.where(np.arange(k) == j, 0, gain))
    return out


def exactly(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, its squared distance, squared distance to the next), in integers; ties to the smaller number."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
    best = d.argmin(1)
    rows = np.arange(len(x))
    least = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    return best, least, d.min(1)


def settle_vectors(x: np.ndarray, own: np.ndarray, lower: np.ndarray, centres: np.ndarray, loosened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, lower bound, whether scanned): vectors whose own centroid is nearer than the loosened bound stay, others
    are scanned. A cluster of -1 means none yet."""
    cluster, square = own.copy(), np.zeros(len(x), np.int64)
    known = own >= 0
    square[known] = ((x[known] - centres[own[known]]) ** 2).sum(1)
    low = np.where(known, lower - loosened[own] - SLACK * (1 + np.abs(lower)), -1.0)
    scan = np.sqrt(square.astype(float)) * (1 + SLACK) + SLACK >= low
    if scan.any():
        best, least, second = exactly(x[scan], centres)
        cluster[scan], square[scan], low[scan] = best, least, np.sqrt(second.astype(float)) * (1 - SLACK)
    return cluster, square, low, scan


def starts(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`, in that order. Of rows that share an id the smaller vector comes
    first; null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    got = kept.select("x", order.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r.x for r in got], np.int64)


def clusters(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]], list[dict]]:
    """(rows, centroids, rounds' figures). rows: (id, cluster, distance) for every usable vector, distance squared, in units of 1 / scale.

    Vectors that are null, of another size, or hold null or non-finite components take no part. Rows that repeat an id, null
    ids too, are vectors of their own. With fewer than k vectors each starts a centroid; equal ones tie and the smaller number wins, the other
    stays empty and where it was. No vectors, no rows and no centroids. The figures tell, by round, rows and how many were scanned.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"

    def settled(state: DataFrame, n: int) -> DataFrame:
        state.write.parquet(f"{folder}/{n}")
        return spark.read.schema(state.schema).parquet(f"{folder}/{n}")

    vector = F.col(vector_col)
    state = settled(df.where(usable(vector, size)).select(F.col(id_col).alias("id"), integers(vector, scale).alias("x"), F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(-1.0).alias("lower"), F.lit(True).alias("scanned")), 0)
    centres = starts(state, k, seed)
    told: list[dict] = []
    if not len(centres):
        return state.select("id", "cluster", "distance"), [], told
    loosened = np.zeros(len(centres))
    for n in range(1, rounds + 2):
        state = settled(assigned(state, centres, loosened), n)
        remove(spark, f"{folder}/{n - 1}")
        if n > rounds:
            break
        wide = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size)]
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.count_if("scanned").alias("scanned"), *wide).collect()
        told.append({"rows": sum(r.n for r in sums), "scanned": sum(r.scanned for r in sums)})
        moved, radius = centres.copy(), np.zeros(len(centres))
        for r in sums:
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
            radius[r.cluster] = np.sqrt(float(r.far)) * (1 + SLACK)
        loosened = nearer(centres.astype(float), moved.astype(float), radius) * (1 + SLACK) + SLACK
        centres = moved
    return state.select("id", "cluster", "distance"), centres.tolist(), told


def assigned(state: DataFrame, centres: np.ndarray, loosened: np.ndarray) -> DataFrame:
    """The state with every vector at its nearest centroid; ids pass through as they are, in batches of Arrow rows."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists, own, lower = b.column(1), b.column(2).to_numpy(), b.column(4).to_numpy()
            x = lists.flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)
            got = settle_vectors(x, own.astype(np.int64), lower, centres, loosened)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(got[0].astype(np.int32)), pa.array(got[1]), pa.array(got[2]), pa.array(got[3])], names=b.schema.names)

    return state.mapInArrow(run, state.schema)


def with_inertia(rows: DataFrame, centres: list[list[int]]) -> DataFrame:
    """rows of `clusters` with cluster_inertia, inertia and centroid_sha256. Sums by cluster, k of them, are looked up in a map."""
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    sha = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centres)}
    table = rows.sparkSession.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), sha[c]) for c in sha], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster")
