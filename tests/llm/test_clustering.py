"""Centroid clustering against plain rounds in Python's integers; the bound against sampled points of spheres."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clustering


def plain_rounds(rows, k=16, rounds=3):
    """rows: (id, list of ints)."""
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in rows)
    centres = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in rows]

    for _ in range(rounds):
        to = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(rows, to, strict=True) if c == n]
            if own:
                centres[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted((i is None, i or 0, c, d) for (i, _), (d, c) in zip(rows, assign(), strict=True)), centres


def vectors(n, size, seed, spread):
    rng = np.random.default_rng(seed)
    means = rng.normal(0, spread, (12, size))
    return (means[rng.integers(0, 12, n)] + rng.normal(0, 0.3, (n, size))).astype(np.float32)


@pytest.mark.parametrize("spread", [0.1, 1.5])
def test_equals_plain_rounds_and_spares_scans(spark, spread):
    x = vectors(600, 8, 3, spread)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[9].tolist()), (7, x[7].tolist()), (None, x[1].tolist()), (None, x[2].tolist())]
    odd = [(901, None), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [1.0] * 7 + [float("nan")]), (905, [1.0] * 7 + [float("inf")]), (906, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"x": F.lit("c"), "cluster": F.lit(9), "scanned": F.lit(1), "id": F.lit("i")})
    got, centres, told = clustering.clusters(df.repartition(5), size=8, rounds=5)
    want, want_centres = plain_rounds([(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows], rounds=5)
    assert sorted((r.id is None, r.id or 0, r.cluster, r.distance) for r in got.collect()) == want
    assert centres == want_centres
    assert told[0]["scanned"] == told[0]["rows"] == len(rows)
    assert sum(t["scanned"] for t in told[1:]) < (0.6 if spread > 1 else 1.0) * sum(t["rows"] for t in told[1:])
    full = clustering.with_inertia(got, centres).collect()
    for r in full:
        assert r.inertia == sum(w[3] for w in want) and r.cluster_inertia == sum(w[3] for w in want if w[2] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_ties_few_vectors_and_none(spark):
    same = [(i, [0.5, -0.01]) for i in range(30)] + [(99, [0.25, 0.0])]
    got, centres, _ = clustering.clusters(spark.createDataFrame(same, "vec_id long, embedding array<double>"), k=16, size=2)
    want, want_centres = plain_rounds([(i, [math.floor(64 * c) for c in v]) for i, v in same])
    assert sorted((r.id is None, r.id, r.cluster, r.distance) for r in got.collect()) == want and centres == want_centres
    two, _, _ = clustering.clusters(spark.createDataFrame(same[-2:], "vec_id long, embedding array<double>"), size=2)
    assert sorted((r.id, r.distance) for r in two.collect()) == [(29, 0), (99, 0)]
    none, centres, _ = clustering.clusters(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert none.count() == 0 and centres == [] and clustering.with_inertia(none, centres).count() == 0


def test_bound_holds_for_points_of_the_sphere_and_is_less_than_the_move():
    rng = np.random.default_rng(0)
    less = 0
    for _ in range(300):
        size = int(rng.integers(2, 6))
        a = rng.normal(0, 3, (3, size))
        b = a + rng.normal(0, rng.choice([0.1, 2.0]), (3, size))
        radius = rng.uniform(0, 2, 3)
        bound = clustering.nearer(a, b, radius)
        for i in range(3):
            away = rng.normal(size=(2000, size))
            points = a[i] + radius[i] * away / np.linalg.norm(away, axis=1, keepdims=True) * rng.uniform(0, 1, (2000, 1)) ** 0.2
            others = [j for j in range(3) if j != i]
            gain = max((np.linalg.norm(points - a[j], axis=1) - np.linalg.norm(points - b[j], axis=1)).max() for j in others)
            full = max(np.linalg.norm(b[j] - a[j]) for j in others)
            assert gain <= bound[i] + 1e-9 <= full + 2e-9
            less += bound[i] < 0.9 * full
    assert less > 300
