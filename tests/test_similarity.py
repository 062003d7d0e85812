from datetime import date as D_
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import neighbours as N
from tidemark.operators import similarity as S
from tidemark.plans import dashboard as D
from tidemark.sources.bucketed import bucketed


def frame(spark, x, fold=None):
    rows = [(f"p{i:02d}", *map(float, v), int(i % 3 if fold is None else fold[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "item string, a double, b double, fold int")


def brute(x, k, apart):
    out = set()
    for i, p in enumerate(x):
        near = sorted((np.sqrt(((p - q) ** 2).sum()), j) for j, q in enumerate(x) if apart[i] != apart[j])[:k]
        out |= {(f"p{i:02d}", f"p{j:02d}", r + 1) for r, (_, j) in enumerate(near)}
    return out


def test_neighbours_equal_brute_force_with_ties(spark):
    x = np.random.default_rng(0).integers(0, 6, (60, 2)).astype(float)  # many ties
    got = {(r["item"], r.neighbour, r["rank"]) for r in S.knn_neighbours(frame(spark, x), ["a", "b"], 4).collect()}
    spread = np.random.default_rng(1).normal(size=(60, 2))
    assert {(i, r) for i, _, r in got} == {(f"p{i:02d}", r) for i in range(60) for r in range(1, 5)}
    exact = {(r["item"], r.neighbour, r["rank"]) for r in S.knn_neighbours(frame(spark, spread), ["a", "b"], 4).collect()}
    assert exact == brute(spread, 4, range(60))
    apart = {(r["item"], r.neighbour, r["rank"]) for r in S.knn_neighbours(frame(spark, spread), ["a", "b"], 4, apart="fold").collect()}
    assert apart == brute(spread, 4, [i % 3 for i in range(60)])
    assert S.knn_neighbours(frame(spark, spread[:2]), ["a", "b"], 4).count() == 2


def test_neighbours_are_exact_at_every_size(spark):
    x = np.random.default_rng(3).normal(scale=20, size=(60, 2))  # nearly all pairs are further apart than 1
    for block in (7, 1000):
        got = {(r["item"], r.neighbour, r["rank"]) for r in S.knn_neighbours(frame(spark, x), ["a", "b"], 4, block).collect()}
        assert got == brute(x, 4, range(60))


def test_ties_at_the_borders_of_cells_and_repeats(spark):
    x = np.array([(i % 8, i // 8) for i in range(64)], float)  # a grid: every border is a tie
    x[50:] = x[49]  # a cell of equal items, more than a block
    names = [f"p{i:02d}" for i in range(64)]
    want = {}
    for i in range(64):
        near = sorted((np.sqrt(((x[i] - x[j]) ** 2).sum()), names[j]) for j in range(64) if j != i)[:5]
        want[names[i]] = [(n, round(d, 9)) for d, n in near]
    got = {}
    for r in sorted(S.knn_neighbours(frame(spark, x), ["a", "b"], 5, 6).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["item"], []).append((r.neighbour, round(r.distance, 9)))
    assert got == want


def test_only_near_cells_are_asked_again(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(scale=50, size=(20, 2))
    x = centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, 2))
    rows = frame(spark, x).selectExpr("item", "item AS apart", "array(a, b) AS x").withColumn("item", F.monotonically_increasing_id().cast("string")).withColumn("apart", F.col("item"))
    placed, pivots = N.placed_items(rows, 2, 30)
    found = N._met(placed, placed, 5, 2, 30)
    assert len(pivots) == 20 and N.cells_in_reach(placed, found, pivots, 5, 2).count() < 0.25 * 600 * 19
    odd = spark.createDataFrame([("a", None, 1.0), ("b", float("nan"), 1.0), ("c", 1.0, 1.0)], "item string, a double, b double")
    assert S.knn_neighbours(odd, ["a", "b"]).count() == 0 and S.knn_neighbours(odd.where("false"), ["a", "b"]).count() == 0


def test_few_cells_are_asked_again_without_clusters(spark):
    x = np.random.default_rng(8).normal(size=(2400, 5))
    df = spark.createDataFrame([(f"p{i:04d}", *map(float, v)) for i, v in enumerate(x)], "item string, a double, b double, c double, d double, e double")
    rows = df.select("item", F.col("item").alias("apart"), F.array(*"abcde").alias("x"))
    placed, cells = N.placed_items(rows, 5, 150)
    assert N.cells_in_reach(placed, N._met(placed, placed, 5, 5, 150), cells, 5, 5).count() < 0.5 * 2400 * 15  # 0.75 with cells around pivots
    got = S.knn_neighbours(df, list("abcde"), 5, 150).toPandas().sort_values(["item", "rank"])
    d = np.sqrt(sum((x[:, f, None] - x[:, f]) ** 2 for f in range(5))) + np.diag(np.full(2400, np.inf))
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert (got.neighbour.to_numpy().reshape(-1, 5) == np.array([f"p{i:04d}" for i in range(2400)])[order]).all()
    assert (got.distance.to_numpy().reshape(-1, 5) == np.take_along_axis(d, order, 1)).all()


def test_nearest_in_a_task_with_copies_kinds_and_limits():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 4))
    x[500:900], x[900:1200] = x[0], np.round(x[900:1200])  # more copies than a leaf holds, and ties
    for kind in (np.arange(1500), np.arange(1500) % 4):
        d = np.sqrt(sum((x[:, f, None] - x[:, f]) ** 2 for f in range(4)))
        d[kind[:, None] == kind] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :5]
        for limit in (np.inf, 0.4):
            want = np.take_along_axis(np.where(d <= limit, d, np.inf), order, 1)
            best, place = N.nearest(x, kind, np.full(1500, limit), x, kind, 5)
            assert (best == want).all() and (place == order)[np.isfinite(want)].all()


def test_features_of_a_cube_stored_by_product_need_no_exchange(spark):
    rows = [(f"p{i % 40}", D_(2023, 1, 2) + timedelta(weeks=i % 30), "COM_X", i % 7 + 1, float(i), float(i) + 1) for i in range(900)]
    cube = spark.createDataFrame(rows, "product_id string, week date, channel string, units long, revenue double, list_revenue double")
    table, _ = bucketed(cube, "product_id", 4)
    got = S.product_features(table, fill=False)
    assert "hashpartitioning(item" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["item"]: (r.units, r.cv) for r in got.collect()}.keys() == {f"p{i}" for i in range(40)}


def test_profile_is_of_active_products_from_the_start_with_curves(spark):
    weeks = [D_(2023, 1, 2) + timedelta(weeks=k) for k in range(60)]
    units = {"up": lambda k: 10 + k, "up too": lambda k: 20 + 2 * k, "down": lambda k: 100 - k, "down too": lambda k: 60 - k, "few": lambda k: 5 if k > 50 else 0, "old": lambda k: 9 if k < 20 else 0}
    rows = [(w, p, "COM_X", f(k), float(f(k)), float(f(k))) for k, w in enumerate(weeks) for p, f in units.items() if f(k)]
    cube = spark.createDataFrame(rows, "week date, product_id string, channel string, units long, revenue double, list_revenue double")
    profile = S.similarity_profile(cube, as_of=weeks[-1], start=weeks[20], least_weeks=20)
    assert {r["item"] for r in profile.collect()} == {"up", "up too", "down", "down too"}
    near = {r["item"]: r.neighbour for r in S.knn_neighbours(profile, S.CURVES[:1], 1).collect()}
    assert near == {"up": "up too", "up too": "up", "down": "down too", "down too": "down"}


def test_curves_equal_a_plain_decomposition(spark):
    rng = np.random.default_rng(6)
    months = [D_(2022, 1 + k, 3) for k in range(12)]
    units = rng.integers(1, 50, (15, 12))
    cube = spark.createDataFrame([(m, f"p{i:02d}", int(units[i, k])) for i in range(15) for k, m in enumerate(months)], "week date, product_id string, units long")
    got = np.array([[r[f"curve{j}"] for j in range(1, 5)] for r in S.curve_components(cube).orderBy("item").collect()])
    z = (units - units.mean(1, keepdims=True)) / units.std(1, keepdims=True)
    _, _, v = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = z @ v[:4].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_standardised_columns(spark):
    got = S.standardise(frame(spark, np.array([[1, 5], [2, 5], [3, 5]])), ["a", "b"]).orderBy("item").collect()
    assert np.allclose([r.a for r in got], np.array([-1, 0, 1]) / np.sqrt(2 / 3)) and [r.b for r in got] == [0, 0, 0]


def test_clear_groups_are_consistent_and_found(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    df = frame(spark, x)
    groups = spark.createDataFrame([(f"p{i:02d}", f"g{i // 12}") for i in range(36)], "item string, grp string")
    row = S.catalog_consistency(df, ["a", "b"], groups).first()
    assert row.accuracy == 1.0 and row["items"] == 36 and abs(row.chance - 1 / 3) < 1e-9
    clusters, profile = S.kmeans_profiles(df, ["a", "b"], range(3, 5))
    assert profile.count() == 3 and {r["count"] for r in clusters.groupBy("cluster").count().collect()} == {12}


def test_consistency_equals_a_plain_vote(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 2))
    of = {f"p{i:02d}": "abc"[int(rng.integers(0, 3))] for i in range(38)} | {"p38": "tiny", "p39": "tiny"}
    df = frame(spark, x)
    groups = spark.createDataFrame(list(of.items()), "item string, grp string")
    row = S.catalog_consistency(df, ["a", "b"], groups, k=3, folds=4).first()
    hashed = {r["item"]: r.h for r in df.select("item", F.xxhash64("item").alias("h")).collect()}
    kept = [i for i in of if of[i] != "tiny"]  # groups of fewer than three are left out
    fold = {i: (r + 1) % 4 for g in "abc" for r, i in enumerate(sorted((i for i in kept if of[i] == g), key=lambda i: (hashed[i], i)))}
    right = 0
    for i in kept:
        near = sorted((np.sqrt(((x[int(i[1:])] - x[int(j[1:])]) ** 2).sum()), j) for j in kept if fold[j] != fold[i])[:3]
        votes = {}
        for d, j in near:
            n, least = votes.get(of[j], (0, np.inf))
            votes[of[j]] = (n + 1, min(least, d))
        right += min(votes, key=lambda g: (-votes[g][0], votes[g][1], g)) == of[i]
    assert row["items"] == len(kept) and abs(row.accuracy - right / len(kept)) < 1e-9
    assert abs(row.chance - sum((sum(of[i] == g for i in kept) / len(kept)) ** 2 for g in "abc")) < 1e-9


def test_brands_alike_in_features_and_mix_are_one_cluster(spark):
    rows = [(f"b{i}", g, 1.0 + (i % 2), 0.1, None if i == 0 else 0.5, 0.0, s) for i in range(8) for g, s in (("x", 0.9), ("y", 0.1)) if i % 2 or g == "x"]
    profile = spark.createDataFrame(rows, "brand string, grp string, log_price double, discount double, professional_share double, trend double, mix_share double")
    got = S.brand_clusters(profile, 2).collect()
    of = {r.brand: r.cluster for r in got}
    assert len(got) == 8 and len({of[f"b{i}"] for i in range(0, 8, 2)}) == 1 and len(set(of.values())) == 2
    assert next(r.mix for r in got if r.brand == "b2") == {"x": 0.9, "y": 0.0}
    assert S.brand_clusters(profile.where("brand in ('b1', 'b2')"), 2).count() == 0 and S.brand_clusters(profile.where("false"), 2).count() == 0


def test_document_of_sections(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", None)], "k string, v double")
    got = D.dashboard_document({"x": D.as_list(df, "k", "x"), "y": D.as_map(df, "k", df["v"], "y")}).first().json
    assert got == '{"x":[{"k":"a","v":null},{"k":"b","v":2.0}],"y":{"a":null,"b":2.0}}'
