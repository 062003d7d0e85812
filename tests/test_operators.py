import datetime as dt
import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.config import ExtremeRule, OrderRules
from tidemark.functions import clean_state, region_of_state
from tidemark.operators import basket, calendar, cannibal, cubes, kpis, orders, sketches
from tidemark.queries import products

D = dt.date


def test_valid_orders_filter_rows_before_grouping(spark):
    rows = [(1, "ok", None, 5, None, " sp "), (1, "cancelled", 3, 5, None, "RJ"), (2, "cancelled", 3, 5, None, "SP"), (3, None, 4, None, "me@x", None), (4, "ok", 9, 1, None, "MG"), (None, "ok", 1, 1, None, "SP")]
    df = spark.createDataFrame(rows, "id long, status string, professional_id long, customer_id long, email string, state string")
    got = orders.valid_orders(df, OrderRules(statuses=("cancelled",), professionals=(9,), emails=("you@x",)))
    assert {tuple(r) for r in got.collect()} == {(1, False, "SP"), (3, True, None)}
    assert orders.valid_orders(df.where("false"), OrderRules()).count() == 0


def totals(spark, rows):
    return spark.createDataFrame([(i, d, Decimal(v), n, u) for i, (d, v, n, u) in enumerate(rows)], "order_id long, order_date date, value decimal(18,2), lines long, units long")


def test_extremes_at_the_edges(spark):
    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(day(0), 1000, 2, 5), (day(7), 1000, 2, 5), (day(15), 1000, 2, 5), (day(0), 5000, 1, 1), (day(0), Decimal("5000.01"), 1, 1), (day(0), 999, 2, 3), (day(1), 999, 2, 3), (day(0), 2000, 2, 1), (day(1), 2000, 2, 2)]
    got = orders.flag_extremes(totals(spark, rows), ExtremeRule()).orderBy("order_id").collect()
    assert [(r.in_group, r.is_extreme) for r in got] == [(True, True), (True, True), (False, False), (False, False), (False, True), (False, False), (False, False), (False, False), (False, False)]


def test_extremes_equal_the_plain_window(spark):
    rng = random.Random(4)
    rows = [(D(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 90)), rng.choice([500, 1000, 1500, 6000]), rng.randint(1, 3), rng.randint(1, 2)) for _ in range(400)]
    got = {r.order_id: r.in_group for r in orders.flag_extremes(totals(spark, rows), ExtremeRule()).collect()}
    alike = lambda a, b: a[1:] == b[1:] and abs((a[0] - b[0]).days) <= 7
    assert got == {i: a[1] >= 1000 and a[2] >= 2 and sum(alike(a, b) for b in rows) >= 2 for i, a in enumerate(rows)}


def test_dedup_keeps_the_latest_line(spark):
    rows = [(1, "a", 1, 10.0, "x", 1), (1, "a", 2, 20.0, "y", 2), (1, "a", 3, 30.0, None, 2), (1, "b", 1, 1.0, None, None)]
    got = orders.dedup_items(spark.createDataFrame(rows, "order_id long, product_id string, units long, total_price double, origin string, updated int"))
    assert {(r.product_id, r.units) for r in got.collect()} == {("a", 3), ("b", 1)}


def test_product_dimension_is_unique(spark):
    rows = [("1", "a", None, None, None, dt.datetime(2024, 1, 1)), ("1", "b", None, None, None, dt.datetime(2024, 2, 1)), (None, "c", None, None, None, None)]
    got = orders.product_dimension(spark.createDataFrame(rows, "product_id string, name string, brand string, grp string, subgroup string, updated timestamp"))
    assert [(r.product_id, r.name) for r in got.collect()] == [("1", "b")]


def test_daily_series_fills_days(spark):
    rows = [(1, D(2024, 2, 28), Decimal(10), 2, Decimal(10), False, False), (2, D(2024, 3, 2), Decimal(5), 1, Decimal(10), True, True), (3, D(2024, 3, 9), Decimal(5), 1, Decimal(10), True, True)]
    flags = spark.createDataFrame(rows, "order_id long, order_date date, value decimal(18,2), units long, list_value decimal(18,2), in_group boolean, is_extreme boolean")
    got = kpis.daily_series(flags, D(2024, 3, 4)).orderBy("ds").collect()
    assert [(r.ds.day, r.orders, r.revenue, r.ticket, r.discount_pct) for r in got] == [(28, 1, 10.0, 10.0, 0.0), (29, 0, 0.0, None, None), (1, 0, 0.0, None, None), (2, 1, 5.0, 5.0, 50.0), (3, 0, 0.0, None, None)]
    assert kpis.daily_series(flags.where("false"), D(2024, 3, 4)).count() == 0


def test_same_days_last_year_with_29_february(spark):
    days = [(D(2023, 2, 20) + dt.timedelta(days=k), k, float(k)) for k in range(375)]
    got = kpis.mtd_vs_last_year(spark.createDataFrame([d for d in days if d[0] <= D(2024, 2, 29)], "ds date, orders int, revenue double")).first()
    assert got["orders_year_ago"] == sum(k for d, k, _ in days if D(2023, 2, 1) <= d <= D(2023, 2, 28)) and got["orders"] == sum(k for d, k, _ in days if D(2024, 2, 1) <= d <= D(2024, 2, 29))


def test_last_complete_week(spark):
    df = spark.createDataFrame([(D(2024, 1, 13),), (D(2024, 1, 14),), (D(2024, 1, 15),)], "d date")
    assert [r[0] for r in df.select(cubes.last_complete_week(F.col("d"))).collect()] == [D(2024, 1, 1), D(2024, 1, 8), D(2024, 1, 8)]


def test_calendar_against_known_dates(spark):
    got = {r.ds: r for r in calendar.calendar_dimension(spark, D(2023, 12, 1), D(2025, 1, 5)).collect()}
    assert [d for d, r in got.items() if r.is_black_friday] == [D(2024, 11, 29)]
    assert got[D(2024, 3, 29)].is_holiday and got[D(2024, 2, 13)].is_carnival and got[D(2024, 3, 31)].is_holy_week and not got[D(2024, 4, 1)].is_holy_week
    assert got[D(2024, 12, 24)].is_eve and got[D(2024, 12, 26)].is_after and got[D(2024, 11, 20)].is_holiday and not got.get(D(2023, 11, 20))
    easters = spark.createDataFrame([(y,) for y in (1961, 2000, 2008, 2011, 2038)], "y int").select(calendar.easter(F.col("y"))).collect()
    assert [r[0] for r in easters] == [D(1961, 4, 2), D(2000, 4, 23), D(2008, 3, 23), D(2011, 4, 24), D(2038, 4, 25)]


def test_levels_add_up_and_shares_sum_to_100(spark):
    rows = [(D(2024, 1, 1 + 7 * w), f"c{i % 2}", f"s{i}", e, 1, i + w, Decimal(i), Decimal(i)) for w in range(3) for i in range(4) for e in (False, True)]
    cube = spark.createDataFrame(rows, "week date, channel string, state string, is_extreme boolean, orders long, units long, revenue decimal(18,2), list_revenue decimal(18,2)")
    got = cubes.aggregate_levels(cube)
    sums = {r.level: r.s for r in got.groupBy("level").agg(F.sum("units").alias("s")).collect()}
    assert set(sums) == {"Total", "Canal", "UF"} and len(set(sums.values())) == 1
    shares = cubes.share_over_total(got, ["level", "week"]).groupBy("level", "week").agg(F.sum("share_pct").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-9 for r in shares)
    top = cubes.top_n_plus_others(got.where("level = 'UF'"), 2).collect()
    assert {r.series for r in top} == {"s3", "s2", "OUTROS"}


def test_basket_pairs(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "c"), (4, "a")]
    lines = spark.createDataFrame([(o, p, D(2024, 1, 2), Decimal(1), o == 9) for o, p in rows] + [(9, "a", D(2024, 1, 2), Decimal(1), True), (9, "b", D(2024, 1, 2), Decimal(1), True)], "order_id long, product_id string, order_date date, total_price decimal(18,2), is_extreme boolean")
    got = {(r.product_a, r.product_b): (r.together, r.orders_a, r.orders_b, r.total_orders, round(r.lift, 6)) for r in basket.basket_lift(basket.basket_pairs(lines, D(2024, 2, 1))).collect()}
    assert got == {("a", "b"): (2, 3, 2, 4, round(8 / 6, 6)), ("a", "c"): (1, 3, 2, 4, round(4 / 6, 6)), ("b", "c"): (1, 2, 2, 4, 1.0)}


def test_constant_series_have_no_correlation(spark):
    weeks = [D(2024, 1, 1) + dt.timedelta(weeks=k) for k in range(8)]
    rows = [(i, w, float(v)) for k, w in enumerate(weeks) for i, v in (("a", k), ("b", -k), ("c", 1))]
    residuals = spark.createDataFrame(rows, "item string, week date, residual double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "item_a string, item_b string")
    got = {r.item_b: r.corr for r in cannibal.weekly_corr(residuals, pairs).collect()}
    assert abs(got["b"] + 1) < 1e-9 and got["c"] is None


def test_a_planted_peak_takes_from_its_group(spark):
    weeks = [D(2024, 2, 5) + dt.timedelta(weeks=k) for k in range(20)]
    units = lambda i, k: {"a": 40.0 if k == 12 else 10.0, "b": 2.0 if k == 12 else 12.0, "c": 10.0}[i]
    grid = spark.createDataFrame([(i, "g", w, units(i, k), units(i, k), units(i, k)) for k, w in enumerate(weeks) for i in "abc"], "item string, grp string, week date, units double, revenue double, list_revenue double")
    summary = cannibal.peak_summary(cannibal.detect_peaks(cannibal.with_baselines(grid))).collect()
    assert [(r["item"], r.episodes, r.gain, r.rest_change, round(r.rate, 6)) for r in summary] == [("a", 1, 30.0, -10.0, round(1 / 3, 6))]


def test_an_item_alone_in_its_group_has_no_peaks(spark):
    weeks = [D(2024, 2, 5) + dt.timedelta(weeks=k) for k in range(20)]
    units = lambda i, k: 40.0 if k in (12, 15, 18) and i != "c" else 10.0
    groups = {"a": "alone", "b": "both", "c": "both"}
    grid = spark.createDataFrame([(i, g, w, units(i, k), units(i, k), units(i, k)) for k, w in enumerate(weeks) for i, g in groups.items()], "item string, grp string, week date, units double, revenue double, list_revenue double")
    summary = cannibal.peak_summary(cannibal.detect_peaks(cannibal.with_baselines(grid)))
    assert [(r["item"], r.episodes) for r in summary.collect()] == [("b", 3)]
    assert [r.grp for r in cannibal.group_cannibalization(summary).collect()] == ["both"]


def test_the_list_of_peaks_has_items_alone_in_their_group(spark):
    weeks = [D(2024, 2, 5) + dt.timedelta(weeks=k) for k in range(20)]
    units = lambda k: 40.0 if k in (12, 15) else 10.0
    grid = spark.createDataFrame([("a", "alone", w, units(k), units(k), units(k)) for k, w in enumerate(weeks)], "item string, grp string, week date, units double, revenue double, list_revenue double")
    based = cannibal.with_baselines(grid)
    assert [r.week for r in cannibal.detect_peaks(based, alone=True).orderBy("week").collect()] == [weeks[12], weeks[15]]
    assert products.ORACLES["peaks"].count("members >= 2") == 0 and products.ORACLES["peak_summary"].count("members >= 2") == 1


def test_regions_of_states(spark):
    states = {"AM": "NORTE", "ba": "NORDESTE", " df ": "CENTRO-OESTE", "RJ": "SUDESTE", "sc": "SUL", "XX": "SEM_INFO", "": "SEM_INFO", None: "SEM_INFO"}
    df = spark.createDataFrame([(s,) for s in states], "state string")
    assert {r.state: r.region for r in df.select("state", region_of_state(clean_state(F.col("state"))).alias("region")).collect()} == states


def test_quantiles_of_values_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, -500, 0, 7, 99, rng.randrange(200), rng.randrange(10**7)])) for _ in range(3000)] + [("none", None), ("one", 5)]
    df = spark.createDataFrame(rows, "k string, cents long").selectExpr("k", "cast(cents * 0.01bd as decimal(28,2)) as value").repartition(5)
    got = {r.k: r for r in kpis.exact_quantiles(df, ["k"], {"p50": "0.5", "p99": "0.99"}).collect()}
    for k in ("a", "b", None, "one"):
        own = sorted(v for key, v in rows if key == k and v is not None)
        assert [int(got[k][n] * 100) for n in ("p50", "p99")] == [own[-(-len(own) * q // 100) - 1] for q in (50, 99)]
    assert set(got) == {"a", "b", None, "one"}
    many = spark.range(3_000_000).selectExpr("cast((id * 7919 % 3000000) * 0.01bd as decimal(28,2)) as value").repartition(8)
    assert float(kpis.value_quantile(many, "0.99").first()["limit"]) == 29699.99
    assert [r.p50 for r in kpis.exact_quantiles(df.where("false"), [], {"p50": "0.5"}).collect()] == [None]


def test_merged_sketches_are_near_the_exact_quantiles(spark):
    rng = random.Random(1)
    rows = [(D(2023, 1, 1) + dt.timedelta(days=rng.randrange(365)), rng.random() < 0.3, rng.lognormvariate(5, 1)) for _ in range(20_000)] + [(D(2023, 1, 1), False, None)]
    flags = spark.createDataFrame(rows, "order_date date, has_professional boolean, value double").repartition(7)
    daily = sketches.value_sketches(flags)
    for r in sketches.quantiles_by_period(daily).collect():
        own = sorted(v for d, _, v in rows if v is not None and (r.period == "all" or (d.year, d.month if r.period == "month" else (d.month - 1) // 3) == (r.start.year, r.start.month if r.period == "month" else (r.start.month - 1) // 3)))
        assert r.orders == len(own)
        for q, got in ((0.5, r.p50), (0.9, r.p90), (0.99, r.p99)):
            assert abs(sum(v <= got for v in own) / len(own) - q) < 0.015
    assert sketches.quantiles_by_period(daily.where("false")).count() == 0


def test_missing_evidence_is_unclear(spark):
    rows = [(True, False, None, None, None), (True, False, 0.2, None, None), (True, False, 0.2, None, 1.3), (False, True, None, -0.3, None), (False, False, None, 0.1, 1.6)]
    df = spark.createDataFrame(rows, "same_group boolean, is_neighbour boolean, pair_rate double, corr double, lift double")
    assert [r.kind for r in cannibal.classify_pairs(df).collect()] == ["indefinido", "concorrentes", "indefinido", "concorrentes", "complementares"]


def test_pair_rates_count_all_peaks_of_an_item_and_directions_alone(spark):
    weeks = [date(2020, 1, 6) + timedelta(weeks=k) for k in range(4)]
    peaks = spark.createDataFrame([("a", "g", w, 10.0) for w in weeks[1:]] + [("b", "g", weeks[2], 10.0), ("b", "g", weeks[3], 10.0)], "item string, grp string, week date, gain double")
    based = spark.createDataFrame([(i, "g", w, u, base) for i, u in (("a", 20.0), ("b", 4.0), ("c", 1.0)) for k, w in enumerate(weeks) for base in [None if i == "c" or k < 2 else 10.0]], "item string, grp string, week date, units double, units_base double")
    got = {(r.item, r.other): (r.episodes, r.gain, r.other_change, round(r.rate, 6)) for r in cannibal.peak_pairs(peaks, based).collect()}
    assert got["a", "b"] == (3, 30.0, -12.0, 0.4) and got["a", "c"] == (3, 30.0, 0.0, 0.0) and got["b", "a"] == (2, 20.0, 20.0, -1.0)
    sym = {(r.item_a, r.item_b): (round(r.pair_rate, 6), r.episodes) for r in cannibal.pair_rate_symmetric(cannibal.peak_pairs(peaks, based)).collect()}
    assert sym == {("a", "b"): (0.4, 3), ("a", "c"): (0.0, 3)}
    assert [r.item for r in cannibal.top_of_group(based.withColumn("revenue", F.lit(0)), 2).orderBy("rank").collect()] == ["a", "b"]


def test_levels_need_two_series_with_labels_of_their_own(spark):
    rows = [("UF", "SEM_INFO"), ("UF", "SP"), ("Canal", "SEM_NUTRICIONISTA"), ("Canal", "COM_NUTRICIONISTA"), ("Total", "Total")]
    kept = cubes.informative_levels(spark.createDataFrame(rows, "level string, series string"))
    assert {r.level for r in kept.collect()} == {"Canal", "Total"}


def test_verdicts_need_only_the_weeks_and_items_that_can_be_evidence(spark, monkeypatch):
    rng = random.Random(4)
    weeks = [D(2024, 2, 5) + dt.timedelta(weeks=k) for k in range(40)]
    cube = [(f"p{i:02}", f"g{i % 2}", w, rng.choice([1, 2, 9]), rng.randrange(1, 50), 60) for i in range(12) for w in weeks if rng.random() < 0.8]
    cube += [("early", "g0", weeks[k], 500, 1, 1) for k in range(25)] + [("rare", "g1", D(2024, 1, 29), 1, 1, 1)]
    rows, spine = cannibal.weekly_sums(spark.createDataFrame(cube, "product_id string, subgroup string, week date, units long, revenue long, list_revenue long"), "product_id", "subgroup", 20)
    assert spine.count() == 41 and rows.count() == len(cube) - 1 - sum(r[0] not in ("early", "rare") for r in cube if sum(q[0] == r[0] for q in cube) < 20)
    sizes, plain = [], cannibal.with_baselines
    monkeypatch.setattr(cannibal, "with_baselines", lambda grid, *a: sizes.append(grid.select("item").distinct().count()) or plain(grid, *a))
    args = dict(k=3, start=weeks[26])
    sparse = cannibal.pair_verdicts(rows, weeks=spine, **args).collect()
    assert sizes == [6] and len(sparse) == 6  # three of each group
    grid = cannibal.dense(rows, spine)
    assert grid.count() == 41 * 13
    based, candidates = plain(grid), cannibal.candidate_pairs(grid, k=3, start=weeks[26])
    rates = {(r.item_a, r.item_b): r.pair_rate for r in cannibal.pair_rate_symmetric(cannibal.peak_pairs(cannibal.detect_peaks(based, start=weeks[26]), based, 3, weeks[26])).collect()}
    corrs = {(r.item_a, r.item_b): r.corr for r in cannibal.weekly_corr(cannibal.log_diff_residual(grid), candidates).collect()}
    near = lambda x, y: x is y or abs(x - y) < 1e-9
    assert {(r.item_a, r.item_b) for r in sparse} == {(r.item_a, r.item_b) for r in candidates.collect()}
    assert all(near(r.pair_rate, rates.get((r.item_a, r.item_b))) and near(r["corr"], corrs.get((r.item_a, r.item_b))) for r in sparse)
    assert cannibal.top_of_group(rows, 3, D(2030, 1, 7), spine).count() == 0


def test_sparse_peaks_and_pairs_equal_those_of_the_dense_grid(spark, monkeypatch):
    rng = random.Random(12)
    weeks = [D(2024, 2, 5) + dt.timedelta(weeks=k) for k in range(60)]
    cube = [(f"p{i:02}", f"g{i % 3}", w, rng.choice([1, 2, 4, 20]), rng.randrange(0, 50), rng.choice([0, 60])) for i in range(14) for w in weeks if rng.random() < (0.9 if i % 4 else 0.6)]
    cube += [("lone", "g9", w, 30 if k % 7 == 0 else 4, 3, 6) for k, w in enumerate(weeks)]
    df = spark.createDataFrame(cube, "product_id string, subgroup string, week date, units long, revenue long, list_revenue long")
    rows, spine = cannibal.weekly_sums(df, "product_id", "subgroup", 20)
    grid = cannibal.dense(rows, spine)
    plain = cannibal.with_baselines(grid)
    as_set = lambda df: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}
    monkeypatch.setattr(cannibal, "dense", None)
    for args in ({}, {"alone": True}, {"start": weeks[30]}):
        peaks, want = cannibal.sparse_peaks(rows, spine, **args), cannibal.detect_peaks(plain, **args)
        assert peaks.columns == want.columns and as_set(peaks) == as_set(want) and want.count() > 20
    peaks = cannibal.detect_peaks(plain)
    assert as_set(cannibal.sparse_peak_pairs(peaks, rows, spine, 3)) == as_set(cannibal.peak_pairs(peaks, plain, 3))
    late = cannibal.detect_peaks(plain, start=weeks[20])
    assert as_set(cannibal.sparse_peak_pairs(late, rows, spine, 3, weeks[20])) == as_set(cannibal.peak_pairs(late, plain, 3, weeks[20]))
    assert cannibal.sparse_peaks(rows.where("false"), spine).count() == 0
    pairs, store = cannibal.candidate_pairs(grid, k=4), grid.groupBy("week").agg(F.sum("units").alias("units"))
    assert as_set(cannibal.sparse_corr(rows, store, pairs)) == as_set(cannibal.weekly_corr(cannibal.log_diff_residual(grid), pairs))
    alone, of = rows.where("item = 'lone'"), spark.createDataFrame([("lone", "lone")], "item_a string, item_b string")
    assert [r["corr"] for r in cannibal.sparse_corr(alone, alone.select("week", "units"), of).collect()] == [None]  # moves as the store does
