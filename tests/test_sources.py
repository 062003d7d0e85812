import datetime as dt
import re
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import sources as S
from tidemark.operators import orders as O
from tidemark.queries.base import OPTIONS, Base
from tidemark.sources.bucketed import bucketed, exists, fingerprint

SF = "/root/testdata/sf0.001"


def test_resolve_columns_takes_first_candidate_and_manual_choice():
    found = S.resolve_columns({"orders": ["ID", "Estado", "x"], "items": ["id_pedido", "id_produto", "unidades", "preco_unitario", "preco_total", "pedido_date"]}, manual={"orders": {"email": "x"}})
    assert found["orders"]["id"] == "ID" and found["orders"]["state"] == "Estado" and found["orders"]["email"] == "x" and found["orders"]["status"] is None
    with pytest.raises(ValueError, match="order_id"):
        S.resolve_columns({"items": ["a"]})


def test_read_orders_fills_missing_columns(spark):
    got = S.read_orders(spark.createDataFrame([("7", "ok"), ("x", None)], "id string, status string"))
    assert got.columns == list(S.ORDERS) and [r.id for r in got.collect()] == [7, None]


def test_csv_cube(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("week,brand,is_extreme,units\n2024-01-01,a,true,3\nbad,b,0,x\n2024-01-08,c,1,\n")
    got = S.read_csv_cube(spark, str(path), ["brand"], ["units", "revenue"]).orderBy("brand").collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 1, 1), "a", True, 3.0, 0.0), (None, "b", False, 0.0, 0.0), (dt.date(2024, 1, 8), "c", True, 0.0, 0.0)]


def test_upsert_replaces_one_run_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "runs")
    run = lambda day, v: spark.createDataFrame([(dt.date(2024, 1, day), v)], "run_date date, v double")
    S.upsert_run(run(1, 1.0), path)
    S.upsert_run(run(2, 2.00004), path)
    for _ in range(2):
        S.upsert_run(run(1, 3.0), path)
    assert sorted((r.run_date.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, 3.0), (2, 2.0)]
    assert [r.v for r in S.latest_run(spark.read.parquet(path)).collect()] == [2.0]
    old = spark.createDataFrame([(None, 9.0), (dt.date(2024, 1, 1), 1.0)], "run_date date, v double")
    merged = S.merge_run(old, run(1, 5.0).selectExpr("*", "'n' as note"))
    assert sorted((r.run_date is None, r.v, r.note) for r in merged.collect()) == [(False, 5.0, "n"), (True, 9.0, None)]
    S.replace_table(run(4, 4.0), path)
    assert spark.read.parquet(path).count() == 1


def test_names_and_guards(spark):
    assert [S.safe_column_name(t) for t in ("Viés %", "2024 total", "", "a--b", "ção")] == ["Vies_pct", "c_2024_total", "col", "a_b", "cao"]
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    assert S.safe_columns(df).columns == ["a_b", "a_b_2"]
    with pytest.raises(ValueError, match="protected"):
        S.save_table(df, "gold.sales", ["gold"])
    S.save_table(df, "scratch_sales", ["gold"])
    assert spark.table("scratch_sales").count() == 1


def test_rounded_and_schema(spark):
    df = spark.createDataFrame([(Decimal("1.23456"), 2.34565, 3)], "a decimal(10,5), b double, c int")
    assert [float(x) for x in S.rounded(df, 4).first()] == [1.2346, 2.3457, 3.0]
    assert {(r.table, r.column, r.type) for r in S.schema_table(spark, {"t": df}).collect()} == {("t", "a", "decimal(10,5)"), ("t", "b", "double"), ("t", "c", "int")}


def _exchanges(df):
    """Exchanges of the plan as it ran, by what they deal out by."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.split("Initial Plan")[0].splitlines() if re.search(r"\bExchange (hash|single|range|Round)", line)]


def test_stored_tables_join_and_group_without_exchanges(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = Base(spark, SF)
        assert _exchanges(O.order_totals(b.dated)) == []
        assert _exchanges(b.flags.select("order_id", "is_extreme")) == []
        assert _exchanges(b.lines.select("order_id", "product_id", "is_extreme")) == []
        per_order = b.lines.groupBy(F.trunc("order_date", "week").alias("week"), "state", "order_id").agg(F.sum("units").alias("units"))
        assert len(_exchanges(per_order.groupBy("week", "state").agg(F.count("*").alias("orders")))) == 1
        assert "first_date" not in b.lines.select("order_id", "units")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:200]
        assert Base(spark, SF)._stored()[0] is b._stored()[0]
        assert Base(spark, SF, replace(OPTIONS, dedup_items=False))._stored()[0] is not b._stored()[0]
        assert sorted(map(tuple, O.order_totals(b.base).collect())) == sorted(map(tuple, O.order_totals(b.dated).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_tables_follow_their_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    before = fingerprint(spark, [path])
    assert before == fingerprint(spark, [path])
    spark.range(4).write.mode("append").parquet(path)
    assert before != fingerprint(spark, [path])
    table, where = bucketed(spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k int, v int"), "k", 3)
    assert exists(spark, where) and sorted(r.v for r in table.collect()) == [1, 2, 3]
    assert bucketed(spark.range(0), "id")[0].count() == 0


def test_what_every_query_stores_does_not_go_by_product(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = Base(spark, SF)
        assert "first_date" not in b._stored()[0].columns and "new_value" not in b.marks.columns
        assert not any("product_id" in e for e in _exchanges(b.lines.groupBy("order_id").agg(F.max("is_extreme"))))
        files = b._stored()[0].inputFiles()
        assert len(files) == len({re.search(r"_(\d{5})\.", f).group(1) for f in files})  # one a bucket, so they count as sorted
        dealt = [e for e in _exchanges(O.flag_extremes(b.marks.drop("in_group", "is_extreme"), OPTIONS.extremes)) if "hashpartitioning(order_id" in e]
        assert len(dealt) <= 1  # ids that are in a group; none if there are no groups
        flags = {r.order_id: r for r in b.flags.collect()}
        assert {r.order_id: r.new_value for r in O.order_totals(b.dated).collect()} == {k: r.new_value for k, r in flags.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_new_value_is_the_same_with_and_without_first_dates(spark):
    rows = [(1, "a", 0, None), (1, "b", 0, None), (2, "a", 200, 5), (2, "c", 200, None), (3, "a", 201, 7), (4, None, 1, 3), (5, "d", 3, 2), (5, "a", 95, 4)]
    lines = spark.createDataFrame(rows, "order_id long, product_id string, day int, price int").selectExpr(
        "order_id", "product_id", "date_add(date'2020-01-01', day) as order_date", "true as has_professional", "'SP' as state", "cast(price as decimal(18,2)) as total_price", "cast(price as decimal(18,2)) as list_price", "cast(price as decimal(18,2)) as unit_price", "1L as units")
    plain, dated = O.order_totals(lines), O.order_totals(O.with_first_sale(lines))
    assert plain.dtypes == dated.dtypes and sorted(map(str, plain.collect())) == sorted(map(str, dated.collect()))
