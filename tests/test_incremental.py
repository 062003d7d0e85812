"""A cube after a late batch against a full build, and the files of weeks that it does not touch."""

import datetime as dt
import random
from decimal import Decimal
from pathlib import Path

from tidemark.config import ExtremeRule, Options, OrderRules
from tidemark.plans import incremental as I

D = dt.date
OPTIONS = Options(as_of=D(2024, 1, 1), rules=OrderRules(statuses=("x",)), extremes=ExtremeRule(value=900.0, group_value=50.0, unit=10.0, same_units=False))
ITEM = "order_id long, product_id string, units long, list_price decimal(18,2), unit_price decimal(18,2), total_price decimal(18,2), origin string, order_date date, updated long"
ORDER = "id long, status string, professional_id long, customer_id long, email string, state string"


def line(order, product, day, price, updated=0, units=1):
    return (order, product, units, Decimal(price), Decimal(price), Decimal(price) * units, "1P", day, updated)


def data():
    rng = random.Random(4)
    items, orders = [], []
    for o in range(300):
        day = D(2023, 1, 2) + dt.timedelta(days=rng.randrange(200))
        orders.append((o, "ok", None, o, None, rng.choice(["SP", "RJ"])))
        items += [line(o, f"p{rng.randrange(40)}", day, rng.randrange(20, 400)) for _ in range(rng.randrange(1, 4))]
    items += [line(900, "p1", D(2023, 3, 1), 60), line(900, "p2", D(2023, 3, 1), 60)]  # alone until a like order comes
    orders.append((900, "ok", None, 900, None, "SP"))
    return items, orders


def test_late_batch_equals_a_full_build_and_leaves_other_weeks_alone(spark, tmp_path):
    items, orders = data()
    late_items = [
        line(901, "p3", D(2023, 3, 5), 60), line(901, "p4", D(2023, 3, 5), 60),  # makes order 900 one of a group
        line(5, "p7", items[0][7], 1, 9), line(7, "p9", D(2023, 5, 5), 2000, 9),  # another line; an order that gets extreme
        line(902, "new", D(2022, 12, 1), 30), line(903, "p5", D(2022, 11, 1), 30),  # an older week; a first sale that moves
        line(None, "p5", D(2023, 1, 1), 30),
    ]
    gone = next(o for o, _, _ in ((i[0], i[7], 0) for i in items) if o not in (5, 7))
    late_orders = [(901, "ok", None, 1, None, "SP"), (902, "ok", None, 1, None, "RJ"), (903, "ok", None, 1, None, "RJ"), (11, "x", None, 11, None, "SP"), (None, "ok", None, 1, None, None)]
    dropped = [o for o in orders if o[0] not in (11, gone)] + [o for o in late_orders if o[0] == 11]  # 11 no longer counts, `gone` is not among the orders
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    all_items, all_orders = make(items + late_items, ITEM), make(dropped + [o for o in late_orders if o[0] != 11], ORDER)
    products = spark.createDataFrame([(f"p{k}", f"n{k}", f"b{k % 3}", "g", "s", 0) for k in range(40)], "product_id string, name string, brand string, grp string, subgroup string, updated long")
    regions = spark.createDataFrame([("SP", "S"), ("RJ", "S")], "state string, region string")
    before = I.full_state(make(items, ITEM), make(orders, ORDER), OPTIONS)
    where = str(tmp_path / "cube")
    I.write_cube(I.cube_of(before, products, regions, "product", OPTIONS), where)
    files = {p: p.stat().st_mtime_ns for p in Path(where).rglob("*.parquet")}

    changed = I.changed_orders(make(late_items, ITEM), make([*late_orders, (gone, "x", None, 1, None, None)], ORDER))
    after, weeks = I.refreshed(before, all_items, all_orders, changed, OPTIONS)
    I.overwrite_weeks(I.cube_of(after, products, regions, "product", OPTIONS, weeks), weeks, where)

    full = I.full_state(all_items, all_orders, OPTIONS)
    rows = lambda df, columns: sorted(map(str, df.select(*sorted(columns)).collect()))
    assert rows(after.lines, full.lines.columns) == rows(full.lines, full.lines.columns)
    assert rows(after.flags, full.flags.columns) == rows(full.flags, full.flags.columns)
    want = I.cube_of(full, products, regions, "product", OPTIONS)
    assert rows(I.read_cube(spark, where), want.columns) == rows(want, want.columns)
    assert {r.order_id for r in after.flags.where("is_extreme").collect()} >= {7, 900, 901}

    remade = {str(r.week) for r in weeks.collect()}
    kept = {p: t for p, t in files.items() if p.parent.name.removeprefix("week=") not in remade}
    assert kept and len(kept) > len(files) / 2 and all(p.exists() and p.stat().st_mtime_ns == t for p, t in kept.items())
    assert "2022-11-28" in remade and (Path(where) / "week=2022-11-28").exists()

    same, none = I.refreshed(after, all_items, all_orders, changed.limit(0), OPTIONS)
    assert none.count() == 0 and rows(same.flags, full.flags.columns) == rows(full.flags, full.flags.columns)


def test_a_late_batch_leaves_stored_lines_where_they_lie(spark, tmp_path):
    items, orders = data()
    late = [line(901, "p3", D(2023, 3, 5), 60), line(901, "p4", D(2023, 3, 5), 60), line(5, "p7", items[0][7], 1, 9), line(7, "p9", D(2023, 5, 5), 2000, 9)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    all_items, all_orders = make(items + late, ITEM), make([*orders, (901, "ok", None, 1, None, "SP")], ORDER)
    before = I.full_state(make(items, ITEM), make(orders, ORDER), OPTIONS, new_value=False)
    after, weeks = I.refreshed(before, all_items, all_orders, I.changed_orders(make(late, ITEM), all_orders.limit(0)), OPTIONS)
    full = I.full_state(all_items, all_orders, OPTIONS, new_value=False)
    rows = lambda df, columns: sorted(map(str, df.select(*sorted(columns)).collect()))
    for got, want in ((after.lines, full.lines), (after.flags, full.flags)):
        assert rows(got, want.columns) == rows(want, want.columns) and "new_value" not in want.columns
    assert "Exchange hashpartitioning" not in after.lines._jdf.queryExecution().executedPlan().toString()
    assert set(before.lines.inputFiles()) <= set(after.lines.inputFiles())  # the old lines are not written again
    assert 0 < weeks.count() < 30
