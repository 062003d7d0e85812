"""Queries against their SQL on the smallest tables; the entry module without the subpackage that may be taken out."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ("channel_split", "monthly_kpis", "daily_series", "extreme_orders", "cleaning_impact", "cube_full", "levels", "noise_by_level", "weekly_calendar", "basket_lift", "peak_summary", "weekly_corr", "standardised_features", "model_choice", "top_down", "damped_holt_winters", "calendar_regression", "trend_season_regression", "ticket_forecast", "simple_run_record", "product_group_verdicts", "incremental_cube", "op2_line_dedup", "op3_chat", "op9_warc", "op12_clusters", "op13_divergence")


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in SOME if n in entry.queries()])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["month", "channel", "orders", "revenue", "ticket", "extreme_orders"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_subpackage(tmp_path):
    repo = Path(entry.__file__).parent
    for p in repo.iterdir():
        if p.name not in ("tidemark", "corpus_pipeline.py", "tests", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tidemark").mkdir()
    for p in (repo / "tidemark").iterdir():
        if p.name != "llm":
            (tmp_path / "tidemark" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); from pyspark.sql import SparkSession; spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); assert e.entry(spark).count() > 0; assert len(q) > 90 and not any(k.startswith('op') and k[2].isdigit() for k in q), len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
