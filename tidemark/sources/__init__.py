"""Reading raw tables into canonical columns, and writing results."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical columns and their types.
ORDERS = {"id": "long", "status": "string", "professional_id": "long", "customer_id": "long", "email": "string", "state": "string"}
ITEMS = {"order_id": "long", "product_id": "string", "units": "long", "list_price": "decimal(18,2)", "unit_price": "decimal(18,2)", "total_price": "decimal(18,2)", "origin": "string", "order_date": "date", "updated": "timestamp"}
PRODUCTS = {"product_id": "string", "name": "string", "brand": "string", "grp": "string", "subgroup": "string", "updated": "timestamp"}
#: Names under which canonical columns are looked for, first match wins (fixed values).
CANDIDATES = {
    "orders": {"id": ("id", "id_pedido"), "status": ("status",), "professional_id": ("id_nutricionista",), "customer_id": ("id_paciente",), "email": ("email",), "state": ("uf", "estado", "sigla_uf", "state")},
    "items": {"order_id": ("id_pedido", "order_id"), "product_id": ("id_produto", "product_id"), "units": ("unidades", "units"), "list_price": ("preco_cheio", "list_price"), "unit_price": ("preco_unitario", "unit_price"), "total_price": ("preco_total", "total_price"), "origin": ("origem_produto", "origin"), "order_date": ("pedido_date", "order_date"), "updated": ("data_atualizacao", "updated")},
    "products": {"product_id": ("id_produto", "id", "product_id"), "name": ("nome", "name"), "brand": ("marca", "brand"), "grp": ("grupo", "categoria", "grp"), "subgroup": ("subgrupo", "subcategoria", "subgroup"), "updated": ("data_atualizacao", "updated")},
}
NEEDED = {"orders": ("id",), "items": ("order_id", "product_id", "units", "unit_price", "total_price", "order_date"), "products": ("product_id",)}


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A table by name (kind="table") or files of any format Spark reads."""
    return spark.table(path) if kind == "table" else spark.read.options(**options).format(kind).load(path)


def resolve_columns(columns: Mapping[str, Sequence[str]], candidates: Mapping[str, Mapping[str, Sequence[str]]] = CANDIDATES, manual: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, dict[str, str | None]]:
    """For each table and canonical column the column to read: a manual choice, else the first candidate that the table has,
    in any letter case, else None. A needed column that is found nowhere is an error."""
    found: dict[str, dict[str, str | None]] = {}
    for table, wanted in candidates.items():
        have = {c.lower(): c for c in columns.get(table, ())}
        chosen = (manual or {}).get(table, {})
        found[table] = {k: chosen.get(k) or next((have[n.lower()] for n in names if n.lower() in have), None) for k, names in wanted.items()}
        if table in columns and (missing := [k for k in NEEDED.get(table, ()) if found[table].get(k) is None]):
            raise ValueError(f"{table}: no column for {', '.join(missing)}")
    return found


def canonical(df: DataFrame, mapping: Mapping[str, str | None], types: Mapping[str, str]) -> DataFrame:
    """Canonical columns only; those without a source are null. Unreadable values become null."""
    return df.select(*[(F.col(f"`{mapping[c]}`").try_cast(t) if mapping.get(c) else F.lit(None).cast(t)).alias(c) for c, t in types.items()])


def read_orders(df: DataFrame, manual: Mapping[str, str] | None = None) -> DataFrame:
    return canonical(df, resolve_columns({"orders": df.columns}, manual={"orders": manual or {}})["orders"], ORDERS)


def read_items(df: DataFrame, manual: Mapping[str, str] | None = None) -> DataFrame:
    return canonical(df, resolve_columns({"items": df.columns}, manual={"items": manual or {}})["items"], ITEMS)


def read_products(df: DataFrame, manual: Mapping[str, str] | None = None) -> DataFrame:
    return canonical(df, resolve_columns({"products": df.columns}, manual={"products": manual or {}})["products"], PRODUCTS)


def schema_table(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, type, position) of all columns of the tables."""
    rows = [(t, c, kind, i) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, "table string, column string, type string, position int")


def read_csv_cube(spark: SparkSession, path: str, dims: Sequence[str], measures: Sequence[str], flags: Sequence[str] = ("is_extreme",), week: str = "week") -> DataFrame:
    """A cube kept as CSV: weeks as dates, flags from true or 1, measures that are no numbers as 0."""
    names = [week, *dims, *flags, *measures]
    head = spark.read.option("header", True).csv(path)
    text = head.select(*[F.col(c) if c in head.columns else F.lit(None).cast("string").alias(c) for c in names])
    return text.select(
        F.col(week).try_cast("date").alias(week), *dims,
        *[F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False)).alias(c) for c in flags],
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in measures],
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles, floats and decimals with at most `digits` decimals, half away from zero."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (*kinds, T.DecimalType)) else F.col(f"`{f.name}`")) for f in df.schema.fields])


def merge_run(old: DataFrame, new: DataFrame, key: str = "run_date") -> DataFrame:
    """old without the runs that new has, and new; columns that one lacks are null. Rows whose key is null stay."""
    kept = old.join(F.broadcast(new.select(key).distinct()), key, "left_anti")  # a few run dates
    return kept.unionByName(rounded(new), allowMissingColumns=True)


def upsert_run(df: DataFrame, path: str, key: str = "run_date") -> None:
    """Writes runs into a table partitioned by run; a run that is there is replaced, others are not touched."""
    rounded(df).write.mode("overwrite").partitionBy(key).option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def safe_column_name(text: str) -> str:
    """Letters, digits and _ only: accents go, % becomes pct, a leading digit gets c_, nothing becomes col."""
    plain = unicodedata.normalize("NFKD", str(text)).encode("ascii", "ignore").decode().replace("%", "pct")
    name = re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]", "_", plain)).strip("_")
    return "col" if not name else f"c_{name}" if name[0].isdigit() else name


def safe_columns(df: DataFrame) -> DataFrame:
    """df with safe names; names that become equal get a number."""
    names: list[str] = []
    for c in df.columns:
        name, n = safe_column_name(c), 1
        while (name if n == 1 else f"{name}_{n}").lower() in {x.lower() for x in names}:
            n += 1
        names.append(name if n == 1 else f"{name}_{n}")
    return df.toDF(*names)


def save_table(df: DataFrame, target: str, forbidden: Sequence[str] = ()) -> None:
    """Overwrites a table; targets in a protected layer (any part of the dotted name, or its beginning up to a _) are refused."""
    parts = target.lower().replace("`", "").split(".")
    for layer in forbidden:
        if any(p == layer.lower() or p.startswith(f"{layer.lower()}_") for p in parts):
            raise ValueError(f"{target} lies in the protected layer {layer}")
    safe_columns(df).write.mode("overwrite").saveAsTable(target)


def latest_run(df: DataFrame, key: str = "run_date") -> DataFrame:
    """The rows of the last run."""
    return df.join(F.broadcast(df.agg(F.max(key).alias(key))), key, "left_semi")  # one row
