"""The clean base over the star schema, for queries and for their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ExtremeRule, Options, OrderRules
from tidemark.operators import orders as O
from tidemark.sources import star
from tidemark.sources.bucketed import bucketed, exists, fingerprint
from tidemark.sources.stages import settle

OPTIONS = Options(
    as_of=date(2001, 8, 1),
    rules=OrderRules(statuses=("P",), professionals=(7, 21), customers=(3, 11), emails=("test@example.com",)),
    extremes=ExtremeRule(value=500_000.0, unit=1000.0, same_units=False),
)


#: Stored tables by application, options and state of the files they were made of; each is (table, folder).
_STORED: dict[tuple, tuple] = {}
_SHARED: dict[tuple, DataFrame] = {}


class Base:
    """Canonical tables and the stages of cleaning, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, options: Options = OPTIONS):
        self.spark, self.sf_dir, self.options = spark, sf_dir, options
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def kept(self, name: str, make) -> DataFrame:
        """Made once and settled, for what several stages read again."""
        return self._once(name, lambda: settle(make()))

    def shared(self, name: str, make) -> DataFrame:
        """Settled once for all queries of a session over the same files: for backtests of all models, which many queries read."""
        key = (self._key(), name)
        if key not in _SHARED:
            _SHARED[key] = settle(make())
        return _SHARED[key]

    @property
    def orders(self) -> DataFrame:
        return self._once("orders", lambda: star.orders(self.spark, self.sf_dir))

    @property
    def items(self) -> DataFrame:
        return self._once("items", lambda: star.items(self.spark, self.sf_dir))

    @property
    def products(self) -> DataFrame:
        return self._once("products", lambda: O.product_dimension(star.products(self.spark, self.sf_dir)))

    @property
    def regions(self) -> DataFrame:
        return self._once("regions", lambda: star.regions(self.spark, self.sf_dir))

    @property
    def valid(self) -> DataFrame:
        return self._once("valid", lambda: O.valid_orders(self.orders, self.options.rules))

    def _stored(self) -> tuple[DataFrame, DataFrame]:
        """Clean lines, and order flags without new_value, stored by order once for all queries of a session over the same files."""
        return self._once("stored", lambda: self._stores("lines", self._store))

    def _key(self) -> tuple:
        names = ("orders", "customer", "nation", "lineitem", "part", "region")
        return self._once("key", lambda: (self.spark.sparkContext.applicationId, self.options, fingerprint(self.spark, [f"{self.sf_dir}/{n}.parquet" for n in names])))

    def _stores(self, name: str, make) -> tuple[DataFrame, ...]:
        """The tables that `make` stores as pairs (table, folder), unless they are there."""
        key = (self._key(), name)
        if key not in _STORED or not all(exists(self.spark, where) for _, where in _STORED[key]):
            _STORED[key] = make()
        return tuple(df for df, _ in _STORED[key])

    def _store(self) -> tuple[tuple[DataFrame, str], ...]:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        lines = bucketed(O.base_items(self.items.repartition(n, "order_id"), self.valid, self.options.dedup_items), "order_id", n, dealt=True)
        return lines, bucketed(O.flag_extremes(O.plain_totals(lines[0]), self.options.extremes), "order_id", n, dealt=True)

    @property
    def dated(self) -> DataFrame:
        """Clean lines with first_date, stored by order when first asked for."""
        return self._once("dated", lambda: self._stores("dated", lambda: (bucketed(O.with_first_sale(self.base), "order_id"),))[0])

    @property
    def base(self) -> DataFrame:
        return self._stored()[0]

    @property
    def totals(self) -> DataFrame:
        return self.flags.drop("in_group", "is_extreme")

    @property
    def marks(self) -> DataFrame:
        """flags without new_value, for which no line need meet its product's first sale."""
        return self._stored()[1]

    @property
    def flags(self) -> DataFrame:
        """Order totals with in_group and is_extreme, stored by order when first asked for."""

        def make():
            rows = O.with_new_value(self.marks, self.base, self.options.new_product_days)
            return (bucketed(rows.select(*[c for c in self.marks.columns if c not in ("in_group", "is_extreme")], "new_value", "in_group", "is_extreme"), "order_id", dealt=True),)

        return self._once("flags", lambda: self._stores("flags", make)[0])

    @property
    def lines(self) -> DataFrame:
        """Clean lines with the flag of their order."""
        return self._once("lines", lambda: O.with_extremes(self.base, self.marks))


def f(column: str) -> F.Column:
    return F.col(column)


#: The same stages in SQL: o, i, p, regions, valid, base, totals, flags, lines.
CANON = """
WITH o AS (
    SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_custkey END AS professional_id, o_custkey AS customer_id,
        CAST(NULL AS VARCHAR) AS email, n_name AS state
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
), cents AS (
    SELECT *, CAST(l_quantity AS BIGINT) AS units, CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS list_cents FROM lineitem
), unit AS (SELECT *, (list_cents * (100 - CAST(round(l_discount * 100) AS BIGINT))) // 100 AS unit_cents FROM cents),
i AS (
    SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, units, list_cents, unit_cents, unit_cents * units AS total_cents,
        CASE l_returnflag WHEN 'A' THEN '1P' WHEN 'R' THEN '3P' END AS origin, CAST(l_shipdate AS DATE) AS order_date, l_linenumber AS updated
    FROM unit
), p AS (
    SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_brand AS brand, p_type AS grp, p_type || '/' || CAST((p_size - 1) // 10 AS VARCHAR) AS subgroup FROM part
), regions AS (SELECT n_name AS state, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
valid AS (
    SELECT id AS order_id, bool_or(professional_id IS NOT NULL) AS has_professional, max(upper(trim(state))) AS state FROM o
    WHERE (status IS NULL OR status NOT IN ('P')) AND (professional_id IS NULL OR professional_id NOT IN (7, 21)) AND (customer_id IS NULL OR customer_id NOT IN (3, 11))
        AND (email IS NULL OR email NOT IN ('test@example.com')) AND id IS NOT NULL
    GROUP BY id
), base AS (
    SELECT i.*, has_professional, state FROM i JOIN valid USING (order_id) WHERE order_date IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY order_id, product_id ORDER BY updated DESC NULLS LAST, total_cents DESC NULLS LAST, units DESC NULLS LAST, origin NULLS LAST) = 1
), firsts AS (SELECT product_id, min(order_date) AS first_date FROM base GROUP BY product_id),
totals AS (
    SELECT order_id, min(order_date) AS order_date, max(has_professional) AS has_professional, max(state) AS state, sum(total_cents) AS value_cents, sum(list_cents * units) AS list_cents,
        sum(units) AS units, count(*) AS lines, count(*) FILTER (WHERE unit_cents < list_cents) AS discounted_lines, sum(CASE WHEN order_date - first_date <= 90 THEN total_cents ELSE 0 END) AS new_cents
    FROM base LEFT JOIN firsts USING (product_id) GROUP BY order_id
), keyed AS (SELECT *, floor(value_cents / 100.0 / 1000.0 + 0.5) AS like_value FROM totals),
counted AS (
    SELECT *, count(*) OVER (PARTITION BY like_value, lines ORDER BY order_date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 7 DAYS FOLLOWING) AS alike FROM keyed
), flags AS (
    SELECT *, alike >= 2 AND value_cents >= 100000 AND lines >= 2 AS in_group, (alike >= 2 AND value_cents >= 100000 AND lines >= 2) OR value_cents > 50000000 AS is_extreme FROM counted
), lines AS (SELECT base.*, coalesce(is_extreme, FALSE) AS is_extreme FROM base LEFT JOIN (SELECT order_id, is_extreme FROM flags) USING (order_id))
"""
