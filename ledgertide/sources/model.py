"""The raw parquet tables seen as the order-to-cash and audit model.

Every column is an expression over the raw columns, so a query that needs three model
columns reads only the raw columns behind them, and filters on keys and dates reach the scan.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.operators.ordered import Hot, hot_groups, numbered
from ledgertide.sources.schemas import model_schema, raw_schema
from ledgertide.sources.tables import line_total

AS_OF_ORDERS = "2001-08-02"
AS_OF_EVENTS = "2024-01-31"

# Codes that the mapping gives to the raw texts.
CATEGORY_CODES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
DEPARTMENT_OF_REGION = {0: "SALES", 1: "WAREHOUSE", 2: "FINANCE", 3: "ADMIN", 4: "IT"}
PAYMENT_METHOD_OF_PRIORITY = {
    "1-URGENT": "CREDIT_CARD",
    "2-HIGH": "DEBIT_CARD",
    "3-MEDIUM": "PAYPAL",
    "4-NOT SPECIFIED": "BANK_TRANSFER",
    "5-LOW": "CASH",
}
PAYMENT_STATUS_OF_ORDER = {"F": "COMPLETED", "O": "PENDING", "P": "FAILED"}
ACTION_OF_EVENT = {"signup": "INSERT", "click": "UPDATE", "error": "DELETE"}
TABLE_OF_EVENT = {
    "signup": "CUSTOMERS",
    "click": "PRODUCTS",
    "error": "ORDERS",
    "purchase": "ORDER_ITEMS",
    "view": "PAYMENTS",
}
HOLIDAYS = [
    (1, "2024-01-01", "New Year", "Y"),
    (2, "2024-01-15", "Founders Day", "N"),
]
PROMOTIONS = [
    (1, "Summer Sale", 15, "1998-06-01", "1998-08-31", 50, 5000, None),
    (2, "Economy Discount", 10, "1998-01-01", "1998-12-31", 0, None, 101),
    (3, "Winter Clearance", 5, "1997-11-15", "1998-02-15", 100000, 8000, None),
    (4, "Loyalty Week", 20, "2000-03-01", "2000-03-07", 0, 20000, None),
]


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(raw_schema(name)).parquet(os.path.join(folder, f"{name}.parquet"))


def literal_rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few constant rows as a local relation, whose size the optimizer knows."""
    def text(value):
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"

    lines = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({columns})")


class Model:
    """Model tables over one folder of raw tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return scan(self.spark, self.folder, name)

    # -- dimensions -------------------------------------------------------------

    def nations(self, column: str) -> DataFrame:
        """One row per nation: a key known to be unique lets Spark drop the left join when the column is not read."""
        return self.raw("nation").groupBy("n_nationkey").agg(F.max(column).alias(column))

    def customers(self) -> DataFrame:
        nations = self.nations("n_name")
        base = self.raw("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return base.selectExpr(
            "c_custkey AS customer_id",
            "c_name AS customer_name",
            "concat(lower(replace(c_name, '#', '.')), '@mail.example') AS email",
            "CAST(NULL AS STRING) AS phone",
            "if(c_mktsegment <> 'HOUSEHOLD', concat('Street ', c_custkey), NULL) AS address",
            "concat('City ', c_nationkey) AS city",
            "coalesce(n_name, 'USA') AS country",
            "TIMESTAMP_NTZ '1994-01-01' + make_dt_interval(CAST(c_custkey % 365 AS INT)) AS join_date",
            """CASE WHEN c_acctbal >= 7500 THEN 'PLATINUM' WHEN c_acctbal >= 5000 THEN 'GOLD'
                    WHEN c_acctbal >= 2500 THEN 'SILVER' ELSE 'BRONZE' END AS customer_segment""",
            "greatest(CAST(c_acctbal AS DECIMAL(12,2)), CAST(0 AS DECIMAL(12,2))) AS total_spent",
        )

    def regions(self) -> DataFrame:
        """Customer id to region and country, for regional revenue."""
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .selectExpr("c_custkey AS customer_id", "r_name AS region", "n_name AS country")
        )

    def products(self) -> DataFrame:
        cents = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT)"
        cost = f"(2 * {cents} * (100 + p_size) + 200) div 400"
        return self.raw("part").selectExpr(
            "p_partkey AS product_id",
            "p_name AS product_name",
            f"{CATEGORY_CODE} * 100 + CAST(substring(p_brand, 7) AS BIGINT) AS category_id",
            "CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price",
            f"CAST(CAST({cost} AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(10,2)) AS unit_cost",
            "p_partkey div 20 AS supplier_id",
            "CAST(p_size AS BIGINT) AS stock_quantity",
            "CAST(10 AS BIGINT) AS reorder_level",
            "CASE WHEN p_brand = 'Brand#25' THEN 'DISCONTINUED' WHEN p_size = 1 THEN 'OUT_OF_STOCK' ELSE 'ACTIVE' END"
            " AS status",
            "TIMESTAMP_NTZ '1994-01-01' AS created_date",
        )

    def categories(self) -> DataFrame:
        """A two-level tree below one root: catalog, type, type and brand."""
        leaf = self.raw("part").selectExpr(
            f"{CATEGORY_CODE} * 100 + CAST(substring(p_brand, 7) AS BIGINT) AS category_id",
            "concat_ws(' ', p_type, p_brand) AS category_name",
            f"{CATEGORY_CODE} * 100 AS parent_category_id",
            "p_type",
        ).distinct()
        middle = leaf.selectExpr(
            "parent_category_id AS category_id", "p_type AS category_name", "CAST(0 AS BIGINT) AS parent_category_id"
        ).distinct()
        root = literal_rows(self.spark, [(0, "CATALOG", None)], "category_id, category_name, parent_category_id")
        root = root.selectExpr("CAST(category_id AS BIGINT) AS category_id", "category_name",
                               "CAST(parent_category_id AS BIGINT) AS parent_category_id")
        return leaf.drop("p_type").unionByName(middle).unionByName(root)

    def suppliers(self) -> DataFrame:
        nations = self.nations("n_name")
        return self.raw("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").selectExpr(
            "s_suppkey AS supplier_id",
            "s_name AS supplier_name",
            "concat(lower(replace(s_name, '#', '.')), '@supply.example') AS email",
            "coalesce(n_name, 'USA') AS country",
            "'NET30' AS payment_terms",
        )

    def employees(self) -> DataFrame:
        """Staff: one person per supplier contact; a tenth of the key is the manager."""
        nations = self.nations("n_regionkey")
        return self.raw("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").selectExpr(
            "s_suppkey AS employee_id",
            "replace(s_name, 'Supplier', 'Employee') AS employee_name",
            f"{case('n_regionkey', DEPARTMENT_OF_REGION, 'OTHER')} AS department",
            "if(s_suppkey < 10, 'MANAGER', 'CLERK') AS position",
            "TIMESTAMP_NTZ '1994-01-01' AS hire_date",
            "concat(lower(replace(s_name, '#', '.')), '@staff.example') AS email",
            "if(s_suppkey > 0, s_suppkey div 10, NULL) AS manager_id",
            "'Y' AS is_active",
        )

    def holidays(self) -> DataFrame:
        rows = literal_rows(self.spark, HOLIDAYS, "holiday_id, holiday_date, holiday_name, is_recurring")
        return rows.selectExpr("CAST(holiday_id AS BIGINT) AS holiday_id",
                               "CAST(holiday_date AS TIMESTAMP_NTZ) AS holiday_date", "holiday_name", "is_recurring")

    def promotions(self) -> DataFrame:
        rows = literal_rows(
            self.spark, PROMOTIONS,
            "promotion_id, promotion_name, discount_percent, start_date, end_date, minimum_order_amount, "
            "maximum_discount, applicable_category_id")
        kinds = {f.name: f.dataType.simpleString() for f in model_schema("promotions")}
        return rows.selectExpr(*[f"CAST({c} AS {kinds[c]}) AS {c}" for c in rows.columns])

    # -- facts ------------------------------------------------------------------

    def orders(self) -> DataFrame:
        amount = "CAST(o_totalprice AS DECIMAL(12,2))"
        discount = (f"if(o_orderpriority = '2-HIGH', CAST(round({amount} * 0.10BD, 2) AS DECIMAL(10,2)), "
                    "CAST(0 AS DECIMAL(10,2)))")
        tax = f"CAST(round({amount} * 0.08BD, 2) AS DECIMAL(10,2))"
        return self.raw("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "o_orderdate AS order_date",
            """CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'CANCELLED'
                    WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'RETURNED'
                    WHEN o_orderstatus = 'F' THEN 'DELIVERED'
                    WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'SHIPPED'
                    WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'PROCESSING' END AS status""",
            f"{amount} AS total_amount",
            f"{discount} AS discount_amount",
            f"{tax} AS tax_amount",
            f"CAST({amount} - {discount} + {tax} AS DECIMAL(12,2)) AS net_amount",
            "concat('Dock ', o_custkey) AS shipping_address",
            "concat('Desk ', o_custkey) AS billing_address",
            "o_custkey div 15 AS employee_id",
        )

    def items(self) -> DataFrame:
        """Order lines without a surrogate key: enough for every sum."""
        price = ("(2 * CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) + CAST(l_quantity AS BIGINT))"
                 " div (2 * CAST(l_quantity AS BIGINT))")
        lines = self.raw("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "CAST(l_quantity AS INT) AS quantity",
            f"CAST(CAST({price} AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(10,2)) AS unit_price",
            "CAST(CAST(l_discount AS DECIMAL(5,2)) * 100 AS DECIMAL(5,2)) AS discount_percent",
            "l_linenumber", "l_suppkey", "l_tax", "l_shipdate",
        )
        return lines.withColumn("line_total", line_total())

    @cached_property
    def large_orders(self) -> Hot:
        """The orders with more lines than one task should sort, looked for once."""
        return hot_groups(self.items(), ["order_id"])

    def keyed_items(self) -> DataFrame:
        """Order lines with a key: order id times 1000 plus the place of the line in its order."""
        # The product comes first so that even one very large order can be cut by ranges.
        order = ["product_id", "l_linenumber", "l_suppkey", "quantity", "unit_price", "discount_percent",
                 "l_tax", "l_shipdate"]
        numbered_lines = numbered(self.items().drop("line_total"), ["order_id"], order, "line_in_order", hot=self.large_orders)
        # The total is worked out behind the shuffle, so that all who read keyed lines in a query share one shuffle.
        return numbered_lines.withColumn("line_total", line_total()).selectExpr(
            "order_id * 1000 + line_in_order AS order_item_id", "order_id", "product_id", "quantity", "unit_price",
            "discount_percent", "line_total")

    def payments(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS payment_id",
            "o_orderkey AS order_id",
            "o_orderdate AS payment_date",
            "CAST(o_totalprice AS DECIMAL(12,2)) AS amount",
            f"{case('o_orderpriority', PAYMENT_METHOD_OF_PRIORITY, 'CHECK')} AS payment_method",
            "concat('TX', o_orderkey) AS transaction_id",
            f"{case('o_orderstatus', PAYMENT_STATUS_OF_ORDER, 'FAILED')} AS status",
        )

    def shipments(self) -> DataFrame:
        per_order = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.expr("min(l_shipdate) AS ship_date"), F.expr("max(l_shipdate) AS actual_delivery"),
            F.expr("min(l_linestatus) AS first_status"))
        return per_order.selectExpr(
            "l_orderkey AS shipment_id", "l_orderkey AS order_id", "ship_date", "actual_delivery",
            "concat('TRK', l_orderkey) AS tracking_number",
            "if(first_status = 'F', 'DELIVERED', 'PENDING') AS status")

    def purchases(self) -> DataFrame:
        """Purchase events as orders with a time of day, for hourly work."""
        return self.raw("events").filter("event_type = 'purchase'").selectExpr(
            "event_id AS order_id",
            "user_id AS customer_id",
            "ts AS order_date",
            "CASE WHEN value < 1 THEN 'CANCELLED' WHEN value < 40 THEN 'DELIVERED' ELSE 'PENDING' END AS status",
            "CAST(value AS DECIMAL(12,2)) AS net_amount",
        )

    def visits(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'view'").selectExpr("ts AS visit_ts")

    # -- audit ------------------------------------------------------------------

    def audit(self) -> DataFrame:
        weekday = "dayofweek(ts) NOT IN (1, 7)"
        return self.raw("events").selectExpr(
            "event_id AS audit_id",
            "user_id AS employee_id",
            f"{case('event_type', ACTION_OF_EVENT, 'SELECT')} AS action_type",
            f"{case('event_type', TABLE_OF_EVENT, 'OTHER')} AS table_name",
            "get_json_object(props, '$.k') AS record_id",
            "date_format(ts, 'EEEE') AS day_of_week",
            f"if({holiday_test('CAST(ts AS DATE)', HOLIDAYS)}, 'Y', 'N') AS is_holiday",
            f"if({weekday}, 'Y', 'N') AS is_weekday",
            f"""CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'click' AND {weekday} THEN 'DENIED'
                     ELSE 'ALLOWED' END AS status""",
            f"""CASE WHEN event_type = 'error' AND value < 10 THEN 'missing permission on table'
                     WHEN event_type = 'error' AND value < 20 THEN 'access denied by policy'
                     WHEN event_type = 'error' THEN 'lock timeout'
                     WHEN event_type = 'click' AND {weekday} THEN 'employee not authorized on weekdays' END
                AS error_message""",
            "concat('U', user_id % 20) AS session_user",
            "ts AS action_timestamp",
            "concat('10.0.0.', user_id % 250) AS ip_address",
        )

    def actions(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS action_id",
            "user_id AS employee_id",
            "ts AS action_date",
            f"{case('event_type', ACTION_OF_EVENT, 'SELECT')} AS action_type",
            "concat('event ', event_type) AS description",
            "CAST(value AS DECIMAL(12,2)) AS amount",
        )


def case(column: str, table: dict, default: str) -> str:
    """A fixed mapping as the text of a CASE expression."""
    def literal(value):
        return str(value) if isinstance(value, int) else f"'{value}'"

    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {literal(default)} END"


CATEGORY_CODE = f"CAST({case('p_type', CATEGORY_CODES, 0)} AS BIGINT)"


def holiday_test(date: str, holidays: list[tuple]) -> str:
    """True on a listed day, or on the same month and day for recurring ones."""
    tests = []
    for _, on, _, recurring in holidays:
        year, month, day = (int(x) for x in on.split("-"))
        if recurring == "Y":
            tests.append(f"(month({date}) = {month} AND day({date}) = {day})")
        else:
            tests.append(f"{date} = DATE '{on}'")
    return " OR ".join(tests) or "FALSE"
