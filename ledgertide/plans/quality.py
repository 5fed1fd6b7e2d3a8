"""Data-quality checks: each gives the number of violations and the rows checked.

All row rules of one table are counted in a single pass over that table; references are anti
joins, and uniqueness is one grouped count.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import rules
from ledgertide.functions.compat import parse_moment
from ledgertide.operators.joins import parent_chains

RESULT = "table_name string, rule string, kind string, checked bigint, violations bigint"


def outside(column: str, domain: tuple) -> str:
    return f"{column} NOT IN ({', '.join(repr(x) for x in domain)})"


# Table to rule name to (kind, test for a violation). NULL counts only for required columns.
# `:now` stands for the time of the check.
ROW_RULES = {
    "customers": {
        "segment domain": ("DOMAIN", outside("customer_segment", rules.SEGMENTS)),
        "total spent not negative": ("RANGE", "total_spent < 0"),
        "key present": ("REQUIRED", "customer_id IS NULL"),
        "name and email present": ("REQUIRED", "customer_name IS NULL OR email IS NULL"),
        "join date not in future": ("FUTURE", "join_date > :now"),
    },
    "products": {
        "status domain": ("DOMAIN", outside("status", rules.PRODUCT_STATUSES)),
        "price positive": ("RANGE", "unit_price <= 0"),
        "cost positive": ("RANGE", "unit_cost <= 0"),
        "stock not negative": ("RANGE", "stock_quantity < 0"),
        "reorder level not negative": ("RANGE", "reorder_level < 0"),
        "price covers cost": ("CROSS", "unit_price < unit_cost"),
        "name present": ("REQUIRED", "product_name IS NULL"),
    },
    "orders": {
        "status domain": ("DOMAIN", outside("status", rules.ORDER_STATUSES + rules.COMPUTED_ORDER_STATUSES)),
        "total positive": ("RANGE", "total_amount <= 0"),
        "discount within half of total": ("CROSS", f"discount_amount > total_amount * {rules.MAX_DISCOUNT_SHARE}"),
        "customer present": ("REQUIRED", "customer_id IS NULL"),
        "order date not in future": ("FUTURE", "order_date > :now"),
    },
    "order_items": {
        "quantity positive": ("RANGE", "quantity <= 0"),
        "price positive": ("RANGE", "unit_price <= 0"),
        "discount between 0 and 100": ("RANGE", "discount_percent NOT BETWEEN 0 AND 100"),
    },
    "payments": {
        "method domain": ("DOMAIN", outside("payment_method", rules.PAYMENT_METHODS)),
        "status domain": ("DOMAIN", outside("status", rules.PAYMENT_STATUSES)),
        "amount positive": ("RANGE", "amount <= 0"),
    },
    "shipments": {
        "status domain": ("DOMAIN", outside("status", rules.SHIPMENT_STATUSES)),
        "delivery not before shipping": ("CROSS", "actual_delivery < ship_date"),
        "ship date not in future": ("FUTURE", "ship_date > :now"),
    },
    "employees": {
        "department domain": ("DOMAIN", outside("department", rules.DEPARTMENTS)),
        "active flag domain": ("DOMAIN", outside("is_active", ("Y", "N"))),
        "not own manager": ("CROSS", "manager_id = employee_id"),
        "hire date not in future": ("FUTURE", "hire_date > :now"),
    },
    "suppliers": {"payment terms domain": ("DOMAIN", outside("payment_terms", rules.PAYMENT_TERMS))},
    "promotions": {
        "discount between 1 and 100": ("RANGE", "discount_percent NOT BETWEEN 1 AND 100"),
        "end after start": ("CROSS", "end_date <= start_date"),
    },
    "holidays": {
        "recurring flag domain": ("DOMAIN", outside("is_recurring", ("Y", "N"))),
        "not on a weekend": ("CROSS", "dayofweek(holiday_date) IN (1, 7)"),
    },
    "categories": {"not own parent": ("CROSS", "parent_category_id = category_id")},
    "audit_log": {
        "action domain": ("DOMAIN", outside("action_type", rules.AUDIT_ACTIONS)),
        "no old value on insert": ("CROSS", "action_type = 'INSERT' AND old_value IS NOT NULL"),
        "no new value on delete": ("CROSS", "action_type = 'DELETE' AND new_value IS NOT NULL"),
    },
    "returns": {
        "type domain": ("DOMAIN", outside("return_type", rules.RETURN_TYPES)),
        "status domain": ("DOMAIN", outside("status", rules.RETURN_STATUSES)),
        "quantity positive": ("RANGE", "return_quantity <= 0"),
    },
    "refunds": {
        "method domain": ("DOMAIN", outside("refund_method", rules.REFUND_CHANNELS)),
        "status domain": ("DOMAIN", outside("status", rules.REFUND_STATUSES)),
    },
    "exchanges": {
        "status domain": ("DOMAIN", outside("status", rules.EXCHANGE_STATUSES)),
        "products present": ("REQUIRED", "original_product_id IS NULL OR exchange_product_id IS NULL"),
    },
    "change_log": {"change time not in future": ("FUTURE", "change_timestamp > :now")},
}


def check_rows(table: str, df: DataFrame, as_of, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Every row rule of one table in one aggregate, one result row per rule."""
    chosen = {n: r for n, r in ROW_RULES[table].items() if kinds is None or r[0] in kinds}
    now = f"TIMESTAMP_NTZ '{parse_moment(as_of)}'"
    tests = [f"count_if({test.replace(':now', now)}) AS v{i}" for i, (_, test) in enumerate(chosen.values())]
    counted = df.agg(F.expr("count(1) AS checked"), *[F.expr(t) for t in tests])
    lines = ", ".join(f"'{name}', '{kind}', v{i}" for i, (name, (kind, _)) in enumerate(chosen.items()))
    return counted.selectExpr(
        f"'{table}' AS table_name", "checked", f"stack({len(chosen)}, {lines}) AS (rule, kind, violations)"
    ).select("table_name", "rule", "kind", "checked", "violations")


def check_tables(tables: dict[str, DataFrame], as_of, kinds: tuple[str, ...] | None = None) -> DataFrame:
    parts = [
        check_rows(name, df, as_of, kinds)
        for name, df in tables.items()
        if kinds is None or any(k in kinds for k, _ in ROW_RULES[name].values())
    ]
    return reduce(DataFrame.unionByName, parts)


def _result(df: DataFrame, table: str, rule: str, kind: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), "checked", "violations"
    )


# Foreign keys of the model: child, column, parent, parent key.
REFERENCES = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("orders", "employee_id", "employees", "employee_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("products", "category_id", "categories", "category_id"),
    ("products", "supplier_id", "suppliers", "supplier_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("shipments", "order_id", "orders", "order_id"),
    ("returns", "order_id", "orders", "order_id"),
    ("returns", "product_id", "products", "product_id"),
    ("refunds", "return_id", "returns", "return_id"),
    ("exchanges", "return_id", "returns", "return_id"),
    ("categories", "parent_category_id", "categories", "category_id"),
    ("employees", "manager_id", "employees", "employee_id"),
    ("promotions", "applicable_category_id", "categories", "category_id"),
    ("employee_audit_log", "employee_id", "employees", "employee_id"),
)


def check_reference(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child keys are counted per value first, so a frequent value meets the parent once."""
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    known = parent.select(F.col(key).alias("_known")).distinct()
    return used.join(known, F.col("_key") == F.col("_known"), "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("violations"),
    )


def check_references(tables: dict[str, DataFrame], children: tuple[str, ...] | None = None) -> DataFrame:
    """Every reference between the given tables, or only those of `children`."""
    parts = [
        _result(check_reference(tables[child], column, tables[parent], key), child, f"{column} in {parent}", "REFERENCE")
        for child, column, parent, key in REFERENCES
        if child in (children or tables) and child in tables and parent in tables
    ]
    return reduce(DataFrame.unionByName, parts)


# Unique keys of the model.
UNIQUE_KEYS = (
    ("customers", ("email",)),
    ("suppliers", ("email",)),
    ("employees", ("email",)),
    ("categories", ("category_name",)),
    ("payments", ("transaction_id",)),
    ("shipments", ("tracking_number",)),
    ("shipments", ("order_id",)),
    ("order_items", ("order_id", "product_id")),
    ("holidays", ("holiday_date",)),
)


def check_unique(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows beyond the first of each key; rows with a NULL in the key do not take part."""
    groups = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"),
    )


def check_uniqueness(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        _result(check_unique(tables[t], cols), t, "unique " + ", ".join(cols), "UNIQUE")
        for t, cols in UNIQUE_KEYS
        if t in tables
    ]
    return reduce(DataFrame.unionByName, parts)


# The smallest row counts that count as loaded.
ROW_THRESHOLDS = {"customers": 20, "products": 15, "orders": 10, "order_items": 20}


def check_row_counts(tables: dict[str, DataFrame], thresholds: dict[str, int] | None = None) -> DataFrame:
    parts = [
        _result(
            tables[t].agg(F.count(F.lit(1)).alias("checked")).withColumn(
                "violations", F.when(F.col("checked") >= least, 0).otherwise(1).cast("bigint")
            ),
            t, f"at least {least} rows", "ROWS",
        )
        for t, least in (thresholds or ROW_THRESHOLDS).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def check_documented(tables: dict[str, DataFrame]) -> DataFrame:
    """Rules across tables: payment within the order, list price at order time, free shipping."""
    orders = tables["orders"].select("order_id", "net_amount")
    paid = (
        tables["payments"].select("order_id", "amount").join(orders, "order_id")
        .agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("amount") > F.col("net_amount")).alias("violations"))
    )
    priced = (
        tables["order_items"].groupBy("product_id", "unit_price").agg(F.count(F.lit(1)).alias("n"))
        .join(tables["products"].select("product_id", F.col("unit_price").alias("list_price")), "product_id")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
             F.coalesce(F.sum(F.when(F.col("unit_price") != F.col("list_price"), F.col("n"))), F.lit(0))
             .alias("violations"))
    )
    parts = [
        _result(paid, "payments", "amount within order net", "DOCUMENTED"),
        _result(priced, "order_items", "price equals product price", "DOCUMENTED"),
    ]
    if "shipping_cost" in tables["shipments"].columns:
        shipped = (
            tables["shipments"].join(orders, "order_id")
            .agg(F.count(F.lit(1)).alias("checked"),
                 F.count_if((F.col("net_amount") > rules.FREE_SHIPPING_ABOVE) & (F.col("shipping_cost") > 0))
                 .alias("violations"))
        )
        parts.append(_result(shipped, "shipments", "free shipping above limit", "DOCUMENTED"))
    return reduce(DataFrame.unionByName, parts)


def check_hierarchy(categories: DataFrame, max_depth: int = rules.MAX_CATEGORY_DEPTH) -> DataFrame:
    chains = parent_chains(categories, "category_id", "parent_category_id", "category_name")
    bad = (F.col("depth") > max_depth) | ~F.col("complete")
    counted = chains.agg(F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("violations"))
    return _result(counted, "categories", f"at most {max_depth} levels", "HIERARCHY")


def check_returns(booked: dict[str, DataFrame], orders: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """Row rules, references and change times of what `process_returns` has booked."""
    made = {name: booked[name] for name in ("returns", "refunds", "exchanges")}
    return check_tables(made | {"change_log": booked["audit"]}, as_of).unionByName(
        check_references(made | {"orders": orders, "products": products}, children=tuple(made)))


# -- all checks in one pass ---------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """One check of a plan: `how` is row (a test), unique, reference or rows (a least number of rows)."""

    table: str
    rule: str
    kind: str
    how: str
    test: str = ""
    columns: tuple[str, ...] = ()
    parent: str = ""
    parent_key: str = ""
    least: int = 0


def check_plan(tables: dict[str, DataFrame], thresholds: dict[str, int] | None = None) -> list[Check]:
    """Every row rule, reference, uniqueness and row-count check that the given tables allow."""
    plan = [
        Check(t, name, kind, "row", test=test)
        for t in tables for name, (kind, test) in ROW_RULES.get(t, {}).items()
    ]
    plan += [
        Check(child, f"{column} in {parent}", "REFERENCE", "reference", columns=(column,), parent=parent, parent_key=key)
        for child, column, parent, key in REFERENCES if child in tables and parent in tables
    ]
    plan += [Check(t, "unique " + ", ".join(cols), "UNIQUE", "unique", columns=cols) for t, cols in UNIQUE_KEYS if t in tables]
    least = thresholds or ROW_THRESHOLDS
    return plan + [Check(t, f"at least {n} rows", "ROWS", "rows", least=n) for t, n in least.items() if t in tables]


def _key_text(columns: tuple[str, ...]) -> Column:
    """The values of a key as one text, NULL where one of them is."""
    first, *rest = [F.col(c).cast("string") for c in columns]
    return F.concat(F.length(first).cast("string"), F.lit(":"), first, *rest) if rest else first


def run_plan(tables: dict[str, DataFrame], plan: list[Check], as_of) -> DataFrame:
    """The results of all checks of a plan, each table scanned once.

    A row tells what it has to say to the checks of its table: a mark per rule that it breaks, its key per uniqueness
    and reference check (also as the parent of other tables), and one mark for being there. One grouping by check and
    key, summed up before its shuffle, then counts repeated keys and keys without a parent.
    """
    now = f"TIMESTAMP_NTZ '{parse_moment(as_of)}'"
    nothing = F.lit(None).cast("string")

    def mark(number: int, key: Column, parent: bool = False) -> Column:
        return F.struct(F.lit(number).alias("number"), key.alias("key"), F.lit(parent).alias("parent"))

    told = []
    names = sorted({c.table for c in plan} | {c.parent for c in plan if c.parent})
    there = {t: -1 - k for k, t in enumerate(names)}
    for t in names:
        marks = [mark(there[t], nothing)]
        for number, check in enumerate(plan):
            if check.table == t and check.how == "row":
                marks.append(F.when(F.expr(check.test.replace(":now", now)), mark(number, nothing)))
            if check.table == t and check.how in ("unique", "reference"):
                key = _key_text(check.columns)
                marks.append(F.when(key.isNotNull(), mark(number, key)))
            if check.parent == t:
                key = _key_text((check.parent_key,))
                marks.append(F.when(key.isNotNull(), mark(number, key, True)))
        told.append(tables[t].select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*"))
    keys = reduce(DataFrame.unionByName, told).groupBy("number", "key").agg(
        F.count_if(~F.col("parent")).alias("n"), F.bool_or("parent").alias("known")
    )
    sums = keys.groupBy("number").agg(
        F.sum("n").alias("n"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("repeated"),
        F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0)).alias("orphans"),
    )  # a row per check
    listed = tables[names[0]].sparkSession.createDataFrame(
        [(k, there[c.table], c.table, c.rule, c.kind, c.how, c.least) for k, c in enumerate(plan)],
        "number INT, there INT, table_name STRING, rule STRING, kind STRING, how STRING, least BIGINT",
    )
    one = sums.agg(F.map_from_entries(F.collect_list(F.struct("number", F.struct("n", "repeated", "orphans")))).alias("found"))
    zero = F.lit(0).cast("bigint")
    joined = listed.crossJoin(one).select(
        "*", *[F.coalesce(F.element_at("found", F.col("number"))[c], zero).alias(f"_{c}") for c in ("n", "repeated", "orphans")],
        F.coalesce(F.element_at("found", F.col("there"))["n"], zero).alias("_rows"),
    )
    own = F.col("how").isin("unique", "reference")
    return joined.select(
        "table_name", "rule", "kind", F.when(own, F.col("_n")).otherwise(F.col("_rows")).alias("checked"),
        F.when(F.col("how") == "row", F.col("_n")).when(F.col("how") == "unique", F.col("_repeated"))
        .when(F.col("how") == "reference", F.col("_orphans"))
        .otherwise(F.when(F.col("_rows") >= F.col("least"), 0).otherwise(1)).cast("bigint").alias("violations"),
    )


def check_all(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """Every check that the given tables allow; a table is scanned once, or twice where a rule crosses tables."""
    return (
        run_plan(tables, check_plan(tables), as_of)
        .unionByName(check_documented(tables))
        .unionByName(check_hierarchy(tables["categories"]))
    )


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(F.col("violations") == 0).alias("passed"),
        F.count_if(F.col("violations") > 0).alias("failed"),
    )


def validation_report(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """The sixteen named tests with their texts; references are really tested here."""
    lines = [
        (t, f"at least {least} rows", f"{t.upper()} table has data", "", " rows", None) for t, least in ROW_THRESHOLDS.items()
    ] + [
        ("orders", "customer_id in customers", "Orders reference valid customers", "All ", " orders valid", "Unknown customers found"),
        ("order_items", "order_id in orders", "Order items reference valid orders", "All ", " items valid", "Unknown orders found"),
        ("order_items", "product_id in products", "Order items reference valid products", "All ", " items valid",
         "Unknown products found"),
        ("customers", "unique email", "Customer emails are unique", "All unique", None, "Duplicates found"),
        ("orders", "total positive", "Order amounts are positive", "All > 0", None, "Negative found"),
        ("orders", "status domain", "Order status values valid", "All valid", None, "Invalid found"),
        ("orders", "discount within half of total", "Discounts within 50% limit", "All within limit", None, "Exceeds limit"),
        ("products", "price covers cost", "Product price >= cost", "All valid", None, "Price < cost"),
        ("customers", "segment domain", "Customer segments valid", "All valid", None, "Invalid segments"),
        ("customers", "key present", "No NULL primary keys", "All PKs populated", None, "NULL PKs found"),
        ("customers", "name and email present", "Required fields populated", "All required filled", None, "Missing data"),
        ("orders", "order date not in future", "Date fields valid", "All dates valid", None, "Invalid dates"),
    ]
    wanted = {(t, rule) for t, rule, *_ in lines}
    found = run_plan(tables, [c for c in check_plan(tables) if (c.table, c.rule) in wanted], as_of)
    texts = found.sparkSession.createDataFrame(
        lines, "table_name STRING, rule STRING, test STRING, before STRING, after STRING, poor STRING"
    )
    count = (F.col("checked") - F.when(F.col("kind") == "ROWS", 0).otherwise(F.col("violations"))).cast("string")
    good = F.when(F.col("after").isNull(), F.col("before")).otherwise(F.concat("before", count, "after"))
    passed = F.col("violations") == 0
    return texts.join(found, ["table_name", "rule"]).select(
        "test",
        F.when(passed, good).otherwise(F.coalesce("poor", good)).alias("result"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
    )


def publishable(results: DataFrame) -> bool:
    """True when a staged load has no violation: one small aggregate decides."""
    return results.filter(F.col("violations") > 0).isEmpty()
