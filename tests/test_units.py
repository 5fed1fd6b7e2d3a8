"""Calendar and text semantics, sources, sinks, quality checks, audit fixtures and streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgertide.functions import compat as c
from ledgertide.operators.joins import active_on, best_promotion, parent_chains
from ledgertide.plans import audit as a
from ledgertide.plans import quality as q
from ledgertide.sources import tables as t
from ledgertide.sources.model import Model
from ledgertide.streaming import enforcement
from tests.helpers import D, customer, item, order, product, rows, table


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("start, months, want", [
    ("2025-02-28 08:30:00", -1, "2025-01-31 08:30:00"), ("2025-01-31 00:00:00", 1, "2025-02-28 00:00:00"),
    ("2024-03-15 23:59:59", 12, "2025-03-15 23:59:59"), ("2025-12-05 00:00:00", -12, "2024-12-05 00:00:00"),
    ("2024-01-30 00:00:00", 1, "2024-02-29 00:00:00"), ("2024-02-29 00:00:00", 12, "2025-02-28 00:00:00")])
def test_add_months(spark, start, months, want):
    want = dt.datetime.fromisoformat(want)
    assert c.shift_months(start, months) == want
    assert one(spark, c.add_months(c.moment(start), months)) == want


def test_number_and_text(spark):
    assert one(spark, c.months_between(c.moment("2025-02-28"), c.moment("2025-01-31"))) == 1.0
    assert one(spark, c.months_between(c.moment("2025-03-15 12:00:00"), c.moment("2025-01-31"))) == 1.5
    assert one(spark, c.text_of(F.lit(None), F.lit(", Chicago"))) == ", Chicago"
    for value, want in (("310.00", "310"), ("0.50", ".5"), ("-0.25", "-.25"), ("100", "100"), ("3037.97", "3037.97")):
        assert one(spark, c.number_text(F.lit(value))) == want
    assert one(spark, c.percent(F.lit(1), F.lit(0))) is None
    assert one(spark, c.ratio(F.lit(-5), F.lit(1000), 1, 2)) == D("-0.01")
    assert one(spark, c.days_between(c.moment("2025-01-02 12:00:00"), c.moment("2025-01-01"))) == 1.5


def test_null_order(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert rows(df.orderBy(*c.oldest("x"))) == [(1,), (2,), (None,)]
    assert rows(df.orderBy(*c.newest("x"))) == [(None,), (2,), (1,)]


# -- sources and sinks --------------------------------------------------------------------


def test_read_table_fills_and_derives(spark, tmp_path):
    raw = table(spark, "orders", [order(1, status=None, discount=None, total="10.00", tax="0.80")]).drop("net_amount")
    raw.write.parquet(str(tmp_path / "o"))
    got = t.read_table(spark, str(tmp_path / "o"), "orders").first()
    assert (got.status, got.discount_amount, got.net_amount) == ("PENDING", D("0.00"), D("10.80"))


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "p")
    base = table(spark, "products", [product(1, "A", stock=5), product(2, "B", stock=7)])
    t.publish_version(base, folder)
    read = t.read_version(spark, folder, "products")
    deltas = spark.createDataFrame([(1, 3, "NEW NAME")], "product_id bigint, d bigint, n string")
    changed = t.apply_changes(read, "product_id", deltas, add={"stock_quantity": "d"}, replace={"product_name": "n"})
    assert t.publish_version(changed, folder).endswith("v00000002")
    now = t.read_version(spark, folder, "products")
    assert sorted(rows(now, "product_id", "product_name", "stock_quantity")) == [(1, "NEW NAME", 8), (2, "B", 7)]
    (tmp_path / "p" / "v00000003").mkdir()
    assert t.current_version(spark, folder) == 2


def test_batches_archive_and_gate(spark, tmp_path):
    df = spark.range(5).withColumn("ts", c.moment("2024-01-15"))
    paths = t.publish_batch({"x": df}, str(tmp_path), "7")
    t.publish_batch({"x": df}, str(tmp_path), "7")
    assert spark.read.parquet(paths["x"]).count() == 5
    with pytest.raises(Exception):
        t.publish_batch({"x": df, "y": df.select(F.raise_error(F.lit("broken")).alias("y"))}, str(tmp_path), "8")
    assert t.read_batches(spark, str(tmp_path), "x").count() == 5
    t.write_archive(df, "ts", str(tmp_path / "arch"))
    assert spark.read.parquet(str(tmp_path / "arch")).filter("archive_month = '2024-01'").count() == 5
    later = df.withColumn("ts", F.expr("ts + interval 1 month"))
    t.write_archive(later, "ts", str(tmp_path / "arch"))
    assert spark.read.parquet(str(tmp_path / "arch")).count() == 10
    t.append(df, str(tmp_path / "log")), t.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10
    bad = spark.createDataFrame([(1,)], "violations bigint")
    assert t.publish_if_clean(df, bad, str(tmp_path / "gate")) is None
    assert t.publish_if_clean(df, bad.filter("violations = 0"), str(tmp_path / "gate"))


def test_keys_columns_and_rows(spark):
    df = spark.createDataFrame([("b",), ("a",)], "x string")
    have = spark.createDataFrame([(41,)], "id bigint")
    assert sorted(rows(t.with_surrogate_key(df, ["x"], "id", existing=have), "x", "id")) == [("a", 42), ("b", 43)]
    assert t.with_hash_key(df, ["x"], "k").select("k").distinct().count() == 2
    people = table(spark, "customers", [customer(1, "A")]).select("customer_id")
    assert rows(t.add_missing_columns(people, t.RETURN_HISTORY)) == [(1, D("0.00"), 0, None, D("0.00"))]
    assert t.one_row(spark).count() == 1
    zipped = t.zip_arrays(spark.sql("SELECT 1 AS r, array(5L, 6L) AS p, array(1L) AS q"), "p", "q", ["r"], ["p", "q"])
    assert sorted(rows(zipped)) == [(1, 0, 5, 1), (1, 1, 6, None)]
    assert c.empty(spark, "a int").count() == 0


# -- joins --------------------------------------------------------------------------------


def test_promotions(spark):
    orders = table(spark, "orders", [order(1, date="2025-06-01", total="100"), order(2, date="2025-08-31", total="40"),
                                     order(3, date="2025-03-01", total="100"), order(4, date="2024-12-31", total="100")])
    items = table(spark, "order_items", [item(1, 1, 1, 1, "90.00"), item(2, 3, 1, 1, "60.00"), item(3, 3, 2, 1, "40.00")])
    goods = table(spark, "products", [product(1, "A", category=1), product(2, "B", category=2)])
    promos = table(spark, "promotions", [
        dict(promotion_id=1, promotion_name="Summer", discount_percent=15, start_date="2025-06-01", end_date="2025-08-31",
             minimum_order_amount=50),
        dict(promotion_id=2, promotion_name="Electronics", discount_percent=10, start_date="2025-01-01",
             end_date="2025-12-31", applicable_category_id=1, maximum_discount=5)])
    out = best_promotion(orders, items, goods, promos)
    assert sorted(rows(out, "order_id", "promotion_id", "promotion_discount")) == [(1, 1, D("15.00")), (3, 2, D("5.00"))]


def test_interval_index(spark):
    """Intervals of all lengths, empty and open ones, against every pair."""
    draw = random.Random(4)
    day = lambda k: None if k is None else str(dt.datetime(2024, 1, 1) + dt.timedelta(days=k))
    made = [(k, draw.choice([None, *range(-900, 900)]), draw.choice([None, *range(-900, 900)])) for k in range(150)]
    made += [(200, 5, 5), (201, 6, 5), (202, None, None), (203, 0, None), (204, None, 0), (205, -1000, 1000)]
    spans = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in made], "id INT, a STRING, b STRING").select(
        "id", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    asked = spark.range(-1200, 1200, 7).select(F.expr("CAST(id AS INT)").alias("k")).withColumn(
        "_day", F.datediff(F.expr("date_add(DATE '2024-01-01', k)"), F.lit("0001-01-01").cast("date")))
    found = active_on(asked.select("_day").distinct(), spans, "a", "b").join(asked, "_day")
    want = {(k, i) for k in range(-1200, 1200, 7) for i, a, b in made if (a is None or a <= k) and (b is None or k <= b)}
    got = [(r.k, r.id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_open_promotions(spark):
    orders = table(spark, "orders", [order(1, date="2025-06-01", total="100"), order(2, date="1990-01-01", total="100")])
    items = table(spark, "order_items", [item(1, 1, 1, 1, "90.00")])
    goods = table(spark, "products", [product(1, "A", category=1)])
    promos = table(spark, "promotions", [dict(promotion_id=1, promotion_name="Open", discount_percent=5, start_date="2025-01-01"),
                                         dict(promotion_id=2, promotion_name="Old", discount_percent=9, end_date="2000-01-01")])
    out = best_promotion(orders, items, goods, promos)
    assert sorted(rows(out, "order_id", "promotion_id", "promotion_discount")) == [(1, 1, D("5.00")), (2, 2, D("9.00"))]


def test_parent_chains(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, 6, "x"), (6, 5, "y"),
                                   (7, 99, "z")], "id bigint, up bigint, name string")
    out = {r.id: (r.depth, r.root_id, r.path, r.complete) for r in
           parent_chains(nodes, "id", "up", "name").collect()}
    assert out[1] == (1, 1, "a", True) and out[4] == (4, 1, "a / b / c / d", True)
    assert not out[5][3] and not out[7][3]


def test_long_parent_chain(spark):
    nodes = spark.range(1, 41).selectExpr("id", "nullif(id - 1, 0) AS up", "cast(id AS string) AS name")
    out = {r.id: r for r in parent_chains(nodes, "id", "up", "name").collect()}
    assert all(r.depth == k and r.root_id == 1 and r.complete for k, r in out.items())
    assert out[40].path == " / ".join(map(str, range(1, 41)))


# -- audit --------------------------------------------------------------------------------


def log(spark, made):
    return table(spark, "employee_audit_log", [
        dict(audit_id=i, employee_id=e, action_timestamp=ts, action_type=kind, table_name="ORDERS", status="ALLOWED",
             session_user="U1") for i, e, ts, kind in made])


def test_patterns(spark):
    made = [(1, 1, "2025-01-01 10:00:00", "INSERT"), (2, 1, "2025-01-01 10:00:00", "UPDATE"),
            (3, 1, "2025-01-02 10:00:00", "DELETE")]
    made += [(10 + i, 2, f"2025-01-01 10:{i * 30 // 60:02d}:{i * 30 % 60:02d}", "SELECT") for i in range(11)]
    for group_rows in (None, 3):
        got = dict(rows(a.suspicious_patterns(log(spark, made), group_rows=group_rows), "audit_id", "activity_pattern"))
        assert got[3] == "SUSPICIOUS_PATTERN"
        assert got[20] == "HIGH_FREQUENCY"  # the eleventh within five minutes, bounds included
        assert [k for k, v in got.items() if v != "NORMAL"] in ([3, 20], [20, 3])


def test_orphans_gaps_and_windows(spark):
    staff = table(spark, "employees", [dict(employee_id=i, employee_name=f"E{i}", department="IT", position="X",
                                            hire_date="2020-01-01", email="e", is_active="Y") for i in (1, 2, 3)])
    entries = log(spark, [(1, 1, "2025-01-01 10:00:00", "INSERT"), (2, None, "2025-01-03 10:00:00", "UPDATE"),
                          (3, 9, "2025-01-03 11:00:00", "DELETE"), (4, 1, "2025-01-03 12:00:00", "DELETE")])
    assert sorted(r[0] for r in rows(a.orphan_entries(entries, staff), "audit_id")) == [2, 3]
    assert [str(r[0])[:10] for r in rows(a.audit_gaps(entries, "2025-01-05"), "audit_date")] == [
        "2025-01-05", "2025-01-04", "2025-01-02"]
    ends = rows(a.first_last_audit(staff, entries), "employee_id", "first_audit_time")
    assert len(ends) == 4 and sorted(e for e, x in ends if x is None) == [2, 3]
    for size in (None, 1):
        ranks = {r.employee_id: (r.activity_rank_dept, r.activity_rank_overall) for r in
                 a.employee_activity_rank(staff, entries, group_rows=size).collect()}
        assert ranks == {1: (1, 1), 2: (2, 2), 3: (2, 2)}
        tiles = {r.employee_id: r.activity_quartile for r in a.activity_quartiles(staff, entries, size).collect()}
        assert tiles == {1: 1, 2: 2, 3: 3}


def changes(spark, made):
    df = spark.createDataFrame(made, "change_id bigint, ts string, employee_id bigint, operation string")
    return df.select("change_id", F.col("ts").cast("timestamp_ntz").alias("change_ts"), F.lit("ann").alias("user_name"),
                     "employee_id", F.lit("ORDERS").alias("table_name"), "operation",
                     (F.col("change_id") + 100).alias("order_id"), F.lit(7).cast("bigint").alias("customer_id"))


def holidays(spark):
    return table(spark, "holidays", [
        dict(holiday_id=1, holiday_date="2024-02-29", holiday_name="Leap", is_recurring="Y"),
        dict(holiday_id=2, holiday_date="2025-12-25", holiday_name="Christmas", is_recurring="Y"),
        dict(holiday_id=3, holiday_date="2025-07-05", holiday_name="Once", is_recurring="N")])


CASES = [(1, "2025-12-05 10:00:00", 1, "INSERT"),  # Friday
         (2, "2025-12-06 10:00:00", 1, "UPDATE"),  # Saturday
         (3, "2027-12-25 10:00:00", 1, "DELETE"),  # Saturday and recurring holiday
         (4, "2025-07-05 10:00:00", 1, "INSERT"),  # Saturday and holiday of one year
         (5, "2026-07-05 10:00:00", 1, "INSERT"),  # Sunday a year later
         (6, "2025-12-05 10:00:00", None, "INSERT")]


def test_calendar_rule(spark):
    decide = lambda **kw: dict(rows(a.calendar_rule(changes(spark, CASES), holidays(spark), **kw),
                                    "change_id", "error_message"))
    assert decide() == {1: "INSERT is not allowed on weekdays", 2: None, 3: "DELETE is not allowed on holidays",
                        4: "INSERT is not allowed on holidays", 5: None, 6: None}
    weekend = decide(blocked_days="WEEKEND")
    assert weekend[1] is None and weekend[2] == "UPDATE is not allowed on weekends" and weekend[6] is None
    nobody = spark.createDataFrame([(1, 1, "X", "N")], "restriction_id bigint, employee_id bigint, "
                                   "restriction_type string, is_active string")
    assert set(decide(restrictions=nobody).values()) == {None}
    parts = a.split_changes(a.calendar_rule(changes(spark, CASES), holidays(spark)))
    assert sorted(r[0] for r in rows(parts["allowed"], "change_id")) == [2, 5, 6]
    assert ("Emp_ID: 1, Cust_ID: 7",) in rows(parts["violations"], "attempted_values")
    assert ("Order: 103, Emp: 1",) in rows(parts["violations"], "attempted_values")
    assert sorted(rows(parts["audit"], "change_id", "operation_type")) == [
        (1, "BLOCKED"), (3, "BLOCKED"), (4, "BLOCKED"), (5, "INSERT")]
    held = table(spark, "orders", [order(103, status="SHIPPED", employee_id=9)])
    logged = a.split_changes(a.calendar_rule(changes(spark, CASES), holidays(spark)), held)["audit"]
    values = {r.change_id: (r.old_values, r.new_values) for r in logged.collect()}
    assert values[3] == ("Order: 103, Emp: 9, Status: SHIPPED, Total: 100.00", None)
    assert values[1] == (None, "Attempted INSERT: Emp 1, Cust 7")
    assert values[5][0] is None and values[5][1].endswith("INSERT check passed")


def test_change_capture(spark):
    old = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id bigint, s string")
    new = spark.createDataFrame([(1, "A"), (2, "C"), (3, None), (4, "D")], "id bigint, s string")
    out = a.change_capture(old, new.filter("id <> 1"), "id", {"Order": "id", "Status": "s"})
    assert sorted(rows(out)) == [("1", "DELETE", "Order: 1, Status: A", None),
                                 ("2", "UPDATE", "Order: 2, Status: B", "Order: 2, Status: C"),
                                 ("4", "INSERT", None, "Order: 4, Status: D")]


# -- quality ------------------------------------------------------------------------------


def test_quality_finds_faults(spark):
    people = table(spark, "customers", [customer(1, "A", "IRON", join="2030-01-01"), customer(1, None)])
    found = {r.rule: r.violations for r in q.check_rows("customers", people, "2025-12-05").collect()}
    assert found == {"segment domain": 1, "total spent not negative": 0, "key present": 0, "name and email present": 1,
                     "join date not in future": 1}
    orders = table(spark, "orders", [order(1, 5), order(2, 5), order(3, 1, discount="60")])
    assert rows(q.check_reference(orders, "customer_id", people, "customer_id")) == [(3, 2)]
    assert rows(q.check_unique(people, ("email",))) == [(2, 1)]
    found = {r.rule: r.violations for r in q.check_rows("orders", orders, "2025-12-05 12:00:00").collect()}
    assert found["discount within half of total"] == 1 and found["order date not in future"] == 0
    deep = table(spark, "categories", [dict(category_id=i, category_name=f"c{i}", parent_category_id=i - 1 or None)
                                       for i in range(1, 6)])
    assert rows(q.check_hierarchy(deep), "violations") == [(2,)]
    assert not q.publishable(q.check_hierarchy(deep))


def test_all_checks_in_one_pass(spark, tmp_path):
    """The plan finds what the single checks find, and reads each table once."""
    given = {
        "customers": table(spark, "customers", [customer(1, "A", "IRON", join="2030-01-01"), customer(1, None), customer(2, "B")]),
        "orders": table(spark, "orders", [order(1, 5), order(2, 5), order(3, 1, discount="60"), order(4, None, total="-1")]),
        "products": table(spark, "products", [product(1, "A", price="1.00"), product(2, None, stock=-1)]),
        "order_items": table(spark, "order_items", [item(1, 1, 1, 1, "9.00"), item(2, 1, 1, 0, "9.00"), item(3, 9, 7, 1, "9.00")]),
    }
    stored = {}
    for name, df in given.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    as_of = "2025-12-05 12:00:00"
    found = q.run_plan(stored, q.check_plan(stored), as_of)
    single = q.check_tables(given, as_of).unionByName(q.check_references(given)).unionByName(
        q.check_uniqueness(given)).unionByName(q.check_row_counts(given))
    assert sorted(rows(found)) == sorted(rows(single)) and found.filter("violations > 0").count() > 10
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == len(given)
    none = {name: df.limit(0) for name, df in given.items()}
    assert {r.violations for r in q.run_plan(none, q.check_plan(none), as_of).filter("kind <> 'ROWS'").collect()} == {0}


def test_documented_rules(spark):
    tables = {
        "orders": table(spark, "orders", [order(1, total="100", tax="8")]),
        "payments": table(spark, "payments", [dict(payment_id=1, order_id=1, amount="109", payment_method="CASH",
                                                   status="COMPLETED")]),
        "order_items": table(spark, "order_items", [item(1, 1, 1, 1, "9.00"), item(2, 1, 1, 1, "10.00")]),
        "products": table(spark, "products", [product(1, "A", "10.00")]),
        "shipments": table(spark, "shipments", [dict(shipment_id=1, order_id=1, shipping_cost="5", status="PENDING")]),
    }
    assert dict(rows(q.check_documented(tables), "rule", "violations")) == {
        "amount within order net": 1, "price equals product price": 1, "free shipping above limit": 1}


def test_returns_and_parents(spark):
    sql = spark.sql
    booked = {
        "returns": sql("SELECT * FROM VALUES (1L, 1L, 1L, 2L, 'REFUND', 'PROCESSED'), (2L, 9L, 1L, 0L, 'GIFT', 'LOST') "
                       "AS t(return_id, order_id, product_id, return_quantity, return_type, status)"),
        "refunds": sql("SELECT * FROM VALUES (1L, 'CHECK', 'COMPLETED'), (3L, 'GOLD', 'DONE') AS t(return_id, refund_method, status)"),
        "exchanges": sql("SELECT 2L AS return_id, 1L AS original_product_id, CAST(NULL AS BIGINT) AS exchange_product_id, "
                         "'PENDING' AS status"),
        "audit": sql("SELECT TIMESTAMP_NTZ '2025-12-06 00:00:00' AS change_timestamp"),
    }
    orders, goods = table(spark, "orders", [order(1)]), table(spark, "products", [product(1, "A")])
    found = {(r.table_name, r.rule): r.violations for r in q.check_returns(booked, orders, goods, "2025-12-05").collect()}
    assert found == {
        ("returns", "type domain"): 1, ("returns", "status domain"): 1, ("returns", "quantity positive"): 1,
        ("refunds", "method domain"): 1, ("refunds", "status domain"): 1, ("exchanges", "status domain"): 0,
        ("exchanges", "products present"): 1, ("change_log", "change time not in future"): 1,
        ("returns", "order_id in orders"): 1, ("returns", "product_id in products"): 0,
        ("refunds", "return_id in returns"): 1, ("exchanges", "return_id in returns"): 0}
    tree = table(spark, "categories", [dict(category_id=1, category_name="a", parent_category_id=None),
                                       dict(category_id=2, category_name="b", parent_category_id=7)])
    assert rows(q.check_references({"categories": tree}), "checked", "violations") == [(1, 1)]


def test_country_is_joined_on_demand(spark, sf):
    people = Model(spark, sf).customers()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "n_nationkey" not in plan(people.select("customer_id", "customer_segment"))
    assert "n_nationkey" in plan(people.select("customer_id", "country"))


# -- streams ------------------------------------------------------------------------------


def test_enforcement_writes_three_outputs(spark, sf, tmp_path):
    changes_df = changes(spark, CASES)
    handler = enforcement.enforce(holidays(spark), str(tmp_path))
    handler(changes_df, 0), handler(changes_df, 0)
    counts = {n: spark.read.parquet(str(tmp_path / n)).count() for n in ("allowed", "violations", "audit")}
    assert counts == {"allowed": 3, "violations": 3, "audit": 4}
    enforcement.count_batches(str(tmp_path / "n"))(changes_df, 0)
    assert rows(spark.read.parquet(str(tmp_path / "n")), "new_values") == [("Batch: I=4, U=1, D=1",)]
