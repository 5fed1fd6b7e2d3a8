"""Data-quality queries."""

from contract.base import query
from contract.orders import RETURNS, returned
from ledgertide.plans import audit as a
from ledgertide.plans import quality as q
from ledgertide.session import settle
from ledgertide.sources.model import AS_OF_ORDERS as NOW


def changed_orders(m):
    orders = m.orders()
    return a.change_capture(
        orders.filter("status <> 'PENDING'"), orders.filter("status <> 'CANCELLED'"), "order_id",
        {"Order": "order_id", "Status": "status"})


BUILDERS = {"order_items": lambda m: m.items(), "employee_audit_log": lambda m: m.audit(), "audit_log": changed_orders}
NAMES = ("customers", "categories", "suppliers", "products", "employees", "promotions", "holidays", "orders",
         "order_items", "payments", "shipments", "audit_log")


def tables(m, *names):
    return {n: BUILDERS[n](m) if n in BUILDERS else getattr(m, n)() for n in names or NAMES}


LOG = """(SELECT CASE WHEN status = 'PENDING' THEN 'INSERT' ELSE 'DELETE' END AS action_type,
  CASE WHEN status = 'CANCELLED' THEN 'x' END AS old_value, CASE WHEN status = 'PENDING' THEN 'x' END AS new_value
  FROM m_orders WHERE status IN ('PENDING', 'CANCELLED'))"""

TODAY = "TIMESTAMP '2001-08-02'"
ROW_RULES = [
    ("customers", "m_customers", "segment domain", "DOMAIN", "customer_segment NOT IN ('BRONZE','SILVER','GOLD','PLATINUM')"),
    ("customers", "m_customers", "total spent not negative", "RANGE", "total_spent < 0"),
    ("customers", "m_customers", "key present", "REQUIRED", "customer_id IS NULL"),
    ("customers", "m_customers", "name and email present", "REQUIRED", "customer_name IS NULL OR email IS NULL"),
    ("customers", "m_customers", "join date not in future", "FUTURE", f"join_date > {TODAY}"),
    ("products", "m_products", "status domain", "DOMAIN", "status NOT IN ('ACTIVE','DISCONTINUED','OUT_OF_STOCK')"),
    ("products", "m_products", "price positive", "RANGE", "unit_price <= 0"),
    ("products", "m_products", "cost positive", "RANGE", "unit_cost <= 0"),
    ("products", "m_products", "stock not negative", "RANGE", "stock_quantity < 0"),
    ("products", "m_products", "reorder level not negative", "RANGE", "reorder_level < 0"),
    ("products", "m_products", "price covers cost", "CROSS", "unit_price < unit_cost"),
    ("products", "m_products", "name present", "REQUIRED", "product_name IS NULL"),
    ("orders", "m_orders", "status domain", "DOMAIN",
     "status NOT IN ('PENDING','PROCESSING','SHIPPED','DELIVERED','CANCELLED','RETURNED','PARTIALLY_RETURNED')"),
    ("orders", "m_orders", "total positive", "RANGE", "total_amount <= 0"),
    ("orders", "m_orders", "discount within half of total", "CROSS", "discount_amount * 2 > total_amount"),
    ("orders", "m_orders", "customer present", "REQUIRED", "customer_id IS NULL"),
    ("orders", "m_orders", "order date not in future", "FUTURE", f"order_date > {TODAY}"),
    ("order_items", "m_items", "quantity positive", "RANGE", "quantity <= 0"),
    ("order_items", "m_items", "price positive", "RANGE", "unit_price <= 0"),
    ("order_items", "m_items", "discount between 0 and 100", "RANGE", "discount_percent NOT BETWEEN 0 AND 100"),
    ("payments", "m_payments", "method domain", "DOMAIN",
     "payment_method NOT IN ('CREDIT_CARD','DEBIT_CARD','PAYPAL','BANK_TRANSFER','CASH','CHECK')"),
    ("payments", "m_payments", "status domain", "DOMAIN",
     "status NOT IN ('PENDING','COMPLETED','FAILED','REFUNDED','PARTIALLY_REFUNDED')"),
    ("payments", "m_payments", "amount positive", "RANGE", "amount <= 0"),
    ("shipments", "m_shipments", "status domain", "DOMAIN",
     "status NOT IN ('PENDING','PROCESSING','SHIPPED','IN_TRANSIT','DELIVERED','RETURNED')"),
    ("shipments", "m_shipments", "delivery not before shipping", "CROSS", "actual_delivery < ship_date"),
    ("shipments", "m_shipments", "ship date not in future", "FUTURE", f"ship_date > {TODAY}"),
    ("employees", "m_employees", "department domain", "DOMAIN",
     "department NOT IN ('SALES','WAREHOUSE','FINANCE','ADMIN','IT')"),
    ("employees", "m_employees", "active flag domain", "DOMAIN", "is_active NOT IN ('Y','N')"),
    ("employees", "m_employees", "not own manager", "CROSS", "manager_id = employee_id"),
    ("employees", "m_employees", "hire date not in future", "FUTURE", f"TIMESTAMP '1994-01-01' > {TODAY}"),
    ("suppliers", "m_suppliers", "payment terms domain", "DOMAIN", "payment_terms NOT IN ('NET15','NET30','NET45','NET60')"),
    ("promotions", "m_promotions", "discount between 1 and 100", "RANGE", "discount_percent NOT BETWEEN 1 AND 100"),
    ("promotions", "m_promotions", "end after start", "CROSS", "end_date <= start_date"),
    ("holidays", "m_holidays", "recurring flag domain", "DOMAIN", "is_recurring NOT IN ('Y','N')"),
    ("holidays", "m_holidays", "not on a weekend", "CROSS", "isodow(holiday_date) > 5"),
    ("categories", "m_categories", "not own parent", "CROSS", "parent_category_id = category_id"),
    ("audit_log", LOG, "action domain", "DOMAIN", "action_type NOT IN ('INSERT','UPDATE','DELETE','NOTE')"),
    ("audit_log", LOG, "no old value on insert", "CROSS", "action_type = 'INSERT' AND old_value IS NOT NULL"),
    ("audit_log", LOG, "no new value on delete", "CROSS", "action_type = 'DELETE' AND new_value IS NOT NULL"),
]


def line(table, rule, kind, body):
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{kind}' AS kind, {body}"


def rows_sql(*kinds):
    return "\nUNION ALL\n".join(
        line(t, rule, kind, f"count(*) AS checked, count(*) FILTER ({test}) AS violations FROM {view}")
        for t, view, rule, kind, test in ROW_RULES if not kinds or kind in kinds)


def check_kind(*kinds):
    names = dict.fromkeys(t for t, _, _, kind, _ in ROW_RULES if kind in kinds)
    return lambda m: q.check_tables(tables(m, *names), NOW, kinds)


query("quality_domains", rows_sql("DOMAIN"))(check_kind("DOMAIN"))
query("quality_ranges", rows_sql("RANGE"))(check_kind("RANGE"))
query("quality_cross_columns", rows_sql("CROSS"))(check_kind("CROSS"))
query("quality_required", rows_sql("REQUIRED"))(check_kind("REQUIRED"))
query("quality_future_dates", rows_sql("FUTURE"))(check_kind("FUTURE"))

REFS = [("orders", "customer_id", "customers", "m_orders", "m_customers"),
        ("orders", "employee_id", "employees", "m_orders", "m_employees"),
        ("order_items", "order_id", "orders", "m_items", "m_orders"),
        ("order_items", "product_id", "products", "m_items", "m_products"),
        ("products", "category_id", "categories", "m_products", "m_categories"),
        ("products", "supplier_id", "suppliers", "m_products", "m_suppliers"),
        ("payments", "order_id", "orders", "m_payments", "m_orders"),
        ("shipments", "order_id", "orders", "m_shipments", "m_orders"),
        ("categories", "parent_category_id", "categories", "m_categories", "m_categories", "category_id"),
        ("employees", "manager_id", "employees", "m_employees", "m_employees", "employee_id"),
        ("promotions", "applicable_category_id", "categories", "m_promotions", "m_categories", "category_id"),
        ("employee_audit_log", "employee_id", "employees", "m_audit", "m_employees")]


def refs_sql(references):
    return "\nUNION ALL\n".join(
        line(t, f"{col} in {p}", "REFERENCE", f"""count({col}) AS checked, count({col}) FILTER (NOT EXISTS
      (SELECT 1 FROM {pv} x WHERE x.{key[0] if key else col} = c.{col})) AS violations FROM {cv} c""")
        for t, col, p, cv, pv, *key in references)


REFS_SQL = refs_sql(REFS)


@query("quality_references", REFS_SQL)
def _(m):
    return q.check_references(tables(m, *[n for n in NAMES if n not in ("holidays", "audit_log")], "employee_audit_log"))


@query("quality_returns", f"""
WITH {RETURNS.strip()},
exchanged AS (SELECT * FROM booked WHERE final_kind = 'EXCHANGE'),
refunded AS (SELECT *, CASE final_kind WHEN 'REFUND' THEN 'ORIGINAL_PAYMENT' ELSE 'STORE_CREDIT' END AS refund_method
  FROM booked WHERE refund > 0 AND final_kind IN ('REFUND', 'CREDIT'))
""" + "\nUNION ALL\n".join(
    [line(t, rule, kind, f"count(*) AS checked, count(*) FILTER ({test}) AS violations FROM {view}")
     for t, view, rule, kind, test in (
        ("returns", "booked", "type domain", "DOMAIN", "final_kind NOT IN ('REFUND','EXCHANGE','CREDIT')"),
        ("returns", "booked", "status domain", "DOMAIN", "'PROCESSED' NOT IN ('PENDING','PROCESSED','DENIED','CANCELLED')"),
        ("returns", "booked", "quantity positive", "RANGE", "q <= 0"),
        ("refunds", "refunded", "method domain", "DOMAIN",
         "refund_method NOT IN ('ORIGINAL_PAYMENT','STORE_CREDIT','CHECK')"),
        ("refunds", "refunded", "status domain", "DOMAIN", "'COMPLETED' NOT IN ('PENDING','COMPLETED','FAILED')"),
        ("exchanges", "exchanged", "status domain", "DOMAIN", "'PROCESSED' NOT IN ('PENDING','PROCESSED','CANCELLED')"),
        ("exchanges", "exchanged", "products present", "REQUIRED", "product_id IS NULL OR other IS NULL"),
        ("change_log", "booked", "change time not in future", "FUTURE", f"request_ts > {TODAY}"))]
    + [refs_sql([("returns", "order_id", "orders", "booked", "m_orders"),
                 ("returns", "product_id", "products", "booked", "m_products"),
                 ("refunds", "return_id", "returns", "refunded", "booked"),
                 ("exchanges", "return_id", "returns", "exchanged", "booked")])]))
def _(m):
    # Four outputs are checked, so the decided rows are written once.
    return q.check_returns(returned(m, settle=lambda judged: settle(judged, "returns-judged")), m.orders(), m.products(), NOW)


UNIQUES = [("customers", "m_customers", "email"), ("suppliers", "m_suppliers", "email"),
           ("employees", "m_employees", "email"), ("categories", "m_categories", "category_name"),
           ("payments", "m_payments", "transaction_id"), ("shipments", "m_shipments", "tracking_number"),
           ("shipments", "m_shipments", "order_id"), ("order_items", "m_items", "order_id, product_id"),
           ("holidays", "m_holidays", "holiday_date")]
UNIQUES_SQL = "\nUNION ALL\n".join(
    line(t, f"unique {cols}", "UNIQUE",
         f"count(*) AS checked, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {v})) AS violations FROM {v}")
    for t, v, cols in UNIQUES)


@query("quality_uniqueness", UNIQUES_SQL)
def _(m):
    return q.check_uniqueness(tables(m, *dict.fromkeys(t for t, _, _ in UNIQUES)))


COUNTS = [("customers", "m_customers", 20), ("products", "m_products", 15), ("orders", "m_orders", 10),
          ("order_items", "m_items", 20)]
COUNTS_SQL = "\nUNION ALL\n".join(
    line(t, f"at least {n} rows", "ROWS",
         f"count(*) AS checked, CAST(count(*) < {n} AS BIGINT) AS violations FROM {v}") for t, v, n in COUNTS)


@query("quality_row_counts", COUNTS_SQL)
def _(m):
    return q.check_row_counts(tables(m, *[t for t, _, _ in COUNTS]))


DOCUMENTED_SQL = "\nUNION ALL\n".join([
    line("payments", "amount within order net", "DOCUMENTED", """count(*) AS checked,
      count(*) FILTER (amount > net_amount) AS violations FROM m_payments JOIN m_orders USING (order_id)"""),
    line("order_items", "price equals product price", "DOCUMENTED", """count(*) AS checked,
      count(*) FILTER (i.unit_price <> p.unit_price) AS violations FROM m_items i JOIN m_products p USING (product_id)""")])


@query("quality_documented", DOCUMENTED_SQL)
def _(m):
    return q.check_documented(tables(m, "orders", "payments", "order_items", "products", "shipments"))


HIERARCHY_SQL = line("categories", "at most 3 levels", "HIERARCHY", """count(*) AS checked,
  count(*) FILTER (d > 3) AS violations FROM (
  WITH RECURSIVE tree AS (SELECT category_id, 1 AS d FROM m_categories WHERE parent_category_id IS NULL
    UNION ALL SELECT c.category_id, d + 1 FROM m_categories c JOIN tree t ON c.parent_category_id = t.category_id)
  SELECT * FROM tree)""")


@query("quality_hierarchy", HIERARCHY_SQL)
def _(m):
    return q.check_hierarchy(m.categories())


ALL_SQL = "\nUNION ALL\n".join([rows_sql(), REFS_SQL, UNIQUES_SQL, COUNTS_SQL, DOCUMENTED_SQL, HIERARCHY_SQL])


def everything(m):
    known = tables(m)
    checks = q.check_all(known, NOW)
    log = {"employee_audit_log": m.audit(), "employees": known["employees"]}
    return checks.unionByName(q.check_references(log, children=("employee_audit_log",)))


@query("quality_all", ALL_SQL)
def _(m):
    return everything(m)


@query("quality_summary", f"""
SELECT count(*) AS total_tests, count(*) FILTER (violations = 0) AS passed, count(*) FILTER (violations > 0) AS failed
FROM ({ALL_SQL})""")
def _(m):
    return q.summary(everything(m))


def test_sql(name, good, poor, bad, view):
    return (f"SELECT '{name}' AS test, CASE WHEN n = 0 THEN {good} ELSE {poor} END AS result, "
            f"CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) FILTER ({bad}) AS n, "
            f"count(*) AS c FROM {view})")


@query("validation_report", "\nUNION ALL\n".join(
    [test_sql(f"{t.upper()} table has data", "c || ' rows'", "c || ' rows'", "FALSE", v) for t, v, n in COUNTS] + [
        test_sql("Orders reference valid customers", "'All ' || c || ' orders valid'", "'Unknown customers found'",
                 "customer_id NOT IN (SELECT customer_id FROM m_customers)", "m_orders"),
        test_sql("Order items reference valid orders", "'All ' || c || ' items valid'", "'Unknown orders found'",
                 "order_id NOT IN (SELECT order_id FROM m_orders)", "m_items"),
        test_sql("Order items reference valid products", "'All ' || c || ' items valid'", "'Unknown products found'",
                 "product_id NOT IN (SELECT product_id FROM m_products)", "m_items"),
        test_sql("Customer emails are unique", "'All unique'", "'Duplicates found'", "k > 1",
                 "(SELECT email, count(*) AS k FROM m_customers GROUP BY 1)"),
        test_sql("Order amounts are positive", "'All > 0'", "'Negative found'", "total_amount <= 0", "m_orders"),
        test_sql("Order status values valid", "'All valid'", "'Invalid found'",
                 "status NOT IN ('PENDING','PROCESSING','SHIPPED','DELIVERED','CANCELLED','RETURNED')", "m_orders"),
        test_sql("Discounts within 50% limit", "'All within limit'", "'Exceeds limit'",
                 "discount_amount > total_amount * 0.5", "m_orders"),
        test_sql("Product price >= cost", "'All valid'", "'Price < cost'", "unit_price < unit_cost", "m_products"),
        test_sql("Customer segments valid", "'All valid'", "'Invalid segments'",
                 "customer_segment NOT IN ('BRONZE','SILVER','GOLD','PLATINUM')", "m_customers"),
        test_sql("No NULL primary keys", "'All PKs populated'", "'NULL PKs found'", "customer_id IS NULL", "m_customers"),
        test_sql("Required fields populated", "'All required filled'", "'Missing data'",
                 "customer_name IS NULL OR email IS NULL", "m_customers"),
        test_sql("Date fields valid", "'All dates valid'", "'Invalid dates'", f"order_date > {TODAY}", "m_orders")]))
def _(m):
    return q.validation_report(tables(m, "customers", "products", "orders", "order_items"), NOW)
