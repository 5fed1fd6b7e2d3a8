"""Recorded outcomes of single calls, and the rules around them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgertide.functions import rules
from ledgertide.plans import invoices as inv
from ledgertide.plans import orders as jobs
from ledgertide.plans import sales
from tests.helpers import D, customer, item, order, product, rows, table


@pytest.fixture(scope="module")
def goods(spark):
    return table(spark, "products", [product(1, "UltraBook Pro X1", "1299.99", "900.00", stock=50),
                                     product(2, "SmartPhone Max Pro", "899.99", "600.00", stock=118)])


@pytest.fixture(scope="module")
def people(spark):
    return table(spark, "customers", [customer(1001, "John Smith", "GOLD")])


def requests(spark, *made):
    return table(spark, "order_requests", [
        dict(request_id=i, request_ts="2025-12-05 10:54:10", customer_id=c, product_ids=p, quantities=q,
             shipping_address="123 Main St") for i, c, p, q in made])


def test_create_order(spark, goods, people):
    made = jobs.create_orders(requests(spark, (1, 1001, [1, 2], [1, 2])), goods, people, discount_percent=10,
                              first_order_id=12, first_item_id=12)
    assert rows(made["orders"], "order_id", "total_amount", "discount_amount", "tax_amount", "net_amount", "status") == [
        (12, D("3099.97"), D("310.00"), D("248.00"), D("3037.97"), "PENDING")]
    assert sorted(rows(made["items"], "order_item_id", "product_id", "quantity", "line_total")) == [
        (12, 1, 1, D("1299.99")), (13, 2, 2, D("1799.98"))]
    assert made["rejects"].count() == 0


def test_create_order_rejects(spark, goods, people):
    made = jobs.create_orders(
        requests(spark, (1, 9, [1], [1]), (2, 1001, [], []), (3, 1001, [1], [0]), (4, 1001, [7], [1]),
                 (5, 1001, [1, 1], [1, 1]), (6, 1001, [1, 2], [1]), (7, 1001, [2], [3])),
        goods, people, discount_percent={"GOLD": 5})
    assert dict(rows(made["rejects"], "request_id", "reason")) == {
        1: "Customer ID 9 not found", 2: "Order has no items or unpaired items", 3: "Quantity must be greater than 0",
        4: "Product not found", 5: "Product repeated in order", 6: "Quantity must be greater than 0"}
    assert rows(made["orders"], "discount_amount", "net_amount") == [(D("135.00"), D("2780.97"))]


def status_requests(spark, made):
    return table(spark, "status_requests", [
        dict(request_id=i, request_ts=t, order_id=o, new_status=s, updated_by="ann", notes=n) for i, t, o, s, n in made])


def test_every_status_pair(spark):
    orders, asks, expected = [], [], {}
    for a in rules.ORDER_STATUSES:
        for b in rules.ORDER_STATUSES:
            n = len(orders) + 1
            orders.append(order(n, status=a))
            asks.append((n, "2025-12-05 12:00:00", n, b, None))
            expected[n] = a == b or b in rules.STATUS_TRANSITIONS.get(a, ())
    shipments = table(spark, "shipments", [dict(shipment_id=o["order_id"], order_id=o["order_id"], status="PENDING")
                                           for o in orders])
    out = jobs.apply_status_changes(status_requests(spark, asks), table(spark, "orders", orders),
                                    table(spark, "order_items", []), shipments)
    assert dict(rows(out["results"], "request_id", "success")) == expected


def test_status_chain_and_effects(spark):
    orders = table(spark, "orders", [order(1), order(2), order(3, date="2025-12-01"), order(4, status="PROCESSING")])
    items = table(spark, "order_items", [item(1, 2, 7, 3, "5.00"), item(2, 2, 8, 2, "5.00")])
    shipments = table(spark, "shipments", [dict(shipment_id=1, order_id=1, status="PENDING")])
    asks = [(1, "2025-12-05 11:00:00", 1, "PROCESSING", "rush"), (2, "2025-12-05 12:00:00", 1, "SHIPPED", None),
            (3, "2025-12-05 13:00:00", 1, "SHIPPED", None), (4, "2025-12-05 14:00:00", 1, "DELIVERED", None),
            (5, "2025-12-05 15:00:00", 1, "PENDING", None), (6, "2025-12-05 16:00:00", 1, "RETURNED", None),
            (7, "2025-12-05 11:00:00", 2, "CANCELLED", None), (8, "2025-12-05 11:00:00", 3, "CANCELLED", None),
            (9, "2025-12-05 11:00:00", 4, "SHIPPED", None), (10, "2025-12-05 11:00:00", 77, "SHIPPED", None),
            (11, "2025-12-05 11:00:00", 1, "LOST", None)]
    out = jobs.apply_status_changes(status_requests(spark, asks), orders, items, shipments)
    text = dict(rows(out["results"], "request_id", "message"))
    assert text[1] == "Order status updated from PENDING to PROCESSING"
    assert text[3] == "Order status is already SHIPPED"
    assert text[5] == "Invalid status transition: DELIVERED -> PENDING"
    assert text[6] == "Order status updated from DELIVERED to RETURNED"
    assert text[8] == "Order cannot be cancelled after 24 hours. Hours elapsed: 107"
    assert text[9] == "Cannot ship order without shipment record"
    assert text[10] == "Order ID 77 not found"
    assert text[11] == "Invalid status: LOST"
    assert sorted(rows(out["orders"])) == [(1, "RETURNED"), (2, "CANCELLED")]
    assert sorted(rows(out["stock"])) == [(7, 3), (8, 2)]
    assert rows(out["customers"]) == [(1, dt.datetime(2025, 12, 5, 14))]
    assert rows(out["shipments"]) == [(1, "SHIPPED", dt.datetime(2025, 12, 5, 12))]
    assert sorted(rows(out["audit"], "action_type", "new_value")) == [
        ("NOTE", "rush"), ("UPDATE", "CANCELLED"), ("UPDATE", "DELIVERED"), ("UPDATE", "PROCESSING"),
        ("UPDATE", "RETURNED"), ("UPDATE", "SHIPPED")]


def test_many_status_requests_for_one_order(spark):
    orders = table(spark, "orders", [order(1), order(2)])
    shipments = table(spark, "shipments", [dict(shipment_id=1, order_id=1, status="PENDING")])
    wishes = ["PENDING", "SHIPPED", "PROCESSING", "SHIPPED", "PROCESSING", "RETURNED", "DELIVERED"]
    asks = status_requests(spark, [(i, f"2025-12-05 12:00:{i:02d}", 1, s, None) for i, s in enumerate(wishes)]
                           + [(50, "2025-12-05 13:00:00", 2, "CANCELLED", None)])
    items = table(spark, "order_items", [])
    plain = jobs.apply_status_changes(asks, orders, items, shipments)
    cut = jobs.apply_status_changes(asks, orders, items, shipments, group_rows=3)
    for part in plain:
        assert sorted(map(repr, plain[part].collect())) == sorted(map(repr, cut[part].collect())), part
    assert dict(rows(plain["orders"])) == {1: "RETURNED", 2: "CANCELLED"}


def test_daily_report_of_one_order(spark, goods, people):
    orders = table(spark, "orders", [order(12, 1001, total="3099.97", discount="310.00", tax="248.00")])
    items = table(spark, "order_items", [item(12, 12, 1, 1, "1299.99"), item(13, 12, 2, 2, "899.99")])
    day = sales.daily_revenue(orders, items, goods, people, dates=["2025-12-05"]).first()
    assert day.revenue == day.max_order_value == day.min_order_value == D("3037.97")
    assert (day.avg_order_value, day.order_count, day.completion_rate) == (3037.97, 1, 0.0)
    assert (day.business_hours_revenue, day.avg_revenue_per_hour) == (D("3037.97"), 126.58)
    assert (day.top_product, day.top_customer) == ("SmartPhone Max Pro", "John Smith")
    assert rows(sales.hourly_breakdown(orders, "2025-12-05"), "hour_of_day", "order_count", "hourly_revenue",
                "avg_order_value") == [(10, 1, D("3037.97"), 3037.97)]


def test_invoice(spark):
    goods = table(spark, "products", [product(1, "UltraBook Pro X1"), product(2, "Noise-Canceling Pro"),
                                      product(3, "Men's Casual Shirt"), product(4, "Men's Jeans")])
    items = table(spark, "order_items", [
        item(1, 1, 1, 1, "1299.99", "3.5"), item(2, 1, 2, 1, "299.99", "5"), item(3, 1, 3, 2, "39.99", "10"),
        item(4, 1, 4, 1, "59.99", "15")])
    people = table(spark, "customers", [
        customer(2, "Customer 2", city="Chicago", email="customer2@email.com")])
    orders = table(spark, "orders", [order(1, 2, "2025-12-04", "PROCESSING", tax="8.63"), order(9, 2), order(8, 55)])
    payments = table(spark, "payments", [
        dict(payment_id=1, order_id=1, amount="499.19", status="COMPLETED", payment_method="CASH")])
    out = inv.invoices(orders, items, goods, people, payments)
    one = out["invoices"].first()
    assert one.invoice_number == "INV-202512-000001" and one.invoice_id == 1000
    assert (one.subtotal_amount, one.discount_amount, one.tax_amount) == (D("1739.95"), D("77.50"), D("8.63"))
    assert (one.total_amount, one.paid_amount, one.balance_due) == (D("1671.08"), D("499.19"), D("1171.89"))
    assert dict(rows(out["rejects"])) == {9: "No items found for order 9", 8: "Order ID 8 not found"}
    lines = inv.invoice_lines(items, goods)
    assert sorted(rows(lines, "line_number", "line_total")) == [
        (1, D("1254.49")), (2, D("284.99")), (3, D("71.98")), (4, D("50.99"))]
    text = inv.render_invoices(out["invoices"], lines).first().document
    assert "\n, Chicago, USA\n" in text
    assert "   1  UltraBook Pro X1                   1  $1,299.99   $1,254.49\n" in text
    assert "Tax (.5%):" + " " * 39 + "        $8.63\n" in text
    # The recorded document has 1463 characters.
    assert len(text) == 1463
    page = inv.render_invoices(out["invoices"], lines, "html").first().document
    assert page.startswith("<!DOCTYPE html>") and "$1,671.08" in page
    with pytest.raises(ValueError):
        inv.render_invoices(out["invoices"], lines, "PDF")


def test_invoice_tax_rules(spark):
    goods = table(spark, "products", [product(1, "A")])
    items = table(spark, "order_items", [item(1, 1, 1, 1, "50.00")])
    people = table(spark, "customers", [customer(1, "C")])
    orders = table(spark, "orders", [order(1, tax=None)])
    payments = table(spark, "payments", [])
    with_tax = inv.invoices(orders, items, goods, people, payments)["invoices"].first()
    assert (with_tax.tax_amount, with_tax.total_amount, with_tax.payment_status) == (D("4.00"), D("54.00"), "UNPAID")
    without = inv.invoices(orders, items, goods, people, payments, include_tax=False)["invoices"].first()
    assert (without.tax_amount, without.total_amount) == (D("0.00"), D("50.00"))


def return_requests(spark, made):
    return table(spark, "return_requests", [
        dict(request_id=i, request_ts=f"2025-12-08 10:00:{i:02d}", order_id=o, product_id=p, return_quantity=q,
             return_reason=why, return_type=kind, processed_by="ann") for i, o, p, q, why, kind in made])


@pytest.fixture(scope="module")
def sold(spark):
    return dict(
        orders=table(spark, "orders", [order(3, 4, "2025-12-05", "DELIVERED"), order(4, 4, "2025-12-05", "DELIVERED"),
                                       order(5, 4, "2025-10-05", "DELIVERED"), order(6, 4, "2025-12-05", "PENDING")]),
        items=table(spark, "order_items", [item(1, 3, 2, 1, "299.99"), item(2, 3, 5, 1, "10.00"),
                                           item(3, 4, 2, 4, "100.00"), item(4, 5, 2, 1, "1.00"),
                                           item(5, 4, 9, 1, "1.00"), item(6, 4, 6, 2, "30.00")]),
        products=table(spark, "products", [
            product(2, "SmartPhone Max Pro", "899.99", category=1, stock=118), product(5, "Case", "10.00", category=1),
            product(6, "Lamp", "30.00", category=2), product(9, "Old", category=1, status="DISCONTINUED")]),
    )


def test_returns(spark, sold):
    asks = return_requests(spark, [
        (1, 3, 2, 1, "Defective product", "REFUND"), (2, 3, 2, 1, "Wrong size", "CREDIT"),
        (3, 3, 2, 10, "Defective", "REFUND"), (4, 4, 2, 1, "Changed mind", "REFUND"),
        (5, 4, 2, 2, "I no longer need it", "REFUND"), (6, 4, 2, 1, "x", "EXCHANGE"), (7, 5, 2, 1, "x", "REFUND"),
        (8, 6, 2, 1, "x", "REFUND"), (9, 4, 9, 1, "x", "REFUND"), (10, 4, 77, 1, "x", "REFUND"),
        (11, 4, 5, 1, "x", "REFUND"), (12, 4, 2, 0, "x", "REFUND"), (13, 99, 2, 1, "x", "REFUND"),
        (14, 4, 6, 1, "x", "EXCHANGE"), (15, 4, 6, 1, "x", "GIFT")])
    out = jobs.process_returns(asks, **sold)
    assert sorted(rows(out["returns"], "request_id", "return_id", "return_type", "refund_amount", "restocking_fee",
                       "exchange_product_id")) == [
        (1, 1000, "REFUND", D("299.99"), D("0.00"), None),
        (2, 1001, "CREDIT", D("299.99"), D("0.00"), None),
        (4, 1002, "REFUND", D("60.00"), D("40.00"), None),  # fee on the whole line, refund by share
        (5, 1003, "REFUND", D("180.00"), D("20.00"), None),
        (6, 1004, "EXCHANGE", D("0.00"), D("0.00"), 5),
        (14, 1005, "REFUND", D("30.00"), D("0.00"), None),  # nothing to exchange for
    ]
    assert dict(rows(out["rejects"], "request_id", "reason")) == {
        3: "Order status (RETURNED) is not eligible for return",
        7: "Return period expired. Order is 64 days old (max 30 days)",
        8: "Order status (PENDING) is not eligible for return",
        9: "Product Old is DISCONTINUED and cannot be returned",
        10: "Product ID 77 not found", 11: "Product Case was not found in order 4",
        12: "Return quantity must be greater than 0", 13: "Order ID 99 not found", 15: "Invalid return type: GIFT"}
    assert dict(rows(out["orders"])) == {3: "RETURNED", 4: "PARTIALLY_RETURNED"}
    assert dict(rows(out["stock"])) == {2: 6, 6: 1}
    assert rows(out["customers"], "returns_delta", "refund_delta", "credit_delta") == [(6, D("869.98"), D("299.99"))]
    assert sorted(rows(out["refunds"], "return_id", "refund_method")) == [
        (1000, "ORIGINAL_PAYMENT"), (1001, "STORE_CREDIT"), (1002, "ORIGINAL_PAYMENT"), (1003, "ORIGINAL_PAYMENT"),
        (1005, "ORIGINAL_PAYMENT")]
    assert rows(out["exchanges"], "return_id", "original_product_id", "exchange_product_id") == [(1004, 2, 5)]
    assert "Return processed: 1 units of SmartPhone Max Pro for $299.99 refund" in [
        r[0] for r in rows(out["audit"], "new_value")]


def test_return_quantity_above_ordered(spark, sold):
    out = jobs.process_returns(return_requests(spark, [(1, 3, 2, 10, "Defective", "REFUND")]), **sold)
    assert rows(out["rejects"], "reason") == [("Return quantity (10) exceeds original quantity (1)",)]


def test_strict_returns_and_history(spark, sold):
    asks = return_requests(spark, [(1, 3, 2, 1, "x", "REFUND"), (2, 3, 2, 1, "x", "REFUND")])
    assert jobs.process_returns(asks, **sold)["returns"].count() == 2
    assert rows(jobs.process_returns(asks, strict=True, **sold)["rejects"], "request_id") == [(2,)]
    past = table(spark, "returns", [dict(return_id=1, order_id=3, product_id=5, return_quantity=1, return_reason="x",
                                         status="PROCESSED")])
    out = jobs.process_returns(asks, returns=past, **sold)
    assert rows(out["rejects"], "request_id", "reason") == [(2, "Order status (RETURNED) is not eligible for return")]
    assert dict(rows(out["orders"])) == {3: "RETURNED"}


def strict_lines(spark, sold, asks, quantities, past=()):
    """Decisions on an order 7 of lines (product, quantity)."""
    own = dict(sold)
    own["orders"] = sold["orders"].unionByName(table(spark, "orders", [order(7, status="DELIVERED")]))
    own["items"] = sold["items"].unionByName(table(spark, "order_items", [
        item(700 + p, 7, p, n, "10") for p, n in quantities.items()]))
    history = table(spark, "returns", [dict(return_id=k, order_id=7, product_id=p, return_quantity=n, return_reason="x",
                                            status="PROCESSED") for k, (p, n) in enumerate(past)]) if past else None
    made = return_requests(spark, [(k, 7, p, n, "x", "REFUND") for k, (p, n) in enumerate(asks, 1)])
    out = jobs.process_returns(made, returns=history, strict=True, **own)
    return sorted(r[0] for r in rows(out["returns"], "request_id")), dict(rows(out["rejects"], "request_id", "reason"))


def test_strict_counts_accepted_units_only(spark, sold):
    kept, lost = strict_lines(spark, sold, [(2, 1), (2, 1), (5, 1)], {2: 1, 5: 1})
    assert kept == [1, 3] and list(lost) == [2]
    kept, lost = strict_lines(spark, sold, [(2, 2), (2, 2), (2, 1)], {2: 3})
    assert kept == [1, 3] and lost == {2: "Return quantity exceeds the quantity left"}
    kept, lost = strict_lines(spark, sold, [(2, 1), (5, 1)], {2: 1, 5: 2}, past=[(2, 1)])
    assert kept == [2] and lost == {1: "Return quantity exceeds the quantity left"}


def test_many_requests_for_one_order(spark, sold):
    """The cut into ranges gives the same decisions."""
    asks = return_requests(spark, [(i, 4, 2, 1, "x", "REFUND") for i in range(1, 30)])
    plain = jobs.process_returns(asks, **sold)
    cut = jobs.process_returns(asks, group_rows=4, **sold)
    for part in ("returns", "rejects", "orders"):
        assert sorted(map(repr, plain[part].collect())) == sorted(map(repr, cut[part].collect()))
    assert plain["returns"].count() + plain["rejects"].count() == 29


def test_settled_outputs_agree(spark, sold):
    from ledgertide.session import cut_lineage

    asks = return_requests(spark, [(1, 3, 2, 1, "x", "REFUND"), (2, 4, 2, 1, "x", "CREDIT")])
    a, b = jobs.process_returns(asks, **sold), jobs.process_returns(asks, settle=cut_lineage, **sold)
    assert all(sorted(map(repr, a[n].collect())) == sorted(map(repr, b[n].collect())) for n in a)


def test_accepted_returns_read_no_names(spark, sold, tmp_path):
    sold["products"].write.parquet(str(tmp_path / "goods"))
    goods = spark.read.schema(sold["products"].schema).parquet(str(tmp_path / "goods"))
    asks = return_requests(spark, [(1, 3, 2, 1, "x", "REFUND"), (2, 4, 9, 1, "x", "CREDIT")])
    out = jobs.process_returns(asks, **(sold | {"products": goods}))
    read = {n: "product_name" in out[n]._jdf.queryExecution().executedPlan().toString() for n in ("customers", "rejects")}
    assert read == {"customers": False, "rejects": True}  # names are shown in reasons only
    assert rows(out["rejects"], "reason") == [("Product Old is DISCONTINUED and cannot be returned",)]


def test_one_return_output_sorts_its_columns_only(spark, sold):
    asks = return_requests(spark, [(1, 3, 2, 1, "x", "REFUND"), (2, 4, 2, 1, "x", "CREDIT"), (3, 4, 6, 1, "x", "EXCHANGE")])
    shared = jobs.process_returns(asks, **sold)
    for name in ("returns", "refunds", "exchanges", "audit"):
        alone = jobs.process_returns(asks, only=name, **sold)[name]
        assert alone.schema == shared[name].schema
        assert sorted(map(repr, alone.collect())) == sorted(map(repr, shared[name].collect()))
    refunds = jobs.process_returns(asks, only="refunds", **sold)["refunds"]
    stored = spark.read.parquet(*[f for f in refunds.inputFiles() if "placed-" in f]).columns
    assert not {"product_name", "notes", "return_reason"} & set(stored)


def test_returns_of_repeated_and_missing_products(spark, sold):
    goods = sold["products"].unionByName(sold["products"].filter("product_id = 2"))
    asks = return_requests(spark, [(1, 3, 2, 1, "x", "REFUND"), (2, 4, None, 1, "x", "CREDIT"), (2, 4, None, 1, "x", "CREDIT")])
    out = jobs.process_returns(asks, **(sold | {"products": goods}))
    assert rows(out["rejects"].filter("request_id = 2"), "reason") == [("Product ID  not found",)] * 2
    ids = out["returns"].select("request_id").unionByName(out["rejects"].select("request_id"))
    assert sorted(rows(ids)) == [(1,)] * 4 + [(2,)] * 2  # the product is there twice, and each of them finds two to exchange for


def test_printing_numbers_no_invoices(spark):
    goods = table(spark, "products", [product(1, "A")])
    items = table(spark, "order_items", [item(1, 1, 1, 1, "50.00"), item(2, 2, 1, 3, "5.00")])
    people, orders = table(spark, "customers", [customer(1, "C")]), table(spark, "orders", [order(1), order(2)])
    out = inv.invoices(orders, items, goods, people, table(spark, "payments", []))
    lines = inv.invoice_lines(items, goods)
    for form in ("TEXT", "HTML"):
        plain = inv.render_invoices(out["unnumbered"], lines, form)
        assert not plain.inputFiles()  # no sorted copy of the invoices was written
        assert sorted(rows(plain)) == sorted(rows(inv.render_invoices(out["invoices"], lines, form)))
    assert "invoice_id" not in out["unnumbered"].columns


def test_cancelled_orders_stay_in_product_sales(spark):
    goods = table(spark, "products", [product(1, "A"), product(2, "Unsold")])
    cats = table(spark, "categories", [dict(category_id=1, category_name="C")])
    orders = table(spark, "orders", [order(1, status="CANCELLED")])
    items = table(spark, "order_items", [item(1, 1, 1, 4, "10.00")])
    out = sales.product_performance(goods, cats, items, orders)
    assert rows(out, "product_id", "units_sold", "sales_rank") == [(1, 4, 1), (2, 0, 2)]
    kept = sales.product_performance(goods, cats, items, orders, exclude_inactive=True)
    assert rows(kept, "product_id", "units_sold", "sales_rank") == [(1, 0, 1), (2, 0, 1)]


def test_credit_verdicts(spark):
    people = table(spark, "customers", [customer(1, "A", "GOLD"), customer(2, "B", "NEW")])
    orders = table(spark, "orders", [order(1, 1, total="1962.03"), order(2, 1, total="50"), order(3, 2, total="500")])
    payments = table(spark, "payments", [
        dict(payment_id=1, order_id=2, amount="50", status="COMPLETED", payment_method="CASH")])
    asks = table(spark, "credit_requests", [
        dict(request_id=1, customer_id=1, order_amount="3037.97"), dict(request_id=2, customer_id=1, order_amount="3038"),
        dict(request_id=3, customer_id=2, order_amount="1"), dict(request_id=4, customer_id=9, order_amount="1")])
    out = dict(rows(sales.validate_credit_limit(asks, people, orders, payments), "request_id", "verdict"))
    assert out == {
        1: "APPROVED: Available credit: $3037.97",
        2: "DENIED: Order amount ($3038) exceeds available credit ($3037.97)",
        3: "DENIED: Order amount ($1) exceeds available credit ($-400)",
        4: "ERROR: customer not found"}


def test_segments_and_lifetime_value(spark):
    people = table(spark, "customers", [customer(i, f"C{i}", join="2025-01-31") for i in range(1, 7)]
                   + [customer(7, "Future", join="2026-05-01")])
    spend = {1: "10000", 2: "9999.99", 3: "1000", 4: "0.01"}
    orders = table(spark, "orders", [order(i, i, total=t) for i, t in spend.items()]
                   + [order(9, 5, total="99999", status="CANCELLED")])
    out = dict(rows(sales.update_customer_segments(people, orders), "customer_id", "customer_segment"))
    assert out == {1: "PLATINUM", 2: "GOLD", 3: "SILVER", 4: "BRONZE", 5: "NEW", 6: "NEW", 7: "NEW"}
    clv = dict(rows(sales.customer_lifetime_value(people, orders, "2025-02-28"), "customer_id", "clv"))
    assert clv[1] == 360000.0 and clv[5] == 0.0 and clv[7] == 0.0


def test_reports_without_rows(spark, goods, people):
    none = table(spark, "orders", [])
    items = table(spark, "order_items", [])
    report = sales.sales_report(none, items, goods, people, "2025-01-01", "2025-02-01").first()
    assert (report.total_revenue, report.total_orders, report.avg_order_value) == (D("0.00"), 0, 0.0)
    assert (report.top_product, report.top_customer) == ("N/A", "N/A")
    assert sales.predict_sales(none, "2025-12-05").first()[0] is None
    assert sales.yoy_growth(none, "2025-12-05").first().growth_pct == 100.0
    assert sales.conversion_rate(none, "2025-01-01", "2025-02-01").first().conversion_rate == 0.0
    assert sales.top_performers("NOBODY", customers=people).count() == 0


def test_shares_sum_to_hundred(spark, people):
    many = table(spark, "customers", [customer(i, f"C{i}") for i in range(1, 5)])
    orders = table(spark, "orders", [order(i, i, total="25") for i in range(1, 5)])
    out = sales.customer_ranking(many, orders)
    assert out.agg(F.sum("percent_of_total")).first()[0] == 100.0
    assert {r.customer_rank for r in out.collect()} == {1}
