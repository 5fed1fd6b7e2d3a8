"""Invoices for a whole set of orders: amounts, line listings and printed documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import rules
from ledgertide.functions.compat import currency, money, number_text, ratio, text_of
from ledgertide.operators.ordered import numbered
from ledgertide.plans.orders import Outputs
from ledgertide.plans.sales import gross


def _priced_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    return items.join(products.select("product_id", "product_name"), "product_id")


def invoices(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
    include_tax: bool = True,
    first_invoice_id: int = 1000,
) -> Mapping[str, DataFrame]:
    """One invoice row per order, and the orders that cannot be invoiced.

    `unnumbered` are the invoices without invoice_id: printed documents do not show it, and numbering sorts the whole table.
    A stored tax amount wins; without one, 8 % of the subtotal is taken when `include_tax` is set.
    """
    known = items.join(products.select("product_id"), "product_id", "left_semi")
    percent_off = F.col("discount_percent") * F.lit("0.01").cast("decimal(3,2)")
    sums = known.groupBy("order_id").agg(
        money(F.sum(gross())).alias("subtotal_amount"),
        F.sum((gross() * percent_off).cast("decimal(24,6)")).alias("exact_discount"),
    )
    paid = payments.groupBy("order_id").agg(
        F.max("status").alias("payment_status"),
        money(F.coalesce(F.sum(F.when(F.col("status") == "COMPLETED", F.col("amount"))), F.lit(0))).alias("paid_amount"),
    )
    bill_to = customers.select("customer_id", "customer_name", "email", "address", "city", "country")
    heads = (
        orders.select("order_id", "customer_id", "order_date", "status", "tax_amount", "shipping_address",
                      "billing_address")
        .withColumnRenamed("tax_amount", "stored_tax")
        .join(bill_to, "customer_id", "left")
        .join(sums, "order_id", "left")
        .join(paid, "order_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("customer_name").isNull(), text_of(F.lit("Order ID "), "order_id", F.lit(" not found")))
            .when(F.col("subtotal_amount").isNull(), text_of(F.lit("No items found for order "), "order_id")),
        )
    )
    rule_tax = F.col("subtotal_amount") * F.lit(rules.TAX_RATE) if include_tax else F.lit(0)
    tax = F.coalesce(F.col("stored_tax").cast("decimal(24,4)"), rule_tax.cast("decimal(24,4)"))
    due = (F.col("subtotal_amount") - F.col("exact_discount") + F.col("tax")).cast("decimal(28,6)")
    priced = (
        heads.filter(F.col("reason").isNull())
        .withColumn("tax", tax)
        .withColumn("paid_amount", money(F.coalesce("paid_amount", F.lit(0))))
        .withColumn("payment_status", F.coalesce("payment_status", F.lit("UNPAID")))
        .withColumn("invoice_number", text_of(
            F.lit("INV-"), F.date_format("order_date", "yyyyMM"), F.lit("-"),
            _padded(F.col("order_id").cast("string"), 6, "0")))
        .withColumn("discount_amount", money(F.round("exact_discount", 2)))
        .withColumn("tax_amount", money(F.round("tax", 2)))
        .withColumn("total_amount", money(F.round(due, 2)))
        .withColumn("balance_due", money(F.round(due - F.col("paid_amount"), 2)))
        .withColumn("tax_percent", ratio("tax_amount", "subtotal_amount", 100))
    )
    amounts = priced.drop("reason", "stored_tax", "exact_discount", "tax")
    return Outputs(
        invoices=lambda: numbered(amounts, [], ["order_id"], "_place", bounded_by=orders)
        .withColumn("invoice_id", F.col("_place") + (first_invoice_id - 1)).drop("_place"),
        unnumbered=lambda: amounts,
        rejects=lambda: heads.filter(F.col("reason").isNotNull()).select("order_id", "reason"),
    )


def invoice_lines(items: DataFrame, products: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Invoice lines numbered within the order by line key."""
    lines = _priced_lines(items, products)
    return numbered(lines, ["order_id"], ["order_item_id"], "line_number", group_rows, bounded_by=items).select(
        "order_id", "line_number", "product_name", "quantity", "unit_price", "discount_percent", "line_total"
    )


# The printed layout.
RULE = "=" * 50
TITLE = " " * 19 + "INVOICE" + " " * 25
COLUMN_HEADS = "Line  Description                     Qty  Price      Total"
COLUMN_RULES = "----  ------------------------------  ---  ---------  ----------"
LABEL_WIDTH, AMOUNT_WIDTH, TAX_GAP = 48, 13, 39
CLOSING = ("Thank you for your business!", "Please pay within 30 days.", "For questions, contact: sales@company.com")


def _padded(text: Column, width: int, mark: str = " ") -> Column:
    """At least `width` characters; longer texts stay whole."""
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(mark))


def _amount(value: str) -> Column:
    return _padded(currency(value), AMOUNT_WIDTH)


def _labelled(label: str, value: str) -> Column:
    return F.concat(F.lit(label.ljust(LABEL_WIDTH)), _amount(value))


def _bill_address() -> Column:
    return text_of("address", F.lit(", "), "city", F.lit(", "), "country")


def _tax_label() -> Column:
    return text_of(F.lit("Tax ("), number_text("tax_percent"), F.lit("%):"))


def _text_head() -> list:
    return [
        RULE, TITLE, RULE,
        text_of(F.lit("Invoice #: "), "invoice_number"),
        text_of(F.lit("Order #: "), "order_id"),
        text_of(F.lit("Date: "), F.date_format("order_date", "MMM dd, yyyy")),
        text_of(F.lit("Status: "), "status"),
        text_of(F.lit("Payment Status: "), "payment_status"),
        "", "BILL TO:", "-" * 8, F.col("customer_name"), F.col("email"), _bill_address(),
        "", "SHIP TO:", "-" * 8, F.col("shipping_address"),
        "", RULE, COLUMN_HEADS, COLUMN_RULES,
    ]


def _text_line() -> Column:
    return F.concat_ws(
        "  ",
        _padded(F.col("line_number").cast("string"), 4),
        F.rpad(F.substring("product_name", 1, 30), 31, " "),
        _padded(F.col("quantity").cast("string"), 3),
        _padded(currency("unit_price"), 9),
        _padded(currency("line_total"), 10),
    )


def _text_foot(include_tax: bool) -> list:
    tax = [F.concat(_tax_label(), F.lit(" " * TAX_GAP), _amount("tax_amount"))] if include_tax else []
    return [
        RULE, _labelled("Subtotal:", "subtotal_amount"), _labelled("Discount:", "discount_amount"), *tax,
        "-" * 50, _labelled("Total:", "total_amount"),
        "", "Payment Summary:", "-" * 16,
        _labelled("Amount Paid:", "paid_amount"), _labelled("Balance Due:", "balance_due"),
        RULE, "", *CLOSING,
    ]


def _escaped(name: str) -> Column:
    text = F.col(name)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _html_head() -> list:
    facts = [("Invoice #", F.col("invoice_number")), ("Order #", F.col("order_id")),
             ("Date", F.date_format("order_date", "MMM dd, yyyy")), ("Status", F.col("status"))]
    return [
        "<!DOCTYPE html>",
        text_of(F.lit("<html><head><title>Invoice "), "invoice_number", F.lit("</title></head><body>")),
        "<h1>INVOICE</h1>",
        *[text_of(F.lit(f"<p>{label}: "), value, F.lit("</p>")) for label, value in facts],
        text_of(F.lit("<section><h2>Bill To</h2><p>"), _escaped("customer_name"), F.lit("<br>"), _escaped("email"),
                F.lit("<br>"), _bill_address(), F.lit("</p></section>")),
        text_of(F.lit("<section><h2>Ship To</h2><p>"), _escaped("shipping_address"), F.lit("</p></section>")),
        "<table><tr><th>#</th><th>Product</th><th>Quantity</th><th>Unit Price</th><th>Total</th></tr>",
    ]


def _html_line() -> Column:
    cells = ["line_number", _escaped("product_name"), "quantity", currency("unit_price"), currency("line_total")]
    wrapped = [text_of(F.lit("<td>"), cell, F.lit("</td>")) for cell in cells]
    return F.concat(F.lit("<tr>"), *wrapped, F.lit("</tr>"))


def _html_foot(include_tax: bool) -> list:
    def row(label, value: str) -> Column:
        return text_of(F.lit("<tr><th>"), label, F.lit("</th><td>"), currency(value), F.lit("</td></tr>"))

    return [
        "</table><table>",
        row(F.lit("Subtotal:"), "subtotal_amount"), row(F.lit("Discount:"), "discount_amount"),
        *([row(_tax_label(), "tax_amount")] if include_tax else []),
        row(F.lit("Total:"), "total_amount"), row(F.lit("Amount Paid:"), "paid_amount"),
        row(F.lit("Balance Due:"), "balance_due"),
        "</table>",
        *[f"<p>{line}</p>" for line in CLOSING],
        "</body></html>",
    ]


def _joined(lines: list) -> Column:
    """Lines of one block; a NULL value prints as an empty line."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in lines])


def render_invoices(
    invoice_rows: DataFrame, lines: DataFrame, output: str = "TEXT", include_tax: bool = True
) -> DataFrame:
    """One document per invoice. SCREEN and TEXT give the text layout, HTML a page."""
    form = output.upper()
    if form not in ("SCREEN", "TEXT", "HTML"):
        raise ValueError(f"Invalid output type: {output}")
    html = form == "HTML"
    head = _html_head() if html else _text_head()
    foot = _html_foot(include_tax) if html else _text_foot(include_tax)
    body = (
        lines.withColumn("_line", _html_line() if html else _text_line())
        .groupBy("order_id")
        .agg(F.expr("listagg(_line, '\\n') WITHIN GROUP (ORDER BY line_number)").alias("_body"))
    )
    whole = F.concat_ws("\n", _joined(head), F.col("_body"), _joined(foot))
    if not html:
        whole = F.concat(whole, F.lit("\n"))
    return invoice_rows.join(body, "order_id").select("invoice_number", "order_id", whole.alias("document"))
