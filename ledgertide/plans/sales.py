"""Sales analytics: lifetime value, credit, margins, forecasts, rankings and reports.

Facts are summed by key before they meet a dimension, so the join carries one row per key and
a key with very many orders is already combined on the map side.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions import rules
from ledgertide.functions.compat import (
    average,
    average_of,
    day_start,
    empty,
    lookup,
    moment,
    money,
    month_text,
    months_between,
    number_text,
    parse_moment,
    percent,
    ratio,
    shift_months,
    text_of,
    total,
    trunc_to,
)
from ledgertide.operators.ordered import framed, placed, ranked


def active(orders: DataFrame) -> DataFrame:
    """Orders that count: neither cancelled nor returned."""
    return orders.filter(~F.col("status").isin(*rules.INACTIVE_STATUSES))


def since(orders: DataFrame, start) -> DataFrame:
    return orders.filter(F.col("order_date") >= moment(start))


def between(orders: DataFrame, start, end) -> DataFrame:
    return orders.filter(F.col("order_date").between(moment(start), moment(end)))


def gross() -> Column:
    return F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")


def top_name(name: str, value: str) -> Column:
    """The name with the largest value; ties go to the first name."""
    return F.min_by(F.col(name), F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))


# -- values per customer and product ------------------------------------------------


def customer_totals(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        total("net_amount").alias("spent"), F.count(F.lit(1)).alias("order_count")
    )


def customer_lifetime_value(customers: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    spent = customer_totals(active(orders))
    # A month of 31 days in whole seconds keeps the division exact.
    month = 31 * 86400
    seconds = F.round(months_between(moment(as_of), "join_date") * month).cast("decimal(12,0)")
    scaled = F.coalesce("spent", F.lit(0)).cast("decimal(20,2)") * F.lit(rules.LIFETIME_MONTHS * month)
    value = F.round(scaled.cast("decimal(30,2)") / F.col("seconds"), 2).cast("double")
    return (
        customers.select("customer_id", seconds.alias("seconds"))
        .join(spent, "customer_id", "left")
        .select("customer_id", F.when(F.col("seconds") > 0, value).otherwise(0.0).alias("clv"))
    )


def validate_credit_limit(
    requests: DataFrame, customers: DataFrame, orders: DataFrame, payments: DataFrame
) -> DataFrame:
    """Approve or deny each request against the tier limit minus the unpaid orders."""
    asked = requests.select("customer_id").distinct()
    paid = payments.filter(F.col("status") == "COMPLETED").select("order_id")
    owed = (
        active(orders)
        .select("order_id", "customer_id", "net_amount")
        .join(asked, "customer_id", "left_semi")
        .join(paid, "order_id", "left_anti")
        .groupBy("customer_id")
        .agg(total("net_amount").alias("balance"))
    )
    limits = customers.select(
        "customer_id",
        lookup("customer_segment", rules.CREDIT_LIMITS, rules.DEFAULT_CREDIT_LIMIT).alias("credit_limit"),
    )
    left = money(F.col("credit_limit") - F.coalesce("balance", F.lit(0).cast("decimal(22,2)")))
    known = F.col("credit_limit").isNotNull()
    verdict = (
        F.when(~known, F.lit("ERROR: customer not found"))
        .when(F.col("order_amount") <= F.col("available"),
              text_of(F.lit("APPROVED: Available credit: $"), number_text("available")))
        .otherwise(text_of(F.lit("DENIED: Order amount ($"), number_text("order_amount"),
                           F.lit(") exceeds available credit ($"), number_text("available"), F.lit(")")))
    )
    return (
        requests.join(limits, "customer_id", "left")
        .join(owed, "customer_id", "left")
        .withColumn("available", F.when(known, left))
        .select("request_id", "customer_id", "order_amount", "available", verdict.alias("verdict"))
    )


def product_profit_margin(price="unit_price", cost="unit_cost") -> Column:
    price, cost = F.col(price), F.col(cost)
    return F.when(price > 0, percent(price - cost, price)).otherwise(F.lit(0.0))


def discount_amount(amount, segment, percent_by_segment: dict) -> Column:
    """Tier discount; the percentages belong to the caller, an unlisted tier gets none."""
    rate = lookup(segment, {k: float(v) for k, v in percent_by_segment.items()}, 0.0)
    return F.round(F.col(amount) * rate.cast("decimal(5,2)") / 100, 2).cast("decimal(12,2)")


# -- time -----------------------------------------------------------------------------


def monthly_sales(orders: DataFrame, as_of, months_back: int = 12) -> DataFrame:
    return (
        active(since(orders, shift_months(as_of, -months_back)))
        .groupBy(trunc_to("month", "order_date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            total("net_amount").alias("revenue"),
            average("net_amount").alias("avg_order_value"),
        )
        .orderBy(F.col("month").desc())
    )


def predict_sales(orders: DataFrame, as_of, months_ahead: int = 1, target_month_factor: bool = False) -> DataFrame:
    """Average of the month-number sums of the last year times a seasonal factor.

    The factor is that of the current month; `target_month_factor` takes the month forecast.
    """
    month = (shift_months(as_of, months_ahead) if target_month_factor else parse_moment(as_of)).month
    factor = F.lit(rules.SEASONAL_FACTORS.get(month, 1)).cast("decimal(4,2)")
    sums = (
        active(since(orders, shift_months(as_of, -12)))
        .groupBy(F.month("order_date").alias("month"))
        .agg(total("net_amount").alias("sales"))
    )
    predicted = F.sum("sales").cast("decimal(24,2)") * factor / F.count("sales").cast("decimal(4,0)")
    return sums.agg(F.round(predicted, 2).cast("decimal(22,2)").alias("predicted_sales"))


def yoy_growth(orders: DataFrame, as_of) -> DataFrame:
    year = parse_moment(as_of).year
    span = F.col("order_date")
    this_year = span >= moment(dt.date(year, 1, 1))
    window = active(orders).filter(
        (span >= moment(dt.date(year - 1, 1, 1))) & (span < moment(dt.date(year + 1, 1, 1)))
    )
    sums = window.agg(
        total(F.when(this_year, F.col("net_amount"))).alias("current_sales"),
        total(F.when(~this_year, F.col("net_amount"))).alias("previous_sales"),
    )
    growth = percent(F.col("current_sales") - F.col("previous_sales"), "previous_sales")
    return sums.withColumn("growth_pct", F.when(F.col("previous_sales") > 0, growth).otherwise(100.0))


def conversion_rate(
    orders: DataFrame, start, end, visits: DataFrame | None = None, visits_per_order: int = rules.VISITS_PER_ORDER
) -> DataFrame:
    """Orders per hundred visits. Without a visit feed, a fixed number of visits per order is assumed."""
    placed = active(between(orders, start, end)).agg(F.count(F.lit(1)).alias("total_orders"))
    if visits is None:
        counted = placed.withColumn("total_visits", F.col("total_orders") * visits_per_order)
    else:
        seen = visits.filter(F.col("visit_ts").between(moment(start), moment(end))).agg(F.count(F.lit(1)))
        counted = placed.withColumn("total_visits", seen.scalar())
    rate = F.when(F.col("total_visits") > 0, percent("total_orders", "total_visits")).otherwise(0.0)
    return counted.withColumn("conversion_rate", rate)


def _month_trend(monthly: DataFrame, month: str, sales: str) -> DataFrame:
    """Previous month, growth and three-month average; one row per month, so one small task."""
    by_month = Window.orderBy(month)
    frame = by_month.rowsBetween(-2, 0)
    return monthly.withColumn("prev_month_sales", F.lag(sales).over(by_month)).withColumn(
        "three_month_avg", average_of(F.sum(sales).over(frame), F.count(sales).over(frame))
    )


def monthly_trend(orders: DataFrame, as_of, limit: int = 6) -> DataFrame:
    sums = (
        active(since(orders, shift_months(as_of, -12)))
        .groupBy(month_text("order_date").alias("month"))
        .agg(total("net_amount").alias("monthly_sales"))
    )
    return (
        _month_trend(sums, "month", "monthly_sales")
        .withColumnRenamed("three_month_avg", "three_month_moving_avg")
        .orderBy(F.col("month").desc())
        .limit(limit)
    )


def monthly_growth(orders: DataFrame, as_of, months_back: int = 6, status: str = "DELIVERED") -> DataFrame:
    """Growth of delivered sales over the last months; the current month start is the anchor."""
    anchor = parse_moment(as_of).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    sums = (
        since(orders, shift_months(anchor, -months_back))
        .filter(F.col("status") == status)
        .groupBy(month_text("order_date").alias("month_year"))
        .agg(total("total_amount").alias("total_sales"))
    )
    growth = percent(F.col("total_sales") - F.col("prev_month_sales"), "prev_month_sales")
    return (
        _month_trend(sums, "month_year", "total_sales")
        .withColumn("monthly_growth_percent", growth)
        .orderBy(F.col("month_year").desc())
    )


def sales_growth_by_month(orders: DataFrame) -> DataFrame:
    """Growth of gross sales over the whole history, every status."""
    sums = orders.groupBy(month_text("order_date").alias("sales_month")).agg(
        total("total_amount").alias("monthly_sales")
    )
    growth = percent(F.col("monthly_sales") - F.col("prev_month_sales"), "prev_month_sales")
    return (
        sums.withColumn("prev_month_sales", F.lag("monthly_sales").over(Window.orderBy("sales_month")))
        .withColumn("growth_percentage", growth)
        .orderBy("sales_month")
    )


# -- products -------------------------------------------------------------------------


def _product_sums(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.sum("quantity").cast("bigint").alias("units"), total(gross()).alias("gross")
    )


def top_selling_products(
    items: DataFrame, products: DataFrame, orders: DataFrame, as_of, limit: int = 10, months_back: int = 6
) -> DataFrame:
    recent = active(since(orders, shift_months(as_of, -months_back))).select("order_id")
    sold = _product_sums(items.join(recent, "order_id"))
    best = (
        sold.join(products, "product_id")
        .select(
            "product_id",
            "product_name",
            "category_id",
            F.col("units").alias("total_units_sold"),
            F.col("gross").alias("total_revenue"),
            product_profit_margin().alias("avg_profit_margin"),
        )
        .orderBy(F.col("total_units_sold").desc(), "product_id")
        .limit(limit)
    )
    # Everything that beats a kept row is kept too, so ranking the kept rows is exact.
    return best.withColumn(
        "sales_rank", F.rank().over(Window.orderBy(F.col("total_units_sold").desc())).cast("bigint")
    )


def _product_sales(
    products: DataFrame, items: DataFrame, orders: DataFrame, exclude_inactive: bool, keep: list[str]
) -> DataFrame:
    """Units and revenue per product, unsold products included.

    By default lines of cancelled and returned orders count as well: the status test of the
    rules sits in an outer join that never removes a line. `exclude_inactive` leaves them out.
    """
    if exclude_inactive:
        items = items.join(active(orders).select("order_id"), "order_id", "left_semi")
    sold = _product_sums(items)
    return products.join(sold, "product_id", "left").select(
        *keep,
        F.coalesce("units", F.lit(0)).alias("units_sold"),
        money(F.coalesce("gross", F.lit(0))).alias("revenue"),
        product_profit_margin().alias("profit_margin"),
    )


def product_performance(
    products: DataFrame,
    categories: DataFrame,
    items: DataFrame,
    orders: DataFrame,
    category_id: int | None = None,
    exclude_inactive: bool = False,
) -> DataFrame:
    if category_id is not None:
        products = products.filter(F.col("category_id") == category_id)
    keep = ["product_id", "product_name", "category_id"]
    sales = _product_sales(products, items, orders, exclude_inactive, keep)
    named = sales.join(categories.select("category_id", "category_name"), "category_id", "left").drop("category_id")
    return ranked(named, [], ["-units_sold"], rank="sales_rank").orderBy(F.col("units_sold").desc_nulls_last(), "product_id")


def top_performers(
    kind: str,
    customers: DataFrame | None = None,
    orders: DataFrame | None = None,
    products: DataFrame | None = None,
    categories: DataFrame | None = None,
    items: DataFrame | None = None,
    limit: int = 10,
    exclude_inactive: bool = False,
) -> DataFrame:
    """Best customers by spend or best products by revenue; another kind gives no rows."""
    kind = kind.upper()
    if kind == "CUSTOMERS":
        spent = customer_totals(active(orders))
        return (
            customers.select("customer_id", "customer_name", "customer_segment")
            .join(spent, "customer_id", "left")
            .select(
                "customer_id",
                "customer_name",
                "customer_segment",
                money(F.coalesce("spent", F.lit(0))).alias("total_spent"),
                F.coalesce("order_count", F.lit(0)).alias("order_count"),
            )
            .orderBy(F.col("total_spent").desc(), "customer_id")
            .limit(limit)
            .withColumn(
                "avg_order_value",
                F.coalesce(ratio("total_spent", "order_count").cast("double"), F.lit(0.0)),
            )
        )
    if kind == "PRODUCTS":
        keep = ["product_id", "product_name", "category_id"]
        sales = _product_sales(products, items, orders, exclude_inactive, keep)
        best = sales.orderBy(F.col("revenue").desc(), "product_id").limit(limit)
        return (
            best.join(categories.select("category_id", "category_name"), "category_id", "left")
            .drop("category_id")
            .orderBy(F.col("revenue").desc(), "product_id")
        )
    session = next(d for d in (customers, orders, products, items) if d is not None).sparkSession
    return empty(session, "id bigint, name string")


def top_products_by_category(products: DataFrame, categories: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """Best product names of each category; the rank limit is applied before the shuffle."""
    sold = _product_sums(items).select("product_id", "gross")
    sums = (
        products.select("product_id", "product_name", "category_id")
        .join(sold, "product_id", "left")
        .groupBy("category_id", "product_name")
        .agg(total("gross").alias("total_sales"))
    )
    place = Window.partitionBy("category_id").orderBy(F.col("total_sales").desc(), "product_name")
    best = sums.withColumn("sales_rank_in_category", F.row_number().over(place).cast("bigint")).filter(
        F.col("sales_rank_in_category") <= k
    )
    return (
        best.join(categories.select("category_id", "category_name"), "category_id")
        .select("category_name", "product_name", "total_sales", "sales_rank_in_category")
        .orderBy("category_name", "sales_rank_in_category")
    )


def bulk_update_prices(products: DataFrame, category_id: int, pct) -> tuple[DataFrame, DataFrame]:
    """New product rows and a one-row count of the changed ones."""
    hit = F.col("category_id") == category_id
    factor = F.lit(1 + Decimal(str(pct)) / 100).cast("decimal(9,6)")
    changed = products.withColumn(
        "unit_price",
        F.when(hit, F.round(F.col("unit_price") * factor, 2).cast("decimal(10,2)")).otherwise(F.col("unit_price")),
    )
    return changed, products.agg(F.count_if(hit).alias("updated_count"))


# -- customers ------------------------------------------------------------------------


def update_customer_segments(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer rows with the spend recomputed and the segment that follows from it."""
    spent = customer_totals(active(orders)).select("customer_id", "spent")
    now = money(F.coalesce("spent", F.lit(0)))
    segment = F.when(F.lit(False), "")
    for name, floor in rules.SEGMENT_FLOORS:
        segment = segment.when(F.col("total_spent") >= floor, name)
    segment = segment.when(F.col("total_spent") > 0, "BRONZE").otherwise("NEW")
    return (
        customers.join(spent, "customer_id", "left")
        .withColumn("total_spent", now)
        .withColumn("customer_segment", segment)
        .select(*customers.columns)
    )


def customer_ranking(customers: DataFrame, orders: DataFrame, limit: int = 5) -> DataFrame:
    """Best customers by net spend with their share of the total."""
    spent = customer_totals(active(orders)).select("customer_id", F.col("spent").alias("total_spent"))
    named = spent.join(customers.select("customer_id", "customer_name"), "customer_id")
    everyone = named.agg(F.sum("total_spent")).scalar()
    best = named.orderBy(F.col("total_spent").desc(), "customer_id").limit(limit)
    placed = best.withColumn(
        "customer_rank", F.rank().over(Window.orderBy(F.col("total_spent").desc())).cast("bigint")
    )
    return placed.withColumn("percent_of_total", percent("total_spent", everyone))


def customer_rank_stored(customers: DataFrame, limit: int = 5) -> DataFrame:
    """Best customers by the stored spend."""
    best = (
        customers.select("customer_id", "customer_name", "total_spent")
        .orderBy(F.col("total_spent").desc(), "customer_id")
        .limit(limit)
    )
    return best.withColumn(
        "spending_rank", F.rank().over(Window.orderBy(F.col("total_spent").desc())).cast("bigint")
    )


def customer_rank_prev(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer's rank by gross purchases and the spend of the customer just above."""
    spent = orders.groupBy("customer_id").agg(total("total_amount").alias("total_spent"))
    named = spent.join(customers.select("customer_id", "customer_name"), "customer_id")
    order = ["-total_spent", "customer_id"]
    ranks = ranked(placed(named, order, "_at"), [], ["-total_spent"], rank="customer_rank", place="_at")
    return framed(
        ranks, [], order, lambda spec: {"prev_customer_spent": F.lag("total_spent").over(spec)}, before=1, place="_at"
    ).drop("_at")


def order_moving_avg(orders: DataFrame, rows: int = 7) -> DataFrame:
    """Moving average of the order amount over all orders in time order."""
    slim = orders.select("order_id", "order_date", "total_amount")

    def build(spec):
        frame = spec.rowsBetween(1 - rows, 0)
        return {
            "weekly_moving_avg": average_of(
                F.sum("total_amount").over(frame), F.count("total_amount").over(frame)
            )
        }

    return framed(slim, [], ["order_date", "order_id"], build, before=rows - 1)


def customer_order_history(
    customers: DataFrame, orders: DataFrame, items: DataFrame, customer_id: int | None = None
) -> DataFrame:
    """Orders with the number of their lines, newest first."""
    if customer_id is not None:
        customers = customers.filter(F.col("customer_id") == customer_id)
        orders = orders.filter(F.col("customer_id") == customer_id)
        items = items.join(orders.select("order_id"), "order_id", "left_semi")
    lines = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
    return (
        orders.select("order_id", "customer_id", "order_date", "total_amount", "status")
        .join(customers.select("customer_id", "customer_name"), "customer_id")
        .join(lines, "order_id", "left")
        .select(
            "customer_name", "order_id", "order_date", "total_amount", "status",
            F.coalesce("item_count", F.lit(0)).alias("item_count"),
        )
        .orderBy(F.col("order_date").desc(), F.col("order_id").desc())
    )


def customer_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    return customers.select("customer_id", "customer_name").join(
        orders.select("customer_id", "order_id", "total_amount"), "customer_id"
    ).select("customer_name", "order_id", "total_amount")


def segment_order_average(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Joined rows and average order amount by segment."""
    sums = orders.groupBy("customer_id").agg(total("total_amount").alias("spent"), F.count(F.lit(1)).alias("n"))
    return (
        sums.join(customers.select("customer_id", "customer_segment"), "customer_id")
        .groupBy("customer_segment")
        .agg(F.sum("n").alias("customer_count"), average_of(F.sum("spent"), F.sum("n")).alias("avg_order_value"))
    )


def segment_analysis(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers, revenue and orders per customer by segment.

    Orders are unique, so summing per customer first replaces both distinct counts.
    """
    sums = orders.groupBy("customer_id").agg(total("total_amount").alias("spent"), F.count(F.lit(1)).alias("n"))
    return (
        sums.join(customers.select("customer_id", "customer_segment"), "customer_id")
        .groupBy("customer_segment")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            money(F.sum("spent")).alias("total_revenue"),
            average_of(F.sum("spent"), F.sum("n")).alias("avg_order_value"),
            average_of(F.sum("n"), F.count(F.lit(1))).alias("avg_orders_per_customer"),
        )
        .orderBy(F.col("total_revenue").desc())
    )


# -- reports --------------------------------------------------------------------------


def sales_report(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, start, end
) -> DataFrame:
    """One row: revenue, orders, average, best product by units and best customer by spend."""
    chosen = active(between(orders, start, end))
    by_name = (
        customer_totals(chosen)
        .join(customers.select("customer_id", "customer_name"), "customer_id", "left")
        .groupBy("customer_name")
        .agg(F.sum("spent").alias("spent"), F.sum("order_count").alias("order_count"))
    )
    units = (
        _product_sums(items.join(chosen.select("order_id"), "order_id"))
        .join(products.select("product_id", "product_name"), "product_id")
        .groupBy("product_name")
        .agg(F.sum("units").alias("units"))
    )
    best_product = units.agg(top_name("product_name", "units")).scalar()
    known = F.col("customer_name").isNotNull()
    return by_name.agg(
        total("spent").alias("total_revenue"),
        F.coalesce(F.sum("order_count"), F.lit(0)).alias("total_orders"),
        F.coalesce(average_of(F.sum("spent"), F.sum("order_count")), F.lit(0.0)).alias("avg_order_value"),
        F.min_by(
            F.when(known, F.col("customer_name")),
            F.when(known, F.struct((-F.col("spent")).alias("v"), F.col("customer_name").alias("n"))),
        ).alias("top_customer"),
    ).select(
        moment(start).alias("period_start"),
        moment(end).alias("period_end"),
        "total_revenue",
        "total_orders",
        "avg_order_value",
        F.coalesce(best_product, F.lit("N/A")).alias("top_product"),
        F.coalesce("top_customer", F.lit("N/A")).alias("top_customer"),
    )


def performance_summary(orders: DataFrame, as_of) -> DataFrame:
    growth = yoy_growth(orders, as_of).select("growth_pct").scalar()
    return active(orders).agg(
        total("net_amount").alias("total_revenue"),
        F.count(F.lit(1)).alias("total_orders"),
        F.coalesce(average("net_amount"), F.lit(0.0)).alias("avg_order_value"),
    ).withColumn("yoy_growth", growth)


def performance_report(
    kind: str, orders, as_of, customers=None, products=None, categories=None, items=None, top: int = 5
) -> dict[str, DataFrame]:
    """SUMMARY gives the totals; DETAILED adds the best customers and products."""
    report = {"summary": performance_summary(orders, as_of)}
    if kind.upper() == "DETAILED":
        report["customers"] = top_performers("CUSTOMERS", customers=customers, orders=orders, limit=top)
        report["products"] = top_performers(
            "PRODUCTS", products=products, categories=categories, items=items, orders=orders, limit=top
        )
    return report


def daily_revenue(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, dates: list | None = None
) -> DataFrame:
    """The daily report for every day with orders, or for the days given."""
    if dates is not None:
        picked = [parse_moment(d).replace(hour=0, minute=0, second=0, microsecond=0) for d in dates]
        test = F.lit(False)
        for at in picked:
            test = test | (
                (F.col("order_date") >= moment(at)) & (F.col("order_date") < moment(at + dt.timedelta(days=1)))
            )
        orders = orders.filter(test)
    counts = ~F.col("status").isin(*rules.INACTIVE_STATUSES)
    net = F.when(counts, F.col("net_amount"))
    office = counts & F.hour("order_date").between(9, 17)
    by_day = orders.groupBy(day_start("order_date").alias("report_date")).agg(
        total(net).alias("revenue"),
        F.count(F.lit(1)).alias("order_count"),
        F.coalesce(average(net), F.lit(0.0)).alias("avg_order_value"),
        money(F.coalesce(F.max(net), F.lit(0))).alias("max_order_value"),
        money(F.coalesce(F.min(net), F.lit(0))).alias("min_order_value"),
        F.count_if(F.col("status") == "CANCELLED").alias("cancelled_orders"),
        F.count_if(F.col("status") == "RETURNED").alias("returned_orders"),
        percent(F.count_if(F.col("status").isin(*rules.COMPLETED_STATUSES)), F.count(F.lit(1))).alias(
            "completion_rate"
        ),
        total(F.when(office, F.col("net_amount"))).alias("business_hours_revenue"),
    )
    sold = active(orders).select("order_id", "customer_id", "net_amount", day_start("order_date").alias("report_date"))
    best_product = (
        items.select("order_id", "product_id", "quantity")
        .join(sold.select("order_id", "report_date"), "order_id")
        .groupBy("report_date", "product_id")
        .agg(F.sum("quantity").alias("units"))
        .join(products.select("product_id", "product_name"), "product_id")
        .groupBy("report_date", "product_name")
        .agg(F.sum("units").alias("units"))
        .groupBy("report_date")
        .agg(top_name("product_name", "units").alias("top_product"))
    )
    best_customer = (
        sold.groupBy("report_date", "customer_id")
        .agg(total("net_amount").alias("spent"))
        .join(customers.select("customer_id", "customer_name"), "customer_id")
        .groupBy("report_date", "customer_name")
        .agg(F.sum("spent").alias("spent"))
        .groupBy("report_date")
        .agg(top_name("customer_name", "spent").alias("top_customer"))
    )
    return (
        by_day.join(best_product, "report_date", "left")
        .join(best_customer, "report_date", "left")
        .withColumn("avg_revenue_per_hour", ratio("revenue", F.lit(24)).cast("double"))
        .withColumn("top_product", F.coalesce("top_product", F.lit("No products sold")))
        .withColumn("top_customer", F.coalesce("top_customer", F.lit("No customers")))
    )


def hourly_breakdown(orders: DataFrame, date=None) -> DataFrame:
    """Active orders by hour of one day, or of every day."""
    if date is not None:
        at = parse_moment(date).replace(hour=0, minute=0, second=0, microsecond=0)
        orders = orders.filter(
            (F.col("order_date") >= moment(at)) & (F.col("order_date") < moment(at + dt.timedelta(days=1)))
        )
    return (
        active(orders)
        .groupBy(day_start("order_date").alias("report_date"), F.hour("order_date").alias("hour_of_day"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            total("net_amount").alias("hourly_revenue"),
            F.round(F.avg(F.col("net_amount").cast("decimal(18,2)")), 2).cast("double").alias("avg_order_value"),
        )
        .orderBy("report_date", "hour_of_day")
    )
