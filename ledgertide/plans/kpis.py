"""Key figures of the dashboards; the definitions are stated with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions.compat import average_of, moment, percent, total, trunc_to
from ledgertide.plans.sales import active, customer_totals, product_profit_margin


def monthly_revenue_yoy(orders: DataFrame) -> DataFrame:
    """Net revenue per month and its change against the same month a year before.

    The months are laid on a spine, so a month without orders does not shift the comparison.
    """
    sums = active(orders).groupBy(trunc_to("month", "order_date").alias("month")).agg(
        total("net_amount").alias("revenue")
    )
    spine = sums.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month")
    )
    revenue = F.coalesce("revenue", F.lit(0)).cast("decimal(22,2)")
    filled = spine.join(sums, "month", "left").withColumn("revenue", revenue)
    by_month = Window.orderBy("month")
    return (
        filled.withColumn("revenue_last_year", F.lag("revenue", 12).over(by_month))
        .withColumn("yoy_percent", percent(F.col("revenue") - F.col("revenue_last_year"), "revenue_last_year"))
        .orderBy("month")
    )


def retention(orders: DataFrame, as_of) -> DataFrame:
    """Customers of a month who had also ordered the month before, over those of the month before.

    Each order marks its own month and the next one; one grouping by customer and month then
    knows both facts, without joining the orders to themselves.
    """
    month = trunc_to("month", "order_date")
    marks = active(orders).select(
        "customer_id",
        F.explode(F.array(
            F.struct(month.alias("month"), F.lit(1).alias("now"), F.lit(0).alias("before")),
            F.struct((month + F.expr("INTERVAL 1 MONTH")).alias("month"), F.lit(0).alias("now"),
                     F.lit(1).alias("before")),
        )).alias("m"),
    ).select("customer_id", "m.*")
    facts = marks.groupBy("customer_id", "month").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    return (
        facts.filter(F.col("month") <= moment(as_of))
        .groupBy("month")
        .agg(
            F.sum("now").alias("customers"),
            F.sum("before").alias("previous_customers"),
            F.sum(F.col("now") * F.col("before")).alias("retained"),
        )
        .filter(F.col("previous_customers") > 0)
        .withColumn("retention_rate", percent("retained", "previous_customers"))
        .orderBy("month")
    )


def fulfillment_time(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Average and median whole days from order to shipping and to delivery, by order status."""
    ordered = F.to_date("order_date")
    days = (
        orders.select("order_id", "order_date", F.col("status").alias("order_status"))
        .join(shipments.select("order_id", "ship_date", "actual_delivery"), "order_id")
        .select(
            "order_status",
            F.date_diff(F.to_date("ship_date"), ordered).alias("ship_days"),
            F.date_diff(F.to_date("actual_delivery"), ordered).alias("delivery_days"),
        )
    )
    return days.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"),
        average_of(F.sum("ship_days"), F.count("ship_days")).alias("avg_ship_days"),
        F.median("ship_days").alias("median_ship_days"),
        average_of(F.sum("delivery_days"), F.count("delivery_days")).alias("avg_delivery_days"),
        F.median("delivery_days").alias("median_delivery_days"),
    )


def return_rate(orders: DataFrame) -> DataFrame:
    """Returned orders over all orders, by month of order."""
    return (
        orders.groupBy(trunc_to("month", "order_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("status") == "RETURNED").alias("returned"))
        .withColumn("return_rate", percent("returned", "orders"))
    )


def return_rate_by_product(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Returned units over sold units, cancelled orders left out."""
    kept = orders.filter(F.col("status") != "CANCELLED").select("order_id", "status")
    return (
        items.select("order_id", "product_id", "quantity")
        .join(kept, "order_id")
        .groupBy("product_id")
        .agg(
            F.sum("quantity").alias("sold_units"),
            F.sum(F.when(F.col("status") == "RETURNED", F.col("quantity")).otherwise(0)).alias("returned_units"),
        )
        .withColumn("return_rate", percent("returned_units", "sold_units"))
    )


def revenue_by_category(items: DataFrame, orders: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """Revenue of active orders by category, with totals per parent and overall."""
    sold = (
        items.select("order_id", "product_id", "line_total")
        .join(active(orders).select("order_id"), "order_id", "left_semi")
        .groupBy("product_id")
        .agg(total("line_total").alias("revenue"))
    )
    parents = categories.select(F.col("category_id").alias("parent_category_id"), F.col("category_name").alias("parent"))
    named = (
        categories.select("category_id", F.col("category_name").alias("category"), "parent_category_id")
        .join(parents, "parent_category_id")
        .drop("parent_category_id")
    )
    return (
        sold.join(products.select("product_id", "category_id"), "product_id")
        .groupBy("category_id")
        .agg(total("revenue").alias("revenue"))
        .join(named, "category_id")
        .rollup("parent", "category")
        .agg(total("revenue").alias("revenue"))
    )


def revenue_by_region(orders: DataFrame, places: DataFrame) -> DataFrame:
    """Net revenue of active orders by region and country, with totals."""
    return (
        customer_totals(active(orders))
        .join(places, "customer_id")
        .rollup("region", "country")
        .agg(total("spent").alias("revenue"), F.sum("order_count").alias("orders"))
    )


def orders_by_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("orders"), total("net_amount").alias("net_amount"))


def pending_shipments(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Active orders not yet delivered whose shipment is waiting or does not exist."""
    waiting = active(orders).filter(F.col("status") != "DELIVERED").select("order_id", "customer_id", "order_date", "status")
    state = shipments.select("order_id", F.col("status").alias("shipment_status"))
    return waiting.join(state, "order_id", "left").filter(
        F.col("shipment_status").isNull() | F.col("shipment_status").isin("PENDING", "PROCESSING")
    )


def low_stock(products: DataFrame) -> DataFrame:
    return products.filter(F.col("stock_quantity") <= F.col("reorder_level")).select(
        "product_id", "product_name", "stock_quantity", "reorder_level", "status"
    )


def purchase_frequency(orders: DataFrame) -> DataFrame:
    """Active orders per month with at least one, by customer."""
    return (
        active(orders)
        .groupBy("customer_id", trunc_to("month", "order_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("customer_id")
        .agg(F.sum("n").alias("orders"), F.count(F.lit(1)).alias("active_months"))
        .withColumn("orders_per_month", average_of("orders", "active_months"))
    )


def churn_risk(customers: DataFrame, orders: DataFrame, as_of, bands=((90, "LOW"), (180, "MEDIUM"))) -> DataFrame:
    """Days since the last active order, in bands; customers without one are NEVER_ORDERED."""
    last = active(orders).groupBy("customer_id").agg(F.max("order_date").alias("last_order"))
    days = F.date_diff(F.to_date(moment(as_of)), F.to_date("last_order"))
    risk = F.when(F.col("days_since_order").isNull(), "NEVER_ORDERED")
    for limit, name in bands:
        risk = risk.when(F.col("days_since_order") <= limit, name)
    return (
        customers.select("customer_id")
        .join(last, "customer_id", "left")
        .withColumn("days_since_order", days)
        .select("customer_id", "days_since_order", risk.otherwise("HIGH").alias("churn_risk"))
    )


def top_margin_products(products: DataFrame, limit: int = 10) -> DataFrame:
    """Products with the best margin."""
    return (
        products.filter(F.col("status") == "ACTIVE")
        .select("product_id", "product_name", product_profit_margin().alias("profit_margin"))
        .orderBy(F.col("profit_margin").desc(), "product_id")
        .limit(limit)
    )
