"""Tables written, changed and read back, beside the same rows asked in SQL."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract.base import query
from contract.orders import CHANGES, changed
from ledgertide.plans import quality
from ledgertide.sources import tables
from ledgertide.sources.keyed import KeyedTable, KeyRanges
from ledgertide.sources.keyfilter import KeyFilter
from ledgertide.streaming.feeds import work_folder


@query("keyed_update", f"""
WITH RECURSIVE {CHANGES.strip()}
SELECT product_id, product_name, unit_price, stock_quantity + coalesce(extra, 0) AS stock_quantity
FROM m_products LEFT JOIN (
  SELECT product_id, CAST(sum(quantity) AS BIGINT) AS extra FROM walk JOIN m_items USING (order_id)
  WHERE changed AND after = 'CANCELLED' GROUP BY 1) USING (product_id)""")
def _(m):
    stock = KeyedTable(m.spark, work_folder(m.spark, "stock"), "product_id")
    stock.create(m.products().select("product_id", "product_name", "unit_price", "stock_quantity"), files=16)
    stock.change(changed(m)["stock"], add={"stock_quantity": "stock_delta"}, name="restock")
    return stock.read()


@query("keyed_update_files", """
SELECT count(*) AS changed_rows, 1::BIGINT AS files_written, 15::BIGINT AS files_kept FROM m_products
WHERE product_id = (SELECT min(product_id) FROM m_products)""")
def _(m):
    goods = m.products().select("product_id", "unit_price")
    prices = KeyedTable(m.spark, work_folder(m.spark, "prices"), "product_id")
    prices.create(goods, files=16)
    first = goods.agg(F.min("product_id").alias("product_id")).withColumn("raise", F.lit(1))
    prices.change(first, add={"unit_price": "raise"})
    old, new = prices.files(1).select("file"), prices.files(2).select("file")
    was = prices.read(1).withColumnRenamed("unit_price", "old_price")
    moved = prices.read(2).join(was, "product_id").filter("unit_price <> old_price").agg(F.count("*").alias("changed_rows"))
    return moved.crossJoin(new.join(old, "file", "left_anti").agg(F.count("*").alias("files_written"))).crossJoin(
        new.join(old, "file", "left_semi").agg(F.count("*").alias("files_kept")))


@query("key_ranges", """
SELECT order_id, row_number() OVER (ORDER BY order_id % 2 DESC, order_id) AS payment_key FROM m_orders""")
def _(m):
    # Two batches of one job: odd orders come first and take the first range, and the batch that runs again the same one.
    keys = KeyRanges(m.spark, work_folder(m.spark, "keys"))
    orders = m.orders().select("order_id")
    odd = keys.with_keys(orders.filter("order_id % 2 = 1"), ["order_id"], "payment_key", "odd")
    even = keys.with_keys(orders.filter("order_id % 2 = 0"), ["order_id"], "payment_key", "even")
    again = keys.with_keys(orders.filter("order_id % 2 = 1"), ["order_id"], "payment_key", "odd")
    return odd.intersect(again).unionByName(even)


@query("append_log", "SELECT audit_id, employee_id, action_type, status FROM m_audit")
def _(m):
    folder = work_folder(m.spark, "log")
    entries = m.audit().select("audit_id", "employee_id", "action_type", "status")
    tables.append(entries.filter("status = 'ALLOWED'"), folder)
    tables.append(entries.filter("status <> 'ALLOWED'"), folder)
    return m.spark.read.schema(entries.schema).parquet(folder)


@query("added_columns", """
SELECT customer_id, 0.00::DECIMAL(10,2) AS store_credit, 0::BIGINT AS total_returns, NULL::TIMESTAMP AS last_return_date,
       0.00::DECIMAL(12,2) AS total_refund_amount FROM m_customers""")
def _(m):
    folder = work_folder(m.spark, "customers")
    m.customers().select("customer_id").write.parquet(folder)
    grown = tables.add_missing_columns(m.spark.read.parquet(folder), tables.RETURN_HISTORY)
    return tables.add_missing_columns(grown, tables.RETURN_HISTORY)  # a second call finds them there


@query("stored_defaults", """
SELECT order_id, coalesce(nullif(status, 'PENDING'), 'PENDING') AS status,
       total_amount - CASE WHEN order_id % 3 = 0 THEN 0 ELSE discount_amount END + tax_amount AS net_amount FROM m_orders""")
def _(m):
    # Stored without some values: reading fills the defaults and derives the net amount.
    folder = work_folder(m.spark, "orders")
    bare = m.orders().drop("net_amount")
    bare = bare.withColumn("status", F.nullif("status", F.lit("PENDING")))
    bare.withColumn("discount_amount", F.when(F.col("order_id") % 3 != 0, F.col("discount_amount"))).write.parquet(folder)
    return tables.read_table(m.spark, folder, "orders").select("order_id", "status", "net_amount")


@query("gated_load", "SELECT 'sound' AS load, product_id, product_name FROM m_products")
def _(m):
    # Two loads stand ready; the one with a product twice is held back by its checks.
    goods = m.products().select("product_id", "product_name")
    first = goods.filter(F.col("product_id") == goods.agg(F.min("product_id")).first()[0])
    loads = {"sound": goods, "unsound": goods.unionByName(first)}
    published = []
    for name, staged in loads.items():
        target = tables.publish_if_clean(
            staged, quality.check_unique(staged, ("product_id",)), work_folder(m.spark, f"load-{name}"))
        if target:
            published.append(m.spark.read.parquet(target).select(F.lit(name).alias("load"), "product_id", "product_name"))
    return reduce(DataFrame.unionByName, published)


@query("staged_keys", """
WITH days AS (SELECT max(order_date) - INTERVAL 90 DAY AS start FROM m_orders),
staged AS (SELECT order_id, order_date < start AS there FROM m_orders, days WHERE order_date >= start - INTERVAL 30 DAY
  UNION ALL SELECT order_id, false FROM m_orders, days WHERE order_date >= start + INTERVAL 60 DAY)
SELECT CASE WHEN bool_or(there) THEN 'exists' ELSE 'repeated' END AS finding, order_id, count(*) AS staged_rows
FROM staged GROUP BY order_id HAVING count(*) > 1 OR bool_or(there)
UNION ALL
SELECT 'orphan', order_id, count(*) FROM m_items JOIN m_orders USING (order_id), days WHERE order_date >= start GROUP BY order_id""")
def _(m):
    # History ends 90 days before the last order. The staged orders replay its last month and send the newest orders twice;
    # the lines of all orders are staged before the new orders are.
    orders = m.orders().select("order_id", "order_date")
    start = F.lit(orders.agg(F.max("order_date") - F.expr("INTERVAL 90 DAY")).first()[0])
    history = KeyedTable(m.spark, work_folder(m.spark, "history"), "order_id")
    history.create(orders.filter(F.col("order_date") < start), files=16)
    held = KeyFilter(history)
    newest = orders.filter(F.col("order_date") >= start + F.expr("INTERVAL 60 DAY"))
    staged = orders.filter(F.col("order_date") >= start - F.expr("INTERVAL 30 DAY")).unionByName(newest)
    found = held.repeated(staged).select(
        F.when(F.col("exists"), "exists").otherwise("repeated").alias("finding"), "order_id", "staged_rows")
    lost = held.orphans(m.items(), "order_id").select(F.lit("orphan").alias("finding"), "order_id", "staged_rows")
    return found.unionByName(lost)
