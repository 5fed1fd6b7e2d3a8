"""Dashboard figures, promotions and hierarchies."""

from contract.base import query, rdiv, sql_cents
from ledgertide.operators import joins as j
from ledgertide.plans import kpis as k
from ledgertide.sources.model import AS_OF_ORDERS as NOW

MONTH = "date_trunc('month', order_date)::TIMESTAMP"


@query("kpi_monthly_revenue_yoy", f"""
WITH s AS (SELECT {MONTH} AS month, CAST(sum(net_amount) AS DECIMAL(22,2)) AS revenue FROM m_active GROUP BY 1),
l AS (SELECT a.month, a.revenue, b.revenue AS revenue_last_year
      FROM s a LEFT JOIN s b ON b.month = a.month - INTERVAL 12 MONTH)
SELECT *, {rdiv(sql_cents("revenue - revenue_last_year"), sql_cents("revenue_last_year"), 2, 100)} AS yoy_percent FROM l""")
def _(m):
    return k.monthly_revenue_yoy(m.orders())


@query("kpi_retention", f"""
WITH d AS (SELECT DISTINCT customer_id, {MONTH} AS month FROM m_active),
p AS (SELECT customer_id, month + INTERVAL 1 MONTH AS month FROM d),
f AS (SELECT coalesce(d.month, p.month) AS month, count(d.month) AS customers, count(p.month) AS previous_customers,
             count(*) FILTER (d.month IS NOT NULL AND p.month IS NOT NULL) AS retained
      FROM d FULL JOIN p ON d.customer_id = p.customer_id AND d.month = p.month GROUP BY 1)
SELECT *, {rdiv("retained", "previous_customers", 2, 100)} AS retention_rate FROM f
WHERE month <= TIMESTAMP '2001-08-02' AND previous_customers > 0""")
def _(m):
    return k.retention(m.orders(), NOW)


@query("kpi_fulfillment_time", f"""
WITH d AS (SELECT o.status AS order_status, date_diff('day', order_date::DATE, ship_date::DATE) AS a,
                  date_diff('day', order_date::DATE, actual_delivery::DATE) AS b
           FROM m_orders o JOIN m_shipments s USING (order_id))
SELECT order_status, count(*) AS orders, {rdiv("sum(a)", "count(a)", 6)} AS avg_ship_days,
       median(a)::DOUBLE AS median_ship_days, {rdiv("sum(b)", "count(b)", 6)} AS avg_delivery_days,
       median(b)::DOUBLE AS median_delivery_days
FROM d GROUP BY 1""")
def _(m):
    return k.fulfillment_time(m.orders(), m.shipments())


@query("kpi_return_rate", f"""
SELECT {MONTH} AS month, count(*) AS orders, count(*) FILTER (status = 'RETURNED') AS returned,
       {rdiv("count(*) FILTER (status = 'RETURNED')", "count(*)", 2, 100)} AS return_rate FROM m_orders GROUP BY 1""")
def _(m):
    return k.return_rate(m.orders())


@query("kpi_return_rate_by_product", f"""
WITH t AS (SELECT product_id, CAST(sum(quantity) AS BIGINT) AS sold_units,
                  CAST(coalesce(sum(quantity) FILTER (status = 'RETURNED'), 0) AS BIGINT) AS returned_units
           FROM m_items JOIN m_orders USING (order_id) WHERE status <> 'CANCELLED' GROUP BY 1)
SELECT *, {rdiv("returned_units", "sold_units", 2, 100)} AS return_rate FROM t""")
def _(m):
    return k.return_rate_by_product(m.items(), m.orders())


@query("kpi_revenue_by_category", """
SELECT par.category_name AS parent, c.category_name AS category, CAST(sum(line_total) AS DECIMAL(22,2)) AS revenue
FROM m_items JOIN m_active USING (order_id) JOIN m_products USING (product_id)
     JOIN m_categories c USING (category_id) JOIN m_categories par ON par.category_id = c.parent_category_id
GROUP BY ROLLUP (par.category_name, c.category_name)""")
def _(m):
    return k.revenue_by_category(m.items(), m.orders(), m.products(), m.categories())


@query("kpi_revenue_by_region", """
SELECT region, country, CAST(sum(net_amount) AS DECIMAL(22,2)) AS revenue, count(*) AS orders
FROM m_active JOIN m_regions USING (customer_id) GROUP BY ROLLUP (region, country)""")
def _(m):
    return k.revenue_by_region(m.orders(), m.regions())


@query("kpi_orders_by_status", """
SELECT status, count(*) AS orders, CAST(sum(net_amount) AS DECIMAL(22,2)) AS net_amount FROM m_orders GROUP BY 1""")
def _(m):
    return k.orders_by_status(m.orders())


@query("kpi_pending_shipments", """
SELECT o.order_id, o.customer_id, o.order_date, o.status, s.status AS shipment_status
FROM m_active o LEFT JOIN m_shipments s USING (order_id)
WHERE o.status <> 'DELIVERED' AND coalesce(s.status, 'PENDING') IN ('PENDING', 'PROCESSING')""")
def _(m):
    return k.pending_shipments(m.orders(), m.shipments())


@query("kpi_low_stock", """
SELECT product_id, product_name, stock_quantity, reorder_level, status FROM m_products
WHERE stock_quantity <= reorder_level""")
def _(m):
    return k.low_stock(m.products())


@query("kpi_purchase_frequency", f"""
WITH t AS (SELECT customer_id, count(*) AS orders, count(DISTINCT {MONTH}) AS active_months FROM m_active GROUP BY 1)
SELECT *, {rdiv("orders", "active_months", 6)} AS orders_per_month FROM t""")
def _(m):
    return k.purchase_frequency(m.orders())


@query("kpi_churn_risk", """
WITH t AS (SELECT c.customer_id, CAST(date_diff('day', max(order_date)::DATE, DATE '2001-08-02') AS INTEGER) AS days_since_order
           FROM m_customers c LEFT JOIN m_active USING (customer_id) GROUP BY 1)
SELECT *, CASE WHEN days_since_order IS NULL THEN 'NEVER_ORDERED' WHEN days_since_order <= 90 THEN 'LOW'
       WHEN days_since_order <= 180 THEN 'MEDIUM' ELSE 'HIGH' END AS churn_risk FROM t""")
def _(m):
    return k.churn_risk(m.customers(), m.orders(), NOW)


@query("kpi_top_margin_products", f"""
SELECT product_id, product_name,
       {rdiv(sql_cents("unit_price - unit_cost"), sql_cents("unit_price"), 2, 100)} AS profit_margin
FROM m_products WHERE status = 'ACTIVE' ORDER BY profit_margin DESC, product_id LIMIT 10""")
def _(m):
    return k.top_margin_products(m.products())


@query("best_promotion", """
WITH goods AS (SELECT order_id, category_id, CAST(sum(line_total) AS DECIMAL(22,2)) AS amount
               FROM m_items JOIN m_products USING (product_id) GROUP BY 1, 2),
offers AS (SELECT o.order_id, p.promotion_id, p.promotion_name,
    CAST(least(round(CASE WHEN p.applicable_category_id IS NULL THEN o.total_amount::DECIMAL(22,2) ELSE g.amount END
         * p.discount_percent * 0.01::DECIMAL(3,2), 2), p.maximum_discount) AS DECIMAL(22,2)) AS promotion_discount
  FROM m_orders o JOIN m_promotions p ON o.order_date BETWEEN p.start_date AND p.end_date
       AND o.total_amount >= p.minimum_order_amount
       LEFT JOIN goods g ON g.order_id = o.order_id AND g.category_id = p.applicable_category_id
  WHERE p.applicable_category_id IS NULL OR g.amount IS NOT NULL)
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY promotion_discount DESC, promotion_id) AS n FROM offers) WHERE n = 1""")
def _(m):
    return j.best_promotion(m.orders(), m.items(), m.products(), m.promotions())


def chain_sql(view, key, parent, label):
    return f"""
WITH RECURSIVE tree AS (
  SELECT {key}, 1::BIGINT AS depth, {key} AS root_id, {label} AS path FROM {view} WHERE {parent} IS NULL
  UNION ALL SELECT c.{key}, depth + 1, root_id, path || ' / ' || c.{label} FROM {view} c JOIN tree t ON c.{parent} = t.{key})
SELECT {key}, depth, root_id, path, TRUE AS complete FROM tree"""


@query("category_tree", chain_sql("m_categories", "category_id", "parent_category_id", "category_name"))
def _(m):
    return j.parent_chains(m.categories(), "category_id", "parent_category_id", "category_name")


@query("product_halving_chain", """
WITH RECURSIVE n AS (SELECT product_id, nullif(product_id // 2, 0) AS up, product_name FROM m_products),
tree AS (
  SELECT product_id, 1::BIGINT AS depth, product_id AS root_id, product_name AS path FROM n WHERE up IS NULL
  UNION ALL SELECT c.product_id, depth + 1, root_id, path || ' / ' || c.product_name FROM n c JOIN tree t ON c.up = t.product_id)
SELECT product_id, depth, root_id, path, TRUE AS complete FROM tree""")
def _(m):
    """Each product below the one with half its key: chains as deep as the keys have binary digits."""
    nodes = m.products().selectExpr("product_id", "nullif(product_id div 2, 0) AS up", "product_name")
    return j.parent_chains(nodes, "product_id", "up", "product_name")


@query("manager_chain", chain_sql("m_employees", "employee_id", "manager_id", "employee_name"))
def _(m):
    return j.parent_chains(m.employees(), "employee_id", "manager_id", "employee_name")
