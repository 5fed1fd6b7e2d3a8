"""Sales queries."""

from contract.base import money_avg, months_sql, query, rdiv, sql_cents
from ledgertide.plans import sales as s
from ledgertide.sources.model import AS_OF_ORDERS as NOW

YEAR_AGO = "TIMESTAMP '2000-08-02'"
HALF_YEAR_AGO = "TIMESTAMP '2001-02-02'"
MARGIN = ("CASE WHEN unit_price > 0 THEN " + rdiv(sql_cents("unit_price - unit_cost"), sql_cents("unit_price"), 2, 100)
          + " ELSE 0 END")
UNITS = """SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units,
           CAST(sum(quantity * unit_price) AS DECIMAL(22,2)) AS gross"""


@query("customer_lifetime_value", f"""
SELECT customer_id, CASE WHEN months > 0 THEN {rdiv("cents * 36 * 31", "months * 100", 2)} ELSE 0 END AS clv
FROM (SELECT c.customer_id, {months_sql("DATE '2001-08-02'", "c.join_date")} AS months,
             coalesce({sql_cents("t.spent")}, 0) AS cents
      FROM m_customers c LEFT JOIN (SELECT customer_id, sum(net_amount) AS spent FROM m_active GROUP BY 1) t
        USING (customer_id))""")
def _(m):
    return s.customer_lifetime_value(m.customers(), m.orders(), NOW)


@query("validate_credit_limit", """
WITH asked AS (SELECT order_id AS request_id, customer_id, total_amount AS order_amount
               FROM m_orders WHERE status = 'PENDING'),
open_orders AS (SELECT o.* FROM m_active o
                WHERE NOT EXISTS (SELECT 1 FROM m_payments p WHERE p.order_id = o.order_id AND p.status = 'COMPLETED')),
owed AS (SELECT customer_id, sum(net_amount) AS balance FROM open_orders GROUP BY customer_id),
limits AS (SELECT customer_id, CASE customer_segment WHEN 'PLATINUM' THEN 10000 WHEN 'GOLD' THEN 5000
                  WHEN 'SILVER' THEN 2000 WHEN 'BRONZE' THEN 500 ELSE 100 END AS credit FROM m_customers),
judged AS (SELECT a.*, CAST(l.credit - coalesce(b.balance, 0) AS DECIMAL(22,2)) AS available
           FROM asked a LEFT JOIN limits l USING (customer_id) LEFT JOIN owed b USING (customer_id)),
worded AS (SELECT *, regexp_replace(regexp_replace(CAST(available AS VARCHAR), '\\.?0+$', ''), '^(-?)0\\.', '\\1.') AS av,
                  regexp_replace(CAST(order_amount AS VARCHAR), '\\.?0+$', '') AS am FROM judged)
SELECT request_id, customer_id, order_amount, available,
       CASE WHEN order_amount <= available THEN 'APPROVED: Available credit: $' || av
            ELSE 'DENIED: Order amount ($' || am || ') exceeds available credit ($' || av || ')' END AS verdict
FROM worded""")
def _(m):
    from pyspark.sql import functions as F

    orders = m.orders()
    requests = orders.filter(F.col("status") == "PENDING").select(
        F.col("order_id").alias("request_id"), "customer_id", F.col("total_amount").alias("order_amount"))
    return s.validate_credit_limit(requests, m.customers(), orders, m.payments())


@query("product_profit_margin", f"SELECT product_id, {MARGIN} AS profit_margin FROM m_products")
def _(m):
    return m.products().select("product_id", s.product_profit_margin().alias("profit_margin"))


@query("tier_discount", f"""
SELECT order_id, CAST({rdiv("cents * pct", "100", 0)} / 100 AS DECIMAL(12,2)) AS discount
FROM (SELECT o.order_id, {sql_cents("o.total_amount")} AS cents,
             CASE c.customer_segment WHEN 'PLATINUM' THEN 15 WHEN 'GOLD' THEN 10 WHEN 'SILVER' THEN 5 ELSE 0 END AS pct
      FROM m_orders o JOIN m_customers c USING (customer_id))""")
def _(m):
    joined = m.orders().join(m.customers().select("customer_id", "customer_segment"), "customer_id")
    tiers = {"PLATINUM": 15, "GOLD": 10, "SILVER": 5}
    return joined.select("order_id", s.discount_amount("total_amount", "customer_segment", tiers).alias("discount"))


@query("predict_sales", f"""
WITH sums AS (SELECT month(order_date) AS mon, sum(net_amount) AS sales FROM m_active
              WHERE order_date >= {YEAR_AGO} GROUP BY 1)
SELECT CAST({rdiv(sql_cents("sum(sales)"), "count(*)", 0)} * 0.01::DECIMAL(3,2) AS DECIMAL(22,2)) AS predicted_sales
FROM sums""")
def _(m):
    return s.predict_sales(m.orders(), NOW)


@query("predict_sales_target_month", f"""
WITH sums AS (SELECT month(order_date) AS mon, sum(net_amount) AS sales FROM m_active
              WHERE order_date >= {YEAR_AGO} GROUP BY 1)
SELECT CAST({rdiv(sql_cents("sum(sales)") + " * 3", "count(*) * 2", 0)} * 0.01::DECIMAL(3,2) AS DECIMAL(22,2))
       AS predicted_sales
FROM sums""")
def _(m):
    return s.predict_sales(m.orders(), NOW, months_ahead=3, target_month_factor=True)


@query("top_selling_products", f"""
WITH sold AS ({UNITS} FROM m_items WHERE order_id IN (SELECT order_id FROM m_active WHERE order_date >= {HALF_YEAR_AGO})
              GROUP BY product_id),
placed AS (SELECT p.product_id, p.product_name, p.category_id, s.units AS total_units_sold, s.gross AS total_revenue,
                  {MARGIN} AS avg_profit_margin, rank() OVER (ORDER BY s.units DESC) AS sales_rank,
                  row_number() OVER (ORDER BY s.units DESC, p.product_id) AS place
           FROM sold s JOIN m_products p USING (product_id))
SELECT * EXCLUDE (place) FROM placed WHERE place <= 10""")
def _(m):
    return s.top_selling_products(m.items(), m.products(), m.orders(), NOW)


@query("monthly_sales", f"""
SELECT date_trunc('month', order_date)::TIMESTAMP AS month, count(*) AS order_count,
       CAST(sum(net_amount) AS DECIMAL(22,2)) AS revenue, {money_avg("sum(net_amount)", "count(*)")} AS avg_order_value
FROM m_active WHERE order_date >= {YEAR_AGO} GROUP BY 1""")
def _(m):
    return s.monthly_sales(m.orders(), NOW)


REPORT_SPAN = "order_date BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-06-30'"


@query("sales_report", f"""
WITH chosen AS (SELECT * FROM m_active WHERE {REPORT_SPAN}),
prod AS (SELECT product_name, sum(quantity) AS units FROM m_items JOIN chosen USING (order_id)
         JOIN m_products USING (product_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
cust AS (SELECT customer_name, sum(net_amount) AS spent FROM chosen JOIN m_customers USING (customer_id)
         GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT TIMESTAMP '1998-01-01' AS period_start, TIMESTAMP '1999-06-30' AS period_end,
       CAST(sum(net_amount) AS DECIMAL(22,2)) AS total_revenue, count(*) AS total_orders,
       {money_avg("sum(net_amount)", "count(*)")} AS avg_order_value,
       (SELECT product_name FROM prod) AS top_product, (SELECT customer_name FROM cust) AS top_customer
FROM chosen""")
def _(m):
    return s.sales_report(m.orders(), m.items(), m.products(), m.customers(), "1998-01-01", "1999-06-30")


@query("update_customer_segments", """
WITH t AS (SELECT customer_id, sum(net_amount) AS spent FROM m_active GROUP BY 1)
SELECT c.customer_id, c.customer_name, CAST(coalesce(spent, 0) AS DECIMAL(22,2)) AS total_spent,
       CASE WHEN coalesce(spent, 0) >= 10000 THEN 'PLATINUM' WHEN spent >= 5000 THEN 'GOLD'
            WHEN spent >= 1000 THEN 'SILVER' WHEN spent > 0 THEN 'BRONZE' ELSE 'NEW' END AS customer_segment
FROM m_customers c LEFT JOIN t USING (customer_id)""")
def _(m):
    return s.update_customer_segments(m.customers(), m.orders()).select(
        "customer_id", "customer_name", "total_spent", "customer_segment")


PRODUCT_SALES = f"""sold AS ({UNITS} FROM m_items GROUP BY product_id),
listed AS (SELECT p.product_id, p.product_name, c.category_name, CAST(coalesce(units, 0) AS BIGINT) AS units_sold,
                  CAST(coalesce(gross, 0) AS DECIMAL(22,2)) AS revenue, {MARGIN} AS profit_margin
           FROM m_products p LEFT JOIN m_categories c USING (category_id) LEFT JOIN sold USING (product_id))"""


@query("product_performance",
       f"WITH {PRODUCT_SALES} SELECT *, rank() OVER (ORDER BY units_sold DESC) AS sales_rank FROM listed")
def _(m):
    return s.product_performance(m.products(), m.categories(), m.items(), m.orders())


@query("product_performance_active_only", f"""
WITH {PRODUCT_SALES.replace("FROM m_items", "FROM m_items WHERE order_id IN (SELECT order_id FROM m_active)")}
SELECT *, rank() OVER (ORDER BY units_sold DESC) AS sales_rank FROM listed""")
def _(m):
    return s.product_performance(m.products(), m.categories(), m.items(), m.orders(), exclude_inactive=True)


@query("product_performance_category", f"""
WITH {PRODUCT_SALES}
SELECT *, rank() OVER (ORDER BY units_sold DESC) AS sales_rank FROM listed WHERE category_name = 'ECONOMY Brand#1'""")
def _(m):
    return s.product_performance(m.products(), m.categories(), m.items(), m.orders(), category_id=101)


@query("yoy_growth", f"""
WITH y AS (SELECT CAST(sum(net_amount) FILTER (year(order_date) = 2001) AS DECIMAL(22,2)) AS current_sales,
                  CAST(sum(net_amount) FILTER (year(order_date) = 2000) AS DECIMAL(22,2)) AS previous_sales FROM m_active)
SELECT *, {rdiv(sql_cents("current_sales - previous_sales"), sql_cents("previous_sales"), 2, 100)} AS growth_pct FROM y""")
def _(m):
    return s.yoy_growth(m.orders(), NOW)


@query("top_performers_customers", f"""
SELECT c.customer_id, c.customer_name, c.customer_segment, CAST(coalesce(sum(net_amount), 0) AS DECIMAL(22,2)) AS total_spent,
       count(order_id) AS order_count,
       coalesce({rdiv(sql_cents("coalesce(sum(net_amount), 0)"), "count(order_id) * 100", 2)}, 0) AS avg_order_value
FROM m_customers c LEFT JOIN m_active o USING (customer_id) GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1 LIMIT 10""")
def _(m):
    return s.top_performers("CUSTOMERS", customers=m.customers(), orders=m.orders())


@query("top_performers_products",
       f"WITH {PRODUCT_SALES} SELECT * FROM listed ORDER BY revenue DESC, product_id LIMIT 10")
def _(m):
    return s.top_performers("products", products=m.products(), categories=m.categories(), items=m.items(),
                            orders=m.orders())


@query("conversion_rate", f"""
SELECT count(*) AS total_orders, count(*) * 10 AS total_visits, CASE WHEN count(*) > 0 THEN 10.0 ELSE 0 END::DOUBLE
       AS conversion_rate FROM m_active WHERE {REPORT_SPAN}""")
def _(m):
    return s.conversion_rate(m.orders(), "1998-01-01", "1999-06-30")


@query("conversion_rate_visits", f"""
WITH v AS (SELECT count(*) AS total_visits FROM events WHERE event_type = 'view'
           AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'),
o AS (SELECT count(*) AS total_orders FROM m_purchases WHERE status NOT IN ('CANCELLED', 'RETURNED')
      AND order_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')
SELECT total_orders, total_visits, {rdiv("total_orders", "total_visits", 2, 100)} AS conversion_rate FROM o, v""")
def _(m):
    return s.conversion_rate(m.purchases(), "2024-01-05", "2024-01-20", visits=m.visits())


@query("bulk_update_prices", """
SELECT product_id, category_id,
       CASE WHEN category_id = 101 THEN CAST(round(unit_price * 1.075::DECIMAL(9,6), 2) AS DECIMAL(10,2))
            ELSE unit_price END AS unit_price FROM m_products""")
def _(m):
    return s.bulk_update_prices(m.products(), 101, 7.5)[0].select("product_id", "category_id", "unit_price")


@query("bulk_update_prices_count", "SELECT count(*) AS updated_count FROM m_products WHERE category_id = 101")
def _(m):
    return s.bulk_update_prices(m.products(), 101, 7.5)[1]


@query("performance_report_summary", f"""
WITH y AS (SELECT CAST(sum(net_amount) FILTER (year(order_date) = 2001) AS DECIMAL(22,2)) AS a,
                  CAST(sum(net_amount) FILTER (year(order_date) = 2000) AS DECIMAL(22,2)) AS b FROM m_active)
SELECT CAST(sum(net_amount) AS DECIMAL(22,2)) AS total_revenue, count(*) AS total_orders,
       {money_avg("sum(net_amount)", "count(*)")} AS avg_order_value,
       (SELECT {rdiv(sql_cents("a - b"), sql_cents("b"), 2, 100)} FROM y) AS yoy_growth FROM m_active""")
def _(m):
    return s.performance_report("SUMMARY", m.orders(), NOW)["summary"]


@query("performance_report_detailed", f"""
WITH {PRODUCT_SALES}, best AS (SELECT customer_name, CAST(sum(net_amount) AS DECIMAL(22,2)) AS amount, count(*) AS n
      FROM m_active JOIN m_customers USING (customer_id) GROUP BY customer_id, customer_name
      ORDER BY 2 DESC, customer_id LIMIT 5),
goods AS (SELECT product_name, revenue, units_sold FROM listed ORDER BY revenue DESC, product_id LIMIT 5)
SELECT 'CUSTOMER' AS section, customer_name AS name, amount, n AS quantity FROM best
UNION ALL SELECT 'PRODUCT', product_name, revenue, units_sold FROM goods""")
def _(m):
    from pyspark.sql import functions as F

    parts = s.performance_report("DETAILED", m.orders(), NOW, m.customers(), m.products(), m.categories(), m.items())
    return parts["customers"].select(
        F.lit("CUSTOMER").alias("section"), F.col("customer_name").alias("name"), F.col("total_spent").alias("amount"),
        F.col("order_count").alias("quantity"),
    ).unionByName(parts["products"].select(
        F.lit("PRODUCT").alias("section"), F.col("product_name").alias("name"), F.col("revenue").alias("amount"),
        F.col("units_sold").alias("quantity")))


def daily_sql(orders: str) -> str:
    items = f"""prod AS (SELECT report_date, product_name, row_number() OVER (PARTITION BY report_date ORDER BY units DESC, product_name) AS n
  FROM (SELECT date_trunc('day', order_date)::TIMESTAMP AS report_date, product_name, sum(quantity) AS units
        FROM {orders} o JOIN m_items USING (order_id) JOIN m_products USING (product_id)
        WHERE o.status NOT IN ('CANCELLED', 'RETURNED') GROUP BY 1, 2)),"""
    return f"""
WITH {items}
cust AS (SELECT report_date, customer_name, row_number() OVER (PARTITION BY report_date ORDER BY spent DESC, customer_name) AS n
  FROM (SELECT date_trunc('day', order_date)::TIMESTAMP AS report_date, customer_name, sum(net_amount) AS spent
        FROM {orders} JOIN m_customers USING (customer_id)
        WHERE status NOT IN ('CANCELLED', 'RETURNED') GROUP BY 1, 2)),
flagged AS (SELECT *, date_trunc('day', order_date)::TIMESTAMP AS report_date,
                   CASE WHEN status NOT IN ('CANCELLED', 'RETURNED') THEN net_amount END AS net FROM {orders}),
days AS (SELECT report_date, CAST(coalesce(sum(net), 0) AS DECIMAL(22,2)) AS revenue, count(*) AS order_count,
       coalesce({money_avg("sum(net)", "count(net)")}, 0) AS avg_order_value,
       CAST(coalesce(max(net), 0) AS DECIMAL(22,2)) AS max_order_value,
       CAST(coalesce(min(net), 0) AS DECIMAL(22,2)) AS min_order_value,
       count(*) FILTER (status = 'CANCELLED') AS cancelled_orders,
       count(*) FILTER (status = 'RETURNED') AS returned_orders,
       {rdiv("count(*) FILTER (status IN ('DELIVERED', 'SHIPPED'))", "count(*)", 2, 100)} AS completion_rate,
       CAST(coalesce(sum(net) FILTER (hour(order_date) BETWEEN 9 AND 17), 0) AS DECIMAL(22,2)) AS business_hours_revenue
  FROM flagged GROUP BY report_date)
SELECT d.*, coalesce(p.product_name, 'No products sold') AS top_product,
       coalesce(c.customer_name, 'No customers') AS top_customer,
       {rdiv(sql_cents("revenue"), "2400", 2)} AS avg_revenue_per_hour
FROM days d LEFT JOIN (SELECT * FROM prod WHERE n = 1) p USING (report_date)
     LEFT JOIN (SELECT * FROM cust WHERE n = 1) c USING (report_date)"""


@query("daily_revenue", daily_sql("m_orders"))
def _(m):
    return s.daily_revenue(m.orders(), m.items(), m.products(), m.customers())


@query("daily_revenue_intraday", daily_sql("m_purchases"))
def _(m):
    return s.daily_revenue(m.purchases(), m.items(), m.products(), m.customers())


@query("daily_revenue_one_day", daily_sql("m_orders") + " WHERE report_date = TIMESTAMP '1998-10-03'")
def _(m):
    return s.daily_revenue(m.orders(), m.items(), m.products(), m.customers(), dates=["1998-10-03"])


@query("hourly_breakdown", f"""
SELECT date_trunc('day', order_date)::TIMESTAMP AS report_date, CAST(hour(order_date) AS INTEGER) AS hour_of_day,
       count(*) AS order_count, CAST(sum(net_amount) AS DECIMAL(22,2)) AS hourly_revenue,
       {rdiv(sql_cents("sum(net_amount)"), "count(*) * 100", 2)} AS avg_order_value
FROM m_purchases WHERE status NOT IN ('CANCELLED', 'RETURNED') GROUP BY 1, 2""")
def _(m):
    return s.hourly_breakdown(m.purchases())


@query("customer_ranking", f"""
WITH t AS (SELECT customer_id, customer_name, CAST(sum(net_amount) AS DECIMAL(22,2)) AS total_spent
           FROM m_active JOIN m_customers USING (customer_id) GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (ORDER BY total_spent DESC) AS customer_rank, sum(total_spent) OVER () AS everyone,
             row_number() OVER (ORDER BY total_spent DESC, customer_id) AS place FROM t)
SELECT customer_id, customer_name, total_spent, customer_rank,
       {rdiv(sql_cents("total_spent"), sql_cents("everyone"), 2, 100)} AS percent_of_total FROM r WHERE place <= 5""")
def _(m):
    return s.customer_ranking(m.customers(), m.orders())


@query("customer_rank_stored", """
SELECT customer_id, customer_name, total_spent, rank() OVER (ORDER BY total_spent DESC) AS spending_rank
FROM m_customers ORDER BY total_spent DESC, customer_id LIMIT 5""")
def _(m):
    return s.customer_rank_stored(m.customers())


TREND_AVG = money_avg("sum(x) OVER w", "count(x) OVER w")


@query("monthly_trend", f"""
WITH t AS (SELECT strftime(order_date, '%Y-%m') AS month, CAST(sum(net_amount) AS DECIMAL(22,2)) AS x FROM m_active
           WHERE order_date >= {YEAR_AGO} GROUP BY 1)
SELECT month, x AS monthly_sales, lag(x) OVER (ORDER BY month) AS prev_month_sales, {TREND_AVG} AS three_month_moving_avg
FROM t WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ORDER BY month DESC LIMIT 6""")
def _(m):
    return s.monthly_trend(m.orders(), NOW)


GROWTH = rdiv(sql_cents("x - px"), sql_cents("px"), 2, 100)


@query("monthly_growth", f"""
WITH t AS (SELECT strftime(order_date, '%Y-%m') AS month_year, CAST(sum(total_amount) AS DECIMAL(22,2)) AS x FROM m_orders
           WHERE order_date >= TIMESTAMP '2001-02-01' AND status = 'DELIVERED' GROUP BY 1),
u AS (SELECT *, lag(x) OVER (ORDER BY month_year) AS px, {TREND_AVG} AS three_month_avg FROM t
      WINDOW w AS (ORDER BY month_year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT month_year, x AS total_sales, px AS prev_month_sales, three_month_avg, {GROWTH} AS monthly_growth_percent FROM u""")
def _(m):
    return s.monthly_growth(m.orders(), NOW)


@query("sales_growth_by_month", f"""
WITH t AS (SELECT strftime(order_date, '%Y-%m') AS sales_month, CAST(sum(total_amount) AS DECIMAL(22,2)) AS x
           FROM m_orders GROUP BY 1), u AS (SELECT *, lag(x) OVER (ORDER BY sales_month) AS px FROM t)
SELECT sales_month, x AS monthly_sales, px AS prev_month_sales, {GROWTH} AS growth_percentage FROM u""")
def _(m):
    return s.sales_growth_by_month(m.orders())


@query("top_products_by_category", f"""
WITH sold AS ({UNITS} FROM m_items GROUP BY product_id),
t AS (SELECT category_id, product_name, CAST(coalesce(sum(gross), 0) AS DECIMAL(22,2)) AS total_sales
      FROM m_products LEFT JOIN sold USING (product_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY total_sales DESC, product_name)
             AS sales_rank_in_category FROM t)
SELECT category_name, product_name, total_sales, sales_rank_in_category FROM r JOIN m_categories USING (category_id)
WHERE sales_rank_in_category <= 3""")
def _(m):
    return s.top_products_by_category(m.products(), m.categories(), m.items())


HISTORY = """SELECT customer_name, order_id, order_date, total_amount, status,
       (SELECT count(*) FROM m_items i WHERE i.order_id = o.order_id) AS item_count
FROM m_orders o JOIN m_customers USING (customer_id)"""


@query("customer_order_history", HISTORY)
def _(m):
    return s.customer_order_history(m.customers(), m.orders(), m.items())


@query("customer_order_history_one", HISTORY + " WHERE customer_id = 101")
def _(m):
    return s.customer_order_history(m.customers(), m.orders(), m.items(), customer_id=101)


@query("customer_orders",
       "SELECT customer_name, order_id, total_amount FROM m_orders JOIN m_customers USING (customer_id)")
def _(m):
    return s.customer_orders(m.customers(), m.orders())


@query("segment_order_average", f"""
SELECT customer_segment, count(*) AS customer_count, {money_avg("sum(total_amount)", "count(*)")} AS avg_order_value
FROM m_orders JOIN m_customers USING (customer_id) GROUP BY 1""")
def _(m):
    return s.segment_order_average(m.customers(), m.orders())


@query("segment_analysis", f"""
SELECT customer_segment, count(DISTINCT o.customer_id) AS customer_count,
       CAST(sum(total_amount) AS DECIMAL(22,2)) AS total_revenue, {money_avg("sum(total_amount)", "count(*)")} AS avg_order_value,
       {rdiv("count(DISTINCT order_id)", "count(DISTINCT o.customer_id)", 6)} AS avg_orders_per_customer
FROM m_orders o JOIN m_customers c USING (customer_id) GROUP BY 1""")
def _(m):
    return s.segment_analysis(m.customers(), m.orders())


@query("customer_rank_prev", """
WITH t AS (SELECT customer_id, customer_name, CAST(sum(total_amount) AS DECIMAL(22,2)) AS total_spent
           FROM m_orders JOIN m_customers USING (customer_id) GROUP BY 1, 2)
SELECT *, rank() OVER (ORDER BY total_spent DESC) AS customer_rank,
       lag(total_spent) OVER (ORDER BY total_spent DESC, customer_id) AS prev_customer_spent FROM t""")
def _(m):
    return s.customer_rank_prev(m.customers(), m.orders())


@query("order_moving_avg", f"""
SELECT order_id, order_date, total_amount, {money_avg("sum(total_amount) OVER w", "count(*) OVER w")} AS weekly_moving_avg
FROM m_orders WINDOW w AS (ORDER BY order_date, order_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(m):
    return s.order_moving_avg(m.orders())
