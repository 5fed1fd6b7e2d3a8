"""The model over the raw tables, written independently in SQL."""

CODES = ("CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 "
         "WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 ELSE 0 END")

MODEL_SQL = {
    "m_customers": """
SELECT c_custkey AS customer_id, c_name AS customer_name,
       lower(replace(c_name, '#', '.')) || '@mail.example' AS email,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'Street ' || c_custkey END AS address,
       'City ' || c_nationkey AS city, coalesce(n_name, 'USA') AS country,
       CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS join_date,
       CASE WHEN c_acctbal >= 7500 THEN 'PLATINUM' WHEN c_acctbal >= 5000 THEN 'GOLD'
            WHEN c_acctbal >= 2500 THEN 'SILVER' ELSE 'BRONZE' END AS customer_segment,
       greatest(c_acctbal::DECIMAL(12,2), 0::DECIMAL(12,2)) AS total_spent
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "m_regions": """
SELECT c_custkey AS customer_id, r_name AS region, n_name AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "m_products": f"""
SELECT p_partkey AS product_id, p_name AS product_name,
       CAST({CODES} AS BIGINT) * 100 + CAST(substr(p_brand, 7) AS BIGINT) AS category_id,
       p_retailprice::DECIMAL(10,2) AS unit_price,
       CAST(((2 * CAST(round(p_retailprice * 100) AS BIGINT) * (100 + p_size) + 200) // 400)::DECIMAL(18,0)
            * 0.01::DECIMAL(3,2) AS DECIMAL(10,2)) AS unit_cost,
       p_partkey // 20 AS supplier_id, CAST(p_size AS BIGINT) AS stock_quantity, 10::BIGINT AS reorder_level,
       CASE WHEN p_brand = 'Brand#25' THEN 'DISCONTINUED' WHEN p_size = 1 THEN 'OUT_OF_STOCK' ELSE 'ACTIVE' END
           AS status
FROM part""",
    "m_categories": f"""
SELECT DISTINCT CAST({CODES} AS BIGINT) * 100 + CAST(substr(p_brand, 7) AS BIGINT) AS category_id,
       p_type || ' ' || p_brand AS category_name, CAST({CODES} AS BIGINT) * 100 AS parent_category_id FROM part
UNION ALL
SELECT DISTINCT CAST({CODES} AS BIGINT) * 100, p_type, 0::BIGINT FROM part
UNION ALL
SELECT 0::BIGINT, 'CATALOG', NULL::BIGINT""",
    "m_suppliers": """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name,
       lower(replace(s_name, '#', '.')) || '@supply.example' AS email, coalesce(n_name, 'USA') AS country,
       'NET30' AS payment_terms
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "m_employees": """
SELECT s_suppkey AS employee_id, replace(s_name, 'Supplier', 'Employee') AS employee_name,
       CASE n_regionkey WHEN 0 THEN 'SALES' WHEN 1 THEN 'WAREHOUSE' WHEN 2 THEN 'FINANCE' WHEN 3 THEN 'ADMIN'
            WHEN 4 THEN 'IT' ELSE 'OTHER' END AS department,
       lower(replace(s_name, '#', '.')) || '@staff.example' AS email,
       CASE WHEN s_suppkey > 0 THEN s_suppkey // 10 END AS manager_id, 'Y' AS is_active
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "m_holidays": """
SELECT * FROM (VALUES (1::BIGINT, TIMESTAMP '2024-01-01', 'New Year', 'Y'),
                      (2::BIGINT, TIMESTAMP '2024-01-15', 'Founders Day', 'N'))
       AS h(holiday_id, holiday_date, holiday_name, is_recurring)""",
    "m_promotions": """
SELECT * FROM (VALUES
  (1::BIGINT, 'Summer Sale', 15, TIMESTAMP '1998-06-01', TIMESTAMP '1998-08-31', 50, 5000, NULL::BIGINT),
  (2, 'Economy Discount', 10, TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', 0, NULL, 101),
  (3, 'Winter Clearance', 5, TIMESTAMP '1997-11-15', TIMESTAMP '1998-02-15', 100000, 8000, NULL),
  (4, 'Loyalty Week', 20, TIMESTAMP '2000-03-01', TIMESTAMP '2000-03-07', 0, 20000, NULL))
  AS p(promotion_id, promotion_name, discount_percent, start_date, end_date, minimum_order_amount,
       maximum_discount, applicable_category_id)""",
    "m_orders": """
SELECT *, CAST(total_amount - discount_amount + tax_amount AS DECIMAL(12,2)) AS net_amount FROM (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'CANCELLED'
              WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'RETURNED'
              WHEN o_orderstatus = 'F' THEN 'DELIVERED'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'SHIPPED'
              WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'PROCESSING' END AS status,
         o_totalprice::DECIMAL(12,2) AS total_amount,
         CASE WHEN o_orderpriority = '2-HIGH'
              THEN CAST(round(o_totalprice::DECIMAL(12,2) * 0.10::DECIMAL(3,2), 2) AS DECIMAL(10,2))
              ELSE 0::DECIMAL(10,2) END AS discount_amount,
         CAST(round(o_totalprice::DECIMAL(12,2) * 0.08::DECIMAL(3,2), 2) AS DECIMAL(10,2)) AS tax_amount,
         'Dock ' || o_custkey AS shipping_address, 'Desk ' || o_custkey AS billing_address,
         o_custkey // 15 AS employee_id
  FROM orders)""",
    "m_active": "SELECT * FROM m_orders WHERE status NOT IN ('CANCELLED', 'RETURNED')",
    "m_items": """
SELECT *, CAST(round(quantity::DECIMAL(10,0) * unit_price * ((100 - discount_percent) * 0.01::DECIMAL(3,2)), 2)
               AS DECIMAL(12,2)) AS line_total FROM (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
               // (2 * CAST(l_quantity AS BIGINT)))::DECIMAL(18,0) * 0.01::DECIMAL(3,2) AS DECIMAL(10,2))
             AS unit_price,
         CAST(l_discount::DECIMAL(5,2) * 100 AS DECIMAL(5,2)) AS discount_percent,
         l_linenumber, l_suppkey, l_tax, l_shipdate
  FROM lineitem)""",
    "m_keyed_items": """
SELECT *, order_id * 1000 + row_number() OVER (PARTITION BY order_id ORDER BY product_id, l_linenumber, l_suppkey,
       quantity, unit_price, discount_percent, l_tax, l_shipdate) AS order_item_id FROM m_items""",
    "m_payments": """
SELECT o_orderkey AS payment_id, o_orderkey AS order_id, o_orderdate AS payment_date,
       o_totalprice::DECIMAL(12,2) AS amount, 'TX' || o_orderkey AS transaction_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CREDIT_CARD' WHEN '2-HIGH' THEN 'DEBIT_CARD'
            WHEN '3-MEDIUM' THEN 'PAYPAL' WHEN '4-NOT SPECIFIED' THEN 'BANK_TRANSFER' WHEN '5-LOW' THEN 'CASH'
            ELSE 'CHECK' END AS payment_method,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status
FROM orders""",
    "m_shipments": """
SELECT l_orderkey AS shipment_id, l_orderkey AS order_id, min(l_shipdate) AS ship_date,
       max(l_shipdate) AS actual_delivery, 'TRK' || l_orderkey AS tracking_number,
       CASE WHEN min(l_linestatus) = 'F' THEN 'DELIVERED' ELSE 'PENDING' END AS status
FROM lineitem GROUP BY l_orderkey""",
    "m_purchases": """
SELECT event_id AS order_id, user_id AS customer_id, ts AS order_date,
       CASE WHEN value < 1 THEN 'CANCELLED' WHEN value < 40 THEN 'DELIVERED' ELSE 'PENDING' END AS status,
       value::DECIMAL(12,2) AS net_amount
FROM events WHERE event_type = 'purchase'""",
    "m_audit": """
SELECT event_id AS audit_id, user_id AS employee_id,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE'
            ELSE 'SELECT' END AS action_type,
       CASE event_type WHEN 'signup' THEN 'CUSTOMERS' WHEN 'click' THEN 'PRODUCTS' WHEN 'error' THEN 'ORDERS'
            WHEN 'purchase' THEN 'ORDER_ITEMS' WHEN 'view' THEN 'PAYMENTS' ELSE 'OTHER' END AS table_name,
       regexp_extract(props, '[0-9]+') AS record_id, dayname(ts) AS day_of_week,
       CASE WHEN (month(ts) = 1 AND day(ts) = 1) OR CAST(ts AS DATE) = DATE '2024-01-15' THEN 'Y' ELSE 'N' END
           AS is_holiday,
       CASE WHEN isodow(ts) <= 5 THEN 'Y' ELSE 'N' END AS is_weekday,
       CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'click' AND isodow(ts) <= 5 THEN 'DENIED'
            ELSE 'ALLOWED' END AS status,
       CASE WHEN event_type = 'error' AND value < 10 THEN 'missing permission on table'
            WHEN event_type = 'error' AND value < 20 THEN 'access denied by policy'
            WHEN event_type = 'error' THEN 'lock timeout'
            WHEN event_type = 'click' AND isodow(ts) <= 5 THEN 'employee not authorized on weekdays' END
           AS error_message,
       'U' || (user_id % 20) AS session_user, ts AS action_timestamp, '10.0.0.' || (user_id % 250) AS ip_address
FROM events""",
    "m_actions": """
SELECT event_id AS action_id, user_id AS employee_id, ts AS action_date,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE'
            ELSE 'SELECT' END AS action_type
FROM events""",
}
