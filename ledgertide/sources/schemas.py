"""Explicit schemas: raw parquet tables, model tables and request batches."""

from __future__ import annotations

from pyspark.sql.types import StructType

RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

MODEL = {
    "customers": "customer_id bigint not null, customer_name string not null, email string not null, phone string, "
    "address string, city string, country string, join_date timestamp_ntz not null, customer_segment string not null, "
    "total_spent decimal(12,2) not null, last_order_date timestamp_ntz, store_credit decimal(10,2), "
    "total_returns bigint, last_return_date timestamp_ntz, total_refund_amount decimal(12,2)",
    "categories": "category_id bigint not null, category_name string not null, parent_category_id bigint, "
    "description string",
    "suppliers": "supplier_id bigint not null, supplier_name string not null, contact_name string, "
    "email string not null, phone string, address string, city string, country string, payment_terms string",
    "products": "product_id bigint not null, product_name string not null, category_id bigint not null, "
    "unit_price decimal(10,2) not null, unit_cost decimal(10,2) not null, supplier_id bigint not null, "
    "stock_quantity bigint not null, reorder_level bigint not null, status string not null, "
    "created_date timestamp_ntz not null",
    "employees": "employee_id bigint not null, employee_name string not null, department string not null, "
    "position string not null, hire_date timestamp_ntz not null, email string not null, phone string, "
    "manager_id bigint, is_active string not null",
    "orders": "order_id bigint not null, customer_id bigint not null, order_date timestamp_ntz not null, "
    "status string not null, total_amount decimal(12,2) not null, discount_amount decimal(10,2), "
    "tax_amount decimal(10,2), shipping_address string not null, billing_address string not null, employee_id bigint",
    "order_items": "order_item_id bigint not null, order_id bigint not null, product_id bigint not null, "
    "quantity int not null, unit_price decimal(10,2) not null, discount_percent decimal(5,2)",
    "payments": "payment_id bigint not null, order_id bigint not null, payment_date timestamp_ntz, "
    "amount decimal(10,2) not null, payment_method string not null, transaction_id string, status string not null, "
    "authorization_code string",
    "shipments": "shipment_id bigint not null, order_id bigint not null, ship_date timestamp_ntz, carrier string, "
    "tracking_number string, estimated_delivery timestamp_ntz, actual_delivery timestamp_ntz, "
    "shipping_cost decimal(10,2), status string not null",
    "promotions": "promotion_id bigint not null, promotion_name string not null, discount_percent decimal(5,2) not null, "
    "start_date timestamp_ntz not null, end_date timestamp_ntz not null, minimum_order_amount decimal(10,2), "
    "maximum_discount decimal(10,2), applicable_category_id bigint",
    "audit_log": "audit_id bigint not null, table_name string not null, record_id string, action_type string not null, "
    "old_value string, new_value string, changed_by string not null, change_timestamp timestamp_ntz not null, "
    "ip_address string",
    "holidays": "holiday_id bigint not null, holiday_date timestamp_ntz not null, holiday_name string not null, "
    "description string, is_recurring string not null",
    "returns": "return_id bigint, order_id bigint not null, product_id bigint not null, return_date timestamp_ntz, "
    "return_quantity bigint not null, return_reason string not null, return_type string, refund_amount decimal(10,2), "
    "restocking_fee decimal(10,2), status string, processed_by string, exchange_product_id bigint, notes string, "
    "created_date timestamp_ntz",
    "refunds": "refund_id bigint, return_id bigint not null, order_id bigint not null, refund_date timestamp_ntz, "
    "refund_amount decimal(10,2) not null, refund_method string, status string, processed_by string, "
    "transaction_id string, notes string",
    "exchanges": "exchange_id bigint, return_id bigint not null, original_product_id bigint not null, "
    "exchange_product_id bigint not null, exchange_date timestamp_ntz, status string, processed_by string, notes string",
    "employee_audit_log": "audit_id bigint, employee_id bigint, action_type string, table_name string, "
    "record_id string, day_of_week string, is_holiday string, is_weekday string, status string, "
    "error_message string, session_user string, action_timestamp timestamp_ntz, ip_address string",
    "test_employee_actions": "action_id bigint, employee_id bigint, action_date timestamp_ntz, action_type string, "
    "description string, amount decimal(12,2), status string",
    "business_rule_violations": "violation_id bigint, rule_name string, user_name string, table_name string, "
    "operation_type string, attempted_values string, error_message string, resolved string",
    "employee_restrictions": "restriction_id bigint, employee_id bigint, restriction_type string, is_active string",
    "invoices": "invoice_id bigint, invoice_number string, order_id bigint, invoice_date timestamp_ntz, "
    "customer_id bigint, subtotal_amount decimal(12,2), discount_amount decimal(12,2), tax_amount decimal(12,2), "
    "total_amount decimal(12,2), payment_status string, generated_by string, generation_date timestamp_ntz",
}

REQUESTS = {
    "order_requests": "request_id bigint, request_ts timestamp_ntz, customer_id bigint, product_ids array<bigint>, "
    "quantities array<bigint>, shipping_address string",
    "status_requests": "request_id bigint, request_ts timestamp_ntz, order_id bigint, new_status string, "
    "updated_by string, notes string",
    "return_requests": "request_id bigint, request_ts timestamp_ntz, order_id bigint, product_id bigint, "
    "return_quantity bigint, return_reason string, return_type string, processed_by string, notes string",
    "credit_requests": "request_id bigint, customer_id bigint, order_amount decimal(12,2)",
}

# What a missing optional column counts as.
DEFAULTS = {
    "customers": {"country": "USA", "customer_segment": "BRONZE", "total_spent": 0},
    "suppliers": {"country": "USA", "payment_terms": "NET30"},
    "products": {"stock_quantity": 0, "reorder_level": 10, "status": "ACTIVE"},
    "employees": {"is_active": "Y"},
    "orders": {"status": "PENDING", "discount_amount": 0, "tax_amount": 0},
    "order_items": {"discount_percent": 0},
    "payments": {"status": "PENDING"},
    "shipments": {"shipping_cost": 0, "status": "PENDING"},
    "promotions": {"minimum_order_amount": 0},
    "holidays": {"is_recurring": "N"},
}


def raw_schema(name: str) -> StructType:
    return StructType.fromDDL(RAW[name])


def model_schema(name: str) -> StructType:
    ddl = MODEL.get(name) or REQUESTS[name]
    return StructType.fromDDL(ddl)
