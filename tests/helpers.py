"""Small hand-made tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgertide.sources.schemas import model_schema
from ledgertide.sources.tables import with_generated


def table(spark, name, rows, **columns):
    """A model table from dicts; columns that are not given are NULL."""
    schema = model_schema(name)
    text = [[None if r.get(f.name) is None else r[f.name] if isinstance(r[f.name], list) else str(r[f.name])
             for f in schema] for r in rows]
    ddl = ", ".join(f"`{f.name}` " + ("array<bigint>" if f.dataType.typeName() == "array" else "string") for f in schema)
    df = spark.createDataFrame(text, ddl)
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return with_generated(df, name)


def order(order_id, customer_id=1, date="2025-12-05 10:54:10", status="PENDING", total="100.00", discount="0", tax="0",
          **more):
    return dict(order_id=order_id, customer_id=customer_id, order_date=date, status=status, total_amount=total,
                discount_amount=discount, tax_amount=tax, shipping_address="123 Main St, City 1",
                billing_address="123 Main St, City 1", **more)


def item(item_id, order_id, product_id, quantity, price, pct="0"):
    return dict(order_item_id=item_id, order_id=order_id, product_id=product_id, quantity=quantity, unit_price=price,
                discount_percent=pct)


def product(product_id, name, price="10.00", cost="5.00", category=1, status="ACTIVE", stock=10):
    return dict(product_id=product_id, product_name=name, category_id=category, unit_price=price, unit_cost=cost,
                supplier_id=1, stock_quantity=stock, reorder_level=10, status=status, created_date="2025-01-01")


def customer(customer_id, name, segment="BRONZE", join="2025-01-01", **more):
    base = dict(customer_id=customer_id, customer_name=name, email=f"c{customer_id}@email.com", join_date=join,
                customer_segment=segment, total_spent="0", country="USA")
    return base | more


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]


D = Decimal
