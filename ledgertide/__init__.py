"""ledgertide: order-to-cash and audit analytics on PySpark DataFrames."""

__version__ = "0.1.0"
