"""Business values of the order-to-cash rules.

Fixed values: they decide results, so they are stated here as plain data.
"""

from __future__ import annotations

from decimal import Decimal

# Order life cycle.
ORDER_STATUSES = ("PENDING", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED", "RETURNED")
COMPUTED_ORDER_STATUSES = ("PARTIALLY_RETURNED",)
INACTIVE_STATUSES = ("CANCELLED", "RETURNED")
COMPLETED_STATUSES = ("DELIVERED", "SHIPPED")
STATUS_TRANSITIONS = {
    "PENDING": ("PROCESSING", "CANCELLED"),
    "PROCESSING": ("SHIPPED", "CANCELLED"),
    "SHIPPED": ("DELIVERED", "RETURNED"),
    "DELIVERED": ("RETURNED",),
}
CANCEL_WINDOW_HOURS = 24

# Customer tiers.
SEGMENTS = ("BRONZE", "SILVER", "GOLD", "PLATINUM")
SEGMENT_FLOORS = (("PLATINUM", 10000), ("GOLD", 5000), ("SILVER", 1000))
CREDIT_LIMITS = {"PLATINUM": 10000, "GOLD": 5000, "SILVER": 2000, "BRONZE": 500}
DEFAULT_CREDIT_LIMIT = 100

# Forecasting and lifetime value.
SEASONAL_FACTORS = {11: Decimal("1.5"), 12: Decimal("2.0"), 1: Decimal("1.3"), 7: Decimal("1.2")}
LIFETIME_MONTHS = 36
VISITS_PER_ORDER = 10

# Tax, returns and fees.
TAX_RATE = Decimal("0.08")
RETURN_WINDOW_DAYS = 30
RETURN_TYPES = ("REFUND", "EXCHANGE", "CREDIT")
RETURNABLE_STATUSES = ("DELIVERED", "SHIPPED", "PARTIALLY_RETURNED")
RESTOCKING_FEES = (("%CHANGED MIND%", Decimal("0.10")), ("%NO LONGER NEED%", Decimal("0.05")))
REFUND_METHODS = {"REFUND": "ORIGINAL_PAYMENT", "CREDIT": "STORE_CREDIT"}

# Value domains of the tables.
PRODUCT_STATUSES = ("ACTIVE", "DISCONTINUED", "OUT_OF_STOCK")
PAYMENT_METHODS = ("CREDIT_CARD", "DEBIT_CARD", "PAYPAL", "BANK_TRANSFER", "CASH", "CHECK")
PAYMENT_STATUSES = ("PENDING", "COMPLETED", "FAILED", "REFUNDED", "PARTIALLY_REFUNDED")
SHIPMENT_STATUSES = ("PENDING", "PROCESSING", "SHIPPED", "IN_TRANSIT", "DELIVERED", "RETURNED")
RETURN_STATUSES = ("PENDING", "PROCESSED", "DENIED", "CANCELLED")
REFUND_CHANNELS = ("ORIGINAL_PAYMENT", "STORE_CREDIT", "CHECK")
REFUND_STATUSES = ("PENDING", "COMPLETED", "FAILED")
EXCHANGE_STATUSES = ("PENDING", "PROCESSED", "CANCELLED")
DEPARTMENTS = ("SALES", "WAREHOUSE", "FINANCE", "ADMIN", "IT")
PAYMENT_TERMS = ("NET15", "NET30", "NET45", "NET60")
AUDIT_ACTIONS = ("INSERT", "UPDATE", "DELETE", "NOTE")
MAX_DISCOUNT_SHARE = Decimal("0.5")
FREE_SHIPPING_ABOVE = 100
MAX_CATEGORY_DEPTH = 3

# Thresholds of the audit monitors.
BURST_MINUTES = 5
BURST_ACTIONS = 10
HOURLY_ACTIONS = 5
ARCHIVE_DAYS = 90
RULE_NAME = "WEEKDAY_HOLIDAY_RESTRICTION"
