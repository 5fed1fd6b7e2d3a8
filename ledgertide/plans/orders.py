"""Batch jobs that turn requests into changes: new orders, status changes and returns.

The rules speak of one call at a time. Here a whole batch is decided at once: rules that look
at one request are columns, and rules that depend on earlier requests of the same order use the
request time (ties by request id). Each job returns the accepted effects and the rejections as
DataFrames; writing them is the caller's step, so one batch is published or dropped as a whole.

A caller that writes several outputs passes `settle=cut_lineage`: the decided rows are then
written once to the shared folder, and every output starts from them. Outputs of `create_orders` and
`process_returns` are made when they are asked for, as numbering writes its sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions import rules
from ledgertide.functions.compat import lookup, micros, money, number_text, text_of
from ledgertide.operators.ordered import divide, hot_groups, large_groups, numbered, placed_parts, running_totals
from ledgertide.session import settle as settled
from ledgertide.sources.tables import zip_arrays

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Requests of an order whose lines are folded where they lie; a fold takes as many steps as the square of a line's requests.
FOLD_ROWS = 5_000


def words(template: str, **values) -> Column:
    """A message with columns put in: words("Order {id} not found", id="order_id")."""
    parts: list[Column] = []
    rest = template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), value if isinstance(value, Column) else F.col(value)]
    return text_of(*parts, F.lit(rest))


class Outputs(Mapping):
    """The outputs of a job by name, each made when it is first asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = {name: cache(make) for name, make in makers.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


# -- new orders -------------------------------------------------------------------------


def create_orders(
    requests: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    tax_rate=rules.TAX_RATE,
    discount_percent=0,
    first_order_id: int = 1,
    first_item_id: int = 1,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> Mapping[str, DataFrame]:
    """Price the requested products and lay out order and line rows.

    `discount_percent` is one number for every order or a mapping from customer segment.
    """
    lines = zip_arrays(requests, "product_ids", "quantities", ["request_id"], ["product_id", "quantity"])
    priced = lines.join(
        products.select("product_id", F.col("unit_price").cast("decimal(10,2)").alias("unit_price")), "product_id", "left"
    )
    amount = F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")
    given = F.col("quantity").isNotNull()
    # A product without any quantity is bad; one that is named twice is told as repeated.
    bare, counted = F.collect_set(F.when(~given, F.col("product_id"))), F.collect_set(F.when(given, F.col("product_id")))
    sums = priced.groupBy("request_id").agg(
        F.sum(amount).cast("decimal(12,2)").alias("total_amount"),
        (F.coalesce(F.max(F.col("quantity") <= 0), F.lit(False)) | (F.size(F.array_except(bare, counted)) > 0)).alias("bad_quantity"),
        F.max(F.col("product_id").isNotNull() & F.col("unit_price").isNull()).alias("unknown_product"),
        F.max(F.col("product_id").isNull()).alias("no_product"),
        (F.count("product_id") > F.size(F.collect_set("product_id"))).alias("repeated"),
        F.sort_array(F.collect_list(F.struct("position", "product_id", "quantity", "unit_price"))).alias("lines"),
    )
    if isinstance(discount_percent, dict):
        rate = lookup("customer_segment", {k: float(v) for k, v in discount_percent.items()}, 0.0)
    else:
        rate = F.lit(float(discount_percent))
    known = customers.select("customer_id", rate.cast("decimal(5,2)").alias("rate"))
    base = requests.select("request_id", "request_ts", "customer_id", "shipping_address")
    judged = (
        base.join(sums, "request_id", "left")
        .join(known, "customer_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("rate").isNull(), words("Customer ID {c} not found", c="customer_id"))
            .when(F.coalesce("no_product", F.lit(True)), F.lit("Order has no items or unpaired items"))
            .when(F.col("bad_quantity"), F.lit("Quantity must be greater than 0"))
            .when(F.col("unknown_product"), F.lit("Product not found"))
            .when(F.col("repeated"), F.lit("Product repeated in order")),
        )
    )
    judged = settle(judged) if settle else judged
    good = judged.filter(F.col("reason").isNull())
    total = F.col("total_amount")
    discount = F.round(total * F.col("rate") / 100, 2).cast("decimal(10,2)")
    tax = F.round(total * F.lit(tax_rate), 2).cast("decimal(10,2)")
    turn = ["request_ts", "request_id"]
    orders = lambda: numbered(good.drop("lines"), [], turn, "place", bounded_by=requests).select(
        (F.col("place") + (first_order_id - 1)).alias("order_id"),
        "customer_id",
        F.col("request_ts").alias("order_date"),
        F.lit("PENDING").alias("status"),
        "total_amount",
        discount.alias("discount_amount"),
        tax.alias("tax_amount"),
        (total - discount + tax).cast("decimal(12,2)").alias("net_amount"),
        "shipping_address",
        F.col("shipping_address").alias("billing_address"),
    )
    items = lambda: placed_parts(good.select(*turn, "lines"), turn, "lines", "place", "number").select(
        (F.col("number") + (first_item_id - 1)).alias("order_item_id"),
        (F.col("place") + (first_order_id - 1)).alias("order_id"),
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        "unit_price",
        F.lit(0).cast("decimal(5,2)").alias("discount_percent"),
        money(amount).cast("decimal(12,2)").alias("line_total"),
    )
    return Outputs(
        orders=orders,
        items=items,
        rejects=lambda: judged.filter(F.col("reason").isNotNull()).select("request_id", "customer_id", "reason"),
    )


# -- status changes ---------------------------------------------------------------------


def allowed_change(old: Column, new: Column) -> Column:
    """The transition table as one boolean expression."""
    test = F.lit(False)
    for start, targets in rules.STATUS_TRANSITIONS.items():
        test = test | ((old == start) & new.isin(*targets))
    return test


def _longest_path(start: str) -> int:
    """Changes on the longest way through the transition table."""
    return max((1 + _longest_path(target) for target in rules.STATUS_TRANSITIONS.get(start, ())), default=0)


LONGEST_PATH = max(map(_longest_path, rules.STATUS_TRANSITIONS))


def status_rounds(slim: DataFrame, state: DataFrame, free: Column | None = None, hint: str | None = None) -> DataFrame:
    """Per order the changes that its requests bring about, in time order.

    `slim` holds order_id, new_status and at (a struct that orders the requests), `state` a row per order with its status
    s0; `free` may hold a request back by what the state knows. Round k adds p<k> and s<k>: at which request the order
    took its k-th new status, and which. No order changes more often than the longest path of statuses. `hint` says how to
    join the two where Spark cannot know their sizes.
    """
    kept = [c for c in state.columns if c != "order_id"]
    slim = slim.select("order_id", "new_status", "at")
    for step in range(1, LONGEST_PATH + 1):
        opens = allowed_change(F.col(f"s{step - 1}"), F.col("new_status"))
        if free is not None:
            opens = opens & free
        if step > 1:
            opens = opens & (F.col("at") > F.col(f"p{step - 1}"))
        key = F.when(opens, F.col("at"))
        state = (
            slim.join(state.hint(hint) if hint else state, "order_id")
            .groupBy("order_id")
            .agg(
                *[F.any_value(c).alias(c) for c in kept],
                F.min(key).alias(f"p{step}"),
                F.min_by("new_status", key).alias(f"s{step}"),
            )
        )
        kept = kept + [f"p{step}", f"s{step}"]
    return state


def status_outcome() -> tuple[Column, Column, Column]:
    """Of a request joined with the rounds: the status before it, whether it changed that, and the order's last status."""
    old, changed, last = F.col("s0"), F.lit(False), F.col("s0")
    for step in range(1, LONGEST_PATH + 1):
        old = F.when(F.col(f"p{step}") < F.col("at"), F.col(f"s{step}")).otherwise(old)
        changed = changed | F.coalesce(F.col(f"p{step}") == F.col("at"), F.lit(False))
        last = F.coalesce(F.col(f"s{step}"), last)
    return old, changed, last


def _decide(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Old status, outcome and message of each request."""
    at = F.struct("request_ts", "request_id")
    elapsed = micros("at.request_ts") - micros("order_date")
    free = ((F.col("new_status") != "SHIPPED") | F.col("has_shipment")) & (
        (F.col("new_status") != "CANCELLED") | (elapsed <= rules.CANCEL_WINDOW_HOURS * HOUR)
    )
    state = status_rounds(requests.select("order_id", "new_status", at.alias("at")), state, free)

    seen = requests.withColumn("at", at).join(state, "order_id", "left")
    new = F.col("new_status")
    old, changed, _ = status_outcome()
    hours = F.round(elapsed.cast("decimal(20,0)") / F.lit(HOUR).cast("decimal(12,0)"), 2)
    message = (
        F.when(~new.isin(*rules.ORDER_STATUSES), words("Invalid status: {s}", s="new_status"))
        .when(F.col("customer_id").isNull(), words("Order ID {o} not found", o="order_id"))
        .when(F.col("old_status").isNull(), F.lit("Current order status is NULL"))
        .when(F.col("old_status") == new, words("Order status is already {s}", s="new_status"))
        .when(F.col("changed"), words("Order status updated from {a} to {b}", a="old_status", b="new_status"))
        .when(~allowed_change(F.col("old_status"), new),
              words("Invalid status transition: {a} -> {b}", a="old_status", b="new_status"))
        .when(new == "SHIPPED", F.lit("Cannot ship order without shipment record"))
        .otherwise(words("Order cannot be cancelled after 24 hours. Hours elapsed: {h}", h=number_text(hours)))
    )
    same = (F.col("old_status") == new) & new.isin(*rules.ORDER_STATUSES)
    return (
        seen.withColumn("old_status", old)
        .withColumn("changed", changed)
        .withColumn("message", message)
        .withColumn("success", F.coalesce(F.col("changed") | same, F.lit(False)))
        .select(*requests.columns, "at", "customer_id", "old_status", "changed", "success", "message")
    )


def apply_status_changes(
    requests: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    shipments: DataFrame,
    group_rows: int | None = None,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Decide every request in time order per order.

    An order can change at most four times, as the transitions have no way back. So instead of
    folding all requests of an order in one task, each round takes for every order the earliest
    request that may follow its current status; four such rounds are complete.

    Orders with a great many requests are decided apart, so that Spark may broadcast their few
    states by its own size check; each round then combines the requests before its shuffle.
    """
    asked = requests.select("order_id").distinct()
    shipped = shipments.select("order_id").distinct().withColumn("has_shipment", F.lit(True))
    state = (
        orders.select("order_id", "customer_id", "order_date", F.col("status").alias("s0"))
        .join(asked, "order_id", "left_semi")
        .join(shipped, "order_id", "left")
        .withColumn("has_shipment", F.coalesce("has_shipment", F.lit(False)))
    )
    hot = large_groups(requests, ["order_id"], group_rows)
    plain, frequent = divide(requests, ["order_id"], hot)
    results = _decide(plain, state)
    if frequent is not None:
        few = state.join(hot.select("order_id"), "order_id", "left_semi")
        results = results.unionByName(_decide(frequent, few))
    results = settle(results) if settle else results
    new = F.col("new_status")
    done = results.filter("changed")
    restock = (
        done.filter(new == "CANCELLED").select("order_id")
        .join(items.select("order_id", "product_id", "quantity"), "order_id")
        .groupBy("product_id").agg(F.sum("quantity").cast("bigint").alias("stock_delta"))
    )
    audit = F.array(
        F.struct(F.lit("UPDATE").alias("action_type"), F.col("old_status").alias("old_value"),
                 F.col("new_status").alias("new_value")),
        F.when(F.col("notes").isNotNull(),
               F.struct(F.lit("NOTE").alias("action_type"), F.lit(None).cast("string").alias("old_value"),
                        F.col("notes").alias("new_value"))),
    )
    return {
        "results": results.select("request_id", "order_id", "old_status", "new_status", "success", "changed", "message"),
        "orders": done.groupBy("order_id").agg(F.max_by("new_status", "at").alias("status")),
        "stock": restock,
        "customers": done.filter(new == "DELIVERED").groupBy("customer_id")
        .agg(F.max("request_ts").alias("last_order_date")),
        "shipments": done.filter(new == "SHIPPED").select(
            "order_id", F.lit("SHIPPED").alias("status"), F.col("request_ts").alias("ship_date")),
        "audit": done.withColumn("entry", F.explode(F.array_compact(audit))).select(
            "request_id",
            F.lit("ORDERS").alias("table_name"),
            F.col("order_id").cast("string").alias("record_id"),
            "entry.*",
            F.col("updated_by").alias("changed_by"),
            F.col("request_ts").alias("change_timestamp"),
        ),
    }


# -- returns ----------------------------------------------------------------------------


def exchange_products(products: DataFrame) -> DataFrame:
    """For every product the cheapest other active product of its category.

    Only the two cheapest of a category matter: the second serves the first.
    """
    place = Window.partitionBy("category_id").orderBy("unit_price", "product_id")
    two = (
        products.filter(F.col("status") == "ACTIVE")
        .select("category_id", "product_id", "unit_price")
        .withColumn("n", F.row_number().over(place))
        .filter(F.col("n") <= 2)
        .groupBy("category_id")
        .agg(F.max(F.when(F.col("n") == 1, F.col("product_id"))).alias("first"),
             F.max(F.when(F.col("n") == 2, F.col("product_id"))).alias("second"))
    )
    other = F.when(F.col("first") == F.col("product_id"), F.col("second")).otherwise(F.col("first"))
    return (
        products.select("product_id", "category_id")
        .join(two, "category_id")
        .select("product_id", other.alias("exchange_product_id"))
    )


LINE = ["order_id", "product_id"]


def _turn(units: Column | str = "_units") -> Column:
    """What orders the requests of a line; those alike in it are one request that came twice."""
    return F.struct("request_ts", "request_id", units).alias("at")


def accepted_in_turn(requests: DataFrame) -> DataFrame:
    """Line and `at` of the requests that fit: those of a line in time order, each while it fits what the accepted ones left.

    Decided in rounds over all lines at once. A round takes the earliest open request of each line, which fits as all
    that do not are no longer open, and closes the requests that no longer fit what it leaves (that never grows again).
    Each round is a minimum per line, combined before its shuffle; there are as many as requests of a line are accepted.
    `requests` is read by two of them, so it should be a stored table.
    """
    waiting = requests.filter("_units <= room").select(*LINE, _turn(), F.col("room").alias("left"))
    taken = []
    while not waiting.isEmpty():
        first = settled(waiting.groupBy(*LINE).agg(F.min("at").alias("first")), "returns-first")
        taken.append(first.select(*LINE, F.col("first").alias("at")))
        waiting = waiting.join(first, LINE).withColumn("left", F.col("left") - F.col("first._units"))
        waiting = settled(
            waiting.filter((F.col("at") > F.col("first")) & (F.col("at._units") <= F.col("left"))).drop("first"), "returns-open"
        )
    none = requests.select(*LINE, _turn()).limit(0)
    return reduce(DataFrame.unionByName, taken, none)


def fitting_by_rounds(rows: DataFrame) -> DataFrame:
    """`fits` of the requests of a few orders that have a great many; the rows are stored, as several jobs read them."""
    rows = settled(rows, "returns-frequent")
    fits = accepted_in_turn(rows.filter("_valid")).repartition("order_id").withColumn("fits", F.lit(True))
    rows = rows.withColumn("at", _turn()).repartition("order_id").join(fits, [*LINE, "at"], "left").drop("at")
    return rows.withColumn("fits", F.col("fits").isNotNull() & F.col("request_id").isNotNull())


def fitting_by_fold(rows: DataFrame) -> DataFrame:
    """`fits` as `accepted_in_turn` decides it, from the rows of a line in one place: no row is moved or stored."""
    line = Window.partitionBy(*LINE)
    candidate = F.col("_valid") & (F.col("_units") <= F.col("room"))
    rows = rows.withColumn("_wish", F.when(candidate, _turn())).withColumn(
        "_wishes", F.collect_set("_wish").over(line)).withColumn("_wished", F.sum("_wish._units").over(line))

    def take(state: Column, wish: Column) -> Column:
        fits = wish["_units"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] - wish["_units"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.concat(state["taken"], F.array(wish))).otherwise(state["taken"]).alias("taken"),
        )

    kind = rows.schema["_wishes"].dataType
    start = F.struct(F.col("room").alias("left"), F.array().cast(kind).alias("taken"))
    taken = F.aggregate(F.sort_array("_wishes"), start, take, lambda state: state["taken"])
    # Most lines have room for all their requests.
    fits = F.when(F.col("_wish").isNull() | F.col("request_id").isNull(), False).when(F.col("_wished") <= F.col("room"), True).otherwise(
        F.array_contains(taken, F.col("_wish")))
    return rows.withColumn("fits", fits).drop("_wish", "_wishes", "_wished")


#: What the outputs with a return_id show of an accepted request, besides its time and id.
NUMBERED = {
    "returns": ("order_id", "product_id", "return_quantity", "return_reason", "kind", "refund_amount", "restocking_fee",
                "processed_by", "swap", "notes"),
    "refunds": ("order_id", "kind", "refund_amount", "processed_by"),
    "exchanges": ("product_id", "kind", "swap", "processed_by"),
    "audit": ("return_quantity", "product_name", "refund_amount", "processed_by"),
}
#: Columns of the output `returns`, and where one is called otherwise before.
RETURN_COLUMNS = ("return_id", "request_id", "order_id", "product_id", "return_date", "return_quantity", "return_reason", "return_type",
                  "refund_amount", "restocking_fee", "status", "processed_by", "exchange_product_id", "notes")
RETURN_SOURCES = {"return_date": "request_ts", "return_type": "kind", "exchange_product_id": "swap"}


def process_returns(
    requests: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    returns: DataFrame | None = None,
    strict: bool = False,
    first_return_id: int = 1000,
    group_rows: int | None = None,
    settle: Callable[[DataFrame], DataFrame] | None = None,
    only: str | None = None,
    return_columns: Sequence[str] = RETURN_COLUMNS,
) -> Mapping[str, DataFrame]:
    """Check, price and book a batch of returns.

    A return is checked against the ordered quantity. Once an order is returned as a whole, its
    later requests fail. `strict` checks against what is left of the line: its history and the requests accepted
    before it count, rejected ones do not. `only` names the one output with a return_id that will be asked for: columns that
    others show are not sorted to number it. `return_columns` are the columns that the output `returns` is to have.
    """
    if strict:
        # Requests by order are counted once: which orders are asked for, and which have many.
        counted = settled(requests.groupBy("order_id").agg(F.count(F.lit(1)).alias("_rows")), "returns-asked")
        asked = counted.select("order_id")
    else:
        asked = requests.select("order_id").distinct()
    lines = items.join(asked, "order_id", "left_semi")
    first_line = lines.groupBy("order_id", "product_id").agg(
        F.min("order_item_id").alias("line"), F.min_by("quantity", "order_item_id").alias("ordered"),
        F.min_by("line_total", "order_item_id").alias("line_total"),
    )
    sizes = lines.groupBy("order_id").agg(F.sum("quantity").cast("bigint").alias("order_units"))
    heads = orders.select("order_id", "customer_id", "order_date", F.col("status").alias("order_status"))
    goods = products.select("product_id", "product_name", F.col("status").alias("product_status")).join(
        exchange_products(products), "product_id", "left")

    # Only the two keys go to the products; all else needs the rows of an order in one place, where requests stay.
    named = requests.select("order_id", "product_id").distinct().join(goods, "product_id").repartition("order_id")
    # What is known by order comes first, then what is known by line, so that each needs one sort.
    facts = [(["order_id"], heads), (["order_id"], sizes), (LINE, first_line), (LINE, named)]
    before = {"returned_before": ["order_id"], "line_before": LINE}
    if returns is not None:
        done = returns.filter(F.col("status") == "PROCESSED")
        units = F.sum("return_quantity").cast("bigint")
        facts += [(keys, done.groupBy(*keys).agg(units.alias(name))) for name, keys in before.items()]
    rows = requests
    for keys, known in sorted(facts, key=lambda fact: len(fact[0])):
        rows = rows.join(known, keys, "left")
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumns({name: zero if returns is None else F.coalesce(name, zero) for name in before})

    asked_units, ordered = F.col("return_quantity"), F.col("ordered")
    age = micros("request_ts") - micros("order_date")
    days = F.round(age.cast("decimal(20,0)") / F.lit(DAY).cast("decimal(12,0)"), 0).cast("bigint")
    before_status = [
        (asked_units <= 0, F.lit("Return quantity must be greater than 0")),
        (F.col("customer_id").isNull(), words("Order ID {o} not found", o="order_id")),
    ]
    after_status = [
        (age > rules.RETURN_WINDOW_DAYS * DAY,
         words("Return period expired. Order is {d} days old (max {m} days)", d=days, m=F.lit(rules.RETURN_WINDOW_DAYS))),
        (F.col("product_status").isNull(), words("Product ID {p} not found", p="product_id")),
        (F.col("product_status") != "ACTIVE",
         words("Product {n} is {s} and cannot be returned", n="product_name", s="product_status")),
        (F.col("line").isNull(), words("Product {n} was not found in order {o}", n="product_name", o="order_id")),
        (asked_units > ordered,
         words("Return quantity ({q}) exceeds original quantity ({o})", q="return_quantity", o=ordered)),
        (~F.col("return_type").isin(*rules.RETURN_TYPES), words("Invalid return type: {t}", t="return_type")),
    ]
    barred = F.coalesce(~F.col("order_status").isin(*rules.RETURNABLE_STATUSES), F.lit(False))
    broken = [F.coalesce(test, F.lit(False)) for test, _ in before_status + after_status]
    rows = rows.withColumn("_valid", ~reduce(Column.__or__, broken, barred)).withColumn(
        "_units", F.when(F.col("_valid"), asked_units).otherwise(0))
    turn, sums = ["request_ts", "request_id"], {"_sum": F.col("_units")}
    if strict:
        many = large_groups(requests, ["order_id"], min(group_rows or FOLD_ROWS, FOLD_ROWS), counted=counted)
        hot = hot_groups(requests, ["order_id"], group_rows, counted=counted)
        rows = rows.withColumn("room", (ordered - F.col("line_before")).cast("bigint")).withColumn(
            "_units", F.col("_units").cast("bigint"))
        sides = zip(divide(rows, ["order_id"], many), (fitting_by_fold, fitting_by_rounds))
        decided = [decide(side) for side, decide in sides if side is not None]
        decided = [side.withColumn("_units", F.when(F.col("fits"), F.col("_units")).otherwise(0)) for side in decided]
        rows = reduce(DataFrame.unionByName, [running_totals(side, ["order_id"], turn, sums, hot=hot) for side in decided])
    else:
        rows = running_totals(rows, ["order_id"], turn, sums, group_rows, bounded_by=requests)
    earlier = F.col("_sum") - F.col("_units")
    whole = F.coalesce((earlier > 0) & (F.col("returned_before") + earlier >= F.col("order_units")), F.lit(False))
    if strict:
        over = F.col("_valid") & ~F.col("fits")
        after_status.append((over, F.lit("Return quantity exceeds the quantity left")))
    status_text = F.when(whole, F.lit("RETURNED")).otherwise(F.col("order_status"))
    ineligible = (barred | whole, words("Order status ({s}) is not eligible for return", s="order_status"))
    # The first rule that a request breaks; its text is made for rejects only, from what the columns left here say.
    tests = [*before_status, ineligible, *after_status]
    judged = rows.withColumn("_broken", F.coalesce(*[F.when(test, F.lit(k)) for k, (test, _) in enumerate(tests)])).withColumn(
        "order_status", status_text).drop("line", "line_before", "room", "fits", "_valid", "_units", "_sum")
    reason = F.coalesce(*[F.when(F.col("_broken") == k, text) for k, (_, text) in enumerate(tests)])
    if settle:
        judged = settle(judged)
    elif strict:
        # Rejects are stored with their keys and reason, accepted requests with all else.
        keys = ("request_id", *LINE, "_broken")
        booked = [F.when(F.col("_broken").isNull(), F.col(c)).alias(c) for c in judged.columns if c not in keys]
        judged = settled(judged.select(*keys, *booked, reason.alias("_reason")), "returns-judged")
        reason = F.col("_reason")

    accepted = judged.filter(F.col("_broken").isNull())
    swap = F.col("exchange_product_id")
    kind = F.when((F.col("return_type") == "EXCHANGE") & swap.isNull(), F.lit("REFUND")).otherwise(F.col("return_type"))
    line_value = F.col("line_total").cast("decimal(12,2)")
    fee = F.lit(0).cast("decimal(3,2)")
    rate = F.when(F.lit(False), fee)
    for pattern, share in rules.RESTOCKING_FEES:
        rate = rate.when(F.upper("return_reason").like(pattern), F.lit(share).cast("decimal(3,2)"))
    fee = line_value * F.when(F.col("return_type") == "REFUND", rate.otherwise(fee)).otherwise(fee)
    share = line_value * asked_units.cast("decimal(10,0)") / ordered.cast("decimal(10,0)")
    refund = F.when(kind == "EXCHANGE", F.lit(0)).otherwise(F.greatest(share - fee, F.lit(0)))
    priced = (
        accepted.withColumn("kind", kind)
        .withColumn("refund_amount", F.round(refund, 2).cast("decimal(10,2)"))
        .withColumn("restocking_fee", F.round(fee, 2).cast("decimal(10,2)"))
        .withColumn("swap", F.when(F.col("kind") == "EXCHANGE", swap))
    )

    @cache
    def placed() -> DataFrame:
        wanted = {RETURN_SOURCES.get(c, c) for c in return_columns}
        needed = NUMBERED | {"returns": [c for c in NUMBERED["returns"] if c in wanted]}
        shown = needed[only] if only in needed else dict.fromkeys(c for columns in needed.values() for c in columns)
        booked = priced.select("request_ts", "request_id", *shown)
        return numbered(booked, [], ["request_ts", "request_id"], "_place", bounded_by=requests).withColumn(
            "return_id", F.col("_place") + (first_return_id - 1)
        )

    units = priced.groupBy("order_id").agg(
        F.sum("return_quantity").alias("now"), F.any_value("returned_before").alias("before"),
        F.any_value("order_units").alias("order_units"),
    )
    left = F.col("order_units") - F.col("now") - F.col("before")
    return Outputs(
        returns=lambda: placed().select(*[
            F.lit("PROCESSED").alias(c) if c == "status" else F.col(RETURN_SOURCES.get(c, c)).alias(c) for c in return_columns
        ]),
        refunds=lambda: placed().filter((F.col("refund_amount") > 0) & F.col("kind").isin(*rules.REFUND_METHODS)).select(
            "return_id", "order_id", F.col("request_ts").alias("refund_date"), "refund_amount",
            lookup("kind", rules.REFUND_METHODS, "CHECK").alias("refund_method"), F.lit("COMPLETED").alias("status"),
            "processed_by",
        ),
        exchanges=lambda: placed().filter(F.col("kind") == "EXCHANGE").select(
            "return_id", F.col("product_id").alias("original_product_id"), F.col("swap").alias("exchange_product_id"),
            F.col("request_ts").alias("exchange_date"), F.lit("PROCESSED").alias("status"), "processed_by",
        ),
        stock=lambda: priced.groupBy("product_id").agg(F.sum("return_quantity").alias("stock_delta")),
        customers=lambda: priced.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("returns_delta"),
            money(F.sum("refund_amount")).alias("refund_delta"),
            money(F.sum(F.when(F.col("kind") == "CREDIT", F.col("refund_amount")).otherwise(0))).alias("credit_delta"),
            F.max("request_ts").alias("last_return_date"),
        ),
        orders=lambda: units.select(
            "order_id", F.when(left <= 0, "RETURNED").otherwise("PARTIALLY_RETURNED").alias("status")),
        audit=lambda: placed().select(
            F.lit("RETURNS").alias("table_name"),
            F.col("return_id").cast("string").alias("record_id"),
            F.lit("INSERT").alias("action_type"),
            words("Return processed: {q} units of {n} for ${r} refund", q="return_quantity", n="product_name",
                  r=number_text("refund_amount")).alias("new_value"),
            F.col("processed_by").alias("changed_by"),
            F.col("request_ts").alias("change_timestamp"),
        ),
        rejects=lambda: judged.filter(F.col("_broken").isNotNull()).select(
            "request_id", "order_id", "product_id", reason.alias("reason")),
    )
