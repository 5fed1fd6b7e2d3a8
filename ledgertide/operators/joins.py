"""Joins beyond plain equality: effective-dated promotions and parent chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.session import cut_lineage


#: Days are numbered from FIRST_DAY up to 2**LEVELS - 1 (some 2,800 years), in blocks of 1, 2, 4, ... days.
FIRST_DAY, LEVELS = "0001-01-01", 20


def _day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit(FIRST_DAY).cast("date"))


def _blocks(low: Column, high: Column) -> Column:
    """The fewest aligned blocks (level, node) that make up the days from low to high: two per level at most."""

    def block(level: Column, node: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), node.cast("int").alias("node"))

    def step(seen: Column, level: Column) -> Column:
        low, high = seen["low"], seen["high"]
        some = low <= high
        odd, even = F.when(some & (low % 2 == 1), block(level, low)), F.when(some & (high % 2 == 0), block(level, high))
        return F.struct(
            F.floor((low + 1) / 2).cast("int").alias("low"), F.floor((high - 1) / 2).cast("int").alias("high"),
            F.concat(seen["blocks"], F.array_compact(F.array(odd, even))).alias("blocks"),
        )

    none = F.array().cast("array<struct<level:int,node:int>>")
    start = F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), none.alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda seen: seen["blocks"])


def active_on(days: DataFrame, intervals: DataFrame, start: str, end: str, day: str = "_day") -> DataFrame:
    """Every day (numbers as of `_day`) with every interval that covers it.

    An interval index: an interval becomes a few blocks of days, a day asks for the one block of each level that holds it,
    so an interval of any length costs some twenty rows at most and meets its days by equality. A NULL start or end is open.
    """
    low = F.greatest(F.coalesce(_day(F.col(start)), F.lit(0)), F.lit(0))
    high = F.least(F.coalesce(_day(F.col(end)), F.lit(2**LEVELS - 1)), F.lit(2**LEVELS - 1))
    laid = intervals.withColumn("_block", F.explode(_blocks(low, high)))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    asked = days.select(day, level).withColumn("_block", F.struct("level", F.expr(f"shiftright({day}, level)").alias("node")))
    return asked.drop("level").join(laid, "_block").drop("_block")


def best_promotion(orders: DataFrame, items: DataFrame, products: DataFrame, promotions: DataFrame) -> DataFrame:
    """The best promotion of each order: active on its date, above its minimum, within its category.

    The days that have orders look their promotions up in an interval index; orders then meet the promotions of their day.
    A promotion without a start or an end is open on that side. A category promotion discounts the lines of that category
    only. Orders without a promotion do not appear.
    """
    slim = orders.select("order_id", "order_date", "total_amount").withColumn("_day", _day(F.col("order_date")))
    running = active_on(slim.select("_day").dropna().distinct(), promotions, "start_date", "end_date")
    begun = F.col("start_date").isNull() | (F.col("order_date") >= F.col("start_date"))
    going = F.col("end_date").isNull() | (F.col("order_date") <= F.col("end_date"))
    dated = (
        slim.join(running, "_day")
        .filter(begun & going)
        .filter(F.col("total_amount") >= F.coalesce("minimum_order_amount", F.lit(0)))
    )
    wanted = promotions.select(F.col("applicable_category_id").alias("category_id")).dropna().distinct()
    goods = products.select("product_id", "category_id").join(wanted, "category_id", "left_semi")
    in_category = (
        items.select("order_id", "product_id", "line_total")
        .join(goods, "product_id")
        .groupBy("order_id", F.col("category_id").alias("applicable_category_id"))
        .agg(F.sum("line_total").cast("decimal(22,2)").alias("_eligible"))
    )
    whole = dated.filter(F.col("applicable_category_id").isNull()).withColumn(
        "_eligible", F.col("total_amount").cast("decimal(22,2)")
    )
    part = dated.filter(F.col("applicable_category_id").isNotNull()).join(
        in_category, ["order_id", "applicable_category_id"]
    )
    discount = F.least(
        F.round(F.col("_eligible") * F.col("discount_percent") * F.lit("0.01").cast("decimal(3,2)"), 2),
        F.col("maximum_discount"),
    ).cast("decimal(22,2)")
    offers = whole.unionByName(part).withColumn("_discount", discount)
    best = F.max_by(
        F.struct("promotion_id", "promotion_name", F.col("_discount").alias("promotion_discount")),
        F.struct(F.col("_discount").alias("d"), (-F.col("promotion_id")).alias("p")),
    )
    return offers.groupBy("order_id").agg(best.alias("_best")).select("order_id", "_best.*")


def parent_chains(nodes: DataFrame, key: str, parent: str, label: str) -> DataFrame:
    """Depth, root and path of every node, whatever the depth.

    Each round lets every node jump to the end of its ancestor's own jump, so a chain of n nodes takes log2(n) rounds.
    First only ids climb, which finds the chains that reach a root; then those gather depth and path in the same way.
    A chain that runs in a circle or points to a missing parent keeps `complete` = false, depth 1 and its own label.
    """
    rows = nodes.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.col(label).alias("path"))
    rows = cut_lineage(rows)
    rounds = max(1, rows.count()).bit_length() + 1

    climbing = rows.select("id", "up")
    for _ in range(rounds):
        climbing = cut_lineage(_jump(climbing, {}))
        if climbing.filter(F.col("up").isNotNull()).isEmpty():
            break
    complete = climbing.filter(F.col("up").isNull()).select("id")
    rooted = rows.join(complete, "id", "left_semi").select(
        "id", "up", F.lit(1).cast("bigint").alias("depth"), F.col("id").alias("root_id"), "path"
    )
    gather = {
        "depth": lambda own, above: own + above, "root_id": lambda own, above: above,
        "path": lambda own, above: F.concat_ws(" / ", above, own),
    }
    while True:
        rooted = cut_lineage(_jump(rooted, gather))
        if rooted.filter(F.col("up").isNotNull()).isEmpty():
            break
    lost = rows.join(complete, "id", "left_anti").select(
        "id", F.lit(1).cast("bigint").alias("depth"), F.col("id").alias("root_id"), "path"
    )
    return rooted.select("id", "depth", "root_id", "path", F.lit(True).alias("complete")).unionByName(
        lost.withColumn("complete", F.lit(False))
    ).withColumnRenamed("id", key)


def _jump(rows: DataFrame, gather: dict) -> DataFrame:
    """Every row that still climbs takes over the pointer of the row it points to; roots stay out of the join."""
    above = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    found = F.col("_id").isNotNull()
    moved = rows.filter(F.col("up").isNotNull()).join(above, F.col("up") == F.col("_id"), "left").select(
        "id", F.when(found, F.col("_up")).otherwise(F.col("up")).alias("up"),
        *[F.when(found, join(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, join in gather.items()],
    )
    return moved.unionByName(rows.filter(F.col("up").isNull()))
