"""The two ways of every ordered operator must agree."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgertide.functions.compat import micros
from ledgertide.operators import ordered as o


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(600):
        key = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "c", None])
        data.append((key, rnd.randint(0, 12), i, rnd.randint(1, 9), 1_000_000 * rnd.randint(0, 4000)))
    df = spark.createDataFrame(data, "k string, v int, id bigint, q int, us bigint")
    df = df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    return df.cache()


def same(left, right):
    cols = sorted(left.columns)
    a = sorted(map(repr, left.select(*cols).collect()))
    b = sorted(map(repr, right.select(*cols).collect()))
    assert a == b


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("size", [7, 50, 100_000])
def test_numbered(rows, keys, size):
    spec = Window.partitionBy(*keys).orderBy(F.col("v").desc_nulls_first(), "id")
    want = rows.withColumn("n", F.row_number().over(spec).cast("bigint"))
    same(o.numbered(rows, keys, ["-v", "id"], "n", group_rows=size), want)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("size", [3, 40])
def test_ranked(rows, keys, size):
    spec = Window.partitionBy(*keys).orderBy(F.col("v").desc_nulls_first())
    want = rows.withColumn("r", F.rank().over(spec).cast("bigint")).withColumn(
        "d", F.dense_rank().over(spec).cast("bigint")
    )
    same(o.ranked(rows, keys, ["-v"], rank="r", dense="d", group_rows=size), want)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("size", [5, 60])
@pytest.mark.parametrize("tiles", [4, 7, 1000])
def test_tiled(rows, keys, size, tiles):
    spec = Window.partitionBy(*keys).orderBy("v", "id")
    want = rows.withColumn("t", F.ntile(tiles).over(spec).cast("bigint"))
    same(o.tiled(rows, keys, ["v", "id"], tiles, "t", group_rows=size), want)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("size", [9, 70])
def test_framed(rows, keys, size):
    def build(spec):
        return {
            "p1": F.lag("q", 1).over(spec),
            "p2": F.lag("q", 2).over(spec),
            "n1": F.lead("q", 1).over(spec),
            "m": F.sum("q").over(spec.rowsBetween(-6, 0)),
        }

    spec = Window.partitionBy(*keys).orderBy("ts", "id")
    want = rows.select("*", *[c.alias(n) for n, c in build(spec).items()])
    same(o.framed(rows, keys, ["ts", "id"], build, before=6, after=1, group_rows=size), want)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("size", [10, 100_000])
def test_trailing_count(rows, keys, size):
    span = 300 * 1_000_000
    spec = Window.partitionBy(*keys).orderBy(micros("ts")).rangeBetween(-span, 0)
    want = rows.withColumn("n", F.count(F.lit(1)).over(spec))
    same(o.trailing_count(rows, keys, "ts", span, "n", group_rows=size), want)


def test_running_totals(rows):
    spec = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("s", F.sum("q").over(spec))
    same(o.running_totals(rows, ["k"], ["ts", "id"], {"s": F.col("q")}, group_rows=20), want)


def test_small_inputs_are_not_counted(rows):
    assert o.large_groups(rows, ["k"]) is None


def test_long_lists_in_parts(rows):
    """Parts of a list of any length, cut the same way for frequent keys; put together they are the whole list."""
    from ledgertide.plans import audit as a

    log = rows.select(F.col("id").alias("audit_id"), F.when(F.col("k") == "hot", 1).otherwise(F.col("v") + 2).cast("bigint").alias(
        "employee_id"), F.col("ts").alias("action_timestamp"), F.element_at(F.array(*map(F.lit, ("INSERT", "UPDATE", "DELETE"))),
        (F.col("q") % 3 + 1).cast("int")).alias("action_type"))
    whole = {r.employee_id: r.action_sequence for r in a.unusual_activity(log, "1970-01-01 01:00:00").collect()}
    for size in (20, None):
        joined = {}
        parts = a.activity_parts(log, "1970-01-01 01:00:00", part_chars=100, group_rows=size)
        for r in parts.orderBy("employee_id", "part").collect():
            assert len(r.action_sequence) < 108
            joined[r.employee_id] = joined.get(r.employee_id, "") + r.action_sequence
        assert joined == whole and len(whole[1]) > 1000
        same(a.action_runs(log, group_rows=size), a.action_runs(log))
