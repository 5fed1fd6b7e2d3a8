"""Streams over rows that come late and in many batches, against the same question in one batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgertide.operators.ordered import trailing_count
from ledgertide.plans import audit as a
from ledgertide.plans import orders as o
from ledgertide.sources.keyed import KeyedTable
from ledgertide.sources.model import Model
from ledgertide.streaming import feeds, monitors, stateful
from tests.helpers import order, rows, table

DAY = dt.datetime(2024, 1, 1)
ACTIONS = "audit_id BIGINT, employee_id BIGINT, action_type STRING, action_timestamp TIMESTAMP_NTZ"
REQUESTS = "request_id BIGINT, order_id BIGINT, request_ts TIMESTAMP_NTZ, new_status STRING"


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


@pytest.fixture
def waves(spark, tmp_path):
    def lay(made, schema, ts):
        df = spark.createDataFrame([row for _, row in made], schema)
        wave_of = F.lit(None).cast("int")
        key = df.columns[0]
        for wave, row in made:
            wave_of = F.when(F.col(key) == row[0], wave).otherwise(wave_of)
        folder = str(tmp_path / "waves")
        feeds.in_waves(df, wave_of, folder, {ts: at(10_000_000)})
        return df, feeds.wave_stream(df, folder)

    return lay


def test_burst_that_a_late_row_completes(spark, waves):
    """Ten actions at 10:00 and one at 10:30, then the eleventh at 10:01 in a later batch."""
    made = [(0, (k, 1, "INSERT", at(600))) for k in range(10)]
    made += [(0, (10, 1, "INSERT", at(630))), (1, (11, 1, "INSERT", at(601))), (2, (12, 2, "INSERT", at(640)))]
    _, stream = waves(made, ACTIONS, "action_timestamp")
    got, _ = feeds.drain(stateful.bursts(stream, late="1 hour"), "bursts")
    assert rows(got, "audit_id", "employee_id", "action_timestamp", "recent") == [(11, 1, at(601), 11)]


def test_sequence_that_a_late_row_completes(spark, waves):
    made = [(0, (1, 1, "INSERT", at(600))), (0, (2, 1, "UPDATE", at(601))), (0, (3, 1, "SELECT", at(610))),
            (0, (4, 1, "SELECT", at(611))), (1, (5, 1, "DELETE", at(602))), (2, (6, 1, "INSERT", at(650)))]
    _, stream = waves(made, ACTIONS, "action_timestamp")
    got, _ = feeds.drain(stateful.sequences(stream, late="1 hour"), "sequences")
    assert rows(got, "audit_id", "employee_id", "action_timestamp") == [(5, 1, at(602))]
    got, _ = feeds.drain(stateful.sequences(stream, ("UPDATE", "DELETE", "SELECT", "SELECT", "INSERT"), "1 hour"), "sequences")
    assert rows(got, "audit_id") == [(6,)]
    got, _ = feeds.drain(stateful.sequences(stream, ("DELETE",), "1 hour"), "sequences")
    assert rows(got, "audit_id") == [(5,)]


@pytest.fixture(scope="module")
def scattered(spark, sf, tmp_path_factory):
    """All events in six files, a third of them one or two files late, and one employee with a third of all rows."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")).cast("bigint"))
    wave = F.floor(F.dayofmonth("ts") / 6) + F.when(F.col("event_id") % 3 == 1, F.col("event_id") % 2 + 1).otherwise(0)
    folder = str(tmp_path_factory.mktemp("scattered") / "waves")
    feeds.in_waves(events, wave, folder, {"ts": dt.datetime(2030, 1, 1)})

    class Live(Model):
        def raw(self, name):
            return feeds.wave_stream(events, folder)

    class Still(Model):
        def raw(self, name):
            return events

    return Live(spark, sf).audit(), Still(spark, sf).audit()


def test_bursts_in_any_order(scattered):
    live, still = scattered
    got, _ = feeds.drain(stateful.bursts(live, minutes=2000, limit=2, late="15 days"), "bursts")
    want = trailing_count(still, ["employee_id"], "action_timestamp", 2000 * 60_000_000, "recent").filter("recent > 2")
    assert sorted(rows(got, "audit_id", "recent")) == sorted(rows(want, "audit_id", "recent"))


def test_sequences_in_any_order(scattered):
    live, still = scattered
    got, _ = feeds.drain(stateful.sequences(live, late="15 days"), "sequences")
    want = a.suspicious_patterns(still).filter("activity_pattern = 'SUSPICIOUS_PATTERN'")
    assert sorted(rows(got, "audit_id")) == sorted(rows(want, "audit_id")) != []


def test_life_cycle_decides_as_the_batch_does(spark, waves, tmp_path):
    """One order holds a third of all requests; requests come late."""
    names = ["PROCESSING", "SHIPPED", "DELIVERED", "RETURNED", "CANCELLED", "LOST"]
    made = []
    for k in range(120):
        order_id = 1 if k % 3 == 0 else k % 17
        made.append((k // 20 + (k % 7 == 0), (k, order_id, at(10 * (k // 20) + (k * 37) % 10), names[(k * 11) % 6])))
    df, stream = waves(made, REQUESTS, "request_ts")
    statuses = KeyedTable(spark, str(tmp_path / "statuses"), "order_id")
    statuses.create(spark.createDataFrame([], "order_id BIGINT, status STRING"))
    got, _ = feeds.drain(stateful.released_requests(stream, late="1 hour"), "life", make=stateful.life_cycle(statuses),
                         schema=StructType.fromDDL(stateful.LIFE_CYCLE_ROWS))
    known = table(spark, "orders", [order(k, date="2024-01-01 00:00:00") for k in range(17)])
    shipped = spark.range(17).select(F.col("id").alias("order_id"))
    decided = o.apply_status_changes(
        df.withColumn("updated_by", F.lit("x")).withColumn("notes", F.lit(None).cast("string")), known,
        spark.createDataFrame([], "order_id BIGINT, product_id BIGINT, quantity INT"), shipped)
    want = decided["results"].select("request_id", "old_status", "new_status", "changed")
    assert sorted(rows(got, "request_id", "old_status", "new_status", "accepted")) == sorted(rows(want))
    last = {r.order_id: r.status for r in statuses.read().collect()}
    assert last == {r.order_id: r.status for r in decided["orders"].collect()}


def test_life_cycle_batch_that_runs_again(spark, tmp_path):
    statuses = KeyedTable(spark, str(tmp_path / "statuses"), "order_id")
    statuses.create(spark.createDataFrame([(1, "PENDING")], "order_id BIGINT, status STRING"))
    handle = stateful.life_cycle(statuses)(str(tmp_path / "rows"))
    batch = spark.createDataFrame([(1, 1, at(1), "PROCESSING"), (2, 1, at(2), "SHIPPED")], REQUESTS)
    for _ in range(2):
        handle(batch, 0)
        assert rows(statuses.read()) == [(1, "SHIPPED")] and statuses.log.newest() == 2
        got = spark.read.parquet(str(tmp_path / "rows/batch_id=0"))
        assert sorted(rows(got, "request_id", "old_status", "accepted")) == [(1, "PENDING", True), (2, "PROCESSING", True)]


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    """More micro-batches than Spark keeps reports of; the side output holds what Spark's own watermark drops."""
    made = [(w, (10 * w + k, 1, "INSERT", at(60 * w - (600 if (w + k) % 9 == 0 else 0)))) for w in range(24) for k in range(2)]
    df = spark.createDataFrame([row for _, row in made], ACTIONS)
    folder = str(tmp_path / "waves")
    assert feeds.in_waves(df, F.floor(F.col("audit_id") / 10), folder) == 24
    stream = feeds.wave_stream(df, folder)
    got, _ = feeds.drain(stream, "late", make=feeds.split_late("action_timestamp", "3 hours"),
                         schema=StructType([*stream.schema.fields, StructField("late", IntegerType())]))
    late = {r.audit_id for r in got.filter("late = 1").collect()}
    assert got.count() == 48 and late == {row[0] for w, row in made if w > 0 and row[3] <= max(
        r[3] for v, r in made if v < w) - dt.timedelta(hours=3)}

    totals = feeds.ProgressTotals()
    spark.streams.addListener(totals)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    try:
        first = monitors.timed(stream, "action_timestamp", "3 hours").dropDuplicatesWithinWatermark(["audit_id"])
        passed, query = feeds.drain(first, "unique")
        assert totals.late_rows(query) == 48 - passed.count() == len(late)
        assert totals.batches[str(query.runId)] >= 24 > 5 >= len(query.recentProgress)
        assert totals.rows[str(query.runId)] == 48
    finally:
        spark.streams.removeListener(totals)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_no_events(spark, tmp_path):
    df = spark.createDataFrame([], ACTIONS)
    folder = str(tmp_path / "waves")
    feeds.in_waves(df, F.lit(0), folder, {"action_timestamp": at(0)})
    for found in (stateful.bursts, stateful.sequences):
        assert feeds.drain(found(feeds.wave_stream(df, folder)), "none")[0].count() == 0


def test_life_cycle_broadcasts_no_rows_of_orders(spark, tmp_path, monkeypatch):
    """Rows that a small last file releases look small to Spark, however many there are."""
    plans, real = [], stateful.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().toString())
        return real(df)

    monkeypatch.setattr(stateful, "cut_lineage", noted)
    statuses = KeyedTable(spark, str(tmp_path / "statuses"), "order_id")
    statuses.create(spark.createDataFrame([(1, "PENDING")], "order_id BIGINT, status STRING"))
    batch = spark.sql("SELECT 1L AS request_id, 1L AS order_id, TIMESTAMP_NTZ '2024-01-01' AS request_ts, 'PROCESSING' AS new_status")
    stateful.life_cycle(statuses)(str(tmp_path / "rows"))(batch, 0)
    assert "SortMergeJoin" in plans[1] and not any("Broadcast" in plan for plan in plans)
    assert rows(statuses.read()) == [(1, "PROCESSING")]
