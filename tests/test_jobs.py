"""Jobs do for an output what that output needs, and once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgertide.operators.ordered import placed_parts
from ledgertide.plans import orders as jobs
from ledgertide.streaming import feeds, monitors, stateful
from tests.helpers import customer, item, order, product, rows, table


@pytest.fixture(scope="module")
def sold(spark):
    return dict(
        orders=table(spark, "orders", [order(1, status="DELIVERED"), order(2, status="PENDING")]),
        items=table(spark, "order_items", [item(1, 1, 1, 3, "10.00"), item(2, 2, 1, 1, "10.00")]),
        products=table(spark, "products", [product(1, "Lamp"), product(2, "Case")]),
    )


def asks(spark, *made):
    return table(spark, "return_requests", [
        dict(request_id=i, request_ts=f"2025-12-08 10:00:{i:02d}", order_id=o, product_id=1, return_quantity=q,
             return_reason="x", return_type="REFUND", processed_by="ann") for i, o, q in made])


@pytest.fixture
def stored(monkeypatch):
    """Names of the tables that a job writes on the way."""
    names = []
    real = jobs.settled

    def settled(df, name):
        names.append(name)
        return real(df, name)

    def numbered(*_args, **_more):
        raise AssertionError("numbered for nobody")

    monkeypatch.setattr(jobs, "settled", settled)
    monkeypatch.setattr(jobs, "numbered", numbered)
    monkeypatch.setattr(jobs, "placed_parts", numbered)
    return names


def test_returns_without_numbers(spark, sold, stored):
    out = jobs.process_returns(asks(spark, (1, 1, 2), (2, 2, 1)), **sold)
    assert rows(out["rejects"], "request_id") == [(2,)]
    assert rows(out["stock"]) == [(1, 2)] and rows(out["orders"]) == [(1, "PARTIALLY_RETURNED")]
    assert rows(out["customers"], "returns_delta") == [(1,)]
    assert list(out) == ["returns", "refunds", "exchanges", "stock", "customers", "orders", "audit", "rejects"]
    assert stored == []


def test_strict_returns_are_joined_once(spark, sold, stored):
    out = jobs.process_returns(asks(spark, (1, 1, 2), (2, 1, 2), (3, 1, 1)), strict=True, **sold)
    assert rows(out["rejects"], "request_id") == [(2,)]
    assert stored[0] == "returns-asked" and stored[-1] == "returns-judged"


def order_requests(spark, *made):
    return table(spark, "order_requests", [
        dict(request_id=i, request_ts="2025-12-05 10:54:10", customer_id=1, product_ids=p, quantities=q,
             shipping_address="123 Main St") for i, p, q in made])


def test_rejected_orders_without_numbers(spark, sold, stored):
    people = table(spark, "customers", [customer(1, "Ann")])
    made = jobs.create_orders(
        order_requests(spark, (1, [1], [1]), (2, [9], [1]), (3, [1, 1], [None, 2]), (4, [1, 2], [None, 2])), sold["products"], people)
    assert dict(rows(made["rejects"], "request_id", "reason")) == {
        2: "Product not found", 3: "Product repeated in order", 4: "Quantity must be greater than 0"}


def test_lines_follow_their_orders(spark, sold):
    people = table(spark, "customers", [customer(1, "Ann")])
    made = jobs.create_orders(
        order_requests(spark, (5, [2, 1], [1, 2]), (3, [1], [4]), (4, [1, 1], [1, 1]), (9, [1, 2], [5, 6])), sold["products"],
        people, first_order_id=10, first_item_id=100)
    assert sorted(rows(made["items"], "order_item_id", "order_id", "product_id", "quantity")) == [
        (100, 10, 1, 4), (101, 11, 2, 1), (102, 11, 1, 2), (103, 12, 1, 5), (104, 12, 2, 6)]


def test_places_of_parts(spark):
    df = spark.range(3000).select((3000 - F.col("id")).alias("k"), F.sequence(F.lit(1), F.col("id") % 3 + 1).alias("n"))
    df = df.select("k", F.transform("n", lambda x: F.struct(F.col("k").alias("of"), x.alias("n"))).alias("parts"))
    got = sorted(rows(placed_parts(df, ["k"], "parts", "place", "number"), "of", "n", "place", "number"))
    assert [g[3] for g in got] == list(range(1, 6001)) and all(of == place for of, _, place, _ in got)


def test_busy_employees_keep_two_state_rows(spark, tmp_path):
    """Every sliding window of the batch form, from two state rows a row instead of one per window."""
    made = [(k, k % 3, dt.datetime(2024, 1, 1, 22) + dt.timedelta(seconds=k * k * 7 % 20000)) for k in range(300)]
    df = spark.createDataFrame(made, "audit_id BIGINT, employee_id BIGINT, action_timestamp TIMESTAMP_NTZ")
    folder = str(tmp_path / "rows")
    df.write.parquet(folder)
    live = monitors.busy_employees(spark.readStream.schema(df.schema).parquet(folder), threshold=7, width="20 minutes")
    assert "1200000000" in live._jdf.queryExecution().analyzed().toString()  # windows move by their width
    logged, _ = feeds.drain(live, "busy", mode="update")
    got = feeds.newest_per_key(logged, ["employee_id", "window_start"])
    want = df.groupBy("employee_id", F.window("action_timestamp", "20 minutes", "5 minutes").alias("w")).agg(
        F.count("*").alias("actions")).filter("actions > 7").select("employee_id", "w.start", "actions")
    assert sorted(rows(got, "employee_id", "window_start", "actions")) == sorted(rows(want)) != []


def test_keyed_streams_call_per_bucket(spark):
    """Released rows meet their state by bucket: as many keys as BUCKETS, however many employees and slots there are."""
    live = spark.readStream.format("rate").load().selectExpr(
        "value AS audit_id", "value AS employee_id", "value AS order_id", "value AS request_id", "'x' AS action_type",
        "'x' AS new_status", "CAST(timestamp AS TIMESTAMP_NTZ) AS action_timestamp", "CAST(timestamp AS TIMESTAMP_NTZ) AS request_ts")
    for told in (stateful.bursts(live), stateful.sequences(live)):
        plan = told._jdf.queryExecution().analyzed().toString()
        assert "bucket" in plan and "collect_list" in plan
    assert "TransformWithState" not in stateful.released_requests(live)._jdf.queryExecution().analyzed().toString()


def test_large_orders_are_looked_for_once(spark, sf, monkeypatch):
    from ledgertide.sources import model

    looked = []
    monkeypatch.setattr(model, "hot_groups", lambda *a, find=model.hot_groups: looked.append(a) or find(*a))
    m = model.Model(spark, sf)
    first, second = m.keyed_items(), m.keyed_items()
    assert len(looked) == 1 and first.exceptAll(second).isEmpty()


def test_strict_returns_fold_in_place(spark, sold, monkeypatch):
    """Requests of ordinary orders are neither stored before they are judged nor moved for a round; both ways decide alike."""
    stored = {}
    real = jobs.settled
    monkeypatch.setattr(jobs, "settled", lambda df, name: stored.setdefault(name, df.columns) and real(df, name))
    lines = [item(k, k // 3, k % 3, 2 + k % 5, "10.00") for k in range(30)]
    own = sold | dict(
        orders=table(spark, "orders", [order(k, status="DELIVERED") for k in range(10)]),
        items=table(spark, "order_items", lines), products=table(spark, "products", [product(k, f"P{k}") for k in range(3)]))
    made = [dict(request_id=k, request_ts=f"2025-12-08 10:00:{k * 7 % 60:02d}", order_id=k % 30 // 3, product_id=k % 3,
                 return_quantity=1 + k * 5 % 4, return_reason="x", return_type="REFUND", processed_by="ann") for k in range(180)]
    made += made[:40]  # a request that comes twice takes its room once
    asked = table(spark, "return_requests", made)

    def judged(**more):
        out = jobs.process_returns(asked, strict=True, **own, **more)
        return sorted(rows(out["returns"], "request_id", "return_quantity")), sorted(rows(out["rejects"], "request_id", "reason"))

    folded = judged()
    assert stored == {"returns-asked": ["order_id", "_rows"], "returns-judged": stored["returns-judged"]}
    assert "_sum" not in stored["returns-judged"]
    assert judged(group_rows=5) == folded and "returns-first" in stored
    assert {reason for _, reason in folded[1]} >= {"Return quantity exceeds the quantity left"} and len(folded[0]) + len(folded[1]) == 220


def test_returns_with_the_columns_asked_for(spark, sold):
    out = jobs.process_returns(asks(spark, (1, 1, 2), (2, 2, 1)), only="returns", return_columns=["request_id", "return_type", "status"], **sold)
    assert out["returns"].columns == ["request_id", "return_type", "status"]
    assert rows(out["returns"]) == [(1, "REFUND", "PROCESSED")] and rows(out["rejects"], "request_id") == [(2,)]


def test_large_groups_count_buckets_first(spark, monkeypatch):
    from ledgertide.operators import ordered

    df = spark.range(400).selectExpr("nullif(floor(sqrt(id)), 3) AS k", "id")
    monkeypatch.setattr(ordered, "BUCKETS", 7)
    for limit in (1, 20, 35):
        want = {r[0]: r[1] for r in df.groupBy("k").count().collect() if r[1] > limit}
        assert {r[0]: r[1] for r in ordered.large_groups(df, ["k"], limit).collect()} == want
    assert ordered.large_groups(df, ["k"], 400) is None
    counted = spark.createDataFrame([(1, 5), (2, 9)], "k BIGINT, _rows BIGINT")
    assert rows(ordered.large_groups(df, ["k"], 6, counted=counted)) == [(2, 9)]
