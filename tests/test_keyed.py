"""Tables that change by key and key ranges for concurrent writers."""

import threading

import pytest

from ledgertide.sources import keyed, keyfilter
from ledgertide.sources.keyed import CommitLog, KeyedTable, KeyRanges
from ledgertide.sources.keyfilter import KeyFilter
from tests.helpers import rows


@pytest.fixture
def prices(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "prices"), "id")
    held.create(spark.range(4000).selectExpr("id", "id * 2 AS price", "'x' AS name"), files=200)
    return held


def test_one_key_rewrites_one_file(spark, prices):
    before = {r.file: r for r in prices.files().collect()}
    assert len(before) == 200 and sum(r.rows for r in before.values()) == 4000
    old = prices.read()
    prices.change(spark.createDataFrame([(1234, 5)], "id BIGINT, up INT"), add={"price": "up"})
    after = {r.file for r in prices.files().collect()}
    assert len(set(before) - after) == 1 and len(after - set(before)) == 1
    assert rows(prices.read().filter("price <> id * 2")) == [(1234, 2473, "x")] and prices.read().count() == 4000
    assert old.filter("price <> id * 2").count() == 0  # who began with the old version still reads it


def test_insert_replace_and_repeat(spark, prices):
    changes = spark.createDataFrame([(3999, "y"), (9000, "z")], "id BIGINT, label STRING")
    for _ in range(2):  # the second one finds its name
        assert prices.change(changes, replace={"name": "label"}, insert=True, name="labels") == 2
    assert sorted(rows(prices.read().filter("name <> 'x'"))) == [(3999, 7998, "y"), (9000, None, "z")]
    assert rows(prices.before("labels").filter("name <> 'x'")) == [] and prices.before("other").count() == 4001
    prices.change(spark.createDataFrame([(9001, "w")], "id BIGINT, label STRING"), replace={"name": "label"})  # no such key
    assert prices.read().count() == 4001
    prices.compact(3)
    assert prices.files().count() == 3 and prices.read().count() == 4001


def test_empty_table(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "id")
    with pytest.raises(FileNotFoundError):
        held.read()
    held.create(spark.createDataFrame([], "id BIGINT, n INT"))
    assert held.read().count() == 0
    held.change(spark.createDataFrame([], "id BIGINT, n INT"), add={"n": "n"}, insert=True)
    held.change(spark.createDataFrame([(1, 2)], "id BIGINT, n INT"), replace={"n": "n"}, insert=True)
    assert rows(held.read()) == [(1, 2)]


def test_key_ranges(spark, tmp_path):
    keys = KeyRanges(spark, str(tmp_path / "keys"), first=100)
    assert keys.take("a", 10) == 100 and keys.take("b/1", 5) == 110 and keys.take("a", 10) == 100 and keys.take("c", 1) == 115
    with pytest.raises(ValueError):
        keys.take("b/1", 6)
    df = spark.createDataFrame([("y",), ("x",)], "v string")
    assert sorted(rows(keys.with_keys(df, ["v"], "id", "d"), "v", "id")) == [("x", 116), ("y", 117)]
    assert sorted(rows(keys.with_keys(df, ["v"], "id", "d"), "v", "id")) == [("x", 116), ("y", 117)]


def test_writers_at_the_same_time(spark, tmp_path):
    """Of two writers that both saw no commit one comes second, and no two get one key."""
    keys, taken = KeyRanges(spark, str(tmp_path / "keys")), {}

    def work(n):
        for k in range(4):
            taken[n, k] = keys.take(f"{n}-{k}", 3)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(taken.values()) == [1 + 3 * k for k in range(16)]


def test_commit_lost_to_another(spark, tmp_path):
    log, calls = CommitLog(spark, str(tmp_path / "log")), []

    def late(number, last):
        calls.append(number)
        if not number:
            CommitLog(spark, str(tmp_path / "log")).commit("first", lambda n, last: {"x": 1})
        return {"x": (last or {"x": 0})["x"] + 10}

    assert log.commit("second", late) == (2, {"x": 11, "name": "second"}) and calls == [0, 1]
    assert log.find("first") == 1 and log.find("third") is None


def test_filter_prunes_and_is_exact(spark, prices):
    held = KeyFilter(prices)
    asked = spark.createDataFrame([(5,), (6,), (1234,), (None,), (5000,), (-1,), (5,)], "id BIGINT")
    assert sorted(rows(held.present(asked))) == [(5,), (6,), (1234,)]
    assert sorted(rows(held.repeated(asked), "id", "staged_rows", "exists")) == [(5, 2, True), (6, 1, True), (1234, 1, True)]
    assert sorted(rows(held.orphans(asked, "id"))) == [(-1, 1), (5000, 1)]
    assert len(held.files_of(held.possible(spark.createDataFrame([(5,), (6,), (1234,)], "id BIGINT")))) == 2  # of 200 files
    far = spark.range(10_000, 30_000)
    assert 0 <= held.possible(far).count() < 4000 and held.present(far).count() == 0
    assert held.possible(spark.range(4000)).count() == 4000  # none is lost


def test_filter_follows_versions(spark, prices, monkeypatch):
    monkeypatch.setattr(keyfilter, "MERGE_AFTER", 2)
    held = KeyFilter(prices)
    first = held.refresh()
    assert held.refresh() == first and len(first["bitmaps"]) == 1
    prices.change(spark.createDataFrame([(9000, 1)], "id BIGINT, p BIGINT"), replace={"price": "p"}, insert=True)
    new = spark.createDataFrame([(9000,), (7,)], "id BIGINT")
    assert rows(held.present(new, version=1)) == [(7,)] and sorted(rows(held.present(new))) == [(7,), (9000,)]
    read = spark.read.parquet(held.log.read(2)["files"][0])
    assert read.count() == 1  # only the new file was read
    more = spark.range(9001, 20_000).selectExpr("id", "1L AS p")
    prices.change(more, replace={"price": "p"}, insert=True)
    grown = held.refresh()
    assert grown["parts"] > 2 * first["parts"] and len(grown["bitmaps"]) == 1  # built anew with more parts
    for key in (30_000, 30_001):
        prices.change(spark.createDataFrame([(key, 1)], "id BIGINT, p BIGINT"), replace={"price": "p"}, insert=True)
        last = held.refresh()
    assert len(last["bitmaps"]) == 1 and last["parts"] == grown["parts"]  # merged
    assert held.present(spark.range(8990, 30_010)).count() == 11_002


def test_filter_of_texts_and_empty_tables(spark, tmp_path):
    names = KeyedTable(spark, str(tmp_path / "names"), "name")
    names.create(spark.createDataFrame([("b", 1), ("a", 2), ("é", 3)], "name STRING, n INT"), files=2)
    asked = spark.createDataFrame([("a",), ("é",), ("c",), ("",)], "name STRING")
    assert sorted(rows(KeyFilter(names).present(asked))) == [("a",), ("é",)]
    none = KeyedTable(spark, str(tmp_path / "none"), "name")
    none.create(spark.createDataFrame([], "name STRING, n INT"))
    assert KeyFilter(none).present(asked).count() == 0 and KeyFilter(none).orphans(asked, "name").count() == 4
    assert KeyFilter(names).present(asked.limit(0)).count() == 0


def test_changes_are_worked_out_once(spark, prices):
    made = spark.sparkContext.accumulator(0)

    def raised(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    changes = spark.range(10, 13).selectExpr("id", "id AS up").mapInPandas(raised, "id BIGINT, up BIGINT")
    prices.change(changes, add={"price": "up"}, name="raise")
    assert made.value == 3 and sorted(rows(prices.read().filter("price <> id * 2"), "price")) == [(30,), (33,), (36,)]
    assert prices.change(changes, add={"price": "up"}, name="raise") == 2 and made.value == 3  # done already: not even read


def test_changes_of_many_rows_are_not_broadcast(spark, prices, monkeypatch):
    """What a broadcast takes goes by rows, not by the bytes of a packed file; the result is the same either way."""
    few = keyed._sized(spark.range(3), 3)
    many = keyed._sized(spark.range(3), keyed.FEW_ROWS + 1)
    plan = lambda df: spark.range(9).join(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)
    asked = []
    monkeypatch.setattr(keyed, "FEW_ROWS", 10)
    monkeypatch.setattr(keyed, "_sized", lambda df, count, real=keyed._sized: asked.append(count) or real(df, count))
    changes = spark.range(3990, 4010).selectExpr("id", "CAST(id AS STRING) AS label")
    prices.change(changes, replace={"name": "label"}, insert=True)
    assert asked == [20, 20, 20]  # the changes twice, and the rows of the file that holds their keys
    assert sorted(rows(prices.read().filter("name <> 'x'"), "id", "name")) == [(k, str(k)) for k in range(3990, 4010)]
    assert prices.read().count() == 4010
