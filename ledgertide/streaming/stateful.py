"""Streams that remember, on Spark's keyed state (RocksDB): bursts, sequences, the order life cycle.

Rows may come in any order and in any number of micro-batches. `released` groups them by their event time, so that Spark holds
a row until the watermark has passed it (no earlier row can follow then) and gives it out in that micro-batch, whose rows all
lie behind those of the batches before. Rows behind the watermark are dropped by Spark; `feeds.split_late` keeps them.

What has to be remembered of released rows lies in the state of `BUCKETS` keys: a task meets many employees in one call, and
the calls of a micro-batch do not grow in number with the rows.

* Bursts are dealt by employee and slot of the trailing span, each row also going to the next slot, so an employee who
  fills the stream is in many buckets, and rows leave the state with their slot.
* Sequences keep the last actions of each employee.
* Released requests of the life cycle are decided per micro-batch by the rounds of `orders.status_rounds`, over all orders at
  once, from the statuses that a keyed table holds.

Rows without a time wait for nothing and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgertide.functions import rules
from ledgertide.functions.compat import micros
from ledgertide.sources.keyed import KeyedTable
from ledgertide.plans.orders import status_outcome, status_rounds
from ledgertide.session import cut_lineage
from ledgertide.streaming.monitors import timed

TS = "action_timestamp"
#: Keys over which employees are dealt.
BUCKETS = 1024


def released(rows: DataFrame, key: str, ts: str, values: list[str], late: str) -> DataFrame:
    """Rows that no earlier one can precede any more: key, time and values."""
    held = timed(rows.select(key, ts, *values).filter(F.col(ts).isNotNull()), ts, late)
    held = held.groupBy(key, ts).agg(F.collect_list(F.struct(*values)).alias("held"))
    return held.select(key, ts, F.explode("held").alias("held")).select(key, ts, "held.*")


def _numbers(rows: DataFrame) -> DataFrame:
    """Entries as whole numbers without NULL, as pandas would make floats of them."""
    return rows.select(
        F.coalesce("employee_id", F.lit(0)).alias("employee"), F.col("employee_id").isNull().cast("bigint").alias("nobody"),
        micros(F.col(TS).cast("timestamp_ntz")).alias("us"), F.coalesce("audit_id", F.lit(0)).alias("entry"),
        F.col("audit_id").isNull().cast("bigint").alias("unnamed"), *[c for c in rows.columns if c not in ("employee_id", "audit_id")],
    )


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int").alias("bucket")


def _told(found: DataFrame, *more: str) -> DataFrame:
    return found.select(
        F.when(F.col("unnamed") == 0, F.col("entry")).alias("audit_id"), F.when(F.col("nobody") == 0, F.col("employee")).alias("employee_id"),
        F.timestamp_micros("us").cast("timestamp_ntz").alias(TS), *more,
    )


class _Held:
    """Whole numbers in columns, kept as one value of a key."""

    def __init__(self, handle: StatefulProcessorHandle, columns: list[str]):
        self.columns, self.value = columns, handle.getValueState("held", "numbers BINARY")

    def with_new(self, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """Held rows, in their order, and new ones; the column `new` tells them apart."""
        new = pd.concat([frame[self.columns] for frame in frames], ignore_index=True).astype(np.int64).assign(new=True)
        if not self.value.exists():
            return new
        kept = np.frombuffer(bytes(self.value.get()[0]), np.int64).reshape(-1, len(self.columns))
        return pd.concat([pd.DataFrame(kept, columns=self.columns).assign(new=False), new], ignore_index=True)

    def keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.value.update((np.ascontiguousarray(rows[self.columns].to_numpy(np.int64)).tobytes(),))
        else:
            self.value.clear()


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether a row of sorted rows is the first of its keys."""
    values = rows[keys].to_numpy()
    return np.r_[True, (values[1:] != values[:-1]).any(axis=1)] if len(rows) else np.zeros(0, bool)


class _Bursts(StatefulProcessor):
    """Times of employees in a slot and the slot before."""

    GROUP = ["employee", "nobody", "slot"]

    def __init__(self, span: int, limit: int):
        self.span, self.limit = span, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = _Held(handle, [*self.GROUP, "us", "entry", "unnamed"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = self.held.with_new(rows).sort_values([*self.GROUP, "us"], ignore_index=True)
        # Times since the start of the slot before; a group's times lie apart from those of all others.
        since = frame["us"].to_numpy() - (frame["slot"].to_numpy() - 1) * self.span
        place = (np.cumsum(_starts(frame, self.GROUP)) - 1) * (2 * self.span) + since
        own = frame["new"].to_numpy(bool) & (since >= self.span)
        recent = np.searchsorted(place, place[own], "right") - np.searchsorted(place, place[own] - self.span, "left")
        found = frame[own].assign(recent=recent)
        found = found[found["recent"] > self.limit]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.held.keep(frame[((frame["slot"] + 1) * self.span > passed) & (frame["us"] >= passed - self.span)])
        if len(found):
            yield found[["entry", "unnamed", "employee", "nobody", "us", "recent"]]

    def close(self) -> None:
        pass


def bursts(
    audit: DataFrame, minutes: int = rules.BURST_MINUTES, limit: int = rules.BURST_ACTIONS, late: str = "1 hour"
) -> DataFrame:
    """Entries that make more than `limit` actions of an employee within the trailing minutes, once the watermark has passed them."""
    span = minutes * 60_000_000
    rows = _numbers(released(audit, "employee_id", TS, ["audit_id"], late))
    slots = F.array(*[F.floor(F.col("us") / span).cast("bigint") + k for k in (0, 1)])
    dealt = rows.withColumn("slot", F.explode(slots)).withColumn("bucket", _bucket("employee", "slot"))
    told = dealt.groupBy("bucket").transformWithStateInPandas(
        _Bursts(span, limit), "entry BIGINT, unnamed BIGINT, employee BIGINT, nobody BIGINT, us BIGINT, recent BIGINT", "append",
        "eventtime",
    )
    return _told(told, "recent")


class _Sequences(StatefulProcessor):
    """The last actions of employees, as their places among the actions of the pattern (0: none of them)."""

    WHO = ["employee", "nobody"]

    def __init__(self, pattern: list[int]):
        self.pattern = pattern

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = _Held(handle, [*self.WHO, "us", "unnamed", "entry", "code"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Held rows are behind all new ones.
        frame = self.held.with_new(rows).sort_values([*self.WHO, "us", "unnamed", "entry", "code"], ignore_index=True)
        first = _starts(frame, self.WHO)
        at, size = np.arange(len(frame)), len(self.pattern)
        start = np.maximum.accumulate(np.where(first, at, 0))
        code = frame["code"].to_numpy()
        hit = frame["new"].to_numpy(bool) & (at - start >= size - 1)
        for back, wanted in enumerate(reversed(self.pattern)):
            hit &= np.roll(code, back) == wanted
        sizes = np.bincount(np.cumsum(first) - 1)
        after = start + np.repeat(sizes, sizes) - 1 - at
        self.held.keep(frame[after < size - 1])
        if hit.any():
            yield frame[hit][["entry", "unnamed", "employee", "nobody", "us"]]

    def close(self) -> None:
        pass


def sequences(audit: DataFrame, pattern: tuple[str, ...] = ("INSERT", "UPDATE", "DELETE"), late: str = "1 hour") -> DataFrame:
    """Entries that complete the pattern, a run of consecutive actions of an employee of any length."""
    codes = {action: k for k, action in enumerate(sorted(set(pattern)), 1)}
    code = F.lit(0)
    for action, k in codes.items():
        code = F.when(F.col("action_type") == action, k).otherwise(code)
    rows = _numbers(released(audit, "employee_id", TS, ["audit_id", "action_type"], late))
    told = rows.withColumn("code", code.cast("bigint")).withColumn("bucket", _bucket("employee")).groupBy(
        "bucket").transformWithStateInPandas(
        _Sequences([codes[a] for a in pattern]), "entry BIGINT, unnamed BIGINT, employee BIGINT, nobody BIGINT, us BIGINT", "append",
        "eventtime",
    )
    return _told(told)


def released_requests(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """request_id, order_id, request_ts, new_status of requests that no earlier one can precede any more."""
    told = released(requests, "order_id", "request_ts", ["request_id", "new_status"], late)
    return told.select("request_id", "order_id", F.col("request_ts").cast("timestamp_ntz").alias("request_ts"), "new_status")


def life_cycle(statuses: KeyedTable, initial: str = "PENDING"):
    """A batch handler that decides released requests and keeps the orders' statuses in a keyed table.

    All orders of a batch are decided together in as many rounds as a status path is long, each round one grouping
    that combines before its shuffle. The table is changed under the name of the batch, so a repeated batch finds
    the statuses it started from.

    Spark takes the files that came with a micro-batch for its size, but the rows that it releases came with earlier
    ones: it would send all of them to the driver to broadcast them when the last file is small. So no side is broadcast.
    """
    apart = "merge"

    def make(target: str):
        def handle(batch: DataFrame, batch_id: int) -> None:
            if batch_id and batch.isEmpty():
                return
            asked = cut_lineage(batch.select("request_id", "order_id", "new_status", F.struct("request_ts", "request_id").alias("at")))
            known = statuses.before(f"batch-{batch_id}").select(F.col("order_id").alias("of"), "status").hint(apart)
            state = asked.select("order_id").distinct().join(known, F.col("order_id") == F.col("of"), "left")
            state = state.select("order_id", F.coalesce("status", F.lit(initial)).alias("s0"))
            state = cut_lineage(status_rounds(asked, state, hint=apart))
            old, accepted, now = status_outcome()
            asked.join(state.hint(apart), "order_id").select(
                "request_id", "order_id", F.col("at.request_ts").alias("request_ts"), old.alias("old_status"), "new_status",
                accepted.alias("accepted"),
            ).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
            moved = state.filter(F.col("p1").isNotNull()).select("order_id", now.alias("status"))
            statuses.change(moved, replace={"status": "status"}, insert=True, name=f"batch-{batch_id}")

        return handle

    return make


LIFE_CYCLE_ROWS = (
    "request_id bigint, order_id bigint, request_ts timestamp_ntz, old_status string, new_status string, accepted boolean"
)
