"""Monitors of the audit stream with event-time windows.

A watermark needs a timestamp with a zone. The session zone is UTC, so the casts there and back
keep every value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import rules

TS = "action_timestamp"


def timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _plain(rows: DataFrame) -> DataFrame:
    """Zone-free timestamps again."""
    return rows.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
        for f in rows.schema
    ])


def hourly_volume(audit: DataFrame, late: str = "1 hour") -> DataFrame:
    return _plain(
        timed(audit, TS, late)
        .groupBy(F.window(TS, "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("audit_count"))
        .select(F.col("w.start").alias("audit_hour"), "audit_count")
    )


def bucket_activity(audit: DataFrame, width: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Actions of a user in fixed buckets of the day."""
    return _plain(
        timed(audit, TS, late)
        .groupBy("session_user", F.window(TS, width).alias("w"))
        .agg(F.min(TS).alias("session_start"), F.max(TS).alias("session_end"),
             F.count(F.lit(1)).alias("actions_per_session"))
        .select("session_user", F.col("w.start").alias("bucket_start"), "session_start", "session_end",
                "actions_per_session")
    )


def gap_sessions(audit: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after a pause."""
    return _plain(
        timed(audit, TS, late)
        .groupBy("session_user", F.session_window(TS, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("actions"))
        .select("session_user", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "actions")
    )


#: Slides of a window that are kept as counters of one state row.
MOST_SLIDES = 48


def busy_employees(
    audit: DataFrame, threshold: int = rules.HOURLY_ACTIONS, width: str = "1 hour", slide: str = "5 minutes",
    late: str = "1 hour",
) -> DataFrame:
    """Employees above the hourly threshold in any sliding window.

    A row lies in width / slide windows. Those that start within one width share a state row with a counter per slide, so
    a row meets two state rows and not one per window; the windows are sums of neighbouring counters. In update mode all
    windows of a changed state row are told, and a late row counts as long as the state row is there.
    """
    long, short = (pd.Timedelta(x) // pd.Timedelta(microseconds=1) for x in (width, slide))
    slides = long // short
    rows = timed(audit, TS, late)
    if long % short or slides > MOST_SLIDES:
        counted = rows.groupBy("employee_id", F.window(TS, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("actions"))
        told = counted.select("employee_id", F.col("w.start").alias("window_start"), "actions")
        return _plain(told.filter(F.col("actions") > threshold))
    rows = rows.select("employee_id", TS, F.window(TS, f"{2 * long} microseconds", f"{long} microseconds").alias("w"))
    slot = F.floor((F.unix_micros(TS) - F.unix_micros("w.start")) / short)
    counters = [f"c{k}" for k in range(2 * slides - 1)]
    counted = rows.withColumn("slot", slot).groupBy("employee_id", "w").agg(
        *[F.count_if(F.col("slot") == k).alias(c) for k, c in enumerate(counters)])
    begin = F.unix_micros("w.start")
    windows = F.array(*[
        F.struct(F.timestamp_micros(begin + k * short).alias("window_start"),
                 sum((F.col(c) for c in counters[k + 1:k + slides]), F.col(counters[k])).alias("actions"))
        for k in range(slides)
    ])
    return _plain(
        counted.select("employee_id", F.explode(F.filter(windows, lambda x: x["actions"] > threshold)).alias("x"))
        .select("employee_id", "x.*")
    )


def first_transactions(payments: DataFrame, ts: str = "payment_date", late: str = "1 day") -> DataFrame:
    """Payments without repeats of a transaction id within the watermark."""
    return _plain(timed(payments, ts, late).dropDuplicatesWithinWatermark(["transaction_id"]))
