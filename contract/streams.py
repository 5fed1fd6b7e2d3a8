"""Streams run over the files that are there, compared with the same result asked in SQL."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from contract.audit import decided_sql, rule_audit_sql
from contract.base import query
from ledgertide.functions.compat import micros
from ledgertide.sources.keyed import KeyedTable
from ledgertide.sources.model import Model
from ledgertide.streaming import enforcement, feeds, monitors, stateful


class StreamModel(Model):
    """The same model over streams of the raw tables."""

    def raw(self, name):
        return feeds.table_stream(self.spark, self.folder, name)


def live(m):
    return StreamModel(m.spark, m.folder)


@query("stream_hourly_volume", """
SELECT date_trunc('hour', action_timestamp)::TIMESTAMP AS audit_hour, count(*) AS audit_count FROM m_audit GROUP BY 1""")
def _(m):
    rows, _q = feeds.drain(monitors.hourly_volume(live(m).audit()), "hourly", mode="update")
    return feeds.newest_per_key(rows, ["audit_hour"])


@query("stream_bucket_activity", """
SELECT session_user, time_bucket(INTERVAL 4 HOUR, action_timestamp, TIMESTAMP '2000-01-01') AS bucket_start,
       min(action_timestamp) AS session_start, max(action_timestamp) AS session_end, count(*) AS actions_per_session
FROM m_audit GROUP BY 1, 2""")
def _(m):
    rows, _q = feeds.drain(monitors.bucket_activity(live(m).audit()), "buckets", mode="update")
    return feeds.newest_per_key(rows, ["session_user", "bucket_start"])


@query("stream_busy_employees", """
WITH s AS (SELECT employee_id, unnest(generate_series(0, 11)) AS k,
                  time_bucket(INTERVAL 5 MINUTE, action_timestamp, TIMESTAMP '2000-01-01') AS slot FROM m_audit)
SELECT employee_id, slot - to_minutes(CAST(5 * k AS INTEGER)) AS window_start, count(*) AS actions
FROM s GROUP BY 1, 2 HAVING count(*) > 2""")
def _(m):
    rows, _q = feeds.drain(monitors.busy_employees(live(m).audit(), threshold=2), "busy", mode="update")
    return feeds.newest_per_key(rows, ["employee_id", "window_start"])


class WaveModel(Model):
    """The model over events that arrive out of order, in many files.

    Events come in `waves` files by time, those whose id is a multiple of `every` by `delay` waves later. A last file
    with one row far ahead, of no employee, closes the stream.
    """

    def __init__(self, m, waves=8, every=5, delay=1, close=True):
        super().__init__(m.spark, m.folder)
        stored = m.raw("events")
        ends = stored.agg(F.min(micros("ts")).alias("low"), F.max(micros("ts")).alias("high"), F.max("ts").alias("last"))
        low, high, last = ends.first()
        width = ((high or 0) - (low or 0)) // waves + 1
        wave = F.floor((micros("ts") - (low or 0)) / width) + F.when(F.col("event_id") % every == 0, delay).otherwise(0)
        self.folder_of_waves = feeds.work_folder(m.spark, "waves")
        closing = {"ts": last + dt.timedelta(days=1000)} if close and last else None
        feeds.in_waves(stored, wave, self.folder_of_waves, closing)
        self.stored = stored

    def raw(self, name):
        return feeds.wave_stream(self.stored, self.folder_of_waves)


#: More than any row of a WaveModel with its defaults is late.
WAVE_LATE = "10 days"


@query("stream_bursts", """
SELECT audit_id, employee_id, action_timestamp, n AS recent FROM (
  SELECT *, count(*) OVER (PARTITION BY employee_id ORDER BY action_timestamp
         RANGE BETWEEN INTERVAL 720 MINUTE PRECEDING AND CURRENT ROW) AS n FROM m_audit) WHERE n > 3""")
def _(m):
    found = stateful.bursts(WaveModel(m).audit(), minutes=720, limit=3, late=WAVE_LATE)
    return feeds.drain(found, "bursts")[0].drop("batch_id")


@query("stream_sequences", """
SELECT audit_id, employee_id, action_timestamp FROM (
  SELECT *, lag(action_type, 2) OVER w || lag(action_type) OVER w || action_type AS path FROM m_audit
  WINDOW w AS (PARTITION BY employee_id ORDER BY action_timestamp, audit_id)) WHERE path = 'INSERTUPDATEDELETE'""")
def _(m):
    found = stateful.sequences(WaveModel(m).audit(), late=WAVE_LATE)
    return feeds.drain(found, "sequences")[0].drop("batch_id")


@query("stream_sequences_of_four", """
SELECT audit_id, employee_id, action_timestamp FROM (
  SELECT *, lag(action_type, 3) OVER w || lag(action_type, 2) OVER w || lag(action_type) OVER w || action_type AS path
  FROM m_audit WINDOW w AS (PARTITION BY employee_id ORDER BY action_timestamp, audit_id))
WHERE path = 'UPDATEINSERTUPDATEUPDATE'""")
def _(m):
    found = stateful.sequences(WaveModel(m).audit(), ("UPDATE", "INSERT", "UPDATE", "UPDATE"), late=WAVE_LATE)
    return feeds.drain(found, "sequences")[0].drop("batch_id")


@query("stream_order_life_cycle", """
WITH RECURSIVE req AS (SELECT event_id AS request_id, user_id AS order_id, ts AS request_ts,
    CASE event_type WHEN 'signup' THEN 'PROCESSING' WHEN 'view' THEN 'SHIPPED' WHEN 'click' THEN 'DELIVERED'
         WHEN 'purchase' THEN 'RETURNED' ELSE 'CANCELLED' END AS new_status,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT order_id, 0::BIGINT AS n, 'PENDING' AS old_status, 'PENDING' AS now FROM (SELECT DISTINCT order_id FROM req)
  UNION ALL SELECT w.order_id, r.n, w.now, CASE WHEN (w.now || '>' || r.new_status) IN ('PENDING>PROCESSING',
    'PENDING>CANCELLED', 'PROCESSING>SHIPPED', 'PROCESSING>CANCELLED', 'SHIPPED>DELIVERED', 'SHIPPED>RETURNED',
    'DELIVERED>RETURNED') THEN r.new_status ELSE w.now END
  FROM walk w JOIN req r ON r.order_id = w.order_id AND r.n = w.n + 1)
SELECT request_id, order_id, request_ts, w.old_status, new_status, w.old_status <> w.now AS accepted
FROM walk w JOIN req r USING (order_id, n)""")
def _(m):
    wish = (F.when(F.col("event_type") == "signup", "PROCESSING").when(F.col("event_type") == "view", "SHIPPED")
            .when(F.col("event_type") == "click", "DELIVERED").when(F.col("event_type") == "purchase", "RETURNED")
            .otherwise("CANCELLED"))
    requests = WaveModel(m, waves=4).raw("events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("order_id"), F.col("ts").alias("request_ts"),
        wish.alias("new_status"))
    statuses = KeyedTable(m.spark, feeds.work_folder(m.spark, "statuses"), "order_id")
    statuses.create(m.spark.createDataFrame([], "order_id BIGINT, status STRING"))
    rows, _q = feeds.drain(stateful.released_requests(requests, late=WAVE_LATE), "life-cycle", make=stateful.life_cycle(statuses),
                           schema=StructType.fromDDL(stateful.LIFE_CYCLE_ROWS))
    return rows.drop("batch_id")


@query("stream_late_rows", """
WITH b AS (SELECT min(epoch_us(ts)) AS low, (max(epoch_us(ts)) - min(epoch_us(ts))) // 105 + 1 AS width FROM events),
w AS (SELECT event_id, user_id, ts, (epoch_us(ts) - low) // width + CASE WHEN event_id % 11 = 0 THEN 6 ELSE 0 END AS wave
      FROM events, b),
t AS (SELECT wave, max(ts) AS latest FROM w GROUP BY wave),
k AS (SELECT wave, max(latest) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark
      FROM t)
SELECT event_id, user_id, ts FROM w JOIN k USING (wave) WHERE ts <= mark""")
def _(m):
    # More micro-batches than Spark keeps progress reports of.
    arriving = WaveModel(m, waves=105, every=11, delay=6, close=False).raw("events")
    rows, _q = feeds.drain(arriving, "late", make=feeds.split_late("ts", "1 day"),
                           schema=StructType([*arriving.schema.fields, StructField("late", IntegerType())]))
    return rows.filter("late = 1").select("event_id", "user_id", "ts")


def live_changes(m):
    return live(m).audit().filter(F.col("action_type") != "SELECT").select(
        F.col("audit_id").alias("change_id"), F.col("action_timestamp").alias("change_ts"),
        F.col("session_user").alias("user_name"), "employee_id", F.lit("ORDERS").alias("table_name"),
        F.col("action_type").alias("operation"), F.col("audit_id").alias("order_id"),
        F.col("employee_id").alias("customer_id"))


def enforced(m, part):
    """One output of the rules over the changes as a stream."""
    target = feeds.work_folder(m.spark, "enforced")
    handler = enforcement.enforce(m.holidays(), target, orders=m.orders())
    query_ = feeds.start(live_changes(m), handler, f"{target}/checkpoint", once=True)
    query_.awaitTermination()
    return m.spark.read.parquet(f"{target}/{part}").drop("batch_id")


@query("stream_rule_violations", f"""
WITH {decided_sql('weekdays')}
SELECT change_id, 'WEEKDAY_HOLIDAY_RESTRICTION' AS rule_name, user_name, table_name, operation AS operation_type,
       CASE WHEN operation = 'INSERT' THEN 'Emp_ID: ' || employee_id || ', Cust_ID: ' || customer_id
            ELSE 'Order: ' || order_id || ', Emp: ' || employee_id END AS attempted_values, error_message
FROM decided WHERE error_message IS NOT NULL""")
def _(m):
    return enforced(m, "violations")


@query("stream_rule_allowed", f"""
WITH {decided_sql('weekdays')} SELECT * EXCLUDE (error_message) FROM decided WHERE error_message IS NULL""")
def _(m):
    return enforced(m, "allowed")


@query("stream_rule_audit", rule_audit_sql())
def _(m):
    return enforced(m, "audit")


@query("stream_batch_counts", f"""
WITH {decided_sql('weekdays')}
SELECT count(*) FILTER (operation = 'INSERT') AS inserts, count(*) FILTER (operation = 'UPDATE') AS updates,
       count(*) FILTER (operation = 'DELETE') AS deletes FROM decided""")
def _(m):
    target = feeds.work_folder(m.spark, "counted")
    query_ = feeds.start(live_changes(m), enforcement.count_batches(f"{target}/rows"), f"{target}/checkpoint", once=True)
    query_.awaitTermination()
    logged = m.spark.read.parquet(f"{target}/rows")
    return logged.agg(*[F.sum(c).alias(c) for c in ("inserts", "updates", "deletes")])


@query("stream_first_transactions", """
SELECT DISTINCT 'TX' || o_custkey AS transaction_id FROM orders""")
def _(m):
    # Payments that reuse one transaction id per customer: only the first of each may pass.
    paid = live(m).raw("orders").select(
        F.concat(F.lit("TX"), F.col("o_custkey").cast("string")).alias("transaction_id"),
        F.col("o_orderdate").alias("payment_date"))
    rows, _q = feeds.drain(monitors.first_transactions(paid), "first-tx")
    return rows.select("transaction_id")


SESSIONS = """
WITH f AS (SELECT session_user, action_timestamp AS t, CASE WHEN action_timestamp >=
    lag(action_timestamp) OVER (PARTITION BY session_user ORDER BY action_timestamp) + INTERVAL 30 MINUTE
    OR lag(action_timestamp) OVER (PARTITION BY session_user ORDER BY action_timestamp) IS NULL THEN 1 ELSE 0 END AS fresh
  FROM m_audit),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_user ORDER BY t) AS s FROM f)
SELECT session_user, min(t) AS session_start, max(t) + INTERVAL 30 MINUTE AS session_end, count(*) AS actions
FROM g GROUP BY session_user, s"""


@query("gap_sessions", SESSIONS)
def _(m):
    return monitors.gap_sessions(m.audit())


@query("stream_gap_sessions", f"""
SELECT * FROM ({SESSIONS})
WHERE session_end <= (SELECT max(action_timestamp) - INTERVAL 1 HOUR FROM m_audit)""")
def _(m):
    # A session is given out once the watermark has passed its end.
    rows, _q = feeds.drain(monitors.gap_sessions(live(m).audit()), "sessions")
    return rows.drop("batch_id")
