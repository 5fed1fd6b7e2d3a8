"""Audit and compliance queries."""

import datetime as dt

from pyspark.sql import functions as F

from contract.base import query, rdiv
from ledgertide.plans import audit as a
from ledgertide.sources.model import AS_OF_EVENTS as NOW

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
WHEN = STAMP.format("action_timestamp")
SHARE = "count(*) FILTER (status = '{}')"


@query("audit_trail", f"""
SELECT audit_id, employee_id, action_type, table_name, record_id, day_of_week, is_holiday, is_weekday, status,
       error_message, session_user, {WHEN} AS timestamp, ip_address FROM m_audit""")
def _(m):
    return a.audit_trail(m.audit())


@query("recent_entries", f"""
SELECT audit_id, employee_id, action_type, table_name, status, error_message, {WHEN} AS timestamp, session_user
FROM m_audit WHERE action_timestamp >= TIMESTAMP '2024-01-30'""")
def _(m):
    return a.recent_entries(m.audit(), NOW)


@query("employee_trail", f"""
SELECT audit_id, action_type, table_name, record_id, day_of_week, status, error_message, {WHEN} AS timestamp,
       session_user, ip_address FROM m_audit WHERE employee_id = 7""")
def _(m):
    return a.employee_trail(m.audit(), 7)


@query("latest_changes", f"""
SELECT audit_id, action_type, record_id, session_user, {WHEN} AS change_time FROM m_audit
WHERE table_name = 'ORDERS' ORDER BY audit_id DESC LIMIT 5""")
def _(m):
    return a.latest_changes(m.audit(), "ORDERS")


VIOLATION = """SELECT a.audit_id, a.employee_id, e.employee_name, a.action_type, a.table_name, a.record_id, a.day_of_week"""


@query("violations", f"""
{VIOLATION}, a.is_holiday, a.is_weekday, a.status, a.error_message, {WHEN} AS violation_time, a.session_user
FROM m_audit a LEFT JOIN m_employees e USING (employee_id) WHERE a.status = 'DENIED'""")
def _(m):
    return a.violations(m.audit(), m.employees())


@query("holiday_violations", f"""
SELECT a.audit_id, a.employee_id, e.employee_name, a.action_type, a.table_name, h.holiday_name,
       strftime(h.holiday_date, '%Y-%m-%d') AS holiday_date, a.error_message, {WHEN} AS violation_time
FROM m_audit a JOIN m_holidays h ON date_trunc('day', a.action_timestamp) = h.holiday_date
     LEFT JOIN m_employees e USING (employee_id) WHERE a.status = 'DENIED' AND a.is_holiday = 'Y'""")
def _(m):
    return a.holiday_violations(m.audit(), m.employees(), m.holidays())


@query("weekday_violations", f"""
{VIOLATION}, a.error_message, {WHEN} AS violation_time, a.session_user
FROM m_audit a LEFT JOIN m_employees e USING (employee_id)
WHERE a.status = 'DENIED' AND a.is_weekday = 'Y' AND a.is_holiday = 'N'""")
def _(m):
    return a.weekday_violations(m.audit(), m.employees())


@query("authorization_failures", f"""
SELECT audit_id, employee_id, action_type, table_name, status, error_message, session_user, ip_address,
       {WHEN} AS attempt_time FROM m_audit
WHERE (status IN ('DENIED', 'ERROR') AND contains(error_message, 'not authorized'))
   OR contains(error_message, 'permission') OR contains(error_message, 'access denied')""")
def _(m):
    return a.authorization_failures(m.audit())


@query("user_activity", f"""
SELECT session_user, count(*) AS total_actions, min(action_timestamp) AS first_action,
       max(action_timestamp) AS last_action, {SHARE.format("ALLOWED")} AS allowed_actions,
       {SHARE.format("DENIED")} AS denied_actions, {SHARE.format("ERROR")} AS error_actions,
       {rdiv("epoch_us(max(action_timestamp)) - epoch_us(min(action_timestamp))", "60000000", 2)}
           AS session_duration_minutes
FROM m_audit GROUP BY session_user""")
def _(m):
    return a.user_activity(m.audit())


@query("unusual_activity", f"""
SELECT employee_id, CAST(count(*) AS BIGINT) AS actions_last_hour, {STAMP.format("max(action_timestamp)")} AS last_action,
       string_agg(action_type, ', ' ORDER BY action_timestamp, audit_id) AS action_sequence
FROM m_audit WHERE action_timestamp >= TIMESTAMP '2024-01-24' GROUP BY employee_id HAVING count(*) > 5""")
def _(m):
    return a.unusual_activity(m.audit(), NOW, span=dt.timedelta(days=7))


@query("unusual_activity_last_hour", f"""
SELECT employee_id, CAST(count(*) AS BIGINT) AS actions_last_hour, {STAMP.format("max(action_timestamp)")} AS last_action,
       string_agg(action_type, ', ' ORDER BY action_timestamp, audit_id) AS action_sequence
FROM m_audit WHERE action_timestamp >= TIMESTAMP '2024-01-30 23:00:00' GROUP BY employee_id HAVING count(*) > 5""")
def _(m):
    return a.unusual_activity(m.audit(), NOW)


@query("activity_parts", """
WITH r AS (SELECT *, count(*) OVER (PARTITION BY employee_id) AS n FROM m_audit WHERE action_timestamp >= TIMESTAMP '2024-01-24'),
p AS (SELECT *, coalesce(sum(length(action_type) + 2) OVER (PARTITION BY employee_id ORDER BY action_timestamp, audit_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM r WHERE n > 5)
SELECT employee_id, CAST(begins // 40 + 1 AS BIGINT) AS part, count(*) AS actions,
       string_agg(CASE WHEN begins > 0 THEN ', ' ELSE '' END || action_type, '' ORDER BY action_timestamp, audit_id) AS action_sequence
FROM p GROUP BY 1, 2""")
def _(m):
    return a.activity_parts(m.audit(), NOW, span=dt.timedelta(days=7), part_chars=40)


@query("action_runs", """
WITH b AS (SELECT *, coalesce(action_type <> lag(action_type) OVER w, TRUE) AS begins FROM m_audit
           WINDOW w AS (PARTITION BY employee_id ORDER BY action_timestamp, audit_id)),
r AS (SELECT *, sum(begins::BIGINT) OVER (PARTITION BY employee_id ORDER BY action_timestamp, audit_id) AS run FROM b)
SELECT employee_id, run::BIGINT AS run, any_value(action_type) AS action_type, count(*) AS actions,
       min(action_timestamp) AS first_action, max(action_timestamp) AS last_action FROM r GROUP BY employee_id, run""")
def _(m):
    return a.action_runs(m.audit())


@query("daily_summary", f"""
SELECT date_trunc('day', action_timestamp)::TIMESTAMP AS audit_date, min(dayname(action_timestamp)) AS day_name,
       count(*) AS total_entries, {SHARE.format("ALLOWED")} AS allowed, {SHARE.format("DENIED")} AS denied,
       {SHARE.format("ERROR")} AS errors, count(DISTINCT employee_id) AS unique_employees,
       count(DISTINCT session_user) AS unique_users, {rdiv(SHARE.format("DENIED"), "count(*)", 2, 100)} AS denial_rate
FROM m_audit GROUP BY 1""")
def _(m):
    return a.daily_summary(m.audit())


@query("monthly_compliance", f"""
SELECT strftime(action_timestamp, '%Y-%m') AS month, count(*) AS total_audits, {SHARE.format("ALLOWED")} AS compliant,
       {SHARE.format("DENIED")} AS non_compliant, {SHARE.format("ERROR")} AS system_errors,
       {rdiv(SHARE.format("ALLOWED"), "count(*)", 2, 100)} AS compliance_percentage,
       count(DISTINCT employee_id) AS employees_monitored, count(DISTINCT table_name) AS tables_monitored
FROM m_audit GROUP BY 1""")
def _(m):
    return a.monthly_compliance(m.audit())


@query("orphan_entries", f"""
SELECT audit_id, employee_id, action_type, table_name, status, {WHEN} AS timestamp FROM m_audit
WHERE employee_id NOT IN (SELECT employee_id FROM m_employees)""")
def _(m):
    return a.orphan_entries(m.audit(), m.employees())


@query("audit_gaps", """
WITH days AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('day', min(action_timestamp))::TIMESTAMP FROM m_audit),
                     TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS TIMESTAMP) AS audit_date)
SELECT audit_date, dayname(audit_date) AS day_name, 0::BIGINT AS audit_count FROM days
WHERE audit_date NOT IN (SELECT date_trunc('day', action_timestamp)::TIMESTAMP FROM m_audit)""")
def _(m):
    return a.audit_gaps(m.audit(), "2024-02-05")


@query("archive_summary", """
SELECT count(*) AS records_to_archive, min(action_timestamp) AS oldest_record, max(action_timestamp) AS newest_record,
       strftime(min(action_timestamp), '%Y-%m-%d') AS archive_from_date
FROM m_audit WHERE action_timestamp < TIMESTAMP '2024-01-11'""")
def _(m):
    return a.archive_summary(m.audit(), "2024-04-10")


@query("archive_listing", f"""
SELECT audit_id, employee_id, action_type, table_name, record_id, status, error_message, session_user,
       {WHEN} AS original_timestamp FROM m_audit WHERE action_timestamp < TIMESTAMP '2024-01-11'""")
def _(m):
    return a.archive_listing(m.audit(), "2024-04-10")


@query("employee_action_sequence", """
SELECT e.employee_id, e.employee_name, t.action_id, t.action_date, t.action_type,
       row_number() OVER (PARTITION BY e.employee_id ORDER BY action_date DESC, action_id DESC) AS action_sequence,
       lag(action_type) OVER w AS previous_action, lead(action_type) OVER w AS next_action
FROM m_employees e JOIN m_actions t USING (employee_id)
WINDOW w AS (PARTITION BY e.employee_id ORDER BY action_date, action_id)""")
def _(m):
    return a.employee_action_sequence(m.employees(), m.actions())


PER_EMPLOYEE = """counted AS (SELECT e.employee_id, e.employee_name, e.department, count(audit_id) AS n
    FROM m_employees e LEFT JOIN m_audit USING (employee_id) GROUP BY 1, 2, 3)"""


@query("employee_activity_rank", f"""
WITH {PER_EMPLOYEE}, shares AS (SELECT *, sum(n) OVER (PARTITION BY department) AS dept FROM counted)
SELECT department, employee_id, employee_name, n AS total_actions,
       rank() OVER (PARTITION BY department ORDER BY n DESC) AS activity_rank_dept,
       dense_rank() OVER (ORDER BY n DESC) AS activity_rank_overall,
       {rdiv("n", "dept", 2, 100)} AS percentage_of_dept_activity FROM shares""")
def _(m):
    return a.employee_activity_rank(m.employees(), m.audit())


@query("daily_activity_change", f"""
WITH d AS (SELECT date_trunc('day', action_timestamp)::TIMESTAMP AS audit_date, count(*) AS n FROM m_audit GROUP BY 1),
l AS (SELECT *, lag(n) OVER (ORDER BY audit_date) AS p,
             avg(n) OVER (ORDER BY audit_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS seven_day_moving_avg FROM d)
SELECT audit_date, n AS daily_attempts, p AS previous_day_attempts, n - p AS day_over_day_change,
       {rdiv("n - p", "p", 2, 100)} AS percentage_change, seven_day_moving_avg FROM l""")
def _(m):
    return a.daily_activity_change(m.audit())


@query("activity_quartiles", f"""
WITH {PER_EMPLOYEE}, q AS (SELECT *, ntile(4) OVER (ORDER BY n DESC, employee_id) AS t FROM counted)
SELECT employee_id, employee_name, department, n AS action_count, t AS activity_quartile,
       ['High Activity', 'Medium-High Activity', 'Medium-Low Activity', 'Low Activity'][t] AS activity_category FROM q""")
def _(m):
    return a.activity_quartiles(m.employees(), m.audit())


@query("first_last_audit", """
SELECT e.employee_id, e.employee_name, first_value(a.action_timestamp) OVER w AS first_audit_time,
       last_value(a.action_timestamp) OVER w AS last_audit_time, first_value(a.status) OVER w AS first_audit_status,
       last_value(a.status) OVER w AS last_audit_status
FROM m_employees e LEFT JOIN m_audit a USING (employee_id)
WINDOW w AS (PARTITION BY e.employee_id ORDER BY a.action_timestamp, a.audit_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(m):
    return a.first_last_audit(m.employees(), m.audit())


@query("suspicious_patterns", """
WITH w AS (SELECT audit_id, employee_id, action_timestamp, action_type, table_name, status,
  lag(action_type, 1) OVER t AS prev_action_1, lag(action_type, 2) OVER t AS prev_action_2,
  lead(action_type, 1) OVER t AS next_action_1,
  count(*) OVER (PARTITION BY employee_id ORDER BY action_timestamp
                 RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) AS burst
  FROM m_audit WINDOW t AS (PARTITION BY employee_id ORDER BY action_timestamp, audit_id))
SELECT * EXCLUDE (burst), CASE WHEN prev_action_2 || '>' || prev_action_1 || '>' || action_type = 'INSERT>UPDATE>DELETE'
       THEN 'SUSPICIOUS_PATTERN' WHEN burst > 10 THEN 'HIGH_FREQUENCY' ELSE 'NORMAL' END AS activity_pattern FROM w""")
def _(m):
    return a.suspicious_patterns(m.audit())


@query("burst_patterns_wide", """
WITH w AS (SELECT audit_id, employee_id, action_timestamp, action_type, table_name, status,
  lag(action_type, 1) OVER t AS prev_action_1, lag(action_type, 2) OVER t AS prev_action_2,
  lead(action_type, 1) OVER t AS next_action_1,
  count(*) OVER (PARTITION BY employee_id ORDER BY action_timestamp
                 RANGE BETWEEN INTERVAL 720 MINUTE PRECEDING AND CURRENT ROW) AS burst
  FROM m_audit WINDOW t AS (PARTITION BY employee_id ORDER BY action_timestamp, audit_id))
SELECT * EXCLUDE (burst), CASE WHEN prev_action_2 || '>' || prev_action_1 || '>' || action_type = 'INSERT>UPDATE>DELETE'
       THEN 'SUSPICIOUS_PATTERN' WHEN burst > 2 THEN 'HIGH_FREQUENCY' ELSE 'NORMAL' END AS activity_pattern FROM w""")
def _(m):
    return a.suspicious_patterns(m.audit(), minutes=720, burst=2)


@query("volume_alerts", f"""
WITH h AS (SELECT date_trunc('hour', action_timestamp)::TIMESTAMP AS audit_hour, count(*) AS n FROM m_audit
           WHERE action_timestamp >= TIMESTAMP '2024-01-24' GROUP BY 1),
l AS (SELECT *, lag(n) OVER (ORDER BY audit_hour) AS p,
             avg(n) OVER (ORDER BY audit_hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mean FROM h)
SELECT audit_hour, n AS audit_count, p AS previous_hour_count, {rdiv("n - p", "p", 2, 100)} AS hour_over_hour_change_percent,
       mean AS twentyfour_hour_moving_avg, CASE WHEN n > 2 * mean THEN 'VOLUME_SPIKE_ALERT' ELSE 'NORMAL' END AS volume_alert
FROM l""")
def _(m):
    return a.volume_alerts(m.audit(), NOW)


@query("compliance_trend", f"""
WITH w AS (SELECT employee_id, date_trunc('week', action_timestamp)::TIMESTAMP AS audit_week,
       (20000 * {SHARE.format("ALLOWED")} + count(*)) // (2 * count(*)) AS r
  FROM m_audit WHERE employee_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, sum(r) OVER x AS s, count(*) OVER x AS n FROM w
      WINDOW x AS (PARTITION BY employee_id ORDER BY audit_week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT employee_id, audit_week, r / 100.0::DOUBLE AS compliance_rate, {rdiv("s", "n * 100", 2)} AS four_week_moving_avg,
       {rdiv("r * n - s", "n * 100", 2)} AS deviation_from_trend,
       CASE WHEN 10 * r * n < 8 * s THEN 'PERFORMANCE_DECLINE' WHEN 10 * r * n > 12 * s THEN 'PERFORMANCE_IMPROVEMENT'
            ELSE 'STABLE' END AS performance_trend FROM f""")
def _(m):
    return a.compliance_trend(m.audit())


@query("session_analysis", f"""
WITH g AS (SELECT session_user, date_trunc('day', action_timestamp)::TIMESTAMP AS audit_date,
       hour(action_timestamp) // 4 AS bucket, min(action_timestamp) AS session_start, max(action_timestamp) AS session_end,
       (epoch_us(max(action_timestamp)) - epoch_us(min(action_timestamp))) // 60000000 AS session_duration_minutes,
       count(*) AS actions_per_session FROM m_audit GROUP BY 1, 2, 3)
SELECT session_user, audit_date, session_start, session_end, session_duration_minutes, actions_per_session,
       row_number() OVER (PARTITION BY session_user ORDER BY session_duration_minutes DESC, session_start)
           AS session_length_rank,
       rank() OVER (PARTITION BY audit_date ORDER BY actions_per_session DESC) AS daily_activity_rank,
       {rdiv("sum(session_duration_minutes) OVER u", "count(*) OVER u", 6)} AS avg_session_length,
       {rdiv("sum(actions_per_session) OVER u", "count(*) OVER u", 6)} AS avg_actions_per_session
FROM g WINDOW u AS (PARTITION BY session_user)""")
def _(m):
    return a.session_analysis(m.audit())


def order_changes(m):
    """Audit entries that write, seen as order changes waiting for a decision."""
    return m.audit().filter(F.col("action_type") != "SELECT").select(
        F.col("audit_id").alias("change_id"), F.col("action_timestamp").alias("change_ts"),
        F.col("session_user").alias("user_name"), "employee_id", F.lit("ORDERS").alias("table_name"),
        F.col("action_type").alias("operation"), F.col("audit_id").alias("order_id"),
        F.col("employee_id").alias("customer_id"))


def decided_sql(days: str, restricted: str = "TRUE") -> str:
    test = "isodow(ts) <= 5" if days == "weekdays" else "isodow(ts) > 5"
    return f"""
decided AS (SELECT event_id AS change_id, ts AS change_ts, 'U' || (user_id % 20) AS user_name, user_id AS employee_id,
  'ORDERS' AS table_name, op AS operation, event_id AS order_id, user_id AS customer_id,
  CASE WHEN NOT ({restricted}) THEN NULL WHEN {test} THEN op || ' is not allowed on {days}'
       WHEN strftime(ts, '%m-%d') = '01-01' OR strftime(ts, '%Y-%m-%d') = '2024-01-15'
       THEN op || ' is not allowed on holidays' END AS error_message
  FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' END
               AS op FROM events) WHERE op IS NOT NULL)"""


@query("calendar_rule_weekday",
       f"WITH {decided_sql('weekdays')} SELECT *, error_message IS NULL AS allowed FROM decided")
def _(m):
    return a.calendar_rule(order_changes(m), m.holidays())


@query("calendar_rule_weekend",
       f"WITH {decided_sql('weekends')} SELECT *, error_message IS NULL AS allowed FROM decided")
def _(m):
    return a.calendar_rule(order_changes(m), m.holidays(), blocked_days="WEEKEND")


@query("calendar_rule_restricted", f"""
WITH {decided_sql('weekdays', "user_id IN (SELECT employee_id FROM m_employees WHERE department = 'SALES')")}
SELECT *, error_message IS NULL AS allowed FROM decided""")
def _(m):
    held = m.employees().select(
        "employee_id", F.when(F.col("department") == "SALES", "Y").otherwise("N").alias("is_active"))
    return a.calendar_rule(order_changes(m), m.holidays(), restrictions=held)


@query("rule_violations", f"""
WITH {decided_sql('weekdays')}
SELECT change_id, 'WEEKDAY_HOLIDAY_RESTRICTION' AS rule_name, user_name, table_name, operation AS operation_type,
       CASE WHEN operation = 'INSERT' THEN 'Emp_ID: ' || employee_id || ', Cust_ID: ' || customer_id
            ELSE 'Order: ' || order_id || ', Emp: ' || employee_id END AS attempted_values, error_message
FROM decided WHERE error_message IS NOT NULL""")
def _(m):
    return a.split_changes(a.calendar_rule(order_changes(m), m.holidays()))["violations"]


def rule_audit_sql() -> str:
    return f"""
WITH {decided_sql('weekdays')}
SELECT change_id, table_name, CASE WHEN error_message IS NULL THEN operation ELSE 'BLOCKED' END AS operation_type, user_name,
       CASE WHEN operation <> 'INSERT' THEN 'Order: ' || o.order_id || ', Emp: ' || o.employee_id || ', Status: ' || o.status
            || ', Total: ' || o.total_amount END AS old_values,
       CASE WHEN operation = 'INSERT' AND error_message IS NULL THEN 'Employee ' || d.employee_id || ' INSERT check passed'
            WHEN operation = 'INSERT' THEN 'Attempted INSERT: Emp ' || d.employee_id || ', Cust ' || d.customer_id
            WHEN operation = 'UPDATE' THEN 'Order: ' || d.order_id || ', Emp: ' || d.employee_id || ', Status: '
            || coalesce(o.status, '') END AS new_values,
       CASE WHEN error_message IS NULL THEN 'Y' ELSE 'N' END AS success_flag, error_message, change_ts AS change_timestamp
FROM decided d LEFT JOIN m_orders o ON o.order_id = d.order_id WHERE error_message IS NOT NULL OR operation = 'INSERT'"""


@query("rule_audit_rows", rule_audit_sql())
def _(m):
    return a.split_changes(a.calendar_rule(order_changes(m), m.holidays()), m.orders())["audit"]


@query("batch_counts", f"""
WITH {decided_sql('weekdays')}, c AS (SELECT count(*) FILTER (operation = 'INSERT') AS inserts,
  count(*) FILTER (operation = 'UPDATE') AS updates, count(*) FILTER (operation = 'DELETE') AS deletes FROM decided)
SELECT *, 'Batch: I=' || inserts || ', U=' || updates || ', D=' || deletes AS new_values FROM c""")
def _(m):
    return a.batch_counts(order_changes(m))


@query("change_capture", """
WITH o AS (SELECT * FROM m_orders WHERE status <> 'PENDING'),
n AS (SELECT order_id, employee_id, CASE WHEN status = 'PROCESSING' THEN 'SHIPPED' ELSE status END AS status, total_amount
      FROM m_orders WHERE status <> 'CANCELLED'),
j AS (SELECT o.order_id AS ok, n.order_id AS nk,
  'Order: ' || o.order_id || ', Emp: ' || o.employee_id || ', Status: ' || o.status || ', Total: ' || o.total_amount AS old_value,
  'Order: ' || n.order_id || ', Emp: ' || n.employee_id || ', Status: ' || n.status || ', Total: ' || n.total_amount AS new_value
  FROM o FULL JOIN n ON o.order_id = n.order_id)
SELECT CAST(coalesce(ok, nk) AS VARCHAR) AS record_id,
       CASE WHEN ok IS NULL THEN 'INSERT' WHEN nk IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action_type,
       old_value, new_value FROM j WHERE old_value IS DISTINCT FROM new_value""")
def _(m):
    orders = m.orders()
    old = orders.filter(F.col("status") != "PENDING")
    new = orders.filter(F.col("status") != "CANCELLED").withColumn(
        "status", F.when(F.col("status") == "PROCESSING", "SHIPPED").otherwise(F.col("status")))
    return a.change_capture(old, new, "order_id",
                            {"Order": "order_id", "Emp": "employee_id", "Status": "status", "Total": "total_amount"})
