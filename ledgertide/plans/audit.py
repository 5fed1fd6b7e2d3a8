"""Audit-log reports: activity windows, monitors, compliance summaries and rule decisions.

Windows per employee go through `operators.ordered`, because one service account may have
written a large part of the log. The audit id breaks ties between equal times.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions import rules
from ledgertide.functions.compat import (
    average_of,
    day_start,
    micros,
    minutes_between,
    moment,
    month_text,
    newest,
    oldest,
    parse_moment,
    percent,
    ratio,
    stamp_text,
    text_of,
    trunc_to,
)
from ledgertide.operators.ordered import framed, hot_groups, numbered, ranked, running_totals, tiled, trailing_count

TS = "action_timestamp"


def _status_count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def _after(audit: DataFrame, as_of, span: dt.timedelta) -> DataFrame:
    return audit.filter(F.col(TS) >= moment(parse_moment(as_of) - span))


# -- trail ----------------------------------------------------------------------------


def audit_trail(audit: DataFrame) -> DataFrame:
    return audit.select(
        "audit_id", "employee_id", "action_type", "table_name", "record_id", "day_of_week", "is_holiday",
        "is_weekday", "status", "error_message", "session_user", stamp_text(TS).alias("timestamp"), "ip_address",
    ).orderBy(F.col("audit_id").desc())


def recent_entries(audit: DataFrame, as_of, span: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    return (
        _after(audit, as_of, span)
        .orderBy(*newest(TS))
        .select("audit_id", "employee_id", "action_type", "table_name", "status", "error_message",
                stamp_text(TS).alias("timestamp"), "session_user")
    )


def employee_trail(audit: DataFrame, employee_id: int) -> DataFrame:
    return (
        audit.filter(F.col("employee_id") == employee_id)
        .orderBy(*newest(TS))
        .select("audit_id", "action_type", "table_name", "record_id", "day_of_week", "status", "error_message",
                stamp_text(TS).alias("timestamp"), "session_user", "ip_address")
    )


def latest_changes(audit: DataFrame, table_name: str, k: int = 5) -> DataFrame:
    return (
        audit.filter(F.col("table_name") == table_name)
        .orderBy(F.col("audit_id").desc())
        .limit(k)
        .select("audit_id", "action_type", "record_id", "session_user", stamp_text(TS).alias("change_time"))
    )


# -- violations -----------------------------------------------------------------------


def _named(rows: DataFrame, employees: DataFrame) -> DataFrame:
    return rows.join(employees.select("employee_id", "employee_name"), "employee_id", "left")


VIOLATION_COLUMNS = ["audit_id", "employee_id", "employee_name", "action_type", "table_name", "record_id",
                     "day_of_week"]


def violations(audit: DataFrame, employees: DataFrame) -> DataFrame:
    denied = _named(audit.filter(F.col("status") == "DENIED"), employees)
    return denied.orderBy(*newest(TS)).select(
        *VIOLATION_COLUMNS, "is_holiday", "is_weekday", "status", "error_message",
        stamp_text(TS).alias("violation_time"), "session_user",
    )


def holiday_violations(audit: DataFrame, employees: DataFrame, holidays: DataFrame) -> DataFrame:
    denied = audit.filter((F.col("status") == "DENIED") & (F.col("is_holiday") == "Y"))
    days = holidays.select("holiday_name", F.to_date("holiday_date").alias("on"))
    joined = _named(denied.withColumn("on", F.to_date(TS)).join(days, "on"), employees)
    return joined.orderBy(*newest(TS)).select(
        "audit_id", "employee_id", "employee_name", "action_type", "table_name", "holiday_name",
        F.date_format("on", "yyyy-MM-dd").alias("holiday_date"), "error_message",
        stamp_text(TS).alias("violation_time"),
    )


def weekday_violations(audit: DataFrame, employees: DataFrame) -> DataFrame:
    denied = audit.filter(
        (F.col("status") == "DENIED") & (F.col("is_weekday") == "Y") & (F.col("is_holiday") == "N")
    )
    return _named(denied, employees).orderBy(*newest(TS)).select(
        *VIOLATION_COLUMNS, "error_message", stamp_text(TS).alias("violation_time"), "session_user"
    )


def authorization_failures(audit: DataFrame) -> DataFrame:
    """The status test binds to the first pattern only, as AND binds tighter than OR."""
    text = F.col("error_message")
    test = (
        (F.col("status").isin("DENIED", "ERROR") & text.like("%not authorized%"))
        | text.like("%permission%")
        | text.like("%access denied%")
    )
    return audit.filter(test).orderBy(*newest(TS)).select(
        "audit_id", "employee_id", "action_type", "table_name", "status", "error_message", "session_user",
        "ip_address", stamp_text(TS).alias("attempt_time"),
    )


# -- summaries ------------------------------------------------------------------------


def user_activity(audit: DataFrame) -> DataFrame:
    return (
        audit.groupBy("session_user")
        .agg(
            F.count(F.lit(1)).alias("total_actions"),
            F.min(TS).alias("first_action"),
            F.max(TS).alias("last_action"),
            _status_count("ALLOWED").alias("allowed_actions"),
            _status_count("DENIED").alias("denied_actions"),
            _status_count("ERROR").alias("error_actions"),
        )
        .withColumn("session_duration_minutes", minutes_between("last_action", "first_action"))
        .orderBy(F.col("total_actions").desc())
    )


def unusual_activity(
    audit: DataFrame, as_of, span: dt.timedelta = dt.timedelta(hours=1), threshold: int = rules.HOURLY_ACTIONS
) -> DataFrame:
    """Employees above the threshold with their actions in order.

    The action list is joined per minute first, so the last step sorts minutes, not actions.
    """
    minute = (
        _after(audit, as_of, span)
        .groupBy("employee_id", trunc_to("minute", TS).alias("minute"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(TS).alias("last_ts"),
            F.expr(f"listagg(action_type, ', ') WITHIN GROUP (ORDER BY {TS}, audit_id)").alias("part"),
        )
    )
    return (
        minute.groupBy("employee_id")
        .agg(
            F.sum("n").alias("actions_last_hour"),
            stamp_text(F.max("last_ts")).alias("last_action"),
            F.expr("listagg(part, ', ') WITHIN GROUP (ORDER BY minute)").alias("action_sequence"),
        )
        .filter(F.col("actions_last_hour") > threshold)
        .orderBy(F.col("actions_last_hour").desc())
    )


def activity_parts(
    audit: DataFrame, as_of, span: dt.timedelta = dt.timedelta(hours=1), threshold: int = rules.HOURLY_ACTIONS,
    part_chars: int = 100_000, group_rows: int | None = None,
) -> DataFrame:
    """The action lists of `unusual_activity` in numbered parts: employee_id, part (from 1), actions, action_sequence.

    The parts of an employee joined one after the other are the whole list. Where an action stands comes from a running
    sum of the lengths before it, so a list of any length is cut without being put together; a part holds the actions
    that begin in its stretch of `part_chars` characters, so it is longer than that by less than one action.
    """
    recent = _after(audit, as_of, span).select("audit_id", "employee_id", TS, "action_type")
    busy = recent.groupBy("employee_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > threshold)
    busy = busy.select(F.col("employee_id").alias("_busy"))
    rows = recent.join(busy, F.col("employee_id").eqNullSafe(F.col("_busy")), "left_semi")
    length = F.coalesce(F.length("action_type"), F.lit(0)) + F.when(F.col("action_type").isNull(), 0).otherwise(2)
    placed = running_totals(rows, ["employee_id"], [TS, "audit_id"], {"_upto": length.cast("bigint")}, group_rows)
    placed = placed.withColumn("_begin", F.col("_upto") - length).withColumn(
        "part", (F.floor(F.col("_begin") / part_chars) + 1).cast("bigint"))
    token = F.when(F.col("_begin") > 0, F.concat(F.lit(", "), F.col("action_type"))).otherwise(F.col("action_type"))
    return placed.withColumn("_token", token).groupBy("employee_id", "part").agg(
        F.count("action_type").alias("actions"),
        F.expr(f"listagg(_token, '') WITHIN GROUP (ORDER BY {TS}, audit_id)").alias("action_sequence"),
    ).filter(F.col("actions") > 0)


def action_runs(audit: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Consecutive equal actions of an employee as one row: run (from 1), action_type, actions, first and last time."""
    rows = audit.select("audit_id", "employee_id", TS, "action_type")
    order = [TS, "audit_id"]
    hot = hot_groups(rows, ["employee_id"], group_rows)
    near = framed(
        rows, ["employee_id"], order,
        lambda spec: {"_before": F.lag(F.struct("action_type")).over(spec)},
        before=1, group_rows=group_rows, hot=hot,
    )
    begins = F.col("_before").isNull() | ~F.col("_before.action_type").eqNullSafe(F.col("action_type"))
    placed = running_totals(near, ["employee_id"], order, {"run": begins.cast("bigint")}, group_rows, hot=hot)
    return placed.groupBy("employee_id", "run").agg(
        F.any_value("action_type").alias("action_type"), F.count(F.lit(1)).alias("actions"),
        F.min(TS).alias("first_action"), F.max(TS).alias("last_action"),
    )


def _counts_by(audit: DataFrame, period: Column, name: str, *others: str) -> DataFrame:
    """Status counts per period and further columns: the rows that distinct counts then run over."""
    return audit.groupBy(period.alias(name), *others).agg(
        F.count(F.lit(1)).alias("n"), *[_status_count(s).alias(s) for s in ("ALLOWED", "DENIED", "ERROR")]
    )


def daily_summary(audit: DataFrame) -> DataFrame:
    return (
        _counts_by(audit, day_start(TS), "audit_date", "employee_id", "session_user")
        .groupBy("audit_date")
        .agg(
            F.sum("n").alias("total_entries"),
            F.sum("ALLOWED").alias("allowed"),
            F.sum("DENIED").alias("denied"),
            F.sum("ERROR").alias("errors"),
            F.count_distinct("employee_id").alias("unique_employees"),
            F.count_distinct("session_user").alias("unique_users"),
        )
        .withColumn("day_name", F.date_format("audit_date", "EEEE"))
        .withColumn("denial_rate", percent("denied", "total_entries"))
        .orderBy(F.col("audit_date").desc())
    )


def monthly_compliance(audit: DataFrame) -> DataFrame:
    return (
        _counts_by(audit, month_text(TS), "month", "employee_id", "table_name")
        .groupBy("month")
        .agg(
            F.sum("n").alias("total_audits"),
            F.sum("ALLOWED").alias("compliant"),
            F.sum("DENIED").alias("non_compliant"),
            F.sum("ERROR").alias("system_errors"),
            F.count_distinct("employee_id").alias("employees_monitored"),
            F.count_distinct("table_name").alias("tables_monitored"),
        )
        .withColumn("compliance_percentage", percent("compliant", "total_audits"))
        .orderBy(F.col("month").desc())
    )


# -- integrity and archive ------------------------------------------------------------


def orphan_entries(audit: DataFrame, employees: DataFrame) -> DataFrame:
    return (
        audit.join(employees.select("employee_id"), "employee_id", "left_anti")
        .orderBy(*newest(TS))
        .select("audit_id", "employee_id", "action_type", "table_name", "status", stamp_text(TS).alias("timestamp"))
    )


def date_spine(bounds: DataFrame, first: str, last: Column) -> DataFrame:
    """One row per day from a one-row table with the first day."""
    return bounds.select(
        F.explode(F.sequence(F.to_date(first), F.to_date(last), F.expr("INTERVAL 1 DAY"))).alias("audit_date")
    )


def audit_gaps(audit: DataFrame, as_of) -> DataFrame:
    """Days without any entry, from the first entry to `as_of`."""
    seen = audit.select(F.to_date(TS).alias("audit_date")).distinct()
    spine = date_spine(audit.agg(F.min(TS).alias("first")), "first", moment(as_of))
    return (
        spine.join(seen, "audit_date", "left_anti")
        .select(
            F.col("audit_date").cast("timestamp_ntz").alias("audit_date"),
            F.date_format("audit_date", "EEEE").alias("day_name"),
            F.lit(0).cast("bigint").alias("audit_count"),
        )
        .orderBy(F.col("audit_date").desc())
    )


def archive_rows(audit: DataFrame, as_of, days: int = rules.ARCHIVE_DAYS) -> DataFrame:
    return audit.filter(F.col(TS) < moment(parse_moment(as_of) - dt.timedelta(days=days)))


def archive_summary(audit: DataFrame, as_of, days: int = rules.ARCHIVE_DAYS) -> DataFrame:
    return (
        archive_rows(audit, as_of, days)
        .agg(
            F.count(F.lit(1)).alias("records_to_archive"),
            F.min(TS).alias("oldest_record"),
            F.max(TS).alias("newest_record"),
        )
        .withColumn("archive_from_date", F.date_format("oldest_record", "yyyy-MM-dd"))
    )


def archive_listing(audit: DataFrame, as_of, days: int = rules.ARCHIVE_DAYS) -> DataFrame:
    return (
        archive_rows(audit, as_of, days)
        .select("audit_id", "employee_id", "action_type", "table_name", "record_id", "status", "error_message",
                "session_user", stamp_text(TS).alias("original_timestamp"))
        .orderBy("audit_id")
    )


# -- windows per employee ---------------------------------------------------------------


def employee_action_sequence(employees: DataFrame, actions: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Actions numbered from the newest, with the neighbours in time order."""
    staff = employees.select("employee_id", "employee_name")
    rows = actions.select("employee_id", "action_id", "action_date", "action_type").join(staff, "employee_id")
    hot = hot_groups(rows, ["employee_id"], group_rows, bounded_by=actions)
    near = framed(
        rows,
        ["employee_id"],
        ["action_date", "action_id"],
        lambda spec: {
            "previous_action": F.lag("action_type").over(spec),
            "next_action": F.lead("action_type").over(spec),
        },
        before=1,
        after=1,
        group_rows=group_rows,
        hot=hot,
    )
    placed = numbered(near, ["employee_id"], ["-action_date", "-action_id"], "action_sequence", hot=hot)
    return placed.select(
        "employee_id", "employee_name", "action_id", "action_date", "action_type", "action_sequence",
        "previous_action", "next_action",
    )


def _actions_per_employee(employees: DataFrame, audit: DataFrame, name: str) -> DataFrame:
    counts = audit.groupBy("employee_id").agg(F.count("audit_id").alias(name))
    return (
        employees.select("employee_id", "employee_name", "department")
        .join(counts, "employee_id", "left")
        .withColumn(name, F.coalesce(name, F.lit(0)))
    )


def employee_activity_rank(employees: DataFrame, audit: DataFrame, group_rows: int | None = None) -> DataFrame:
    counted = _actions_per_employee(employees, audit, "total_actions")
    inside = ranked(counted, ["department"], ["-total_actions"], rank="activity_rank_dept",
                    group_rows=group_rows, bounded_by=employees)
    overall = ranked(inside, [], ["-total_actions"], dense="activity_rank_overall",
                     group_rows=group_rows, bounded_by=employees)
    share = counted.groupBy("department").agg(F.sum("total_actions").alias("dept_actions"))
    return (
        overall.join(share, "department")
        .withColumn("percentage_of_dept_activity", percent("total_actions", "dept_actions"))
        .drop("dept_actions")
        .orderBy("department", "activity_rank_dept")
    )


def activity_quartiles(employees: DataFrame, audit: DataFrame, group_rows: int | None = None) -> DataFrame:
    counted = _actions_per_employee(employees, audit, "action_count")
    placed = tiled(counted, [], ["-action_count", "employee_id"], 4, "activity_quartile",
                   group_rows=group_rows, bounded_by=employees)
    label = (
        F.when(F.col("activity_quartile") == 1, "High Activity")
        .when(F.col("activity_quartile") == 2, "Medium-High Activity")
        .when(F.col("activity_quartile") == 3, "Medium-Low Activity")
        .when(F.col("activity_quartile") == 4, "Low Activity")
    )
    return placed.withColumn("activity_category", label)


def first_last_audit(employees: DataFrame, audit: DataFrame) -> DataFrame:
    """First and last time and status beside every entry; employees without entries appear once.

    The first step keeps the earliest and latest entry per employee and status as one number
    (time, then audit id), which a hash aggregate combines before the shuffle. Only the join
    that repeats the values per entry touches every row, and an inner join can split a very
    large key.
    """
    place = micros(TS).cast("decimal(19,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("audit_id")
    place = place.cast("decimal(38,0)")
    per_status = audit.groupBy("employee_id", "status").agg(
        F.min(place).alias("lo"), F.max(place).alias("hi"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts")
    )
    ends = per_status.groupBy("employee_id").agg(
        F.min("first_ts").alias("first_audit_time"),
        F.max("last_ts").alias("last_audit_time"),
        F.min_by("status", "lo").alias("first_audit_status"),
        F.max_by("status", "hi").alias("last_audit_status"),
    )
    staff = employees.select("employee_id", "employee_name").join(ends, "employee_id", "left")
    quiet = staff.filter(F.col("first_audit_time").isNull())
    busy = staff.filter(F.col("first_audit_time").isNotNull()).join(audit.select("employee_id"), "employee_id")
    return busy.unionByName(quiet)


def suspicious_patterns(
    audit: DataFrame,
    minutes: int = rules.BURST_MINUTES,
    burst: int = rules.BURST_ACTIONS,
    group_rows: int | None = None,
) -> DataFrame:
    """Insert, update, delete in a row; else a burst; else normal."""
    slim = audit.select("audit_id", "employee_id", TS, "action_type", "table_name", "status")
    hot = hot_groups(slim, ["employee_id"], group_rows)
    near = framed(
        slim,
        ["employee_id"],
        [TS, "audit_id"],
        lambda spec: {
            "prev_action_1": F.lag("action_type", 1).over(spec),
            "prev_action_2": F.lag("action_type", 2).over(spec),
            "next_action_1": F.lead("action_type", 1).over(spec),
        },
        before=2,
        after=1,
        group_rows=group_rows,
        hot=hot,
    )
    counted = trailing_count(near, ["employee_id"], TS, minutes * 60_000_000, "recent", hot=hot)
    sequence = (
        (F.col("action_type") == "DELETE") & (F.col("prev_action_1") == "UPDATE") & (F.col("prev_action_2") == "INSERT")
    )
    pattern = (
        F.when(sequence, "SUSPICIOUS_PATTERN").when(F.col("recent") > burst, "HIGH_FREQUENCY").otherwise("NORMAL")
    )
    return counted.withColumn("activity_pattern", pattern).drop("recent")


# -- windows over time ------------------------------------------------------------------


def _change(now: str, before: str) -> Column:
    return percent(F.col(now) - F.col(before), before)


def daily_activity_change(audit: DataFrame) -> DataFrame:
    """One row per day: the window runs over days, not over entries."""
    days = audit.groupBy(day_start(TS).alias("audit_date")).agg(F.count(F.lit(1)).alias("daily_attempts"))
    by_day = Window.orderBy(*oldest("audit_date"))
    return (
        days.withColumn("previous_day_attempts", F.lag("daily_attempts").over(by_day))
        .withColumn("seven_day_moving_avg", F.avg("daily_attempts").over(by_day.rowsBetween(-6, 0)))
        .withColumn("day_over_day_change", F.col("daily_attempts") - F.col("previous_day_attempts"))
        .withColumn("percentage_change", _change("daily_attempts", "previous_day_attempts"))
        .orderBy(F.col("audit_date").desc())
    )


def volume_alerts(audit: DataFrame, as_of, span: dt.timedelta = dt.timedelta(days=7), spike: int = 2) -> DataFrame:
    """Hourly volume of the last days against the average of the last 24 hours seen."""
    hours = (
        _after(audit, as_of, span)
        .groupBy(trunc_to("hour", TS).alias("audit_hour"))
        .agg(F.count(F.lit(1)).alias("audit_count"))
    )
    by_hour = Window.orderBy(*oldest("audit_hour"))
    day = by_hour.rowsBetween(-23, 0)
    above = F.col("audit_count") * F.count("audit_count").over(day) > spike * F.sum("audit_count").over(day)
    return (
        hours.withColumn("previous_hour_count", F.lag("audit_count", 1).over(by_hour))
        .withColumn("twentyfour_hour_moving_avg", F.avg("audit_count").over(day))
        .withColumn("volume_alert", F.when(above, "VOLUME_SPIKE_ALERT").otherwise("NORMAL"))
        .withColumn("hour_over_hour_change_percent", _change("audit_count", "previous_hour_count"))
        .orderBy(F.col("audit_hour").desc())
    )


def compliance_trend(audit: DataFrame) -> DataFrame:
    """Weekly compliance per employee against the four-week average.

    The window sees one row per employee and week, so no partition grows with the log.
    """
    weekly = (
        audit.filter(F.col("employee_id").isNotNull())
        .groupBy("employee_id", trunc_to("week", TS).alias("audit_week"))
        .agg(ratio(_status_count("ALLOWED"), F.count(F.lit(1)), 100).cast("decimal(5,2)").alias("rate"))
    )
    frame = Window.partitionBy("employee_id").orderBy(*oldest("audit_week")).rowsBetween(-3, 0)
    summed = weekly.withColumn("s", F.sum("rate").over(frame)).withColumn("n", F.count("rate").over(frame))
    times = F.col("rate") * F.col("n")
    trend = (
        F.when(times * 10 < F.col("s") * 8, "PERFORMANCE_DECLINE")
        .when(times * 10 > F.col("s") * 12, "PERFORMANCE_IMPROVEMENT")
        .otherwise("STABLE")
    )
    return summed.select(
        "employee_id",
        "audit_week",
        F.col("rate").cast("double").alias("compliance_rate"),
        ratio("s", "n").cast("double").alias("four_week_moving_avg"),
        ratio(times - F.col("s"), "n").cast("double").alias("deviation_from_trend"),
        trend.alias("performance_trend"),
    )


def session_analysis(audit: DataFrame, bucket_hours: int = 4, group_rows: int | None = None) -> DataFrame:
    """User activity in fixed buckets of a day, ranked within the user and within the day."""
    sessions = (
        audit.groupBy("session_user", day_start(TS).alias("audit_date"),
                      F.floor(F.hour(TS) / bucket_hours).alias("bucket"))
        .agg(F.min(TS).alias("session_start"), F.max(TS).alias("session_end"),
             F.count(F.lit(1)).alias("actions_per_session"))
        .drop("bucket")
    )
    gap = F.col("session_end") - F.col("session_start")
    minutes = F.extract(F.lit("MINUTE"), gap) + F.extract(F.lit("HOUR"), gap) * 60
    timed = sessions.withColumn("session_duration_minutes", minutes.cast("bigint"))
    user = Window.partitionBy("session_user")
    by_length = user.orderBy(F.col("session_duration_minutes").desc(), "session_start")
    in_user = (
        timed.withColumn("session_length_rank", F.row_number().over(by_length).cast("bigint"))
        .withColumn("avg_session_length", _mean_over("session_duration_minutes", user))
        .withColumn("avg_actions_per_session", _mean_over("actions_per_session", user))
    )
    return ranked(in_user, ["audit_date"], ["-actions_per_session"], rank="daily_activity_rank",
                  group_rows=group_rows, bounded_by=audit)


def _mean_over(name: str, spec) -> Column:
    return average_of(F.sum(name).over(spec), F.count(name).over(spec))


# -- rule decisions ---------------------------------------------------------------------


def calendar_rule(
    changes: DataFrame, holidays: DataFrame, blocked_days: str = "WEEKDAY", restrictions: DataFrame | None = None
) -> DataFrame:
    """Decide every change: blocked on weekdays (or weekends) and on holidays.

    Changes without an employee pass. With `restrictions`, only employees who hold an active
    one are checked. Recurring holidays match on month and day.
    """
    date = F.to_date("change_ts")
    fixed = holidays.filter(F.col("is_recurring") != "Y").select(
        F.date_format("holiday_date", "yyyy-MM-dd").alias("_on"))
    yearly = holidays.filter(F.col("is_recurring") == "Y").select(
        F.date_format("holiday_date", "MM-dd").alias("_on"))
    # One row per calendar day at most: the list is bounded by the calendar.
    days = fixed.unionByName(yearly).distinct().withColumn("_holiday", F.lit(True))
    marked = changes
    for name, form in (("_full", "yyyy-MM-dd"), ("_yearly", "MM-dd")):
        hit = days.select(F.col("_on").alias(f"{name}_on"), F.col("_holiday").alias(name))
        marked = marked.join(hit, F.date_format(date, form) == F.col(f"{name}_on"), "left").drop(f"{name}_on")
    checked = F.col("employee_id").isNotNull()
    if restrictions is not None:
        held = restrictions.filter(F.col("is_active") == "Y").select("employee_id").distinct()
        marked = marked.join(held.withColumn("_restricted", F.lit(True)), "employee_id", "left")
        checked = checked & F.coalesce("_restricted", F.lit(False))
    weekend = F.dayofweek(date).isin(1, 7)
    on_blocked_day = weekend if blocked_days == "WEEKEND" else ~weekend
    on_holiday = F.coalesce("_full", "_yearly", F.lit(False))
    operation = F.col("operation")
    message = F.when(
        checked & on_blocked_day, text_of(operation, F.lit(f" is not allowed on {blocked_days.lower()}s"))
    ).when(checked & on_holiday, text_of(operation, F.lit(" is not allowed on holidays")))
    return (
        marked.withColumn("error_message", message)
        .withColumn("allowed", F.col("error_message").isNull())
        .select(*changes.columns, "allowed", "error_message")
    )


def split_changes(decided: DataFrame, orders: DataFrame | None = None) -> dict[str, DataFrame]:
    """Accepted changes, violations and audit rows of a decided batch.

    `orders` are the stored rows: blocked updates and deletes log what they would have changed.
    """
    insert = F.col("operation") == "INSERT"
    attempted = F.when(
        insert, text_of(F.lit("Emp_ID: "), "employee_id", F.lit(", Cust_ID: "), "customer_id")
    ).otherwise(text_of(F.lit("Order: "), "order_id", F.lit(", Emp: "), "employee_id"))
    blocked = decided.filter(~F.col("allowed"))
    logged = decided.filter(~F.col("allowed") | (insert & F.col("employee_id").isNotNull()))
    stored = ["order_id", "employee_id", "status", "total_amount"]
    if orders is None:
        logged = logged.select("*", *[F.lit(None).cast("string").alias(f"_old_{c}") for c in stored])
    else:
        held = orders.select(*[F.col(c).alias(f"_old_{c}") for c in stored])
        logged = logged.join(held, F.col("order_id") == F.col("_old_order_id"), "left")
    old_values = F.when(
        ~insert & F.col("_old_order_id").isNotNull(),
        text_of(F.lit("Order: "), "_old_order_id", F.lit(", Emp: "), "_old_employee_id", F.lit(", Status: "), "_old_status",
                F.lit(", Total: "), "_old_total_amount"),
    )
    new_values = (
        F.when(insert & F.col("allowed"), text_of(F.lit("Employee "), "employee_id", F.lit(" INSERT check passed")))
        .when(insert, text_of(F.lit("Attempted INSERT: Emp "), "employee_id", F.lit(", Cust "), "customer_id"))
        .when(F.col("operation") == "UPDATE",
              text_of(F.lit("Order: "), "order_id", F.lit(", Emp: "), "employee_id", F.lit(", Status: "), "_old_status"))
    )
    return {
        "allowed": decided.filter("allowed").drop("allowed", "error_message"),
        "violations": blocked.select(
            "change_id",
            F.lit(rules.RULE_NAME).alias("rule_name"),
            "user_name",
            "table_name",
            F.col("operation").alias("operation_type"),
            attempted.alias("attempted_values"),
            "error_message",
        ),
        "audit": logged.select(
            "change_id",
            "table_name",
            F.when(F.col("allowed"), F.col("operation")).otherwise("BLOCKED").alias("operation_type"),
            "user_name",
            old_values.alias("old_values"),
            new_values.alias("new_values"),
            F.when(F.col("allowed"), "Y").otherwise("N").alias("success_flag"),
            "error_message",
            F.col("change_ts").alias("change_timestamp"),
        ),
    }


def batch_counts(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Inserts, updates and deletes of a batch, with the log text."""
    counted = changes.groupBy(*(by or [])).agg(
        *[F.count_if(F.col("operation") == op).alias(name)
          for op, name in (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes"))]
    )
    text = text_of(F.lit("Batch: I="), "inserts", F.lit(", U="), "updates", F.lit(", D="), "deletes")
    return counted.filter(F.col("inserts") + F.col("updates") + F.col("deletes") > 0).withColumn("new_values", text)


def change_capture(old: DataFrame, new: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Differences of two snapshots as audit rows with old and new values as text.

    `columns` maps a label to a column. Equal rows are left out.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{tag}_key"), *[F.col(c).alias(f"{tag}_{c}") for c in columns.values()])

    def text(tag: str) -> Column:
        parts = [text_of(F.lit(f"{label}: "), f"{tag}_{c}") for label, c in columns.items()]
        return F.when(F.col(f"{tag}_key").isNotNull(), F.concat_ws(", ", *parts))

    both = side(old, "old").join(side(new, "new"), F.col("old_key") == F.col("new_key"), "full")
    differs = F.lit(False)
    for c in columns.values():
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    action = (
        F.when(F.col("old_key").isNull(), "INSERT").when(F.col("new_key").isNull(), "DELETE").when(differs, "UPDATE")
    )
    return (
        both.withColumn("action_type", action)
        .filter(F.col("action_type").isNotNull())
        .select(
            F.coalesce("old_key", "new_key").cast("string").alias("record_id"),
            "action_type",
            text("old").alias("old_value"),
            text("new").alias("new_value"),
        )
    )
