"""Calendar, number and NULL semantics of the source dialect as Column expressions."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(22,2)"


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def moment(value) -> Column:
    """A zone-free timestamp literal from a datetime, date or ISO text."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.lit(value).cast("timestamp_ntz")


def parse_moment(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


def shift_months(value, months: int) -> dt.datetime:
    """ADD_MONTHS on the driver: keeps the time, last day of month stays the last day."""
    at = parse_moment(value)
    index = at.year * 12 + at.month - 1 + months
    year, month = divmod(index, 12)
    first_after = dt.datetime(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (first_after - dt.timedelta(days=1)).day
    at_month_end = (at + dt.timedelta(days=1)).month != at.month
    day = last if at_month_end else min(at.day, last)
    return at.replace(year=year, month=month + 1, day=day)


def add_months(ts, months: int) -> Column:
    """ADD_MONTHS on a column: keeps the time of day and maps month end to month end."""
    ts = as_col(ts)
    moved = ts + F.make_ym_interval(F.lit(0), F.lit(months))
    to_end = F.date_diff(F.last_day(moved), F.to_date(moved))
    at_end = F.to_date(ts) == F.last_day(ts)
    return F.when(at_end, moved + F.make_dt_interval(days=to_end)).otherwise(moved)


def months_between(later, earlier) -> Column:
    return F.months_between(as_col(later), as_col(earlier), roundOff=False)


def text_of(*parts) -> Column:
    """Concatenation where NULL counts as empty text."""
    return F.concat_ws("", *[as_col(p).cast("string") for p in parts])


def money(value) -> Column:
    return as_col(value).cast(MONEY)


def total(value) -> Column:
    """NVL(SUM(x), 0) on money."""
    return F.coalesce(F.sum(as_col(value)), F.lit(0)).cast(MONEY)


def ratio(num, den, factor: int = 1, digits: int = 2) -> Column:
    """num * factor / den, rounded half up; NULL where den is zero or NULL.

    Operands are widened to decimals so that the rounding does not depend on binary fractions.
    """
    num = as_col(num).cast("decimal(20,2)") * F.lit(factor)
    den = as_col(den).cast("decimal(20,2)")
    return F.when(den != 0, F.round(num / den, digits))


def percent(num, den, digits: int = 2) -> Column:
    return ratio(num, den, 100, digits).cast("double")


def average(value) -> Column:
    """AVG on money, to six digits, independent of the order of the rows."""
    return F.avg(as_col(value).cast("decimal(18,2)")).cast("decimal(24,6)").cast("double")


def average_of(sum_col, count_col) -> Column:
    """The same average when sum and count are already aggregated."""
    return ratio(sum_col, count_col, 1, 6).cast("double")


def day(ts) -> Column:
    return F.to_date(as_col(ts))


def day_start(ts) -> Column:
    return F.date_trunc("day", as_col(ts)).cast("timestamp_ntz")


def trunc_to(unit: str, ts) -> Column:
    return F.date_trunc(unit, as_col(ts)).cast("timestamp_ntz")


def micros(ts) -> Column:
    """Microseconds since the epoch of a zone-free timestamp (the session zone is UTC)."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def days_between(later, earlier) -> Column:
    """DATE minus DATE: fractional days."""
    return (micros(later) - micros(earlier)) / F.lit(86400000000)


def minutes_between(later, earlier) -> Column:
    gap = (micros(later) - micros(earlier)).cast("decimal(20,0)")
    return F.round(gap / F.lit(60000000).cast("decimal(10,0)"), 2).cast("double")


def stamp_text(ts) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd HH:mm:ss")


def month_text(ts) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM")


def number_text(value) -> Column:
    """A number as the source dialect prints it: no trailing zeros, no zero before the point."""
    text = as_col(value).cast("string")
    text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.regexp_replace(text, r"^(-?)0\.", "$1.")


def currency(value) -> Column:
    return F.concat(F.lit("$"), F.format_number(as_col(value), 2))


def lookup(key, table: dict, default) -> Column:
    """A small fixed mapping as one CASE expression."""
    key = as_col(key)
    if not table:
        return F.lit(default)
    cases = reduce(
        lambda acc, item: acc.when(key == F.lit(item[0]), F.lit(item[1])),
        table.items(),
        F,
    )
    return cases.otherwise(F.lit(default))


def newest(*cols) -> list[Column]:
    """Descending order with NULL first, as the source dialect sorts."""
    return [as_col(c).desc_nulls_first() for c in cols]


def oldest(*cols) -> list[Column]:
    return [as_col(c).asc_nulls_last() for c in cols]


def empty(spark, schema) -> DataFrame:
    return spark.createDataFrame([], schema)
