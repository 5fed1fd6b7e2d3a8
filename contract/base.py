"""Registry of queries with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from contract.model_sql import MODEL_SQL
from ledgertide.session import tune
from ledgertide.sources.model import Model

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Model under `name`; `sql` is its independent counterpart."""

    def register(fn: Callable[[Model], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Model(tune(spark), folder))
        if sql:
            ORACLE[name] = with_model(sql)
        return fn

    return register


def with_model(body: str) -> str:
    """Put the model views that the text mentions in front of it as common table expressions."""
    needed: list[str] = []

    def visit(text: str):
        for name in dict.fromkeys(re.findall(r"\bm_[a-z_]+\b", text)):
            if name in MODEL_SQL and name not in needed:
                visit(MODEL_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    views = ",\n".join(f"{n} AS ({MODEL_SQL[n].strip()})" for n in needed)
    if not views:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + views + ",\n" + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\b", body):
        return "WITH " + views + ",\n" + re.sub(r"(?i)^with\s+", "", body)
    return "WITH " + views + "\n" + body


def rdiv(num: str, den: str, digits: int, factor: int = 1) -> str:
    """num * factor / den rounded half away from zero to `digits`, in whole numbers; den > 0."""
    n, d, s = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)", factor * 10**digits
    return (
        f"CAST((CASE WHEN {d} = 0 THEN NULL ELSE "
        f"sign({n}) * ((2 * abs({n}) * {s} + {d}) // (2 * {d})) END) AS DOUBLE) / {10**digits}.0::DOUBLE"
    )


def sql_cents(expr: str) -> str:
    return f"CAST(({expr}) * 100 AS HUGEINT)"


def money_avg(total: str, count: str) -> str:
    """SUM and COUNT to the six-digit average; `total` is a decimal with two digits."""
    return rdiv(sql_cents(total), f"100 * ({count})", 6)


def months_sql(as_of: str, start: str) -> str:
    """31 * months between two midnights, as a whole number."""
    return (
        f"(31 * ((year({as_of}) - year({start})) * 12 + month({as_of}) - month({start})) + "
        f"CASE WHEN {as_of} = last_day({as_of}) AND CAST({start} AS DATE) = last_day({start}) THEN 0 "
        f"ELSE day({as_of}) - day({start}) END)"
    )
