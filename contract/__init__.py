"""The registered queries and, beside each, the same question asked in plain SQL."""


def load():
    from contract import audit, base, kpis, orders, quality, sales, streams, tables  # noqa: F401

    return base.QUERIES, base.ORACLE
