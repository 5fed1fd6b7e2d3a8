"""Rule checks on a stream of changes: decisions, violations, audit rows and batch counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgertide.plans.audit import batch_counts, calendar_rule, split_changes
from ledgertide.session import cut_lineage


def enforce(
    holidays: DataFrame, target: str, blocked_days: str = "WEEKDAY", restrictions: DataFrame | None = None,
    orders: DataFrame | None = None,
):
    """A batch handler that writes allowed, violations and audit under the batch id.

    The decisions of a batch are settled once, so the three outputs always agree.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        decided = cut_lineage(calendar_rule(batch, holidays, blocked_days, restrictions))
        for name, part in split_changes(decided, orders).items():
            part.write.mode("overwrite").parquet(f"{target}/{name}/batch_id={batch_id}")

    return handle


def count_batches(target: str):
    """A batch handler that logs inserts, updates and deletes of each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch_counts(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return handle
