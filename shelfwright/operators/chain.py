"""Chains of operations as one change set.

Operations that were applied one after the other are composed from their logs alone: of every object and field, the first
applied old value and the last applied new value. The result is a change set like any other: applying it once gives the
catalog that applying all of them in turn gives, and undoing it takes all of them back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.operators.changes import apply_changes
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.undo import DELTA_KEY
from shelfwright.schema import CHANGE_COLUMNS, ChangeStatus

#: Actions that one operation may have in a chain.
MAX_ACTIONS = 1 << 10


def compose(log: DataFrame, operations: Sequence[int], chain_id: int) -> DataFrame:
    """The applied rows of ``operations``, in that order, as one change set under ``chain_id``.

    Rows that were skipped, failed or are pending changed nothing and are left out; an undo takes part with what it wrote.
    ``action_ix`` keeps the order of the last writes, so two fields stored in one place end as they did. An operation
    named twice, or one without rows, counts once or not at all. The rows of one object and field are reduced in the tasks
    before they are shuffled: a chain of any length moves one row per task, object and field."""
    order = {op: i for i, op in reversed(list(enumerate(operations)))}
    if not order:
        return log.limit(0).select(*CHANGE_COLUMNS)
    if len(order) * MAX_ACTIONS >= 1 << 31:
        raise ValueError("too many operations in one chain")
    place = F.lit(None).cast("int")
    for op, i in order.items():
        place = F.when(F.col("operation_id") == op, F.lit(i)).otherwise(place)
    applied = log.where(F.col("operation_id").isin(*order) & (F.col("status") == int(ChangeStatus.APPLIED)))
    at = (place * MAX_ACTIONS + F.col("action_ix")).cast("int")
    rows = applied.withColumn("__at", at)
    ends = rows.groupBy("object_type", *DELTA_KEY).agg(
        F.min_by("old_value", "__at").alias("old_value"),
        F.max_by("new_value", "__at").alias("new_value"),
        F.max("__at").alias("action_ix"),
    )
    return ends.withColumns(
        {"operation_id": F.lit(chain_id).cast("bigint"), "status": F.lit(int(ChangeStatus.APPLIED)).cast("int")}
    ).select(*CHANGE_COLUMNS)


def apply_chain(
    catalog: Catalog,
    log: DataFrame,
    operations: Sequence[int],
    chain_id: int,
    fields: Sequence[str],
    registry: FieldRegistry,
) -> Catalog:
    """The catalog after all of ``operations``, by one apply. ``fields`` names what any of them can have changed.

    ``log`` is read by each table of the result: pass a written one."""
    return apply_changes(catalog, compose(log, operations, chain_id), fields, registry)
