"""Analytics over the change log and the operation log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.times import instant
from shelfwright.operators.fields import FieldRegistry
from shelfwright.schema import (
    ACTIVE_OPERATION_STATUSES,
    CHANGE_STATUS_LABELS,
    ChangeStatus,
)

# How many days the log is kept unless told otherwise, and how long a run may be silent.
DEFAULT_RETENTION_DAYS = 30
STALL_MINUTES = 10


def _count_statuses() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(label) for s, label in CHANGE_STATUS_LABELS.items()]


def change_counts(log: DataFrame, operation_id: int) -> DataFrame:
    """Rows of one operation per status, zeros included."""
    return log.where(F.col("operation_id") == operation_id).agg(*_count_statuses())


def operation_summary(log: DataFrame) -> DataFrame:
    """Per operation: rows targeted, and how many are in each status."""
    return log.groupBy("operation_id").agg(F.count("*").alias("targets"), *_count_statuses())


def field_summary(log: DataFrame, registry: FieldRegistry) -> DataFrame:
    """Per operation and field: rows in each status. Rows that no field owns any more are under a null field."""
    field = registry.key_of(F.col("field_type"), F.col("field_key")).alias("field")
    return log.groupBy("operation_id", field).agg(F.count("*").alias("targets"), *_count_statuses())


def percent(processed: Column, target: Column) -> Column:
    done = F.floor(F.try_divide(F.least(processed, target), target) * 100)
    return F.when(target > 0, done).otherwise(F.lit(0)).cast("bigint")


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE_OPERATION_STATUSES)


def can_undo(status: Column, processed: Column) -> Column:
    return ~is_active(status) & (processed > 0)


def object_progress(log: DataFrame) -> DataFrame:
    """Objects and rows per operation. An object counts once: as failed if any of its rows
    failed, else as processed once any of its rows was applied or skipped."""
    settled = F.col("status").isin(int(ChangeStatus.APPLIED), int(ChangeStatus.SKIPPED))
    per_object = log.groupBy("operation_id", "object_id").agg(
        F.count("*").alias("rows"),
        F.bool_or(F.col("status") == int(ChangeStatus.FAILED)).alias("failed"),
        F.bool_or(settled).alias("settled"),
    )
    return per_object.groupBy("operation_id").agg(
        F.sum("rows").alias("target_rows"),
        F.count("*").alias("target_objects"),
        F.count_if(F.col("settled") & ~F.col("failed")).alias("processed"),
        F.count_if(F.col("failed")).alias("failed"),
    )


def operation_progress(log: DataFrame, operations: DataFrame) -> DataFrame:
    """Progress of every operation, recomputed from its changes."""
    return progress_rows(object_progress(log), operations)


def progress_rows(progress: DataFrame, operations: DataFrame) -> DataFrame:
    """Progress of every operation from its counts in rows and objects; zeros where there are none."""
    joined = operations.select("id", "status").join(
        progress, F.col("id") == F.col("operation_id"), "left"
    )
    zero = F.lit(0).cast("bigint")
    counted = joined.select(
        "id",
        "status",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("target_rows", "target_objects", "processed", "failed")
        ],
    )
    return counted.withColumns(
        {
            "percent": percent(F.col("processed"), F.col("target_objects")),
            "can_undo": can_undo(F.col("status"), F.col("processed")),
        }
    )


def recount(operations: DataFrame, log: DataFrame) -> DataFrame:
    """Operation rows with their counters, in objects, recomputed from the change log."""
    progress = object_progress(log).select(
        F.col("operation_id").alias("id"),
        F.col("target_objects").alias("__target_count"),
        F.col("processed").alias("__processed"),
        F.col("failed").alias("__failed"),
    )
    counters = {
        name: F.coalesce(f"__{name}", F.lit(0).cast("bigint")).alias(name)
        for name in ("target_count", "processed", "failed")
    }
    rows = operations.join(progress, "id", "left")
    return rows.select(*[counters.get(c, F.col(c)) for c in operations.columns])


def recent_operations(operations: DataFrame, limit: int = 20) -> DataFrame:
    return operations.orderBy(F.desc("id")).limit(max(1, limit))


def operation_history(operations: DataFrame, users: DataFrame, limit: int = 20) -> DataFrame:
    """The latest operations with progress, undo flag and owner ('' when unknown). ``users`` has
    columns user_id and display_name."""
    recent = recent_operations(operations, limit)
    # Users are cut down to the owners on the page before they are joined to it.
    owners = recent.select("user_id").where("user_id > 0").distinct()
    names = users.join(owners, "user_id", "left_semi")
    return (
        recent.join(names, "user_id", "left")
        .select(
            "id",
            "status",
            "source",
            "mode",
            "parent_op_id",
            "conflict_policy",
            "user_id",
            F.coalesce("display_name", F.lit("")).alias("user_name"),
            "target_count",
            "processed",
            "failed",
            percent(F.col("processed"), F.col("target_count")).alias("percent"),
            can_undo(F.col("status"), F.col("processed")).alias("can_undo"),
            "created_at",
            "completed_at",
        )
        .orderBy(F.desc("id"))
    )


def active_operation(operations: DataFrame, excluding: int = 0) -> DataFrame:
    """The active operation with the lowest id, other than one."""
    return (
        operations.where(is_active(F.col("status")) & (F.col("id") != excluding)).orderBy("id").limit(1)
    )


def stalled_operations(
    operations: DataFrame, now: datetime, silent_for: timedelta = timedelta(minutes=STALL_MINUTES)
) -> DataFrame:
    """Running operations whose last sign of life is too long ago, by id. One that never reported
    is not stalled."""
    return operations.where(
        (F.col("status") == "running") & (F.col("last_progress_at") < instant(now - silent_for))
    ).orderBy("id")


def final_statuses(operations: DataFrame) -> DataFrame:
    """Operation ids with their status once undos have taken effect: the parent of a completed
    undo is reverted."""
    undone = (
        operations.where((F.col("source") == "undo") & (F.col("status") == "completed"))
        .where(F.col("parent_op_id").isNotNull())
        .groupBy(F.col("parent_op_id").alias("id"))
        .agg(F.lit(True).alias("undone"))
    )
    return operations.join(undone, "id", "left").select(
        "id",
        F.when(F.col("undone"), F.lit("reverted")).otherwise(F.col("status")).alias("status"),
    )


def completion_report(
    operations: DataFrame, log: DataFrame, rules: DataFrame, default_recipient: str
) -> DataFrame:
    """What to tell whom about each completed scheduled operation."""
    done = operations.where((F.col("source") == "schedule") & (F.col("status") == "completed"))
    # The newest rule wins where several ran the same operation.
    by_operation = (
        rules.where(F.col("last_op_id").isNotNull())
        .groupBy(F.col("last_op_id").alias("id"))
        .agg(F.max_by(F.struct("name", "notify_email"), "id").alias("rule"))
    )
    # Only rows of the operations reported on are counted. The log is on the left of the join, where the rows of an
    # operation that owns much of it can be split; and it is counted before the next join.
    reported = log.join(done.select(F.col("id").alias("operation_id")), "operation_id", "left_semi")
    counts = reported.groupBy(F.col("operation_id").alias("id")).agg(*_count_statuses())
    zero = F.lit(0).cast("bigint")
    return (
        done.join(by_operation, "id", "left")
        .join(counts.select("id", "applied", "skipped", F.col("failed").alias("failed_rows")), "id", "left")
        .select(
            "id",
            F.coalesce(
                F.nullif("rule.name", F.lit("")), F.concat(F.lit("Operation #"), F.col("id").cast("string"))
            ).alias("label"),
            F.coalesce(F.nullif("rule.notify_email", F.lit("")), F.lit(default_recipient)).alias("recipient"),
            F.col("target_count").alias("targets"),
            F.coalesce("applied", zero).alias("changed"),
            F.coalesce("skipped", zero).alias("skipped"),
            F.coalesce("failed_rows", zero).alias("failed"),
            "completed_at",
        )
    )


def retention_cutoff(now: datetime, days: int = DEFAULT_RETENTION_DAYS) -> datetime:
    if days < 1:
        raise ValueError("changes are kept for a day at least")
    return now - timedelta(days=days)


def _expired(operations: DataFrame, cutoff: datetime) -> DataFrame:
    return operations.where(F.col("completed_at") < instant(cutoff)).select(F.col("id").alias("operation_id"))


def expired_operations(
    operations: DataFrame, log: DataFrame, cutoff: datetime, max_operations: int | None = None
) -> DataFrame:
    """The operations whose changes have outlived retention, with their row counts; only the oldest
    ``max_operations`` of them if that is given.

    Operations come first, so that only their rows of the log are counted."""
    rows = log.join(_expired(operations, cutoff), "operation_id", "left_semi")
    counted = rows.groupBy("operation_id").agg(F.count("*").alias("rows"))
    return counted if max_operations is None else counted.orderBy("operation_id").limit(max(1, max_operations))


def purge_counts(
    operations: DataFrame, log: DataFrame, cutoff: datetime, max_operations: int | None = None
) -> DataFrame:
    return expired_operations(operations, log, cutoff, max_operations).agg(
        F.count("*").alias("operations"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
    )


def survivors(
    operations: DataFrame, log: DataFrame, cutoff: datetime, max_operations: int | None = None
) -> DataFrame:
    """The change log after one purge; operations themselves are kept. Without a limit the log is read once."""
    if max_operations is None:
        gone = _expired(operations, cutoff)
    else:
        gone = expired_operations(operations, log, cutoff, max_operations).select("operation_id")
    return log.join(gone, "operation_id", "left_anti").select(*log.columns)
