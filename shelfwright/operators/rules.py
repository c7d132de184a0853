"""Recurring rules: which are due, and when they run again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.recurrence import next_run
from shelfwright.functions.times import instant


def due_rules(rules: DataFrame, now: datetime) -> DataFrame:
    """Active rules whose time has come, the longest waiting first."""
    return rules.where((F.col("status") == "active") & (F.col("next_run") <= instant(now))).orderBy(
        "next_run", "id"
    )


def recent_rules(rules: DataFrame, limit: int = 100) -> DataFrame:
    return rules.orderBy(F.desc("id")).limit(max(1, limit))


def advance(rules: DataFrame, now: datetime, operation_id: int | None = None) -> DataFrame:
    """Rules after having run at ``now``, as an operation if one is named: rescheduled strictly
    later, or completed when they do not recur, in which case they keep the time they had."""
    at = instant(now)
    following = next_run(F.col("recurrence"), F.col("next_run"), at)
    if operation_id is not None:
        rules = rules.withColumn("last_op_id", F.lit(operation_id).cast("bigint"))
    return rules.withColumn("__next", following).select(
        *[c for c in rules.columns if c not in ("status", "next_run", "last_run")],
        F.when(F.col("__next").isNull(), "completed").otherwise("active").alias("status"),
        F.coalesce("__next", "next_run").alias("next_run"),
        at.alias("last_run"),
    )
