"""Undo: reverting an operation's applied changes, with drift detection.

An undo is an operation of its own. Its rows are the parent's applied rows as pending targets;
settling them compares what each object holds now with what the parent wrote. Undoing an undo
therefore re-applies the original change with the same functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.functions.values import values_equal
from shelfwright.operators.changes import read_fields
from shelfwright.operators.fields import FieldRegistry
from shelfwright.schema import CHANGE_COLUMNS, ChangeStatus, ConflictPolicy, Scope

DELTA_KEY = ["object_id", "field_type", "field_key"]


def _applied(log: DataFrame, operation_id: int) -> DataFrame:
    return log.where(
        (F.col("operation_id") == operation_id) & (F.col("status") == int(ChangeStatus.APPLIED))
    )


def undo_targets(log: DataFrame, parent_id: int, undo_id: int) -> DataFrame:
    """The parent's applied rows as pending rows of the undo operation."""
    replaced = {
        "operation_id": F.lit(undo_id).cast("bigint"),
        "old_value": F.lit(None).cast("string"),
        "new_value": F.lit(None).cast("string"),
        "status": F.lit(int(ChangeStatus.PENDING)).cast("int"),
    }
    rows = _applied(log, parent_id)
    return rows.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in CHANGE_COLUMNS])


def revert(
    catalog: Catalog,
    log: DataFrame,
    undo_rows: DataFrame,
    parent_id: int,
    fields: Sequence[str],
    policy: ConflictPolicy | str,
    registry: FieldRegistry,
) -> DataFrame:
    """Settle an undo's pending rows. ``fields`` names what the parent operation could change.

    A row is skipped when its delta is no longer in the log, when no field owns it, or when the
    object has drifted under the skip policy; it fails when the object is gone."""
    is_pending = F.col("status") == int(ChangeStatus.PENDING)
    pending, settled = undo_rows.where(is_pending), undo_rows.where(~is_pending)
    rows = pending.join(_parent_deltas(log, parent_id), DELTA_KEY, "left")
    outcome = _settle(catalog, rows, fields, policy, registry)
    return outcome.unionByName(settled.select(*CHANGE_COLUMNS))


def revert_now(
    catalog: Catalog,
    log: DataFrame,
    parent_id: int,
    undo_id: int,
    fields: Sequence[str],
    policy: ConflictPolicy | str,
    registry: FieldRegistry,
    scope: Scope | None = None,
) -> DataFrame:
    """Freeze and settle an undo in one step. The targets come with their deltas, so nothing but
    the catalog is joined, and of that only ``scope``, if all targets are known to be of it."""
    rows = _applied(log, parent_id).withColumns(
        {
            "operation_id": F.lit(undo_id).cast("bigint"),
            "__delta": F.struct("old_value", "new_value"),
        }
    )
    return _settle(catalog, rows, fields, policy, registry, scope)


def _settle(
    catalog: Catalog,
    rows: DataFrame,
    fields: Sequence[str],
    policy: ConflictPolicy | str,
    registry: FieldRegistry,
    scope: Scope | None = None,
) -> DataFrame:
    """Outcome of undo targets that carry their parent's delta."""
    wide, texts = read_fields(catalog, [registry.get(k) for k in fields], rows, scope)
    rows = rows.join(wide, "object_id", "left")
    current, owned = _current(fields, registry, texts)
    usable = F.col("__delta").isNotNull() & owned
    drift = ~values_equal(F.col("__current"), F.col("__delta.new_value"))
    skip = ~F.col("__usable")
    if ConflictPolicy.parse(policy) is ConflictPolicy.SKIP:
        skip = skip | drift
    status = (
        F.when(F.col("__found").isNull(), int(ChangeStatus.FAILED))
        .when(skip, int(ChangeStatus.SKIPPED))
        .otherwise(int(ChangeStatus.APPLIED))
    )
    rows = rows.withColumns({"__usable": usable, "__current": F.when(usable, current)})
    rows = rows.withColumn("__status", status.cast("int"))
    replaced = {
        "old_value": F.when(F.col("__found"), F.col("__current")),
        "new_value": F.when(F.col("__status") == int(ChangeStatus.APPLIED), F.col("__delta.old_value")),
        "status": F.col("__status"),
    }
    return rows.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in CHANGE_COLUMNS])


def applied_head(log: DataFrame, operation_id: int, limit: int) -> DataFrame:
    """The first applied rows by object and action."""
    return _applied(log, operation_id).orderBy("object_id", "action_ix").limit(max(0, limit))


def undo_preview_sample(
    catalog: Catalog,
    log: DataFrame,
    parent_id: int,
    fields: Sequence[str],
    policy: ConflictPolicy | str,
    registry: FieldRegistry,
    limit: int = 20,
) -> DataFrame:
    """What an undo would do to the first ``limit`` applied rows."""
    rows = _with_current(catalog, applied_head(log, parent_id, limit), fields, registry)
    drift = ~values_equal(F.col("__current"), F.col("new_value"))
    skips = drift if ConflictPolicy.parse(policy) is ConflictPolicy.SKIP else F.lit(False)
    field = F.col("field_key")
    for key in fields:
        f = registry.get(key)
        field = F.when(_is(f), F.lit(f.key)).otherwise(field)
    return rows.select(
        "object_id",
        field.alias("field"),
        F.col("__current").alias("current"),
        F.col("old_value").alias("restore_to"),
        drift.alias("drift"),
        F.when(skips, "skip").otherwise("revert").alias("action"),
    )


def undo_preview_totals(
    catalog: Catalog, log: DataFrame, parent_id: int, fields: Sequence[str], registry: FieldRegistry
) -> DataFrame:
    """How many applied rows an undo would revert, and how many of them have drifted."""
    rows = _with_current(catalog, _applied(log, parent_id), fields, registry)
    drift = ~values_equal(F.col("__current"), F.col("new_value"))
    return rows.agg(F.count("*").alias("total"), F.count_if(drift).alias("drifted"))


def _parent_deltas(log: DataFrame, parent_id: int) -> DataFrame:
    delta = F.struct("old_value", "new_value")
    return (
        _applied(log, parent_id)
        .groupBy(*DELTA_KEY)
        .agg(F.max_by(delta, "action_ix").alias("__delta"))
    )


def _with_current(
    catalog: Catalog, rows: DataFrame, fields: Sequence[str], registry: FieldRegistry
) -> DataFrame:
    wide, texts = read_fields(catalog, [registry.get(k) for k in fields], rows)
    current, _ = _current(fields, registry, texts)
    joined = rows.join(wide, "object_id", "left")
    return joined.withColumn("__current", F.when(F.col("__found"), current))


def _is(field) -> Column:
    return (F.col("field_type") == field.field_type) & (F.col("field_key") == field.storage_key)


def _current(
    fields: Sequence[str], registry: FieldRegistry, texts: Mapping[str, Column]
) -> tuple[Column, Column]:
    """The current text of the field each row refers to, and whether one of the fields owns it."""
    current, owned = F.lit(None).cast("string"), F.lit(False)
    for key in fields:
        field = registry.get(key)
        current = F.when(_is(field), texts[field.key]).otherwise(current)
        owned = owned | _is(field)
    return current, owned
