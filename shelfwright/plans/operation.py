"""Whole operations: freeze, settle and apply, and the same for an undo."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.operators.actions import Action
from shelfwright.operators.changes import apply_changes, changeset, derive, freeze
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Filter
from shelfwright.operators.undo import revert_now
from shelfwright.schema import ConflictPolicy
from shelfwright.sources.store import ChangeLog, snapshot


class TooManyObjects(ValueError):
    pass


@dataclass(frozen=True)
class Outcome:
    changes: DataFrame
    catalog: Catalog
    fields: tuple[str, ...]


def run_operation(
    catalog: Catalog,
    flt: Filter,
    actions: Sequence[Action],
    operation_id: int,
    registry: FieldRegistry,
    log: ChangeLog,
    max_objects: int | None = None,
) -> Outcome:
    """Resolve the filter and settle its targets in one pass, and write the change set before
    anything is applied. The new catalog is lazy: write it with ``CatalogStore``."""
    rows = _limited(changeset(catalog, flt, actions, operation_id, registry), max_objects)
    return _outcome(catalog, log.write_settled(rows, operation_id), actions, registry)


def queue_operation(
    catalog: Catalog,
    flt: Filter,
    actions: Sequence[Action],
    operation_id: int,
    registry: FieldRegistry,
    log: ChangeLog,
    max_objects: int | None = None,
) -> DataFrame:
    """Freeze an operation's targets now, to be run later with ``run_queued``."""
    return log.write_frozen(_limited(freeze(catalog, flt, actions, operation_id, registry), max_objects), operation_id)


def run_queued(
    catalog: Catalog,
    actions: Sequence[Action],
    operation_id: int,
    registry: FieldRegistry,
    log: ChangeLog,
) -> Outcome:
    """Settle frozen targets against the catalog as it has become. Safe to repeat: a run that
    was interrupted starts again from the same targets."""
    rows = derive(catalog, log.frozen(operation_id), actions, registry)
    return _outcome(catalog, log.write_settled(rows, operation_id), actions, registry)


def run_undo(
    catalog: Catalog,
    parent: Outcome,
    parent_id: int,
    undo_id: int,
    policy: ConflictPolicy | str,
    registry: FieldRegistry,
    log: ChangeLog,
) -> Outcome:
    """Revert an operation against the catalog as it is now. The result can itself be undone."""
    rows = revert_now(catalog, parent.changes, parent_id, undo_id, parent.fields, policy, registry)
    changes = log.write_settled(rows, undo_id)
    return Outcome(changes, apply_changes(catalog, changes, parent.fields, registry), parent.fields)


def _limited(rows: DataFrame, max_objects: int | None) -> DataFrame:
    """Refuse an operation over more objects than allowed, before its log says anything of it. The filter is resolved once: what
    is counted is then written."""
    if max_objects is None:
        return rows
    rows = snapshot(rows, "limited")
    if rows.where(F.col("action_ix") == 0).limit(max_objects + 1).count() > max_objects:
        raise TooManyObjects(f"more than {max_objects} objects match")
    return rows


def _outcome(
    catalog: Catalog, changes: DataFrame, actions: Sequence[Action], registry: FieldRegistry
) -> Outcome:
    fields = tuple(a.field for a in actions)
    return Outcome(changes, apply_changes(catalog, changes, fields, registry), fields)
