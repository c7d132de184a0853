"""Running recurring rules. A rule's filter is resolved anew each time, so objects that have come
to match since the last run are picked up."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.operators.actions import actions_from_json, check_actions
from shelfwright.operators.changes import Template, changeset, changesets
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Filter
from shelfwright.operators.oplog import active_operation
from shelfwright.operators.rules import due_rules
from shelfwright.plans.operation import Outcome, run_operation
from shelfwright.sources.store import ChangeLog


@dataclass(frozen=True)
class RuleRun:
    """A rule that has run, and what came of it; without an outcome, it is to be paused. ``rules.advance``
    reschedules the rule."""

    rule: Row
    outcome: Outcome | None


def rule_changeset(catalog: Catalog, rule: Row, operation_id: int, registry: FieldRegistry) -> DataFrame:
    """The change set of one run of a rule."""
    return changeset(
        catalog,
        Filter.from_json(rule["filter_json"]),
        actions_from_json(rule["actions_json"]),
        operation_id,
        registry,
    )


@dataclass(frozen=True)
class DueRules:
    """What all due rules would do. ``changes``: one change set per template, which is a filter with actions; its
    number is the operation id. ``rules``: id and template of every due rule, a null template for one that cannot be
    read, which should be paused."""

    changes: DataFrame | None
    rules: DataFrame


def due_changesets(catalog: Catalog, rules: DataFrame, now: datetime, registry: FieldRegistry) -> DueRules:
    """Change sets for all due rules against one catalog version, in the table passes of one rule per scope however many there
    are. Rules that say the same share a template and its rows. The different filters and actions, which people have typed in,
    become the plan's expressions."""
    due = due_rules(rules, now)
    said = ["filter_json", "actions_json"]
    numbered, templates = [], []
    for row in due.select(*said).distinct().orderBy(*said).toLocalIterator():
        number = len(numbered) + 1
        try:
            template = Template(number, Filter.from_json(row["filter_json"]), tuple(actions_from_json(row["actions_json"])))
            check_actions(template.actions, registry)
        except (KeyError, TypeError, ValueError):
            numbered.append((row["filter_json"], row["actions_json"], None))
            continue
        numbered.append((row["filter_json"], row["actions_json"], number))
        templates.append(template)
    changes = changesets(catalog, templates, registry)
    named = rules.sparkSession.createDataFrame(numbered, "filter_json string, actions_json string, template long")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in said]
    return DueRules(changes, due.alias("d").join(named.alias("t"), same).select("d.id", "t.template"))


def next_due(rules: DataFrame, now: datetime) -> Row | None:
    """The rule that has waited longest."""
    return due_rules(rules, now).first()


def run_next_due(
    catalog: Catalog,
    rules: DataFrame,
    operations: DataFrame,
    now: datetime,
    operation_id: int,
    registry: FieldRegistry,
    log: ChangeLog,
) -> RuleRun | None:
    """Run the longest-waiting rule, unless another operation is active. Rules run one at a time
    because each must see what the one before has written. A rule that cannot be read comes back without an outcome,
    to be paused, so that it does not hold up the others."""
    if active_operation(operations).first() is not None:
        return None
    rule = next_due(rules, now)
    if rule is None:
        return None
    try:
        flt = Filter.from_json(rule["filter_json"])
        actions = actions_from_json(rule["actions_json"])
        check_actions(actions, registry)
    except (KeyError, TypeError, ValueError):
        return RuleRun(rule, None)
    return RuleRun(rule, run_operation(catalog, flt, actions, operation_id, registry, log))
