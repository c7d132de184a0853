"""What a bulk change does to a field."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright.functions import formula as fm
from shelfwright.functions.numbers import literal_text, number_text
from shelfwright.operators.fields import Field, FieldRegistry, unique


@dataclass(frozen=True)
class SetValue:
    """Set a field to a literal. A null literal changes nothing: its rows are skipped."""

    field: str
    value: Any

    def reads(self, registry: FieldRegistry) -> list[Field]:
        return []

    def new_text(self, registry: FieldRegistry, texts: Mapping[str, Column]) -> Column:
        return F.lit(literal_text(self.value)).cast("string")

    def to_dict(self) -> dict[str, Any]:
        return {"type": "set", "field": self.field, "value": self.value}


@dataclass(frozen=True)
class FormulaAction:
    """Set a field to the result of a formula; rows with a null result are skipped."""

    field: str
    formula: fm.Formula

    def reads(self, registry: FieldRegistry) -> list[Field]:
        return unique(registry.variable(v) for v in self.formula.variables)

    def new_number(self, registry: FieldRegistry, texts: Mapping[str, Column]) -> Column:
        return self.formula.column({v: texts[registry.variable(v).key] for v in self.formula.variables})

    def new_text(self, registry: FieldRegistry, texts: Mapping[str, Column]) -> Column:
        return number_text(self.new_number(registry, texts))

    def to_dict(self) -> dict[str, Any]:
        return {"type": "formula", "field": self.field, "formula": self.formula.spec}


Action = Union[SetValue, FormulaAction]


def action_from_dict(data: Mapping[str, Any]) -> Action:
    field = str(data.get("field") or "")
    if not field:
        raise ValueError("an action must name a field")
    kind = data.get("type")
    if kind == "set":
        return SetValue(field, data.get("value"))
    if kind == "formula":
        return FormulaAction(field, fm.from_spec(data.get("formula")))
    raise ValueError(f"unknown action type {kind!r}")


def actions_from_json(text: str) -> list[Action]:
    items = json.loads(text)
    if not items:
        raise ValueError("an operation needs at least one action")
    return [action_from_dict(item) for item in items]


def actions_to_json(actions: Sequence[Action]) -> str:
    return json.dumps([a.to_dict() for a in actions])


def check_actions(actions: Sequence[Action], registry: FieldRegistry) -> None:
    """Reject unsupported targets, and two actions on one field, which would share a delta."""
    if not actions:
        raise ValueError("an operation needs at least one action")
    targets = [registry.get(a.field) for a in actions]
    stored = {(f.field_type, f.storage_key) for f in targets}
    if len(stored) < len(targets):
        raise ValueError("two actions target the same field")
    for action in actions:
        action.reads(registry)


def reads_of(actions: Sequence[Action], registry: FieldRegistry) -> list[Field]:
    """Every field the actions read, once."""
    return unique(f for a in actions for f in a.reads(registry))
