"""Filters as data: a flat list of conditions joined by one relation, over one scope."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

from shelfwright.schema import Scope


class Operator(str, Enum):
    EQUALS = "="
    NOT_EQUALS = "!="
    GREATER_THAN = ">"
    GREATER_OR_EQUAL = ">="
    LESS_THAN = "<"
    LESS_OR_EQUAL = "<="
    BETWEEN = "between"
    IN = "in"
    NOT_IN = "not_in"
    CONTAINS = "contains"
    EXISTS = "exists"
    NOT_EXISTS = "not_exists"


@dataclass(frozen=True)
class Condition:
    """``value`` is a scalar, a pair, a list or null, depending on the operator."""

    field: str
    operator: Operator
    value: Any = None

    def __post_init__(self) -> None:
        if not self.field:
            raise ValueError("a condition field must not be empty")
        object.__setattr__(self, "operator", Operator(self.operator))

    def values(self) -> list[Any]:
        if self.value is None:
            return []
        if isinstance(self.value, Mapping):
            return list(self.value.values())
        if isinstance(self.value, (list, tuple, set, frozenset)):
            return list(self.value)
        return [self.value]

    def to_dict(self) -> dict[str, Any]:
        return {"field": self.field, "operator": self.operator.value, "value": self.value}


@dataclass(frozen=True)
class Filter:
    conditions: tuple[Condition, ...] = ()
    relation: str = "AND"
    scope: Scope = Scope.PRODUCT

    def __post_init__(self) -> None:
        object.__setattr__(self, "conditions", tuple(self.conditions))
        object.__setattr__(self, "relation", "OR" if str(self.relation).upper() == "OR" else "AND")
        object.__setattr__(self, "scope", Scope.parse(self.scope))

    def with_condition(self, condition: Condition) -> "Filter":
        return Filter((*self.conditions, condition), self.relation, self.scope)

    def to_dict(self) -> dict[str, Any]:
        return {
            "relation": self.relation,
            "scope": self.scope.value,
            "conditions": [c.to_dict() for c in self.conditions],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "Filter":
        conditions = [
            Condition(str(c.get("field") or ""), Operator(c.get("operator")), c.get("value"))
            for c in data.get("conditions") or ()
        ]
        return cls(tuple(conditions), data.get("relation") or "AND", data.get("scope"))

    @classmethod
    def from_json(cls, text: str) -> "Filter":
        return cls.from_dict(json.loads(text))


def filter_from_form(
    scope: Scope | str = Scope.PRODUCT,
    price_min: float | None = None,
    price_max: float | None = None,
    stock_status: str = "",
    sku: str = "",
    categories: Sequence[int] = (),
    tags: Sequence[int] = (),
    brands: Sequence[str] = (),
    attribute: str = "",
    attribute_values: Sequence[int] = (),
    brand_field: str = "meta:_brand",
) -> Filter:
    """The filter behind a search form: each filled-in box adds one condition. An attribute
    applies to variations only; without values it asks for any value of the attribute."""
    scope = Scope.parse(scope)
    found: list[Condition] = []
    if price_min is not None:
        found.append(Condition("price", Operator.GREATER_OR_EQUAL, price_min))
    if price_max is not None:
        found.append(Condition("price", Operator.LESS_OR_EQUAL, price_max))
    if stock_status:
        found.append(Condition("stock_status", Operator.EQUALS, stock_status))
    if sku.strip():
        found.append(Condition("sku", Operator.CONTAINS, sku.strip()))
    if categories:
        found.append(Condition("category", Operator.IN, list(categories)))
    if tags:
        found.append(Condition("tag", Operator.IN, list(tags)))
    if brands and brand_field:
        found.append(Condition(brand_field, Operator.IN, list(brands)))
    if scope is Scope.VARIATION and attribute:
        if attribute_values:
            found.append(Condition(attribute, Operator.IN, list(attribute_values)))
        else:
            found.append(Condition(attribute, Operator.EXISTS))
    return Filter(tuple(found), "AND", scope)
