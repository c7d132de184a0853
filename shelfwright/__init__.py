"""Bulk catalog changes on Spark: filter, preview, freeze, derive, apply, undo and audit."""

from shelfwright.catalog import Catalog
from shelfwright.operators.actions import FormulaAction, SetValue
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Condition, Filter

__all__ = ["Catalog", "Condition", "FieldRegistry", "Filter", "FormulaAction", "SetValue"]
