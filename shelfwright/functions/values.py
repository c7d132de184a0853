"""Comparison of stored values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright.functions.numbers import is_numeric


def values_equal(a: Column, b: Column) -> Column:
    """Tolerant equality, never null: null equals only null, numbers compare by value ('5' and
    '5.00'), and all other text compares exactly."""
    both_numeric = is_numeric(a) & is_numeric(b)
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(both_numeric, a.try_cast("double") == b.try_cast("double"))
        .otherwise(a == b)
    )
