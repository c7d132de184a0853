"""Arithmetic for new values, as column functions and as composable formulas.

The column functions take and return doubles, and any null input gives null. ``Formula`` adds
what a bare ``Column`` cannot tell: which catalog fields an expression reads. Write
``roundto(var("cost") * 1.35, 0.99)``; precedence and brackets are Python's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright.functions.numbers import numeric

RESULT_DECIMALS = 6


def divide(a: Column, b: Column) -> Column:
    """Division; a zero divisor gives null."""
    return F.try_divide(a, b)


def round_col(x: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.round(x, 0)


def ceil_col(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor_col(x: Column) -> Column:
    return F.floor(x).cast("double")


def roundto_col(x: Column, step: Column) -> Column:
    """Nearest multiple of ``step``; a zero step gives null."""
    return F.round(F.try_divide(x, step), 0) * step


def min_col(*xs: Column) -> Column:
    return F.when(_all_present(xs), F.least(*xs))


def max_col(*xs: Column) -> Column:
    return F.when(_all_present(xs), F.greatest(*xs))


def result(x: Column) -> Column:
    """The final value of a formula, rounded to take out binary noise."""
    return F.round(x, RESULT_DECIMALS)


def percent_factor(percent: float) -> float:
    """-10 becomes 0.9."""
    return round(1 + float(percent) / 100, RESULT_DECIMALS)


def percent_change(x: Column, percent: float) -> Column:
    return x * F.lit(percent_factor(percent))


def _all_present(xs: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])


Operand = Union["Formula", int, float]

# name -> (column function, fewest arguments, most arguments)
_CALLS: dict[str, tuple[Callable[..., Column], int, int | None]] = {
    "+": (lambda a, b: a + b, 2, 2),
    "-": (lambda a, b: a - b, 2, 2),
    "*": (lambda a, b: a * b, 2, 2),
    "/": (divide, 2, 2),
    "neg": (lambda a: -a, 1, 1),
    "round": (round_col, 1, 1),
    "ceil": (ceil_col, 1, 1),
    "floor": (floor_col, 1, 1),
    "abs": (F.abs, 1, 1),
    "roundto": (roundto_col, 2, 2),
    "min": (min_col, 2, None),
    "max": (max_col, 2, None),
}


class Formula:
    """An expression over named variables. ``spec`` is its JSON form: a number, ``["var", name]``
    or ``[function, argument, ...]``."""

    def __init__(self, spec: object):
        self.spec = spec

    @property
    def variables(self) -> tuple[str, ...]:
        names: dict[str, None] = {}

        def walk(node: object) -> None:
            if isinstance(node, list):
                if node[0] == "var":
                    names[node[1]] = None
                else:
                    for argument in node[1:]:
                        walk(argument)

        walk(self.spec)
        return tuple(names)

    def column(self, texts: Mapping[str, Column]) -> Column:
        """The result as a double, given each variable's stored text."""

        def build(node: object) -> Column:
            if not isinstance(node, list):
                return F.lit(float(node))
            if node[0] == "var":
                return numeric(texts[node[1]])
            return _CALLS[node[0]][0](*[build(argument) for argument in node[1:]])

        return result(build(self.spec))

    def __add__(self, other: Operand) -> "Formula":
        return call("+", self, other)

    def __radd__(self, other: Operand) -> "Formula":
        return call("+", other, self)

    def __sub__(self, other: Operand) -> "Formula":
        return call("-", self, other)

    def __rsub__(self, other: Operand) -> "Formula":
        return call("-", other, self)

    def __mul__(self, other: Operand) -> "Formula":
        return call("*", self, other)

    def __rmul__(self, other: Operand) -> "Formula":
        return call("*", other, self)

    def __truediv__(self, other: Operand) -> "Formula":
        return call("/", self, other)

    def __rtruediv__(self, other: Operand) -> "Formula":
        return call("/", other, self)

    def __neg__(self) -> "Formula":
        return call("neg", self)

    def __pos__(self) -> "Formula":
        return self


def var(name: str) -> Formula:
    return Formula(["var", name])


def number(value: float) -> Formula:
    return Formula(value)


def call(name: str, *arguments: Operand) -> Formula:
    """Apply one of the closed set of functions; a wrong name or argument count raises."""
    if name not in _CALLS:
        raise ValueError(f"unknown function {name!r}")
    _, fewest, most = _CALLS[name]
    if len(arguments) < fewest or (most is not None and len(arguments) > most):
        raise ValueError(f"{name} does not take {len(arguments)} argument(s)")
    return Formula([name, *[_spec(a) for a in arguments]])


def _spec(argument: Operand) -> object:
    if isinstance(argument, Formula):
        return argument.spec
    if isinstance(argument, bool) or not isinstance(argument, (int, float)):
        raise TypeError(f"not a formula operand: {argument!r}")
    return argument


def from_spec(spec: object) -> Formula:
    """Rebuild a formula from its JSON form, checking names and argument counts."""
    if isinstance(spec, list) and spec:
        if spec[0] == "var" and len(spec) == 2 and isinstance(spec[1], str):
            return var(spec[1])
        return call(spec[0], *[from_spec(a) for a in spec[1:]])
    return Formula(_spec(spec))


def round_(x: Operand) -> Formula:
    return call("round", x)


def ceil(x: Operand) -> Formula:
    return call("ceil", x)


def floor(x: Operand) -> Formula:
    return call("floor", x)


def abs_(x: Operand) -> Formula:
    return call("abs", x)


def roundto(x: Operand, step: Operand) -> Formula:
    return call("roundto", x, step)


def min_(*xs: Operand) -> Formula:
    return call("min", *xs)


def max_(*xs: Operand) -> Formula:
    return call("max", *xs)


def percent(field_variable: str, by: float) -> Formula:
    """A field changed by a percentage."""
    return var(field_variable) * percent_factor(by)
