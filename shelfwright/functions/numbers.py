"""Reading numbers out of text columns, and printing them back."""

from __future__ import annotations

import json
import math
import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in stored text. Surrounding blanks are allowed; type
# suffixes, NaN and Infinity (all of which a bare cast would accept) are not.
NUMERIC_TEXT = r"^[ \t\n\r\x0B\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$"
NUMERIC_PREFIX = r"^[ \t\n\r\x0B\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)"

_PREFIX_RE = re.compile(NUMERIC_PREFIX)


def is_numeric(text: Column) -> Column:
    """True for text that is a number from end to end; null text is not numeric."""
    return F.coalesce(text.rlike(NUMERIC_TEXT), F.lit(False))


def numeric(text: Column) -> Column:
    """Text as a double, or null when it is empty, absent or not a number."""
    return F.when(is_numeric(text), text.try_cast("double"))


def decimal_prefix(text: Column) -> Column:
    """Text as DECIMAL(20,4) by its numeric prefix, and 0 where it has none.

    This is how the filters compare metadata numerically, so ``< 5`` also matches '' and 'n/a'.
    """
    prefix = F.regexp_extract(text, NUMERIC_PREFIX, 1)
    number = F.nullif(prefix, F.lit("")).try_cast("decimal(20,4)")
    return F.when(text.isNotNull(), F.coalesce(number, F.lit(0).cast("decimal(20,4)")))


def number_text(x: Column) -> Column:
    """A double as stored text: no trailing zeros, at most 14 significant digits."""
    size = F.abs(x)
    shown = x
    # From nine integer digits on, fourteen significant digits leave fewer than six decimals.
    for decimals in range(5, -1, -1):
        shown = F.when(size >= F.lit(10.0 ** (13 - decimals)), F.round(x, decimals)).otherwise(shown)
    plain = F.regexp_replace(shown.try_cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    # Very large and very small values are shown with an exponent: 1.0E+15, 2.5E-5.
    digits = F.regexp_replace(F.format_string("%.13E", x), r"(\.[0-9]+?)0+E", "$1E")
    exponent = F.regexp_replace(digits, r"E([+-])0+([0-9])", "E$1$2")
    return F.when((size >= F.lit(1e14)) | ((size < F.lit(1e-4)) & (size > F.lit(0.0))), exponent).otherwise(plain)


def literal_float(value: object) -> float:
    """A filter operand as a float: numeric prefix of text, 0 when there is none."""
    if isinstance(value, (bool, int, float, Decimal)):
        return float(value)
    if isinstance(value, str):
        found = _PREFIX_RE.match(value)
        return float(found.group(1)) if found else 0.0
    return 0.0 if not value else 1.0


def literal_int(value: object) -> int:
    """A filter operand as an integer, truncated toward zero."""
    if isinstance(value, bool) or isinstance(value, int):
        return int(value)
    number = literal_float(value)
    return math.trunc(number) if math.isfinite(number) else 0


def literal_decimal(value: object) -> Decimal:
    """A filter operand at six decimals, shortened to four where that loses nothing, so that it
    compares with a DECIMAL(19,4) column without a cast that would block pushdown."""
    number = literal_float(value)
    if not math.isfinite(number):
        raise ValueError(f"not a finite number: {value!r}")
    six = Decimal(repr(number)).quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
    four = six.quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)
    return four if four == six else six


def literal_text(value: object) -> str | None:
    """A literal as stored text; null stays null and nested values become JSON."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "1" if value else ""
    if isinstance(value, float):
        return _float_text(value)
    if isinstance(value, (dict, list, tuple)):
        return json.dumps(value, separators=(",", ":")).replace("/", "\\/")
    return str(value)


def _float_text(value: float) -> str:
    if not math.isfinite(value):
        return {"inf": "INF", "-inf": "-INF"}.get(str(value), "NAN")
    if value == 0:
        return "0"
    shown = format(value, ".14G")
    if "E" in shown:
        digits, exponent = shown.split("E")
        digits = digits if "." in digits else digits + ".0"
        return f"{digits}E{int(exponent):+d}"
    return shown
