"""Turning a filter into matching objects.

However many conditions a filter has, it costs one pass over each long table it touches: the
metadata (and term links) it asks about are reduced to one row of flags per object, with partial
aggregation before the shuffle, and joined to the objects once. The whole filter is then one
boolean expression over a row, so AND, OR and negation take the same plan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.functions.numbers import decimal_prefix, literal_decimal, literal_int, literal_text
from shelfwright.operators.fields import META_PREFIX, Field
from shelfwright.operators.filters import Condition, Filter, Operator
from shelfwright.schema import Scope

ATTRIBUTE_PREFIX = "attribute:"
ATTRIBUTE_META_PREFIX = "attribute_"

_COMPARE = {
    Operator.EQUALS: lambda a, b: a == b,
    Operator.NOT_EQUALS: lambda a, b: a != b,
    Operator.GREATER_THAN: lambda a, b: a > b,
    Operator.GREATER_OR_EQUAL: lambda a, b: a >= b,
    Operator.LESS_THAN: lambda a, b: a < b,
    Operator.LESS_OR_EQUAL: lambda a, b: a <= b,
}
_ORDERED = (
    Operator.GREATER_THAN,
    Operator.GREATER_OR_EQUAL,
    Operator.LESS_THAN,
    Operator.LESS_OR_EQUAL,
)


class Facts:
    """Flags and values per object from a long table, gathered in one aggregation.

    Only rows that can set a flag or a value are read, and a heavily repeated object shrinks to
    one row per task before the shuffle."""

    def __init__(self, table: DataFrame, label: str, prefix: str):
        self._table = table
        self._label = label
        self._prefix = prefix
        self._aggregates: list[Column] = []
        self._wanted: list[Column] = []
        self._values: dict[str, str] = {}

    def flag(self, label: str, test: Column | None = None) -> Column:
        """True where some row with this label passes the test."""
        row = F.col(self._label) == F.lit(label)
        hit = row if test is None else row & test
        return F.coalesce(self._add(F.bool_or(hit), hit), F.lit(False))

    def value(self, label: str, value_column: str = "meta_value") -> Column:
        """The value under a label (the greatest, should there be several)."""
        if label not in self._values:
            row = F.col(self._label) == F.lit(label)
            self._add(F.max(F.when(row, F.col(value_column))), row)
            self._values[label] = f"{self._prefix}{len(self._aggregates) - 1}"
        return F.col(self._values[label])

    def _add(self, aggregate: Column, wanted: Column) -> Column:
        name = f"{self._prefix}{len(self._aggregates)}"
        self._aggregates.append(aggregate.alias(name))
        self._wanted.append(wanted)
        return F.col(name)

    def frame(self, key: str = "object_id") -> DataFrame | None:
        if not self._aggregates:
            return None
        wanted = reduce(lambda a, b: a | b, self._wanted)
        rows = self._table.where(wanted)
        return rows.groupBy(F.col("object_id").alias(key)).agg(*self._aggregates)


class Matcher:
    """One filter over one catalog. Ask for the values and presence flags the caller needs, then
    take ``frame()``: the matching rows of ``objects`` with those facts alongside."""

    facts = Facts

    def __init__(self, catalog: Catalog, flt: Filter, ignore_case: bool = False):
        self._open(catalog, flt.scope, ignore_case)
        self._predicate = self._filtered(flt)

    def _open(self, catalog: Catalog, scope: Scope, ignore_case: bool) -> None:
        self._catalog = catalog
        self._ignore_case = ignore_case
        self._meta = self.facts(catalog.meta_of(scope), "meta_key", "__m")
        self._terms = self.facts(catalog.object_terms, "taxonomy", "__t")
        self._scope = scope
        self._in_scope = (F.col("object_type") == self._scope.value) & (F.col("status") == "publish")
        # Products that leave pricing to their variations have no price of their own.
        self._priced = self._has_meta("_regular_price") if self._scope is Scope.PRODUCT else None

    def present(self, field: Field) -> Column:
        """True where the object carries a non-empty value for a field."""
        if field.meta_key is not None:
            return self._has_meta(field.meta_key)
        return F.coalesce(F.col(field.column).cast("string") != "", F.lit(False))

    def text(self, field: Field) -> Column:
        """A field's value as text."""
        stored = self._meta.value(field.meta_key) if field.meta_key is not None else F.col(field.column)
        return field.read(stored)

    def frame(self) -> DataFrame:
        rows = self._catalog.objects.where(self._in_scope)
        meta = self._meta.frame()
        if meta is not None:
            rows = rows.join(meta, "object_id", "left")
        if self._scope is Scope.VARIATION:
            # Term links sit on products; a variation has those of its parent.
            terms = self._terms.frame("parent_id")
            if terms is not None:
                # Variations are on the left, where adaptive execution splits those of a hot parent.
                rows = rows.join(terms, "parent_id", "left")
        else:
            terms = self._terms.frame()
            if terms is not None:
                rows = rows.join(terms, "object_id", "left")
        if self._priced is not None:
            rows = rows.where(self._priced)
        if self._predicate is not None:
            rows = rows.where(self._predicate)
        return rows

    def _has_meta(self, key: str) -> Column:
        return self._meta.flag(key, F.col("meta_value") != "")

    def _filtered(self, flt: Filter) -> Column | None:
        """A filter as one test over a row; None where it says nothing."""
        tests = [t for t in map(self._test, flt.conditions) if t is not None]
        if not tests:
            return None
        return reduce(lambda a, b: a | b if flt.relation == "OR" else a & b, tests)

    def _test(self, condition: Condition) -> Column | None:
        """One condition as a test, or None where it says nothing and is dropped."""
        field = condition.field
        if field == "price":
            return self._number("min_price", condition, literal_decimal)
        if field == "stock_quantity":
            return self._number("stock_quantity", condition, literal_int)
        if field in ("stock_status", "sku"):
            return self._text_test(F.col(field), condition)
        if field == "category":
            return self._term("product_cat", condition)
        if field == "tag":
            return self._term("product_tag", condition)
        if field.startswith(ATTRIBUTE_PREFIX):
            taxonomy = field[len(ATTRIBUTE_PREFIX) :]
            if not taxonomy:
                return None
            if self._scope is Scope.VARIATION:
                return self._own_attribute(taxonomy, condition)
            return self._term(taxonomy, condition)
        if field.startswith(META_PREFIX) and len(field) > len(META_PREFIX):
            return self._meta_value(field[len(META_PREFIX) :], condition)
        return None

    def _number(self, column: str, condition: Condition, literal) -> Column | None:
        operator, subject = condition.operator, F.col(column)
        if operator in _COMPARE:
            return _COMPARE[operator](subject, F.lit(literal(condition.value)))
        values = [literal(v) for v in condition.values()]
        if operator is Operator.BETWEEN and len(values) >= 2:
            return subject.between(F.lit(values[0]), F.lit(values[1]))
        if operator is Operator.IN and values:
            return subject.isin(*values)
        if operator is Operator.NOT_IN and values:
            return ~subject.isin(*values)
        return None

    def _text_test(self, subject: Column, condition: Condition) -> Column | None:
        """Equality, substring and membership on text; None for any other operator."""
        operator = condition.operator

        def fold(value: object) -> str:
            text = literal_text(value) or ""
            return text.lower() if self._ignore_case else text

        subject = F.lower(subject) if self._ignore_case else subject
        if operator in (Operator.EQUALS, Operator.NOT_EQUALS):
            return _COMPARE[operator](subject, F.lit(fold(condition.value)))
        if operator is Operator.CONTAINS:
            return subject.contains(F.lit(fold(condition.value)))
        values = [fold(v) for v in condition.values()]
        if operator is Operator.IN and values:
            return subject.isin(*values)
        if operator is Operator.NOT_IN and values:
            return ~subject.isin(*values)
        return None

    def _term(self, taxonomy: str, condition: Condition) -> Column | None:
        operator = condition.operator
        if operator is Operator.EXISTS:
            return self._terms.flag(taxonomy)
        if operator is Operator.NOT_EXISTS:
            return ~self._terms.flag(taxonomy)
        ids = _term_ids(condition)
        if not ids:
            return None
        linked = self._terms.flag(taxonomy, F.col("term_id").isin(*ids))
        return ~linked if operator is Operator.NOT_IN else linked

    def _own_attribute(self, taxonomy: str, condition: Condition) -> Column | None:
        """A variation stores the slug of its one value of an attribute as metadata."""
        key, operator = ATTRIBUTE_META_PREFIX + taxonomy, condition.operator
        if operator is Operator.EXISTS:
            return self._has_meta(key)
        if operator is Operator.NOT_EXISTS:
            return ~self._has_meta(key)
        ids = _term_ids(condition)
        if not ids:
            return None
        # At most one slug per id given. As literals they reach the scan of the metadata.
        chosen = self._catalog.terms.where(F.col("term_id").isin(*ids)).select("slug").distinct()
        slugs = [row["slug"] for row in chosen.collect()]
        if not slugs:
            return None
        has = self._meta.flag(key, F.col("meta_value").isin(*slugs))
        return ~has if operator is Operator.NOT_IN else has

    def _meta_value(self, key: str, condition: Condition) -> Column:
        """Some row with this key passes. Objects without the key never match, also under the
        negative comparisons; an operand that says nothing leaves a test for the key alone."""
        operator, subject = condition.operator, F.col("meta_value")
        if operator is Operator.NOT_EXISTS:
            return ~self._meta.flag(key)
        values = condition.values()
        if operator in _ORDERED:
            operand = F.lit(literal_decimal(condition.value))
            return self._meta.flag(key, _COMPARE[operator](decimal_prefix(subject), operand))
        if operator is Operator.BETWEEN and len(values) >= 2:
            low, high = (F.lit(literal_decimal(v)) for v in values[:2])
            return self._meta.flag(key, decimal_prefix(subject).between(low, high))
        return self._meta.flag(key, self._text_test(subject, condition))


class PackedFacts(Facts):
    """Facts whose flags are bits: a word of an object holds ``WORD`` of them, so hundreds of tests are a few numbers in the
    aggregation and in the shuffle."""

    WORD = 63

    def __init__(self, table: DataFrame, label: str, prefix: str):
        super().__init__(table, label, prefix)
        self._hits: list[Column] = []
        self._inputs: list[Column] = []
        self._labels: set[str] = set()

    def flag(self, label: str, test: Column | None = None) -> Column:
        row = F.col(self._label) == F.lit(label)
        word, bit = divmod(len(self._hits), self.WORD)
        self._hits.append(row if test is None else row & test)
        self._labels.add(label)
        packed = F.col(f"{self._prefix}bits{word}").bitwiseAND(F.lit(1 << bit).cast("bigint"))
        return F.coalesce(packed != 0, F.lit(False))

    def value(self, label: str, value_column: str = "meta_value") -> Column:
        if label not in self._values:
            self._values[label] = f"{self._prefix}value{len(self._inputs)}"
            self._inputs.append(F.when(F.col(self._label) == F.lit(label), F.col(value_column)))
            self._labels.add(label)
        return F.col(self._values[label])

    def frame(self, key: str = "object_id") -> DataFrame | None:
        if not self._labels:
            return None
        none, bits = F.lit(0).cast("bigint"), {}
        for at in range(0, len(self._hits), self.WORD):
            own = [F.when(h, F.lit(1 << k).cast("bigint")).otherwise(none) for k, h in enumerate(self._hits[at : at + self.WORD])]
            bits[f"{self._prefix}bits{at // self.WORD}"] = reduce(lambda a, b: a.bitwiseOR(b), own)
        values = {f"{self._prefix}value{i}": c for i, c in enumerate(self._inputs)}
        rows = self._table.where(F.col(self._label).isin(*sorted(self._labels)))
        rows = rows.select(F.col("object_id").alias(key), *[c.alias(n) for n, c in (bits | values).items()])
        return rows.groupBy(key).agg(*[F.bit_or(n).alias(n) for n in bits], *[F.max(n).alias(n) for n in values])


class ManyMatcher(Matcher):
    """Any number of filters of one scope over one catalog, in the passes of one filter: every different condition is one bit of
    an object, and a filter is a test of bits. ``frame()`` has all objects of the scope; ``test`` tells what a filter says."""

    facts = PackedFacts

    def __init__(self, catalog: Catalog, scope: Scope, ignore_case: bool = False):
        self._known: dict[str, Column | None] = {}
        self._predicate = None
        self._open(catalog, scope, ignore_case)

    def test(self, flt: Filter) -> Column:
        found = self._filtered(flt)
        return F.lit(True) if found is None else F.coalesce(found, F.lit(False))

    def _test(self, condition: Condition) -> Column | None:
        said = f"condition {condition.to_dict()!r}"
        if said not in self._known:
            self._known[said] = super()._test(condition)
        return self._known[said]

    def _has_meta(self, key: str) -> Column:
        said = f"meta {key}"
        if said not in self._known:
            self._known[said] = super()._has_meta(key)
        return self._known[said]


def _term_ids(condition: Condition) -> list[int]:
    return [i for i in map(literal_int, condition.values()) if i != 0]


def all_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def resolve(
    catalog: Catalog, flt: Filter, require_present: Iterable[Field] = (), ignore_case: bool = False
) -> DataFrame:
    """Ids of the objects that match and carry every required field, in no particular order."""
    matcher = Matcher(catalog, flt, ignore_case)
    applicable = all_of([matcher.present(f) for f in require_present])
    return matcher.frame().where(applicable).select("object_id")


def resolve_sorted(
    catalog: Catalog, flt: Filter, require_present: Iterable[Field] = (), ignore_case: bool = False
) -> DataFrame:
    """The same ids ascending, by a range-partitioned sort."""
    return resolve(catalog, flt, require_present, ignore_case).orderBy("object_id")


def count_matches(
    catalog: Catalog, flt: Filter, require_present: Iterable[Field] = (), ignore_case: bool = False
) -> DataFrame:
    return resolve(catalog, flt, require_present, ignore_case).agg(F.count("*").alias("matched"))


def scan_scope(catalog: Catalog, scope: Scope) -> DataFrame:
    """The published objects of one scope."""
    return catalog.objects.where(
        (F.col("object_type") == Scope.parse(scope).value) & (F.col("status") == "publish")
    )
