"""Which fields can be read and changed, and where each is stored."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright.functions.numbers import is_numeric, numeric
from shelfwright.schema import PRICE_TYPE

META_PREFIX = "meta:"
POST_FIELD = "post_field"
META = "meta"


class UnsupportedField(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """One field. Exactly one of ``column`` (of ``objects``) and ``meta_key`` says where it lives.

    ``reader`` and ``writer`` convert between the stored text and the field's value."""

    key: str
    label: str
    field_type: str
    storage_key: str
    column: str | None = None
    meta_key: str | None = None
    reader: Callable[[Column], Column] | None = None
    writer: Callable[[Column], Column] | None = None
    # The text as the field can hold it; null where it cannot hold it at all.
    holder: Callable[[Column], Column] | None = None

    def read(self, stored: Column) -> Column:
        """The field's text: an absent metadata key reads as '', an empty column as null."""
        text = stored.cast("string")
        if self.meta_key is not None:
            text = F.coalesce(text, F.lit(""))
        return self.reader(text) if self.reader else text

    def hold(self, value: Column) -> Column:
        """A new value as it will be read back once stored. Where this is null, the value is not set."""
        return self.holder(value) if self.holder else value

    def write(self, value: Column) -> Column:
        """The text to store; metadata has no null, so null is stored as ''."""
        stored = self.writer(value) if self.writer else value
        return F.coalesce(stored, F.lit("")) if self.meta_key is not None else stored


def _core(
    key: str,
    label: str,
    column: str | None = None,
    meta_key: str | None = None,
    holder: Callable[[Column], Column] | None = None,
) -> Field:
    return Field(key, label, POST_FIELD, key, column=column, meta_key=meta_key, holder=holder)


def _whole_number(value: Column) -> Column:
    """A number cut to an integer, as text; null for anything else."""
    return F.when(is_numeric(value), F.trim(value)).try_cast("decimal(38,10)").try_cast("bigint").cast("string")


def _price(value: Column) -> Column:
    """Any text but a number too large for the lookup prices."""
    fits = ~is_numeric(value) | numeric(value).try_cast(PRICE_TYPE).isNotNull()
    return F.when(fits, value)


CORE_FIELDS = (
    _core("regular_price", "Regular price", meta_key="_regular_price", holder=_price),
    _core("sale_price", "Sale price", meta_key="_sale_price", holder=_price),
    _core("stock_quantity", "Stock quantity", column="stock_quantity", holder=_whole_number),
    _core("stock_status", "Stock status", column="stock_status"),
    _core("weight", "Weight", meta_key="_weight"),
    _core("name", "Name", column="title"),
    _core("sku", "SKU", column="sku"),
    _core("tax_class", "Tax class", meta_key="_tax_class"),
    _core("status", "Status", column="status"),
)

PRICE_FIELDS = ("regular_price", "sale_price")
PRICE_META_KEYS = ("_regular_price", "_sale_price")


class FieldRegistry:
    """Core fields, any ``meta:<key>``, and whatever a user registers on top."""

    def __init__(self, cost_meta_key: str = "_cost", brand_meta_key: str = "_brand"):
        self.cost_meta_key = cost_meta_key or "_cost"
        self.brand_meta_key = brand_meta_key or "_brand"
        self._fields = {f.key: f for f in CORE_FIELDS}
        # Formula variable -> field key.
        self._variables = {
            "regular_price": "regular_price",
            "sale_price": "sale_price",
            "stock": "stock_quantity",
            "weight": "weight",
            "cost": META_PREFIX + self.cost_meta_key,
        }

    def register(self, field: Field) -> None:
        if (field.column is None) == (field.meta_key is None):
            raise ValueError("a field is stored in a column or under a metadata key")
        self._fields[field.key] = field

    def get(self, key: str) -> Field:
        if key in self._fields:
            return self._fields[key]
        if key.startswith(META_PREFIX) and len(key) > len(META_PREFIX):
            storage = key[len(META_PREFIX) :]
            return Field(key, storage, META, storage, meta_key=storage)
        raise UnsupportedField(f"no field {key!r}")

    def handles(self, key: str) -> bool:
        try:
            self.get(key)
        except UnsupportedField:
            return False
        return True

    def by_storage(self, field_type: str, storage_key: str) -> Field | None:
        """The field a change-log row refers to, or null when none owns it any more."""
        for field in self._fields.values():
            if (field.field_type, field.storage_key) == (field_type, storage_key):
                return field
        if field_type == META and storage_key:
            return self.get(META_PREFIX + storage_key)
        return None

    def key_of(self, field_type: Column, storage_key: Column) -> Column:
        """``by_storage`` over columns: the key of the field each change-log row refers to, null when none owns it."""
        is_meta = (field_type == META) & (storage_key != "")
        found = F.when(is_meta, F.concat(F.lit(META_PREFIX), storage_key))
        # The first field registered for a place is its field.
        for field in reversed(self._fields.values()):
            owns = (field_type == field.field_type) & (storage_key == field.storage_key)
            found = F.when(owns, F.lit(field.key)).otherwise(found)
        return found

    def all_fields(self) -> list[Field]:
        return list(self._fields.values())

    def variable(self, name: str) -> Field:
        if name not in self._variables:
            raise UnsupportedField(f"unknown variable {name!r}")
        return self.get(self._variables[name])

    def variable_names(self) -> list[str]:
        return list(self._variables)


def unique(fields: Iterable[Field]) -> list[Field]:
    return list({f.key: f for f in fields}.values())
