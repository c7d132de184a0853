"""A hand-made catalog for tests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import SparkSession

from shelfwright import schema as sc
from shelfwright.catalog import Catalog


class Shop:
    """Collects products and variations, then gives a ``Catalog``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.objects: list[tuple] = []
        self.meta: list[tuple] = []
        self.links: list[tuple] = []
        self.terms: list[tuple] = []

    def term(self, term_id: int, taxonomy: str, name: str) -> int:
        self.terms.append((term_id, taxonomy, name, name.lower()))
        return term_id

    def product(self, object_id, price="10", stock=5, stock_status="instock", sku="", title=None,
                status="publish", categories=(), links=(), meta=None):
        number = None if price in (None, "") else Decimal(price)
        title = f"Product {object_id}" if title is None else title
        self.objects.append((object_id, "product", 0, title, status, sku, number, number, stock, stock_status))
        if price is not None:
            self.meta.append((object_id, "_regular_price", price))
        for term_id in categories:
            self.links.append((object_id, "product_cat", term_id))
        for taxonomy, term_id in links:
            self.links.append((object_id, taxonomy, term_id))
        for key, value in (meta or {}).items():
            self.meta.append((object_id, key, value))
        return object_id

    def variation(self, object_id, parent, price="10", stock=7, sku="", meta=None):
        number = Decimal(price)
        self.objects.append((object_id, "variation", parent, "", "publish", sku, number, number, stock, "instock"))
        self.meta.append((object_id, "_regular_price", price))
        for key, value in (meta or {}).items():
            self.meta.append((object_id, key, value))
        return object_id

    def catalog(self) -> Catalog:
        make = self.spark.createDataFrame
        return Catalog(
            make(self.objects, sc.OBJECTS),
            make(self.meta, sc.META),
            make(self.terms, sc.TERMS),
            make(self.links, sc.OBJECT_TERMS),
        )


def ids(frame) -> list[int]:
    return sorted(r["object_id"] for r in frame.collect())


def meta_of(catalog: Catalog, key: str) -> dict[int, str]:
    rows = catalog.meta.where(catalog.meta.meta_key == key).collect()
    return {r["object_id"]: r["meta_value"] for r in rows}
