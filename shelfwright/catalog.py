"""The four DataFrames that make up one version of a catalog."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.schema import META, Scope


@dataclass(frozen=True)
class Catalog:
    """``objects`` and ``meta`` are large; both are keyed by ``object_id``, which is what they
    should be bucketed by when stored (see ``shelfwright.sources.store``)."""

    objects: DataFrame
    meta: DataFrame
    terms: DataFrame
    object_terms: DataFrame
    #: ``meta`` with the ``object_type`` of each row's object, where that is known without a join.
    owned_meta: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        if "meta" in tables:
            tables = {"owned_meta": None} | tables
        return replace(self, **tables)

    def meta_of(self, scope: Scope) -> DataFrame:
        """Metadata of the objects of one scope, as far as its owners are known: what a filter over that scope need not read
        is left out before anything is aggregated or shuffled."""
        if self.owned_meta is None:
            return self.meta
        return self.owned_meta.where(F.col("object_type") == scope.value).select(*META.fieldNames())
