"""Pages of products, variations and change-log rows, with what a person needs to read them.

A page is at most 200 rows. Its ids are fetched first and then put into the following reads as
literals, which reach the scans (and select buckets, where tables are bucketed by object): the
wide columns of everything outside the page are never joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.functions.text import audit_name, page_name
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Filter
from shelfwright.operators.resolve import ATTRIBUTE_META_PREFIX, Matcher
from shelfwright.schema import CHANGE_STATUS_LABELS, CHANGES, ChangeStatus, Scope

MAX_PAGE = 200


def _page_size(per_page: int) -> int:
    if not 1 <= per_page <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows, not {per_page}")
    return per_page


def attribute_summary(meta: DataFrame) -> DataFrame:
    """The attribute values each object carries, in order of their keys, as one text."""
    rows = meta.where(F.col("meta_key").startswith(ATTRIBUTE_META_PREFIX) & (F.col("meta_value") != ""))
    pairs = F.array_sort(F.collect_list(F.struct("meta_key", "meta_value")))
    return (
        rows.groupBy("object_id")
        .agg(pairs.alias("pairs"))
        .select("object_id", F.array_join(F.col("pairs.meta_value"), ", ").alias("attributes"))
    )


def meta_pivot(meta: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Chosen metadata keys as columns (column name -> key); empty values come out null."""
    columns = [
        F.max(F.when(F.col("meta_key") == key, F.nullif(F.col("meta_value"), F.lit("")))).alias(name)
        for name, key in keys.items()
    ]
    return meta.where(F.col("meta_key").isin(*keys.values())).groupBy("object_id").agg(*columns)


def catalog_page(
    catalog: Catalog,
    flt: Filter,
    registry: FieldRegistry,
    page: int = 1,
    per_page: int = 25,
    after_id: int | None = None,
) -> DataFrame:
    """One page of matching objects by ascending id. ``after_id`` continues after the last id of
    the page before, at the same cost however deep the page; ``page`` counts from the start."""
    size = _page_size(per_page)
    # Only ids are matched, shuffled and ordered; the columns shown are read for the page alone.
    matched = Matcher(catalog, flt).frame().select("object_id", "parent_id")
    if after_id is not None:
        matched = matched.where(F.col("object_id") > after_id).orderBy("object_id")
    else:
        matched = matched.orderBy("object_id").offset((max(1, page) - 1) * size)
    return _page_rows(catalog, matched.limit(size).collect(), flt.scope, registry)


def ranked_page(catalog: Catalog, ids: DataFrame, scope: Scope, registry: FieldRegistry) -> DataFrame:
    """The rows of a page whose object and parent ids are known, as from a ``RankIndex``."""
    found = ids.limit(MAX_PAGE + 1).collect()
    if len(found) > MAX_PAGE:
        raise ValueError(f"a page has at most {MAX_PAGE} objects")
    return _page_rows(catalog, found, scope, registry)


def _page_rows(catalog: Catalog, page: Sequence, scope: Scope, registry: FieldRegistry) -> DataFrame:
    ids = [r["object_id"] for r in page]
    rows = catalog.objects.where(F.col("object_id").isin(*ids))
    meta = catalog.meta.where(F.col("object_id").isin(*ids))
    extra = meta_pivot(meta, {"sale_price": "_sale_price", "cost": registry.cost_meta_key})
    rows = rows.join(F.broadcast(extra), "object_id", "left")
    name = F.coalesce("title", F.lit(""))
    if scope is Scope.VARIATION:
        parents = sorted({r["parent_id"] for r in page})
        titles = catalog.objects.where(F.col("object_id").isin(*parents)).select(
            F.col("object_id").alias("parent_id"), F.col("title").alias("__parent_title")
        )
        rows = rows.join(F.broadcast(titles), "parent_id", "left")
        rows = rows.join(F.broadcast(attribute_summary(meta)), "object_id", "left")
        name = page_name(F.col("__parent_title"), F.col("attributes"))
    return rows.select(
        F.col("object_id").alias("id"),
        name.alias("name"),
        F.col("parent_id") if scope is Scope.VARIATION else F.lit(0).cast("bigint").alias("parent_id"),
        F.coalesce("sku", F.lit("")).alias("sku"),
        F.col("min_price").alias("price"),
        "max_price",
        "sale_price",
        "cost",
        F.coalesce("stock_status", F.lit("")).alias("stock_status"),
        "stock_quantity",
    ).orderBy("id")


def status_label(status: Column) -> Column:
    label = F.lit(CHANGE_STATUS_LABELS[int(ChangeStatus.PENDING)])
    for value, text in CHANGE_STATUS_LABELS.items():
        label = F.when(status == value, F.lit(text)).otherwise(label)
    return label


def sku_matches(catalog: Catalog, sku: str, ids: DataFrame | None = None) -> DataFrame:
    """Objects whose own SKU contains a text, and children of parents whose SKU does; only those among ``ids`` if given."""
    objects = catalog.objects.select("object_id", "parent_id", "sku")
    own = objects if ids is None else objects.join(ids, "object_id", "left_semi")
    parents = objects.where(F.col("sku").contains(sku)).select(F.col("object_id").alias("__parent"))
    rows = own.join(parents, F.col("parent_id") == F.col("__parent"), "left")
    return rows.where(F.col("sku").contains(sku) | F.col("__parent").isNotNull()).select("object_id")


def audit_rows(
    catalog: Catalog, log: DataFrame, operation_id: int, object_id: int = 0, sku: str = ""
) -> DataFrame:
    """The log rows of one operation, optionally of one object or of matching SKUs."""
    rows = log.where(F.col("operation_id") == operation_id)
    if object_id > 0:
        rows = rows.where(F.col("object_id") == object_id)
    if sku.strip():
        rows = rows.join(sku_matches(catalog, sku.strip(), rows.select("object_id")), "object_id", "left_semi")
    return rows.select(*CHANGES.fieldNames())


def audit_total(
    catalog: Catalog, log: DataFrame, operation_id: int, object_id: int = 0, sku: str = ""
) -> DataFrame:
    return audit_rows(catalog, log, operation_id, object_id, sku).agg(F.count("*").alias("total"))


def audit_page(
    catalog: Catalog,
    log: DataFrame,
    operation_id: int,
    page: int = 1,
    per_page: int = 50,
    object_id: int = 0,
    sku: str = "",
    after: tuple[int, int] | None = None,
) -> DataFrame:
    """One page of an operation's log with SKU, name and a status label for each row. ``after``, the object id and
    action of the last row of the page before, continues there at the same cost however deep; ``page`` counts
    from the start."""
    size = _page_size(per_page)
    rows = audit_rows(catalog, log, operation_id, object_id, sku)
    if after is not None:
        at, action = after
        rows = rows.where((F.col("object_id") > at) | ((F.col("object_id") == at) & (F.col("action_ix") > action)))
        rows = rows.orderBy("object_id", "action_ix")
    else:
        rows = rows.orderBy("object_id", "action_ix").offset((max(1, page) - 1) * size)
    found = rows.limit(size).collect()
    changes = log.sparkSession.createDataFrame(found, CHANGES)
    who = identify(catalog, sorted({r["object_id"] for r in found}))
    return (
        changes.join(F.broadcast(who), "object_id", "left")
        .select(
            "object_id",
            "action_ix",
            "object_type",
            F.coalesce("__sku", F.lit("")).alias("sku"),
            F.coalesce("__name", F.lit("")).alias("name"),
            "field_type",
            "field_key",
            "old_value",
            "new_value",
            status_label(F.col("status")).alias("status"),
        )
        .orderBy("object_id", "action_ix")
    )


def identify(catalog: Catalog, ids: Sequence[int]) -> DataFrame:
    """SKU and name of the objects of one page; a variation shows its parent's where its own are
    empty. ``ids`` is a page, so every frame below has at most that many rows."""
    if len(ids) > MAX_PAGE:
        raise ValueError(f"a page has at most {MAX_PAGE} objects")
    own = catalog.objects.where(F.col("object_id").isin(*ids)).select(
        "object_id", "object_type", "parent_id", "title", "sku"
    )
    parent_ids = [
        r[0]
        for r in own.where(F.col("object_type") == Scope.VARIATION.value)
        .select("parent_id")
        .distinct()
        .collect()
    ]
    parents = catalog.objects.where(F.col("object_id").isin(*parent_ids)).select(
        F.col("object_id").alias("parent_id"),
        F.col("title").alias("__parent_title"),
        F.col("sku").alias("__parent_sku"),
    )
    attributes = attribute_summary(catalog.meta.where(F.col("object_id").isin(*ids)))
    is_variation = F.col("object_type") == Scope.VARIATION.value
    return (
        own.join(F.broadcast(parents), "parent_id", "left")
        .join(F.broadcast(attributes), "object_id", "left")
        .select(
            "object_id",
            F.when(is_variation, F.coalesce(F.nullif("sku", F.lit("")), "__parent_sku"))
            .otherwise(F.col("sku"))
            .alias("__sku"),
            F.when(is_variation, audit_name(F.col("__parent_title"), F.col("attributes")))
            .otherwise(F.col("title"))
            .alias("__name"),
        )
    )


def pending_head(log: DataFrame, operation_id: int, limit: int) -> DataFrame:
    """The first pending rows by object and action."""
    return (
        log.where(
            (F.col("operation_id") == operation_id) & (F.col("status") == int(ChangeStatus.PENDING))
        )
        .orderBy("object_id", "action_ix")
        .limit(max(1, limit))
    )
