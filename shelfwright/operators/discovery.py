"""Which fields and terms a catalog has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.functions.text import decode_entities, is_user_key
from shelfwright.operators.fields import META_PREFIX, FieldRegistry
from shelfwright.operators.resolve import ATTRIBUTE_PREFIX


def meta_keys(catalog: Catalog, limit: int | None = None) -> DataFrame:
    """User-facing metadata keys; the first ``limit`` of them by name if that is given."""
    keys = catalog.meta.where((F.col("meta_key") != "") & is_user_key(F.col("meta_key"))).select("meta_key").distinct().orderBy("meta_key")
    return keys if limit is None else keys.limit(limit)


def brands(catalog: Catalog, registry: FieldRegistry, limit: int | None = None) -> DataFrame:
    """The brands in use; the first ``limit`` of them by name if that is given."""
    key = registry.brand_meta_key
    values = (
        catalog.meta.where((F.col("meta_key") == key) & (F.col("meta_value") != ""))
        .select(F.col("meta_value").alias("brand"))
        .distinct()
        .orderBy("brand")
    )
    values = values if limit is None else values.limit(limit)
    return values.select(F.lit(META_PREFIX + key).alias("field"), "brand")


def terms_with_counts(catalog: Catalog, taxonomy: str) -> DataFrame:
    """Terms of a taxonomy by name with how many objects carry each, unused ones included. Links
    are counted per term before the join, so a popular term is one row in it."""
    links = (
        catalog.object_terms.where(F.col("taxonomy") == taxonomy)
        .groupBy("term_id")
        .agg(F.count("*").alias("__count"))
    )
    return (
        catalog.terms.where(F.col("taxonomy") == taxonomy)
        .join(links, "term_id", "left")
        .select(
            "term_id",
            decode_entities(F.col("name")).alias("name"),
            F.coalesce("__count", F.lit(0).cast("bigint")).alias("count"),
        )
        .orderBy("name", "term_id")
    )


def attribute_terms(catalog: Catalog, prefix: str = "pa_") -> DataFrame:
    """Every term of every attribute, one row each."""
    return catalog.terms.where(F.col("taxonomy").startswith(prefix)).select(
        F.concat(F.lit(ATTRIBUTE_PREFIX), F.col("taxonomy")).alias("field"),
        "taxonomy",
        "term_id",
        "slug",
        decode_entities(F.col("name")).alias("name"),
    )


def attributes(catalog: Catalog, prefix: str = "pa_", taxonomies: Sequence[str] | None = None) -> DataFrame:
    """Attributes with their terms nested by name; an attribute without terms does not appear. The label is the
    taxonomy's name without prefix, in words.

    One attribute's terms are one value here, so name the ``taxonomies`` of a page where attributes may have many;
    ``attribute_terms`` has the terms as rows."""
    rows = attribute_terms(catalog, prefix)
    if taxonomies is not None:
        rows = rows.where(F.col("taxonomy").isin(*taxonomies))
    words = F.translate(F.substring("taxonomy", len(prefix) + 1, F.length("taxonomy")), "_-", "  ")
    label = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, F.length(words)))
    terms = F.array_sort(F.collect_list(F.struct("name", "term_id", "slug")))
    return (
        rows.groupBy("field", "taxonomy")
        .agg(terms.alias("terms"))
        .withColumns(
            {
                "label": label,
                "terms": F.transform(
                    "terms",
                    lambda t: F.struct(t["term_id"].alias("term_id"), t["slug"].alias("slug"), t["name"].alias("name")),
                ),
            }
        )
    )
