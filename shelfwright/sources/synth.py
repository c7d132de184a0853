"""A synthetic catalog for load tests, generated in parallel and repeatably.

Every value comes from a digest of the row's number and the value's name, so any engine can
recompute it and a lost partition regenerates the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.schema import META, OBJECT_TERMS, OBJECTS, PRICE_TYPE, TERMS
from shelfwright.sources.star import term_id

# The vocabulary of generated catalogs.
CATEGORIES = (
    "Apparel",
    "Footwear",
    "Accessories",
    "Home & Kitchen",
    "Electronics",
    "Toys & Games",
    "Sports",
    "Beauty",
    "Garden",
    "Office",
    "Automotive",
    "Pet Supplies",
)
COLORS = ("Red", "Blue", "Green", "Black", "White", "Yellow")
SIZES = ("S", "M", "L", "XL")
BRANDS = ("Acme", "Globex", "Initech", "Umbrella", "Soylent", "Hooli", "Stark", "Wayne")

MARKER = "_generated"
MARKER_VALUE = "1"
CHILDREN = 8  # ids reserved per product: itself and its variations


def _draw(number: Column, what: str, low: int, high: int) -> Column:
    """An integer in [low, high] fixed by a number and a name."""
    digest = F.md5(F.concat(number.cast("string"), F.lit(f":{what}")))
    value = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return value % (high - low + 1) + low


def _pick(number: Column, what: str, options: tuple) -> Column:
    choices = F.array(*[F.lit(o) for o in options])
    return F.element_at(choices, _draw(number, what, 1, len(options)).cast("int"))


def numbers(spark: SparkSession, products: int) -> DataFrame:
    return spark.range(1, products + 1).select(F.col("id").alias("n"))


def synth_rows(numbers: DataFrame, variable_percent: int = 0) -> DataFrame:
    """One row per generated object: simple products, parents, and a variation per size."""
    n = F.col("n")
    products = numbers.select(
        n, (_draw(n, "variable", 1, 100) <= variable_percent).alias("is_parent"), F.lit(0).alias("child")
    )
    children = products.where("is_parent").select(
        n, F.lit(False).alias("is_parent"), F.explode(F.sequence(F.lit(1), F.lit(len(SIZES)))).alias("child")
    )
    rows = products.unionByName(children)
    draw = F.concat(n.cast("string"), F.lit("/"), F.col("child").cast("string"))
    is_variation = F.col("child") > 0
    cents = F.when(~F.col("is_parent"), _draw(draw, "price", 499, 49999))
    in_stock = _draw(draw, "in_stock", 1, 100) <= 85
    discounted = ~is_variation & (_draw(draw, "discount", 1, 100) <= 20)
    price = (cents / 100).cast("decimal(19,2)")
    margin = _draw(draw, "margin", 20, 60)
    stock = (
        F.when(F.col("is_parent"), F.lit(None))
        .when(is_variation, _draw(draw, "quantity", 0, 200))
        .when(in_stock, _draw(draw, "quantity", 1, 300))
        .otherwise(F.lit(0))
    )
    return rows.select(
        n,
        "child",
        (n * CHILDREN + F.col("child")).cast("bigint").alias("object_id"),
        F.when(is_variation, "variation").otherwise("product").alias("object_type"),
        F.when(is_variation, n * CHILDREN).otherwise(F.lit(0)).cast("bigint").alias("parent_id"),
        F.when(is_variation, "")
        .when(F.col("is_parent"), F.concat(F.lit("Generated variable "), n.cast("string")))
        .otherwise(F.concat(F.lit("Generated product "), n.cast("string")))
        .alias("title"),
        F.when(is_variation, "")
        .when(F.col("is_parent"), F.concat(F.lit("GEN-V-"), n.cast("string")))
        .otherwise(F.concat(F.lit("GEN-"), n.cast("string")))
        .alias("sku"),
        price.alias("price"),
        F.when(discounted & ~F.col("is_parent"), F.floor(cents * 17 / 20 + F.lit(0.5)) / 100)
        .cast("decimal(19,2)")
        .alias("sale"),
        F.floor(cents * 100 / (margin + 100) + F.lit(0.5)).cast("bigint").alias("cost_cents"),
        stock.cast("bigint").alias("stock_quantity"),
        F.when(F.col("is_parent") | (stock > 0), "instock").otherwise("outofstock").alias("stock_status"),
        _pick(n, "category", CATEGORIES).alias("category"),
        F.when(~is_variation & ~F.col("is_parent"), _pick(n, "color", COLORS)).alias("color"),
        F.when(is_variation, F.element_at(F.array(*[F.lit(s) for s in SIZES]), F.greatest(F.col("child"), F.lit(1)))).alias("size"),
        _pick(draw, "brand", BRANDS).alias("brand"),
    )


def synth_catalog(numbers: DataFrame, variable_percent: int = 0) -> Catalog:
    """``numbers`` has one distinct number ``n`` per product."""
    rows = synth_rows(numbers, variable_percent)
    current = F.coalesce("sale", "price").cast(PRICE_TYPE)
    objects = rows.select(
        "object_id",
        "object_type",
        "parent_id",
        "title",
        F.lit("publish").alias("status"),
        "sku",
        current.alias("min_price"),
        current.alias("max_price"),
        "stock_quantity",
        "stock_status",
    ).select(*OBJECTS.fieldNames())

    def pair(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("meta_key"), value.cast("string").alias("meta_value"))

    parent = F.col("price").isNull()
    entries = F.array(
        pair(MARKER, F.lit(MARKER_VALUE)),
        pair("_brand", F.col("brand")),
        F.when(~parent, pair("_cost", (F.col("cost_cents") / 100).cast("decimal(19,2)"))),
        pair("_regular_price", F.coalesce(F.col("price").cast("string"), F.lit(""))),
        F.when(F.col("child") == 0, pair("_sale_price", F.coalesce(F.col("sale").cast("string"), F.lit("")))),
        F.when(~parent, pair("_stock", F.col("stock_quantity"))),
        F.when(F.col("size").isNotNull(), pair("attribute_pa_size", F.lower("size"))),
    )
    meta = rows.select("object_id", F.inline(F.array_compact(entries))).select(*META.fieldNames())

    def ids(taxonomy: str, names: tuple) -> Column:
        pairs = [F.lit(x) for name in names for x in (name, term_id(taxonomy, name))]
        return F.create_map(*pairs)

    def link(taxonomy: str, names: tuple, name: Column) -> Column:
        found = F.struct(F.lit(taxonomy).alias("taxonomy"), F.try_element_at(ids(taxonomy, names), name).alias("term_id"))
        return F.when(name.isNotNull(), found)

    links = F.array(
        link("product_cat", CATEGORIES, F.col("category")), link("pa_color", COLORS, F.col("color"))
    )
    sizes = F.when(
        parent,
        F.array(
            *[
                F.struct(F.lit("pa_size").alias("taxonomy"), F.lit(term_id("pa_size", s)).alias("term_id"))
                for s in SIZES
            ]
        ),
    ).otherwise(F.array())
    object_terms = (
        rows.where("child = 0")
        .select("object_id", F.inline(F.concat(F.array_compact(links), sizes)))
        .select(*OBJECT_TERMS.fieldNames())
    )
    vocabulary = [("product_cat", CATEGORIES), ("pa_color", COLORS), ("pa_size", SIZES)]
    terms = numbers.sparkSession.createDataFrame(
        [(term_id(t, n), t, n, _slug(n)) for t, names in vocabulary for n in names], TERMS
    )
    return Catalog(objects, meta, terms, object_terms)


def _slug(name: str) -> str:
    return "-".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def marked_objects(meta: DataFrame, key: str = MARKER) -> DataFrame:
    return meta.where(F.col("meta_key") == key).select("object_id").distinct()


def drop_marked(catalog: Catalog, key: str = MARKER) -> Catalog:
    """The catalog without the objects that carry a marker, and without what hangs on them. The ids of marked objects, each once,
    are hashed by partition: no table is sorted."""
    marked = marked_objects(catalog.meta, key).hint("shuffle_hash")

    def keep(table: DataFrame) -> DataFrame:
        return table.join(marked, "object_id", "left_anti").select(*table.columns)

    return catalog.with_tables(
        objects=keep(catalog.objects), meta=keep(catalog.meta), object_terms=keep(catalog.object_terms)
    )
