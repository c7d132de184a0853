"""A catalog, its logs and its rules as projections of star-schema tables.

Parts are products and part-supplier pairs seen in line items are variations; orders are
operations, line items are changes, customers own rules, and events are price updates.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.schema import CHANGE_COLUMNS, OPERATIONS, PRICE_TYPE, RULES
from shelfwright.sources.store import snapshot

MARKER_KEY = "attribute_pa_line"

# Variation ids lie above every part key and leave 30 bits each for part and supplier.
VARIATION_BASE = 1 << 60
PART_STRIDE = 1 << 30


def term_id(taxonomy: str, name: str) -> int:
    """The id ``term_id_column`` gives a term."""
    return int(hashlib.md5(f"{taxonomy}|{name}".encode()).hexdigest()[:15], 16)


def term_id_column(taxonomy: Column, name: Column) -> Column:
    """An id that depends on the term alone, so links need no lookup of the numbering."""
    digest = F.md5(F.concat(taxonomy, F.lit("|"), name))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _money(x: Column) -> Column:
    return x.cast("decimal(19,2)").cast("string")


# Declared, so that opening a table reads no file footers.
SCHEMAS = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


class Star:
    def __init__(self, spark: SparkSession, path: str):
        # The tables hold times without a zone, and they are UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._spark = spark
        self._path = path
        self._tables: dict[str, DataFrame] = {}
        self._pairs: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._spark.read.schema(SCHEMAS[name]).parquet(f"{self._path}/{name}.parquet")
        return self._tables[name]

    def catalog(self, settled: bool = False) -> Catalog:
        """``settled``: variations are aggregated now and written, instead of by each table that is read."""
        if settled:
            self._pairs = snapshot(self._sold(), "sold")
        owned = self._meta()
        return Catalog(self._objects(), owned.drop("object_type"), self._terms(), self._links(), owned)

    def _sold(self) -> DataFrame:
        """Variations: one per part and supplier of a line item."""
        if self._pairs is not None:
            return self._pairs
        return self.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(
            F.min("l_extendedprice").alias("low"),
            F.max("l_extendedprice").alias("high"),
            F.sum("l_quantity").alias("quantity"),
        )

    @staticmethod
    def _variation_id() -> Column:
        return (F.lit(VARIATION_BASE) + F.col("l_partkey") * PART_STRIDE + F.col("l_suppkey")).cast("bigint")

    def _objects(self) -> DataFrame:
        key = F.col("p_partkey")
        products = self.table("part").select(
            (key + 1).cast("bigint").alias("object_id"),
            F.lit("product").alias("object_type"),
            F.lit(0).cast("bigint").alias("parent_id"),
            F.col("p_name").alias("title"),
            F.when(key % 20 == 19, "draft").otherwise("publish").alias("status"),
            F.when(key % 10 == 9, "").otherwise(F.concat(F.lit("SKU-"), key.cast("string"))).alias("sku"),
            F.col("p_retailprice").cast(PRICE_TYPE).alias("min_price"),
            F.col("p_retailprice").cast(PRICE_TYPE).alias("max_price"),
            F.when(key % 13 != 0, F.col("p_size")).cast("bigint").alias("stock_quantity"),
            F.when(F.col("p_size") % 7 == 0, "outofstock").otherwise("instock").alias("stock_status"),
        )
        variations = self._sold().select(
            self._variation_id().alias("object_id"),
            F.lit("variation").alias("object_type"),
            (F.col("l_partkey") + 1).cast("bigint").alias("parent_id"),
            F.lit("").alias("title"),
            F.lit("publish").alias("status"),
            F.lit("").alias("sku"),
            F.col("low").cast(PRICE_TYPE).alias("min_price"),
            F.col("high").cast(PRICE_TYPE).alias("max_price"),
            F.col("quantity").cast("bigint").alias("stock_quantity"),
            F.lit("instock").alias("stock_status"),
        )
        return products.unionByName(variations)

    def _meta(self) -> DataFrame:
        """Metadata with the type of its owner. All keys of a product unfold from its part, and all keys of a variation from
        one aggregate."""
        key = F.col("p_partkey")
        price = F.col("p_retailprice")

        def named(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("meta_key"), value.alias("meta_value"))

        cost = F.when(key % 7 == 0, "").when(key % 11 == 0, "n/a").otherwise(_money(price - 120))
        of_part = F.array_compact(
            F.array(
                named("_regular_price", F.when(key % 4 == 0, "").otherwise(_money(price))),
                named("_sale_price", F.when(key % 5 == 0, _money(price - 50)).otherwise("")),
                named("_brand", F.col("p_brand")),
                F.when(key % 3 != 0, named("_cost", cost)),
            )
        )
        of_pair = F.array_compact(
            F.array(
                named("_regular_price", _money(F.col("low"))),
                named("attribute_pa_size", F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string"))),
                F.when(
                    F.col("l_suppkey") % 2 == 0,
                    named(MARKER_KEY, F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string"))),
                ),
            )
        )
        products = self.table("part").select(
            (key + 1).cast("bigint").alias("object_id"), F.lit("product").alias("object_type"), F.inline(of_part)
        )
        variations = self._sold().select(
            self._variation_id().alias("object_id"), F.lit("variation").alias("object_type"), F.inline(of_pair)
        )
        return products.unionByName(variations)

    def _named_links(self) -> DataFrame:
        """(object_id, taxonomy, name): each part unfolds into its links in one scan."""
        key = F.col("p_partkey")
        words = F.split("p_name", " ")
        links = F.array_compact(
            F.array(
                F.struct(F.lit("product_cat").alias("taxonomy"), F.col("p_type").alias("name")),
                F.when(
                    key % 6 != 0,
                    F.struct(F.lit("product_tag").alias("taxonomy"), F.try_element_at(words, F.lit(2)).alias("name")),
                ),
                F.when(
                    key % 8 != 1,
                    F.struct(F.lit("pa_color").alias("taxonomy"), F.try_element_at(words, F.lit(1)).alias("name")),
                ),
            )
        )
        return self.table("part").select((key + 1).cast("bigint").alias("object_id"), F.inline(links))

    def _links(self) -> DataFrame:
        return self._named_links().select(
            "object_id", "taxonomy", term_id_column(F.col("taxonomy"), F.col("name")).alias("term_id")
        )

    def _terms(self) -> DataFrame:
        part = self.table("part")
        words = F.split("p_name", " ")
        named = part.select(
            F.inline(
                F.array(
                    F.struct(F.lit("product_cat").alias("taxonomy"), F.col("p_type").alias("name")),
                    F.struct(F.lit("product_tag").alias("taxonomy"), F.try_element_at(words, F.lit(2)).alias("name")),
                    F.struct(F.lit("pa_color").alias("taxonomy"), F.try_element_at(words, F.lit(1)).alias("name")),
                )
            )
        ).distinct()
        sizes = self.table("supplier").select(
            F.lit("pa_size").alias("taxonomy"),
            F.concat(F.lit("S"), (F.col("s_suppkey") % 4).cast("string")).alias("name"),
        )
        terms = named.unionByName(sizes.distinct())
        return terms.select(
            term_id_column(F.col("taxonomy"), F.col("name")).alias("term_id"),
            "taxonomy",
            "name",
            F.lower("name").alias("slug"),
        )

    def operations(self) -> DataFrame:
        key = F.col("o_orderkey")
        placed = F.col("o_orderdate").cast("timestamp")
        status = (
            F.when(key % 50 == 0, "queued")
            .when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "running")
            .otherwise("paused")
        )
        source = F.element_at(F.array(*[F.lit(s) for s in ("ui", "cli", "schedule", "undo")]), (key % 4 + 1).cast("int"))
        target = key % 5
        rows = self.table("orders").select(
            (key + 1).cast("bigint").alias("id"),
            placed.alias("created_at"),
            F.when(status == "completed", placed + F.make_dt_interval(F.lit(1))).alias("completed_at"),
            F.when(
                status != "queued", placed + F.make_dt_interval(mins=(key % 1440).cast("int"))
            ).alias("last_progress_at"),
            F.when(key % 11 == 0, 0).otherwise(F.col("o_custkey") + 1).cast("bigint").alias("user_id"),
            status.alias("status"),
            source.alias("source"),
            F.when(key % 4 == 3, key).cast("bigint").alias("parent_op_id"),
            F.lit('{"relation": "AND", "scope": "product", "conditions": []}').alias("filter_json"),
            F.lit('[{"type": "set", "field": "stock_status", "value": "instock"}]').alias("actions_json"),
            target.cast("bigint").alias("target_count"),
            F.least(target, key % 3).cast("bigint").alias("processed"),
            F.lit(0).cast("bigint").alias("failed"),
            F.lit("safe").alias("mode"),
            F.lit(100).cast("bigint").alias("batch_size"),
            F.when(key % 4 == 3, "skip").alias("conflict_policy"),
        )
        return rows.select(*OPERATIONS.fieldNames())

    def changes(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_orderstatus")
        running = (F.col("o_orderkey") % 50 != 0) & (F.col("o_orderstatus") == "O")
        grouped = (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_partkey")
            .agg(F.min("l_extendedprice").alias("low"), F.min(F.ascii("l_returnflag")).alias("flag"))
        )
        joined = grouped.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        status = (
            F.when(running, 0)
            .when(F.col("flag") == ord("A"), 1)
            .when(F.col("flag") == ord("N"), 3)
            .otherwise(2)
        )
        low = F.col("low").cast("decimal(19,2)")
        return joined.select(
            (F.col("l_orderkey") + 1).cast("bigint").alias("operation_id"),
            F.lit("product").alias("object_type"),
            (F.col("l_partkey") + 1).cast("bigint").alias("object_id"),
            F.lit(0).cast("int").alias("action_ix"),
            F.lit("post_field").alias("field_type"),
            F.lit("regular_price").alias("field_key"),
            low.cast("string").alias("old_value"),
            F.when(status == 1, (low - 1).cast("decimal(19,2)").cast("string")).alias("new_value"),
            status.cast("int").alias("status"),
        ).select(*CHANGE_COLUMNS)

    def users(self) -> DataFrame:
        return self.table("customer").select(
            (F.col("c_custkey") + 1).cast("bigint").alias("user_id"), F.col("c_name").alias("display_name")
        )

    def rules(self) -> DataFrame:
        key = F.col("c_custkey")
        kinds = F.array(*[F.lit(r) for r in ("once", "hourly", "daily", "weekly", "monthly")])
        start = F.lit("2026-01-31 09:00:00").cast("timestamp")
        brand = '{"relation": "AND", "scope": "product", "conditions": [{"field": "meta:_brand", "operator": "=", "value": "%s"}]}'
        filters = F.array(*[F.lit(brand % b) for b in ("Brand#11", "Brand#12", "Brand#13")])
        raise_price = '[{"type": "formula", "field": "regular_price", "formula": ["*", ["var", "regular_price"], 1.5]}]'
        rows = self.table("customer").select(
            (key + 1).cast("bigint").alias("id"),
            F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("Rule "), key.cast("string"))).alias("name"),
            F.element_at(filters, (key % 3 + 1).cast("int")).alias("filter_json"),
            F.lit(raise_price).alias("actions_json"),
            F.element_at(kinds, (key % 5 + 1).cast("int")).alias("recurrence"),
            F.when(key % 9 == 0, "paused").otherwise("active").alias("status"),
            (start - F.make_dt_interval(hours=key.cast("int"))).alias("next_run"),
            F.lit(None).cast("timestamp").alias("last_run"),
            (F.floor(key / 2) * 4 + 3).cast("bigint").alias("last_op_id"),
            F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com"))).alias("notify_email"),
        )
        return rows.select(*RULES.fieldNames())
