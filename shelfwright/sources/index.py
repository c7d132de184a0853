"""Stored indexes of a catalog version: SKUs by their trigrams, for substring searches that scan no objects, and ids by their
rank, for pages that sort nothing.

The postings hold, under each trigram of an object's own SKU, the SKU and the object's id, and beside it the variations that inherit
the SKU, as lists of ids: a trigram costs a row per SKU, not one per variation. They are clustered by trigram, so a search reads
the row groups of its own trigrams, and the exact test is made on the SKU that came along. Texts shorter than a trigram scan
the list of SKUs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.catalog import Catalog
from shelfwright.functions.numbers import literal_text
from shelfwright.operators.filters import Filter, Operator
from shelfwright.operators.resolve import Matcher
from shelfwright.schema import Scope
from shelfwright.sources.store import is_complete

GRAM = 3
#: Variations in a list, about: those of a parent with more are dealt over several lists.
LISTED = 1000
OWN = "object_id long, object_type string, status string, parent_id long, sku string"
#: One object with its own SKU, or variations of one parent, alike in type and status, with the parent's.
LIST = "owner long, object_type string, status string, sku string, inherited boolean, list long, ids array<long>"


def grams(text: Column) -> Column:
    """The different trigrams of a text in lower case; none for shorter texts."""
    lower = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(lower) - GRAM + 1)
    return F.when(F.length(lower) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substr(lower, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def text_grams(text: str) -> list[str]:
    lower = text.lower()
    return sorted({lower[k : k + GRAM] for k in range(len(lower) - GRAM + 1)})


class SkuIndex:
    """Written once beside a catalog version; ``write`` replaces a half-written one."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path.rstrip("/")

    def write(self, catalog: Catalog, partitions: int | None = None) -> "SkuIndex":
        if is_complete(self._spark, f"{self._path}/complete"):
            raise ValueError(f"there is an index at {self._path} already")
        own = catalog.objects.select("object_id", "object_type", "status", "parent_id", F.coalesce("sku", F.lit("")).alias("sku"))
        own.write.mode("overwrite").parquet(f"{self._path}/skus")
        self._lists(self._own()).write.mode("overwrite").parquet(f"{self._path}/inherited")
        single = self._own().where("sku <> ''").select(
            F.col("object_id").alias("owner"), "object_type", "status", "sku", F.lit(False).alias("inherited"), F.lit(0).cast("long").alias("list"), F.array("object_id").alias("ids")
        )
        postings = single.unionByName(self._inherited()).select(F.explode(grams(F.col("sku"))).alias("gram"), "*")
        # The trailing columns give the range of a popular trigram somewhere to be cut.
        by = [F.col("gram"), F.col("inherited"), F.col("owner"), F.col("list")]
        ranged = postings.repartitionByRange(partitions, *by) if partitions else postings.repartitionByRange(*by)
        ranged.sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{self._path}/postings")
        self._spark.range(1).write.mode("overwrite").parquet(f"{self._path}/complete")
        return self

    @staticmethod
    def _lists(own: DataFrame) -> DataFrame:
        """The variations of each parent with a SKU, in lists of bounded length."""
        children = own.drop("sku").where("parent_id IS NOT NULL")
        large = children.groupBy(F.col("parent_id").alias("__large")).agg(F.ceil(F.count("*") / LISTED).alias("__lists")).where("__lists > 1")
        dealt = children.join(large, F.col("parent_id") == F.col("__large"), "left").withColumn(
            "list", F.when(F.col("__lists").isNull(), 0).otherwise(F.pmod(F.xxhash64("object_id"), "__lists"))
        )
        # An aggregated list leaves nulls out.
        null = F.when(F.bool_or(F.col("object_id").isNull()), F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))
        lists = dealt.groupBy("parent_id", "list", "object_type", "status").agg(F.concat(F.collect_set("object_id"), null).alias("ids"))
        parents = own.where("sku <> ''").select(F.col("object_id").alias("owner"), "sku").distinct()
        return lists.join(parents, F.col("parent_id") == F.col("owner")).select("owner", "object_type", "status", "sku", F.lit(True).alias("inherited"), "list", "ids")

    def _own(self) -> DataFrame:
        return self._spark.read.schema(OWN).parquet(f"{self._path}/skus")

    def _inherited(self) -> DataFrame:
        return self._spark.read.schema(LIST).parquet(f"{self._path}/inherited")

    @staticmethod
    def _entries(lists: DataFrame) -> DataFrame:
        return lists.select(F.explode("ids").alias("object_id"), "object_type", "status", "sku", "inherited")

    def skus(self) -> DataFrame:
        """Every object with its own SKU, and every variation with its parent's, should that have one."""
        return self._own().drop("parent_id").withColumn("inherited", F.lit(False)).unionByName(self._entries(self._inherited()))

    def postings(self) -> DataFrame:
        return self._spark.read.schema(f"gram string, {LIST}").parquet(f"{self._path}/postings")

    def search(self, text: str, ignore_case: bool = False) -> DataFrame:
        """Entries whose SKU contains a text. An empty text is contained in all."""
        wanted = text_grams(text)
        subject, operand = (F.lower("sku"), text.lower()) if ignore_case else (F.col("sku"), text)
        # Lower-casing can change a text's length; such texts, and short ones, are looked for in the list itself.
        if not wanted or len(text.lower()) != len(text) or not text.isascii():
            return self.skus().where(subject.contains(operand))
        # A SKU with the text lies under each of its trigrams and is taken from the first.
        rows = self.postings().where(F.col("gram").isin(*wanted) & subject.contains(operand))
        return self._entries(rows.where(F.array_position(F.lit(wanted), F.col("gram")) == 1))

    def sku_matches(self, text: str) -> DataFrame:
        """Objects whose own SKU contains a text, and children of parents whose SKU does."""
        return self.search(text).select("object_id").distinct()


class RankIndex:
    """Ids of a filter in order, each with its rank. A page of any depth reads the row groups its ranks lie in.

    Ranks come from ranges of ids that are counted apart: one number per range is added up in a single task."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path.rstrip("/")

    def write(self, rows: DataFrame) -> "RankIndex":
        """``rows``: object_id (unique) and parent_id."""
        if is_complete(self._spark, f"{self._path}/complete"):
            raise ValueError(f"there is an index at {self._path} already")
        ranges = rows.select("object_id", "parent_id").repartitionByRange("object_id").withColumn("part", F.spark_partition_id())
        ranges.write.mode("overwrite").parquet(f"{self._path}/ranges")
        kept = self._spark.read.schema(f"{self._ROW}, part int").parquet(f"{self._path}/ranges")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = kept.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        inside = Window.partitionBy("part").orderBy("object_id")
        ranked = kept.withColumn("rank", F.row_number().over(inside)).join(starts, "part").select((F.col("rank") + F.col("before")).alias("rank"), "object_id", "parent_id")
        ranked.sortWithinPartitions("rank").write.mode("overwrite").parquet(f"{self._path}/ranked")
        self._spark.range(1).write.mode("overwrite").parquet(f"{self._path}/complete")
        return self

    _ROW = "object_id long, parent_id long"

    def page(self, page: int, per_page: int) -> DataFrame:
        """object_id and parent_id of the n-th page, from 1, in no particular order."""
        first = (max(1, page) - 1) * per_page
        ranked = self._spark.read.schema(f"rank long, {self._ROW}").parquet(f"{self._path}/ranked")
        return ranked.where(F.col("rank").between(first + 1, first + per_page)).select("object_id", "parent_id")


def resolve_indexed(catalog: Catalog, flt: Filter, index: SkuIndex, ignore_case: bool = False) -> DataFrame:
    """Ids of the objects that match a filter, like ``resolve``, with the SKU conditions of an AND filter answered by the index
    first: facts are gathered about the objects it leaves, and about no others."""
    texts = [literal_text(c.value) or "" for c in flt.conditions if c.field == "sku" and c.operator is Operator.CONTAINS]
    if not texts or (flt.relation == "OR" and len(flt.conditions) > 1):
        return Matcher(catalog, flt, ignore_case).frame().select("object_id")
    ids = None
    for text in texts:
        own = index.search(text, ignore_case).where(~F.col("inherited") & (F.col("object_type") == Scope.parse(flt.scope).value)).select("object_id")
        ids = own if ids is None else ids.join(own, "object_id", "left_semi")

    def of_candidates(table: DataFrame) -> DataFrame:
        return table.join(ids, "object_id", "left_semi")

    few = catalog.with_tables(objects=of_candidates(catalog.objects), meta=of_candidates(catalog.meta_of(flt.scope)))
    if flt.scope is Scope.PRODUCT:  # a variation's links are those of its parent
        few = few.with_tables(object_terms=of_candidates(catalog.object_terms))
    return Matcher(few, flt, ignore_case).frame().select("object_id")
