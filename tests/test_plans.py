"""What plans look like, and that skewed keys are split rather than gathered."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import formula as fm
from shelfwright.operators import changes as ch
from shelfwright.operators import undo
from shelfwright.operators.actions import FormulaAction
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Condition, Filter
from shelfwright.operators.resolve import resolve
from shelfwright.plans.registry import QUERIES
from shelfwright.schema import OBJECTS, Scope
from shelfwright.sources.store import CatalogStore, snapshot
from shelfwright.sources.synth import numbers, synth_catalog

PATH = "/root/testdata/sf0.001"
REGISTRY = FieldRegistry()
COST_PLUS = FormulaAction("regular_price", fm.roundto(fm.var("cost") * 1.35, 0.99))


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def details(frame) -> str:
    """The plan with nothing cut short."""
    explain = frame.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    return explain(frame._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    catalog = synth_catalog(numbers(spark, 2000), 30)
    return CatalogStore(spark, str(tmp_path_factory.mktemp("store"))).write(catalog, "v1", 8)


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    catalog = synth_catalog(numbers(spark, 2000), 30)
    return CatalogStore(spark, str(tmp_path_factory.mktemp("bucketed"))).write_bucketed(catalog, "plans", 8)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_reach_the_scans(stored):
    flt = Filter((Condition("price", ">", 20), Condition("meta:_brand", "=", "Acme"), Condition("category", "in", [7])))
    text = details(resolve(stored, flt))
    assert "GreaterThan(min_price,20.0000)" in text and "EqualTo(object_type,product)" in text
    assert "EqualTo(meta_key,_brand)" in text and "EqualTo(taxonomy,product_cat)" in text
    # One scan of each table, and no columns that the query does not need.
    assert plan(resolve(stored, flt)).count("FileScan") == 3
    scanned = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any("title" in s or "sku" in s for s in scanned)


def test_slugs_reach_the_scan_of_metadata(stored):
    from shelfwright.sources.star import term_id

    flt = Filter((Condition("attribute:pa_size", "in", [term_id("pa_size", "XL")]),), scope=Scope.VARIATION)
    assert "EqualTo(meta_value,xl)" in details(resolve(stored, flt))


def test_change_set_reads_metadata_once(stored, no_broadcast):
    text = plan(ch.changeset(stored, Filter((Condition("meta:_brand", "=", "Acme"),)), [COST_PLUS], 1, REGISTRY))
    assert text.count("FileScan") == 2
    # One shuffle for each side of one join.
    assert text.count("Exchange hashpartitioning") == 2


def test_buckets_need_no_shuffle(bucketed, no_broadcast):
    frame = ch.changeset(bucketed, Filter((Condition("price", ">", 20),)), [COST_PLUS], 1, REGISTRY)
    assert "Exchange" not in plan(frame)
    assert frame.where("status = 1").count() > 0


def test_no_python_no_cross_join_no_global_window(spark):
    for name, query in QUERIES.items():
        if name.startswith("stream_") or name in ("audit_page", "audit_sku_search"):
            continue
        text = plan(query(spark, PATH))
        for node in ("PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "CartesianProduct", "NestedLoop", "Window"):
            assert node not in text, f"{name}: {node}"


def test_skewed_partitions_are_split_while_running(spark, no_broadcast):
    """Adaptive execution divides the children of a hot parent: every join has its large side on the left
    and a join type whose left side can be split."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        children = spark.range(0, 60_000, 1, 8).select(
            F.col("id").alias("object_id"), F.when(F.col("id") % 2 == 0, 8).otherwise(F.col("id")).alias("parent_id")
        )
        parents = spark.range(0, 4000).select(F.col("id").alias("parent_id"), F.lit(True).alias("flag"))
        for how in ("left", "left_semi", "left_anti"):
            rows = children.join(parents, "parent_id", how).agg(F.sum("object_id"))
            rows.collect()
            assert "skew=true" in plan(rows), how
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_hot_object_shrinks_before_the_shuffle(spark, no_broadcast):
    """An object owning most metadata rows reaches the shuffle as one row per task."""
    s = synth_catalog(numbers(spark, 200), 0)
    flood = spark.range(0, 50_000, 1, 8).select(
        F.lit(8).cast("bigint").alias("object_id"), F.lit("_brand").alias("meta_key"), F.lit("Acme").alias("meta_value")
    )
    catalog = s.with_tables(meta=s.meta.unionByName(flood))
    frame = resolve(catalog, Filter((Condition("meta:_brand", "=", "Acme"),)))
    text = plan(frame)
    assert text.index("partial_max") > text.index("Exchange")  # below the exchange, so before it
    assert frame.where("object_id = 8").count() == 1


def test_large_and_small_change_sets_agree(spark, stored):
    """Broadcasting a small change set and joining a large one in full give the same catalog."""
    flt = Filter((Condition("meta:_brand", "=", "Acme"),))
    changes = snapshot(ch.changeset(stored, flt, [COST_PLUS], 1, REGISTRY))
    frozen = snapshot(ch.freeze(stored, flt, [COST_PLUS], 1, REGISTRY))

    def outcome():
        after = ch.apply_changes(stored, changes, ["regular_price"], REGISTRY)
        undone = undo.revert_now(after, changes, 1, 2, ["regular_price"], "skip", REGISTRY)
        derived = ch.derive(stored, frozen, [COST_PLUS], REGISTRY)
        return [sorted(map(repr, f.collect())) for f in (after.meta, after.objects, undone, derived)]

    small = outcome()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert outcome() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_change_set_does_not_shuffle_the_catalog(spark, stored):
    changes = snapshot(ch.changeset(stored, Filter((Condition("price", "<", 7),)), [COST_PLUS], 1, REGISTRY))
    after = ch.apply_changes(stored, changes, ["regular_price"], REGISTRY)
    assert changes.count() > 0
    # Neither table is exchanged by hash on its way out; only the change set is broadcast.
    final = after.objects.where("object_type = 'product'")
    assert "SortMergeJoin" not in plan(final)
    assert "BroadcastHashJoin" in plan(after.meta)
