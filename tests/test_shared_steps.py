"""Steps that several queries share: what they read, and how often."""

from __future__ import annotations

import pytest

from shelfwright.catalog import Catalog
from shelfwright.operators import changes as ch
from shelfwright.operators import undo
from shelfwright.operators.fields import FieldRegistry
from shelfwright.plans import registry
from shelfwright.schema import CHANGES, META, Scope
from shelfwright.sources.star import Star
from shelfwright.sources.store import LogArchive, PartedStore, snapshot
from shelfwright.sources.synth import drop_marked

from .shop import Shop

REGISTRY = FieldRegistry()


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def logical(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def owned(spark, tmp_path) -> Catalog:
    """Products 1 to 20 and as many variations, whose metadata lie in files of their own."""
    s = Shop(spark)
    for k in range(1, 21):
        s.product(k, price=str(k))
        s.variation(100 + k, k)
    catalog, parts = s.catalog(), []
    for name, own in (("product", "object_id <= 100"), ("variation", "object_id > 100")):
        path = str(tmp_path / f"{name}_meta")
        meta = spark.createDataFrame([(k if name == "product" else 100 + k, key, str(k)) for k in range(1, 21) for key in ("_regular_price", "_cost")], META)
        meta.write.parquet(path)
        parts.append(spark.read.schema(META).parquet(path).selectExpr("*", f"'{name}' as object_type"))
    # A condition that tells the plans that read the variations.
    meta = parts[0].unionByName(parts[1].where("meta_value <> 'of variations'"))
    return catalog.with_tables(meta=meta.drop("object_type"), owned_meta=meta)


def test_a_change_set_of_one_scope_reads_others_once(spark, owned):
    rows = [(1, "product", k, 0, "post_field", "regular_price", str(k), "7", 1) for k in range(1, 30)]
    changes = snapshot(spark.createDataFrame(rows, CHANGES))
    plain = ch.apply_changes(owned, changes, ["regular_price"], REGISTRY)
    after = ch.apply_changes(owned, changes, ["regular_price"], REGISTRY, Scope.PRODUCT)
    assert rows_of(after.meta) == rows_of(plain.meta) and rows_of(after.objects) == rows_of(plain.objects)
    assert logical(after.meta).count("of variations") == 1 < logical(plain.meta).count("of variations")
    wanted = undo.revert_now(plain, changes, 1, 2, ["regular_price"], "skip", REGISTRY)
    found = undo.revert_now(after, changes, 1, 2, ["regular_price"], "skip", REGISTRY, Scope.PRODUCT)
    assert rows_of(found) == rows_of(wanted) and "of variations" not in logical(found)
    assert rows_of(after.owned_meta.where("object_type = 'product'").drop("object_type")) == rows_of(plain.meta.where("object_id <= 100"))


def test_marked_objects_go_without_a_sort(spark, owned):
    kept = drop_marked(owned.with_tables(meta=snapshot(owned.meta)), "_cost")
    assert "SortMergeJoin" not in plan(kept.meta) and "ShuffledHashJoin" in plan(kept.meta)
    assert kept.meta.count() == 0


def test_a_chain_joins_its_ids_once(spark, monkeypatch):
    """Steps after the first have the filter's objects alone: of ten tables written, two are cut by ids."""
    cut = []
    own = registry.snapshot

    def written(frame, name="snapshot"):
        cut.append("-77" in logical(frame))
        return own(frame, name).where("object_id <> -77") if name == "ids" else own(frame, name)

    monkeypatch.setattr(registry, "snapshot", written)
    registry._chain_log.__wrapped__(spark, "/root/testdata/sf0.001")
    assert sum(cut) == 2 and len(cut) == 13


def test_variations_are_aggregated_once(spark):
    star, settled = Star(spark, "/root/testdata/sf0.001").catalog(), Star(spark, "/root/testdata/sf0.001").catalog(settled=True)
    for name in ("objects", "meta"):
        assert rows_of(getattr(settled, name)) == rows_of(getattr(star, name))
        assert "lineitem" in plan(getattr(star, name)) and "lineitem" not in plan(getattr(settled, name))


@pytest.mark.parametrize("step", ["_archive", "_kept_counters"])
def test_the_log_is_derived_once(spark, monkeypatch, step):
    read, changes = [], Star.changes

    def written(frame, name="snapshot"):
        read.append(name)
        return snapshot(frame, name)

    monkeypatch.setattr(registry, "snapshot", written)
    monkeypatch.setattr(Star, "changes", lambda self: changes(self))
    getattr(registry, step).__wrapped__(spark, "/root/testdata/sf0.001")
    assert read == ["changes"]


def test_parts_move_no_names_of_parts(spark, owned, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    plans, own = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.append(plan(self._df)) or own(self, path, *a, **k))
    PartedStore(spark, str(tmp_path / "parted")).write(owned, "v1")
    meta = next(p for p in plans if "rebalance" in p.lower() and "meta_key" in p)
    assert "__scope" not in meta[meta.lower().index("rebalance") :]


def test_an_archive_leaves_out_what_it_has_without_sorting(spark, tmp_path):
    rows = [(op, "product", 1, 0, "post_field", "f", "1", "2", 1) for op in range(50)]
    archive, log = LogArchive(spark, str(tmp_path / "a")), spark.createDataFrame(rows, CHANGES)
    archive.add(log.where("operation_id < 20"))
    archive.add(log)
    assert rows_of(archive.rows()) == rows_of(log)
