from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright.functions import formula as fm
from shelfwright.operators.actions import FormulaAction, SetValue
from shelfwright.operators.changes import preview
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Condition, Filter
from shelfwright.operators.resolve import count_matches
from shelfwright.plans.operation import run_operation, run_undo
from shelfwright.schema import Scope
from shelfwright.sources.star import term_id
from shelfwright.sources.store import ChangeLog
from shelfwright.sources.synth import MARKER, SIZES, drop_marked, numbers, synth_catalog
from tests.shop import Shop, ids


def test_generated_catalog(spark):
    catalog = synth_catalog(numbers(spark, 1000), 25)
    objects = catalog.objects.cache()
    kinds = {r["object_type"]: r["count"] for r in objects.groupBy("object_type").count().collect()}
    parents = objects.where("sku LIKE 'GEN-V-%'").count()
    assert kinds["product"] == 1000 and kinds["variation"] == parents * len(SIZES)
    assert 200 < parents < 300
    assert objects.select("object_id").distinct().count() == objects.count()
    simple = objects.where("sku LIKE 'GEN-%' AND sku NOT LIKE 'GEN-V-%'")
    assert 0.8 < simple.where("stock_status = 'instock'").count() / simple.count() < 0.9
    sales = catalog.meta.where("meta_key = '_sale_price' AND meta_value <> ''").count()
    assert 0.15 < sales / simple.count() < 0.25
    assert catalog.meta.where(F.col("meta_key") == MARKER).count() == objects.count()
    orphans = objects.where("object_type = 'variation'").join(
        objects.select(F.col("object_id").alias("parent_id")), "parent_id", "left_anti"
    )
    assert orphans.count() == 0
    again = synth_catalog(numbers(spark, 1000), 25).objects
    assert again.exceptAll(objects).count() == 0


def test_generated_catalog_answers_queries(spark):
    catalog = synth_catalog(numbers(spark, 500), 20)
    flt = Filter((Condition("category", "in", [term_id("product_cat", "Sports")]),))
    assert count_matches(catalog, flt).first()["matched"] > 0
    sized = Filter((Condition("attribute:pa_size", "in", [term_id("pa_size", "XL")]),), scope=Scope.VARIATION)
    variations = catalog.objects.where("object_type = 'variation'").count()
    assert count_matches(catalog, sized).first()["matched"] == variations // len(SIZES)
    cost_plus = FormulaAction("regular_price", fm.var("cost") * 2)
    assert preview(catalog, Filter(), [cost_plus], FieldRegistry()).first()["omitted"] == 0


def test_drop_marked(spark):
    s = Shop(spark)
    s.product(1, "10", categories=[5], meta={MARKER: "1"})
    s.product(2, "10", categories=[5])
    kept = drop_marked(s.catalog())
    assert ids(kept.objects) == [2] and ids(kept.meta) == [2] and ids(kept.object_terms) == [2]


def test_change_and_undo_leave_the_catalog_as_it_was(spark, tmp_path):
    catalog = synth_catalog(numbers(spark, 300), 20)
    registry, log = FieldRegistry(), ChangeLog(spark, str(tmp_path))
    actions = [
        FormulaAction("regular_price", fm.roundto(fm.var("cost") * 1.35, 0.99)),
        FormulaAction("stock_quantity", fm.var("stock") + 1),
        SetValue("meta:_brand", "New"),
    ]
    for op, scope in ((1, Scope.PRODUCT), (3, Scope.VARIATION)):
        flt = Filter((Condition("stock_quantity", ">", 0),), scope=scope)
        counts = preview(catalog, flt, actions, registry).first()
        run = run_operation(catalog, flt, actions, op, registry, log)
        assert run.changes.count() == counts["applicable"] * len(actions) > 0
        assert run.catalog.meta.exceptAll(catalog.meta).count() > 0
        back = run_undo(run.catalog, run, op, op + 1, "skip", registry, log)
        assert back.changes.where("status = 1").count() == run.changes.where("status = 1").count()
        for name in ("objects", "meta"):
            before, after = getattr(catalog, name), getattr(back.catalog, name)
            assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0
