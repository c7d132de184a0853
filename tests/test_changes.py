from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import formula as fm
from shelfwright.operators import changes as ch
from shelfwright.operators import undo
from shelfwright.operators.actions import FormulaAction, SetValue, actions_from_json, actions_to_json
from shelfwright.operators.fields import FieldRegistry, UnsupportedField
from shelfwright.operators.filters import Condition, Filter
from shelfwright.operators.resolve import resolve
from shelfwright.plans.operation import TooManyObjects, queue_operation, run_operation, run_queued, run_undo
from shelfwright.schema import CHANGES, Scope
from shelfwright.sources.store import CatalogStore, ChangeLog, snapshot
from tests.shop import Shop, ids, meta_of

REGISTRY = FieldRegistry()
COST_PLUS = FormulaAction("regular_price", fm.roundto(fm.var("cost") * 1.35, 0.99))


@pytest.fixture
def log(spark, tmp_path):
    return ChangeLog(spark, str(tmp_path / "log"))


@pytest.fixture
def shop(spark):
    s = Shop(spark)
    for i, stock in enumerate((5, 7, None, 0), 1):
        s.product(i, "10", stock=stock)
    return s.catalog()


def rows(frame):
    """(object, field) -> (old, new, status)"""
    return {(r.object_id, r.field_key): (r.old_value, r.new_value, r.status) for r in frame.collect()}


def priced(spark, prices, costs=()):
    s = Shop(spark)
    for i, price in enumerate(prices, 1):
        cost = costs[i - 1] if i <= len(costs) else None
        s.product(i, price, meta={} if cost is None else {"_cost": cost})
    return s.catalog()


def test_set_and_apply(spark, log):
    catalog = priced(spark, ["10", "25", "30", "5", "100"])
    flt = Filter((Condition("price", ">", 20),))
    run = run_operation(catalog, flt, [SetValue("regular_price", "9.99")], 1, REGISTRY, log)
    assert rows(run.changes) == {
        (2, "regular_price"): ("25", "9.99", 1),
        (3, "regular_price"): ("30", "9.99", 1),
        (5, "regular_price"): ("100", "9.99", 1),
    }
    assert meta_of(run.catalog, "_regular_price") == {1: "10", 2: "9.99", 3: "9.99", 4: "5", 5: "9.99"}
    prices = {r.object_id: str(r.min_price) for r in run.catalog.objects.collect()}
    assert prices == {1: "10.0000", 2: "9.9900", 3: "9.9900", 4: "5.0000", 5: "9.9900"}


def test_frozen_targets_survive_the_change(spark, log):
    """Once applied, nothing matches the filter any more, but the frozen rows still stand."""
    catalog = priced(spark, ["25", "30"])
    flt = Filter((Condition("price", ">", 20),))
    actions = [SetValue("regular_price", "1")]
    queue_operation(catalog, flt, actions, 1, REGISTRY, log)
    run = run_queued(catalog, actions, 1, REGISTRY, log)
    assert ids(resolve(run.catalog, flt)) == []
    again = run_queued(catalog, actions, 1, REGISTRY, log)  # as after an interruption
    assert log.frozen(1).count() == 2 and rows(again.changes) == rows(run.changes)
    assert meta_of(again.catalog, "_regular_price") == {1: "1", 2: "1"}
    with pytest.raises(Exception, match="already frozen"):
        log.write_frozen(log.frozen(1), 1)


def test_running_an_operation_twice_applies_it_once(spark, log):
    catalog = priced(spark, ["10"])
    double = [FormulaAction("regular_price", fm.var("regular_price") * 2)]
    first = run_operation(catalog, Filter(), double, 1, REGISTRY, log)
    second = run_operation(first.catalog, Filter(), double, 1, REGISTRY, log)
    assert rows(second.changes) == {(1, "regular_price"): ("10", "20", 1)}
    assert meta_of(second.catalog, "_regular_price") == {1: "20"}


def test_formula_and_applicability(spark):
    catalog = priced(spark, ["100", "200", "300"], ["10", "20"])
    counts = ch.preview(catalog, Filter(), [COST_PLUS], REGISTRY).first().asDict()
    assert counts == {"matched": 3, "applicable": 2, "omitted": 1}
    assert ids(ch.omitted_targets(catalog, Filter(), [COST_PLUS], REGISTRY)) == [3]
    got = ch.changeset(catalog, Filter(), [COST_PLUS], 1, REGISTRY)
    assert rows(got) == {(1, "regular_price"): ("100", "13.86", 1), (2, "regular_price"): ("200", "26.73", 1)}
    assert ch.preview(catalog, Filter(), [SetValue("sku", "x")], REGISTRY).first()["omitted"] == 0


def test_percent(spark):
    got = ch.changeset(priced(spark, ["50"]), Filter(), [FormulaAction("regular_price", fm.percent("regular_price", -10))], 1, REGISTRY)
    assert rows(got) == {(1, "regular_price"): ("50", "45", 1)}


def test_unreadable_number_and_null_literal_are_skipped(spark):
    catalog = priced(spark, ["100"], ["n/a"])
    assert rows(ch.changeset(catalog, Filter(), [COST_PLUS], 1, REGISTRY)) == {(1, "regular_price"): ("100", None, 3)}
    got = ch.changeset(catalog, Filter(), [SetValue("name", None), SetValue("meta:note", "")], 1, REGISTRY)
    assert rows(got) == {(1, "name"): ("Product 1", None, 3), (1, "note"): ("", "", 1)}


def test_later_actions_see_earlier_ones(spark):
    actions = [
        FormulaAction("regular_price", fm.var("regular_price") * 2),
        FormulaAction("sale_price", fm.var("regular_price") - 1),
    ]
    catalog = priced(spark, ["10"])
    expected = {(1, "regular_price"): ("10", "20", 1), (1, "sale_price"): ("", "19", 1)}
    assert rows(ch.changeset(catalog, Filter(), actions, 1, REGISTRY)) == expected
    frozen = ch.freeze(catalog, Filter(), actions, 1, REGISTRY)
    assert rows(ch.derive(catalog, frozen, actions, REGISTRY)) == expected


def test_only_pending_rows_are_evaluated(spark):
    actions = [
        FormulaAction("regular_price", fm.var("regular_price") * 2),
        FormulaAction("sale_price", fm.var("regular_price") - 1),
    ]
    catalog = priced(spark, ["10"])
    half = spark.createDataFrame(
        [
            (1, "product", 1, 0, "post_field", "regular_price", "5", "10", 1),
            (1, "product", 1, 1, "post_field", "sale_price", None, None, 0),
        ],
        CHANGES,
    )
    assert rows(ch.derive(catalog, half, actions, REGISTRY)) == {
        (1, "regular_price"): ("5", "10", 1),
        (1, "sale_price"): ("", "9", 1),
    }


def test_missing_objects_fail(spark):
    catalog = priced(spark, ["10", "20"])
    action = SetValue("regular_price", "1")
    frozen = snapshot(ch.freeze(catalog, Filter(), [action], 1, REGISTRY))
    later = catalog.with_tables(objects=catalog.objects.where("object_id = 1"))
    assert rows(ch.derive(later, frozen, [action], REGISTRY)) == {
        (1, "regular_price"): ("10", "1", 1),
        (2, "regular_price"): (None, None, 2),
    }


def test_replay_does_nothing(spark, log):
    catalog = priced(spark, ["10", "20"])
    actions = [FormulaAction("regular_price", fm.var("regular_price") * 2)]
    run = run_operation(catalog, Filter(), actions, 1, REGISTRY, log)
    assert rows(ch.derive(run.catalog, run.changes, actions, REGISTRY)) == rows(run.changes)


def test_settle_takes_the_first_report_once(spark):
    base = [(1, "product", 1, 0, "post_field", "sku", None, None, 0), (1, "product", 2, 0, "post_field", "sku", "a", "b", 1)]
    logged = spark.createDataFrame(base, CHANGES)
    reports = spark.createDataFrame(
        [(1, 1, 0, 2, "x", "later", 1), (1, 1, 0, 1, "x", "first", 1), (1, 2, 0, 1, "q", "q", 1)],
        "operation_id LONG, object_id LONG, action_ix INT, at INT, old_value STRING, new_value STRING, status INT",
    )
    assert rows(ch.settle(logged, reports, "at")) == {(1, "sku"): ("x", "first", 1), (2, "sku"): ("a", "b", 1)}


def test_rejected_actions(spark):
    catalog = priced(spark, ["10"])
    for actions, error in [
        ([], ValueError),
        ([SetValue("nonsense", 1)], UnsupportedField),
        ([SetValue("sku", 1), SetValue("sku", 2)], ValueError),
        ([FormulaAction("sku", fm.var("unit_price"))], UnsupportedField),
    ]:
        with pytest.raises(error):
            ch.freeze(catalog, Filter(), actions, 1, REGISTRY)


def test_actions_round_trip():
    actions = [SetValue("sku", "x"), COST_PLUS]
    back = actions_from_json(actions_to_json(actions))
    assert back[0] == actions[0] and back[1].formula.spec == COST_PLUS.formula.spec
    for bad in ("[]", '[{"type": "set"}]', '[{"type": "what", "field": "sku"}]'):
        with pytest.raises(ValueError):
            actions_from_json(bad)


def test_object_limit(spark, log):
    with pytest.raises(TooManyObjects):
        run_operation(priced(spark, ["10", "20"]), Filter(), [SetValue("sku", "x")], 1, REGISTRY, log, max_objects=1)


def test_every_kind_of_field_is_applied(spark, log):
    s = Shop(spark)
    s.product(1, "10", meta={"_sale_price": ""})
    s.product(2, "20", meta={"_sale_price": "15"})
    actions = [
        SetValue("stock_quantity", 3), SetValue("name", "New"), SetValue("weight", "1.5"),
        SetValue("meta:note", "hi"), SetValue("sale_price", "8"), SetValue("status", "draft"),
    ]
    run = run_operation(s.catalog(), Filter((Condition("price", "<", 15),)), actions, 1, REGISTRY, log)
    found = {r.object_id: (r.title, r.stock_quantity, r.status, str(r.min_price)) for r in run.catalog.objects.collect()}
    assert found == {1: ("New", 3, "draft", "8.0000"), 2: ("Product 2", 5, "publish", "20.0000")}
    assert meta_of(run.catalog, "_weight") == {1: "1.5"} and meta_of(run.catalog, "note") == {1: "hi"}
    assert meta_of(run.catalog, "_sale_price") == {1: "8", 2: "15"}
    assert run.changes.where("status = 1").count() == 6


def test_preview_values(spark):
    got = ch.preview_values(priced(spark, ["10", "20", "30"]), Filter(), [SetValue("sku", "x")], REGISTRY, 2).collect()
    assert [(r.object_id, r.new_value) for r in got] == [(1, "x"), (2, "x")]


# Undo


def edit(catalog, prices):
    value = F.col("meta_value")
    for object_id, price in prices.items():
        value = F.when((F.col("meta_key") == "_regular_price") & (F.col("object_id") == object_id), price).otherwise(value)
    return catalog.with_tables(meta=catalog.meta.withColumn("meta_value", value))


def test_undo_restores_everything(spark, log):
    catalog = priced(spark, ["20", "30", "40"])
    run = run_operation(catalog, Filter(), [SetValue("regular_price", "9.99"), SetValue("name", "x")], 1, REGISTRY, log)
    back = run_undo(run.catalog, run, 1, 2, "skip", REGISTRY, log)
    assert meta_of(back.catalog, "_regular_price") == {1: "20", 2: "30", 3: "40"}
    assert sorted(map(tuple, back.catalog.objects.collect())) == sorted(map(tuple, catalog.objects.collect()))
    assert back.changes.where("status = 1").count() == 6


def test_drift_is_skipped_or_forced(spark, log):
    run = run_operation(priced(spark, ["20", "30", "40"]), Filter(), [SetValue("regular_price", "9.99")], 1, REGISTRY, log)
    drifted = edit(run.catalog, {2: "5.55", 3: "9.990"})
    back = run_undo(drifted, run, 1, 2, "skip", REGISTRY, log)
    assert rows(back.changes) == {
        (1, "regular_price"): ("9.99", "20", 1),
        (2, "regular_price"): ("5.55", None, 3),
        (3, "regular_price"): ("9.990", "40", 1),
    }
    assert meta_of(back.catalog, "_regular_price") == {1: "20", 2: "5.55", 3: "40"}
    forced = run_undo(drifted, run, 1, 3, "force", REGISTRY, log)
    assert meta_of(forced.catalog, "_regular_price") == {1: "20", 2: "30", 3: "40"}


def test_redo(spark, log):
    run = run_operation(priced(spark, ["20", "30"]), Filter(), [SetValue("regular_price", "9.99")], 1, REGISTRY, log)
    back = run_undo(run.catalog, run, 1, 2, "skip", REGISTRY, log)
    again = run_undo(back.catalog, back, 2, 3, "skip", REGISTRY, log)
    assert meta_of(again.catalog, "_regular_price") == {1: "9.99", 2: "9.99"}


def test_undo_of_pruned_deltas_unowned_fields_and_lost_objects(spark):
    catalog = priced(spark, ["1", "2", "3"])
    parent = spark.createDataFrame(
        [
            (1, "product", 1, 0, "post_field", "regular_price", "10", "1", 1),
            (1, "product", 2, 0, "post_field", "regular_price", "20", "2", 1),
            (1, "product", 3, 0, "term", "gone", "a", "b", 1),
            (1, "product", 9, 0, "post_field", "regular_price", "90", "9", 1),
            (1, "product", 4, 0, "post_field", "regular_price", "40", None, 3),
        ],
        CHANGES,
    )
    targets = snapshot(undo.undo_targets(parent, 1, 2))
    assert ids(targets) == [1, 2, 3, 9]
    pruned = parent.where("object_id <> 2")
    got = undo.revert(catalog, pruned, targets, 1, ["regular_price"], "force", REGISTRY)
    assert rows(got) == {
        (1, "regular_price"): ("1", "10", 1),
        (2, "regular_price"): (None, None, 3),
        (3, "gone"): (None, None, 3),
        (9, "regular_price"): (None, None, 2),
    }


def test_undo_preview(spark, log):
    run = run_operation(priced(spark, ["20", "30", "40"]), Filter(), [SetValue("regular_price", "9.99")], 1, REGISTRY, log)
    drifted = edit(run.catalog, {2: "5.55"})
    sample = undo.undo_preview_sample(drifted, run.changes, 1, ["regular_price"], "skip", REGISTRY, 2)
    got = {r.object_id: (r.field, r.current, r.restore_to, r.drift, r.action) for r in sample.collect()}
    assert got == {
        1: ("regular_price", "9.99", "20", False, "revert"),
        2: ("regular_price", "5.55", "30", True, "skip"),
    }
    forced = undo.undo_preview_sample(drifted, run.changes, 1, ["regular_price"], "force", REGISTRY, 2)
    assert {r.action for r in forced.collect()} == {"revert"}
    assert undo.undo_preview_sample(drifted, run.changes, 1, ["regular_price"], "skip", REGISTRY, 0).count() == 0
    totals = undo.undo_preview_totals(drifted, run.changes, 1, ["regular_price"], REGISTRY).first()
    assert (totals.total, totals.drifted) == (3, 1)


def test_variations(spark, log):
    s = Shop(spark)
    s.product(1, "", sku="P")
    s.variation(11, 1, "10")
    s.variation(12, 1, "50")
    flt = Filter((Condition("price", ">", 20),), scope=Scope.VARIATION)
    run = run_operation(s.catalog(), flt, [SetValue("regular_price", "7")], 1, REGISTRY, log)
    assert [(r.object_type, r.object_id) for r in run.changes.collect()] == [("variation", 12)]
    back = run_undo(run.catalog, run, 1, 2, "skip", REGISTRY, log)
    assert meta_of(back.catalog, "_regular_price") == {1: "", 11: "10", 12: "50"}


def test_custom_field(spark, log):
    from shelfwright.operators.fields import Field

    registry = FieldRegistry()
    # Stored in cents, shown in units.
    registry.register(
        Field("shipping", "Shipping", "meta", "_shipping_cents", meta_key="_shipping_cents",
              reader=lambda t: (t.try_cast("decimal(19,2)") / 100).cast("decimal(19,2)").cast("string"),
              writer=lambda t: (t.try_cast("decimal(19,2)") * 100).cast("bigint").cast("string"))
    )
    s = Shop(spark)
    s.product(1, "10", meta={"_shipping_cents": "250"})
    run = run_operation(s.catalog(), Filter(), [SetValue("shipping", "3.10")], 1, registry, log)
    assert rows(run.changes) == {(1, "_shipping_cents"): ("2.50", "3.10", 1)}
    assert meta_of(run.catalog, "_shipping_cents") == {1: "310"}


# Stores


def test_catalog_store(spark, tmp_path):
    catalog = priced(spark, ["10", "20"], ["1", "2"])
    store = CatalogStore(spark, str(tmp_path))
    for stored in (store.write(catalog, "v1", 3), store.write_bucketed(catalog, "b1", 4)):
        for name in ("objects", "meta", "terms", "object_terms"):
            a, b = getattr(catalog, name), getattr(stored, name)
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    spark.sql("DROP TABLE catalog_b1_meta")  # as in a session that has not seen the tables
    assert store.open_bucketed("b1", 4).meta.count() == catalog.meta.count()


def test_change_log_reads_one_operation(spark, log):
    catalog = priced(spark, ["10", "20"])
    for op in (1, 2):
        run_operation(catalog, Filter(), [SetValue("sku", f"s{op}")], op, REGISTRY, log)
    assert log.all_settled().count() == 4
    one = log.all_settled().where("operation_id = 2")
    assert {r.new_value for r in one.collect()} == {"s2"}
    assert "operation_id" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:80]


def test_interrupted_version_is_no_version(spark, tmp_path, shop):
    store = CatalogStore(spark, str(tmp_path))
    # What a job leaves that dies after the first table.
    shop.objects.write.parquet(str(tmp_path / "v1" / "objects"))
    with pytest.raises(ValueError):
        store.open("v1")
    assert store.write(shop, "v1").objects.count() == shop.objects.count()
    assert store.open("v1").meta.count() == shop.meta.count()
    with pytest.raises(ValueError):
        store.write(shop, "v1")


def test_log_and_catalog_agree_on_stock(spark, shop):
    """A fraction is cut before it is logged, and what is no number is not set."""
    registry = FieldRegistry()
    for action in (FormulaAction("stock_quantity", fm.var("stock") * 1.5), SetValue("stock_quantity", "7.9"), SetValue("stock_quantity", "abc")):
        changes = snapshot(ch.changeset(shop, Filter(), [action], 1, registry))
        after = ch.apply_changes(shop, changes, ["stock_quantity"], registry)
        stored = {r.object_id: r.stock_quantity for r in after.objects.collect()}
        before = {r.object_id: r.stock_quantity for r in shop.objects.collect()}
        for r in changes.collect():
            if r.status == 1:
                assert stored[r.object_id] == int(r.new_value)
            else:
                assert r.new_value is None and stored[r.object_id] == before[r.object_id]
        undone = ch.apply_changes(after, snapshot(undo.revert_now(after, changes, 1, 2, ["stock_quantity"], "skip", registry)), ["stock_quantity"], registry)
        assert {r.object_id: r.stock_quantity for r in undone.objects.collect()} == before


def test_price_too_large_is_skipped(spark, shop):
    registry = FieldRegistry()
    changes = snapshot(ch.changeset(shop, Filter(), [SetValue("regular_price", "1e16")], 1, registry))
    assert {r.status for r in changes.collect()} == {3}
    assert ch.apply_changes(shop, changes, ["regular_price"], registry).objects.count() == shop.objects.count()
