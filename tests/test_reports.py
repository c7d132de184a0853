from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwright import schema as sc
from shelfwright.operators import discovery, oplog, rules, views
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Condition, Filter
from shelfwright.plans.rule import next_due, run_next_due
from shelfwright.schema import CHANGES, OPERATIONS, RULES, Scope
from shelfwright.sources.store import ChangeLog, OperationLog
from tests.shop import Shop, meta_of

REGISTRY = FieldRegistry()
NOW = datetime(2026, 8, 10, 12)


def change(op, obj, status=1, old="19.90", new="9.99", ix=0, kind="product"):
    return (op, kind, obj, ix, "post_field", "regular_price", old, new, status)


def operation(op, status="completed", source="ui", completed=None, progress=None, parent=None, target=0, processed=0, user=1):
    return (op, NOW, completed, progress, user, status, source, parent, "{}", "[]", target, processed, 0, "safe", 100, None)


def rule(i, next_run=NOW, status="active", recurrence="daily", last_op=None, name="R", email="", filter_json="{}",
         actions_json='[{"type": "set", "field": "sku", "value": "x"}]'):
    return (i, name, filter_json, actions_json, recurrence, status, next_run, None, last_op, email)


@pytest.fixture(scope="module")
def shop(spark):
    s = Shop(spark)
    s.term(1, "product_cat", "Home &amp; Kitchen")
    s.term(2, "product_cat", "Empty")
    s.term(3, "pa_size", "Small")
    s.term(4, "pa_size", "Big")
    s.product(1, "10", sku="A-1", categories=[1], meta={"_sale_price": "", "_cost": "4", "_brand": "Acme", "_wp_x": "1"})
    s.product(2, "20", sku="B-2", categories=[1], meta={"_sale_price": "15", "_brand": "Globex"})
    s.product(3, "", sku="PAR-3", title="Shirt")
    s.variation(31, 3, "5", meta={"attribute_pa_size": "small", "attribute_pa_color": "red"})
    s.variation(32, 3, "6", sku="OWN", meta={"attribute_pa_size": ""})
    return s.catalog()


def test_product_page(shop):
    got = [r.asDict() for r in views.catalog_page(shop, Filter(), REGISTRY).collect()]
    assert [(r["id"], r["name"], r["parent_id"], r["sku"], r["sale_price"], r["cost"]) for r in got] == [
        (1, "Product 1", 0, "A-1", None, "4"),
        (2, "Product 2", 0, "B-2", "15", None),
    ]
    assert str(got[0]["price"]) == "10.0000" and got[0]["stock_quantity"] == 5


def test_paging(shop):
    def page(**kw):
        return [r.id for r in views.catalog_page(shop, Filter(), REGISTRY, **kw).collect()]

    assert page(page=1, per_page=1) == [1] and page(page=2, per_page=1) == [2] and page(page=3, per_page=1) == []
    assert page(page=0, per_page=1) == [1]
    for wrong in (0, 201):
        with pytest.raises(ValueError):
            page(per_page=wrong)
    assert page(after_id=1, per_page=5) == [2]


def test_variation_page(shop):
    flt = Filter(scope=Scope.VARIATION)
    got = {r.id: (r.name, r.parent_id, r.sku) for r in views.catalog_page(shop, flt, REGISTRY).collect()}
    assert got == {31: ("Shirt — red, small", 3, ""), 32: ("Shirt", 3, "OWN")}


def test_audit_continues_after_a_row(spark, shop):
    log = spark.createDataFrame([change(1, i) for i in (1, 2, 31, 32)], CHANGES)
    first = views.audit_page(shop, log, 1, per_page=2).collect()
    last = first[-1]
    rest = views.audit_page(shop, log, 1, per_page=2, after=(last.object_id, last.action_ix)).collect()
    assert [r.object_id for r in first + rest] == [1, 2, 31, 32]


def test_audit_page(spark, shop):
    log = spark.createDataFrame(
        [change(1, 1), change(1, 31, 3, kind="variation"), change(1, 32, 0, kind="variation"), change(1, 99, 2), change(2, 2)], CHANGES
    )
    got = {r.object_id: (r.sku, r["name"], r.status) for r in views.audit_page(shop, log, 1).collect()}
    assert got == {
        1: ("A-1", "Product 1", "applied"),
        31: ("PAR-3", "Shirt (red, small)", "skipped"),
        32: ("OWN", "Shirt", "pending"),
        99: ("", "", "failed"),
    }
    assert [r.object_id for r in views.audit_page(shop, log, 1, page=2, per_page=2).collect()] == [32, 99]
    assert [r.object_id for r in views.audit_page(shop, log, 1, object_id=31).collect()] == [31]
    assert [r.object_id for r in views.audit_page(shop, log, 1, sku="PAR").collect()] == [31, 32]
    assert views.audit_total(shop, log, 1, sku="PAR").first()["total"] == 2
    assert views.audit_total(shop, log, 1).first()["total"] == 4
    assert [r.object_id for r in views.pending_head(log, 1, 5).collect()] == [32]


def test_counts_and_progress(spark):
    log = spark.createDataFrame(
        [change(1, 1), change(1, 1, 3, ix=1), change(1, 2, 2), change(1, 3, 0), change(1, 4, 3), change(2, 1)], CHANGES
    )
    assert oplog.change_counts(log, 1).first().asDict() == {"pending": 1, "applied": 1, "failed": 1, "skipped": 2}
    assert oplog.change_counts(log, 9).first().asDict() == {"pending": 0, "applied": 0, "failed": 0, "skipped": 0}
    ops = spark.createDataFrame([operation(1, "running"), operation(2), operation(3)], OPERATIONS)
    got = {r.id: (r.target_rows, r.target_objects, r.processed, r.failed, r.percent, r.can_undo)
           for r in oplog.operation_progress(log, ops).collect()}
    assert got == {1: (5, 4, 2, 1, 50, False), 2: (1, 1, 1, 0, 100, True), 3: (0, 0, 0, 0, 0, False)}
    counted = {r.id: (r.target_count, r.processed, r.failed) for r in oplog.recount(ops, log).collect()}
    assert counted == {1: (4, 2, 1), 2: (1, 1, 0), 3: (0, 0, 0)}
    summary = {r.operation_id: r.targets for r in oplog.operation_summary(log).collect()}
    assert summary == {1: 5, 2: 1}


def test_history_active_and_stalled(spark):
    old = NOW - timedelta(minutes=11)
    ops = spark.createDataFrame(
        [
            operation(1, "running", progress=old, user=1), operation(2, "running", progress=NOW - timedelta(minutes=9), user=2),
            operation(3, "running", user=0), operation(4, "queued", progress=old, user=99), operation(5, target=3, processed=2),
        ],
        OPERATIONS,
    )
    users = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "user_id LONG, display_name STRING")
    got = [(r.id, r.user_name, r.percent, r.can_undo) for r in oplog.operation_history(ops, users).collect()]
    assert got == [(5, "Ann", 66, True), (4, "", 0, False), (3, "", 0, False), (2, "Bo", 0, False), (1, "Ann", 0, False)]
    assert [r.id for r in oplog.operation_history(ops, users, 2).collect()] == [5, 4]
    assert oplog.active_operation(ops).first()["id"] == 1
    assert oplog.active_operation(ops, excluding=1).first()["id"] == 2
    assert [r.id for r in oplog.stalled_operations(ops, NOW).collect()] == [1]
    assert [r.id for r in oplog.recent_operations(ops, 0).collect()] == [5]


def test_completed_undo_reverts_its_parent(spark):
    ops = spark.createDataFrame(
        [operation(1), operation(2), operation(3, source="undo", parent=1), operation(4, "running", "undo", parent=2)], OPERATIONS
    )
    got = {r.id: r.status for r in oplog.final_statuses(ops).collect()}
    assert got == {1: "reverted", 2: "completed", 3: "completed", 4: "running"}


def test_completion_report(spark):
    ops = spark.createDataFrame(
        [operation(1, source="schedule", target=3), operation(2, source="schedule"), operation(3), operation(4, "running", "schedule")],
        OPERATIONS,
    )
    log = spark.createDataFrame([change(1, 1), change(1, 2), change(1, 3, 3), change(3, 1)], CHANGES)
    plans = spark.createDataFrame([rule(1, last_op=1, name="Old"), rule(2, last_op=1, name="New", email="a@example.com")], RULES)
    got = {r.id: (r.label, r.recipient, r.targets, r.changed, r.skipped, r.failed)
           for r in oplog.completion_report(ops, log, plans, "admin@example.com").collect()}
    assert got == {1: ("New", "a@example.com", 3, 2, 1, 0), 2: ("Operation #2", "admin@example.com", 0, 0, 0, 0)}


def test_retention(spark):
    days = {1: 40, 2: 1, 3: 90}
    ops = [operation(i, completed=NOW - timedelta(days=d)) for i, d in days.items()] + [operation(4, "running")]
    ops = spark.createDataFrame(ops, OPERATIONS)
    log = spark.createDataFrame([change(i, 1) for i in (1, 2, 3, 4)] + [change(1, 2)], CHANGES)
    cutoff = oplog.retention_cutoff(NOW)
    assert [(r.operation_id, r.rows) for r in oplog.expired_operations(ops, log, cutoff).collect()] == [(1, 2), (3, 1)]
    assert oplog.purge_counts(ops, log, cutoff).first().asDict() == {"operations": 2, "rows": 3}
    assert sorted(r.operation_id for r in oplog.survivors(ops, log, cutoff).collect()) == [2, 4]
    assert sorted(r.operation_id for r in oplog.survivors(ops, log, cutoff, 1).collect()) == [2, 3, 4]
    nothing = oplog.purge_counts(ops, log, NOW - timedelta(days=400)).first().asDict()
    assert nothing == {"operations": 0, "rows": 0}
    assert oplog.retention_cutoff(NOW, 365) == NOW - timedelta(days=365)
    with pytest.raises(ValueError):
        oplog.retention_cutoff(NOW, 0)


def test_discovery(shop):
    assert [r.meta_key for r in discovery.meta_keys(shop).collect()] == ["_brand", "_cost"]
    assert [(r.field, r.brand) for r in discovery.brands(shop, REGISTRY).collect()] == [("meta:_brand", "Acme"), ("meta:_brand", "Globex")]
    got = [(r.term_id, r["name"], r["count"]) for r in discovery.terms_with_counts(shop, "product_cat").collect()]
    assert got == [(2, "Empty", 0), (1, "Home & Kitchen", 2)]
    nested = discovery.attributes(shop).collect()
    assert [(r.field, [(t.term_id, t.slug, t["name"]) for t in r.terms]) for r in nested] == [
        ("attribute:pa_size", [(4, "big", "Big"), (3, "small", "Small")])
    ]


def test_rules(spark):
    plans = spark.createDataFrame(
        [rule(1, NOW - timedelta(hours=1)), rule(2, NOW + timedelta(hours=1)), rule(3, NOW - timedelta(hours=2)),
         rule(4, NOW - timedelta(hours=3), "paused"), rule(5, NOW, recurrence="once")],
        RULES,
    )
    assert [r.id for r in rules.due_rules(plans, NOW).collect()] == [3, 1, 5]
    assert next_due(plans, NOW)["id"] == 3
    assert [r.id for r in rules.recent_rules(plans, 2).collect()] == [5, 4]
    after = rules.advance(rules.due_rules(plans, NOW), NOW)
    got = {r.id: (r.status, r.t) for r in after.select("id", "status", F.date_format("next_run", "dd HH").alias("t")).collect()}
    assert got == {1: ("active", "11 11"), 3: ("active", "11 10"), 5: ("completed", "10 12")}


def test_rules_pick_up_new_matches(spark, tmp_path):
    s = Shop(spark)
    s.product(1, "50")
    s.product(2, "5")
    cheap = Filter((Condition("price", ">", 20),)).to_json()
    plans = spark.createDataFrame(
        [rule(1, filter_json=cheap, actions_json='[{"type": "set", "field": "regular_price", "value": "9"}]')], RULES
    )
    idle = spark.createDataFrame([operation(1)], OPERATIONS)
    log = ChangeLog(spark, str(tmp_path))
    first = run_next_due(s.catalog(), plans, idle, NOW, 10, REGISTRY, log)
    assert meta_of(first.outcome.catalog, "_regular_price") == {1: "9", 2: "5"}
    moved = rules.advance(plans.where(F.col("id") == first.rule["id"]), NOW, 10).first()
    assert moved["last_op_id"] == 10 and moved["status"] == "active"
    s.product(3, "70")
    second = run_next_due(s.catalog(), plans, idle, NOW, 11, REGISTRY, log)
    assert sorted(r.object_id for r in second.outcome.changes.collect()) == [1, 3]
    busy = spark.createDataFrame([operation(1, "running")], OPERATIONS)
    assert run_next_due(s.catalog(), plans, busy, NOW, 12, REGISTRY, log) is None
    assert run_next_due(s.catalog(), plans, idle, NOW - timedelta(days=9), 12, REGISTRY, log) is None


def test_operation_log_versions(spark, tmp_path):
    log = OperationLog(spark, str(tmp_path / "ops"))
    log.append(spark.createDataFrame([operation(1, "queued"), operation(2, "queued")], sc.OPERATIONS), 1)
    log.append(spark.createDataFrame([operation(1, "completed")], sc.OPERATIONS), 2)
    assert {r.id: r.status for r in log.read().collect()} == {1: "completed", 2: "queued"}
