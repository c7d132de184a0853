"""Named queries over the star tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.functions import formula as fm
from shelfwright.functions.recurrence import start_time
from shelfwright.functions.text import decode_entities
from shelfwright.functions.times import instant
from shelfwright.functions.values import values_equal
from shelfwright.operators import changes as ch
from shelfwright.operators import discovery, oplog, rules, undo, views
from shelfwright.operators.actions import Action, FormulaAction, SetValue
from shelfwright.operators.chain import compose
from shelfwright.operators.fields import Field, FieldRegistry
from shelfwright.operators.filters import Condition, Filter, filter_from_form
from shelfwright.operators.resolve import count_matches, resolve, resolve_sorted, scan_scope
from shelfwright.plans.operation import TooManyObjects, run_operation
from shelfwright.plans.rule import due_changesets
from shelfwright.schema import CHANGES, Scope
from shelfwright.sources import counters
from shelfwright.sources.counters import CounterLog, batch_of
from shelfwright.sources.index import RankIndex, SkuIndex, resolve_indexed
from shelfwright.sources.star import MARKER_KEY, Star, term_id
from shelfwright.sources.store import CatalogStore, ChangeLog, LogArchive, OperationLog, PartedStore, shared_dir, snapshot
from shelfwright.sources.synth import drop_marked, synth_catalog
from shelfwright.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2026, 2, 15, 12, 0, 0)
LOG_NOW = datetime(2001, 7, 1, 12, 0, 0)
CUTOFF = datetime(1998, 1, 1)
STREAM_NOW = datetime(2024, 1, 30, 12, 0, 0)
OPERATION = 2
AUDITED = 3
PARENT, UNDO, REDO = 1, 9001, 9002

REGISTRY = FieldRegistry()
PRICE = "regular_price"

CATEGORIES = [term_id("product_cat", n) for n in ("STANDARD", "PROMO")]
TAGS = [term_id("product_tag", n) for n in ("widget", "ring")]
COLORS = [term_id("pa_color", n) for n in ("red", "blue")]
SIZES = [term_id("pa_size", n) for n in ("S1", "S2")]

COST_PLUS = FormulaAction(PRICE, fm.roundto(fm.var("cost") * 1.35, 0.99))
SALE_AFTER_PRICE = [
    FormulaAction(PRICE, fm.var(PRICE) * 2),
    FormulaAction("sale_price", fm.var(PRICE) - 0.5),
]
EVERYTHING = Filter()
COMBINED = Filter(
    (
        Condition("price", "between", [910, 980]),
        Condition("category", "in", CATEGORIES),
        Condition("stock_status", "=", "instock"),
    )
)
ONE_SIZE = Filter((Condition("attribute:pa_size", "in", SIZES[:1]),), scope=Scope.VARIATION)

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


@lru_cache(maxsize=8)
def _catalog(spark: SparkSession, path: str) -> Catalog:
    """Opened once per session: the frames are plans, which hold no data."""
    return Star(spark, path).catalog()


def _settled_catalog(spark: SparkSession, path: str) -> Catalog:
    """The same, with its variations aggregated once and written, for queries that read them several times."""
    return Star(spark, path).catalog(settled=True)


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _shown(frame: DataFrame) -> DataFrame:
    """Prices as doubles and instants as text, which every engine prints alike."""
    columns = []
    for field in frame.schema:
        kind = field.dataType.typeName()
        if kind == "decimal":
            columns.append(F.col(field.name).cast("double").alias(field.name))
        elif kind == "timestamp":
            columns.append(_time(field.name))
        else:
            columns.append(F.col(field.name))
    return frame.select(*columns)


# Scans and filters -----------------------------------------------------------------------------

FILTERS: dict[str, Filter] = {
    "resolve_all_products": EVERYTHING,
    "filter_price_gt": Filter((Condition("price", ">", 950),)),
    "filter_price_between": Filter((Condition("price", "between", [910, 950.5]),)),
    "filter_stock_lt": Filter((Condition("stock_quantity", "<", "10.7"),)),
    "filter_stock_in": Filter((Condition("stock_quantity", "in", [3, 5, 7, 11]),)),
    "filter_stock_not_in": Filter((Condition("stock_quantity", "not_in", [3, 5, 7, 11]),)),
    "filter_status_eq": Filter((Condition("stock_status", "=", "instock"),)),
    "filter_status_ne": Filter((Condition("stock_status", "!=", "instock"),)),
    "filter_sku_in": Filter((Condition("sku", "in", ["SKU-1", "SKU-22", "SKU-151", "SKU-9"]),)),
    "filter_sku_contains": Filter((Condition("sku", "contains", "KU-1"),)),
    "filter_category_in": Filter((Condition("category", "in", CATEGORIES),)),
    "filter_category_not_in": Filter((Condition("category", "not_in", CATEGORIES),)),
    "filter_tag_in": Filter((Condition("tag", "in", TAGS),)),
    "filter_tag_not_exists": Filter((Condition("tag", "not_exists"),)),
    "filter_color_in": Filter((Condition("attribute:pa_color", "in", COLORS),)),
    "filter_color_exists": Filter((Condition("attribute:pa_color", "exists"),)),
    "filter_meta_eq": Filter((Condition("meta:_brand", "=", "Brand#12"),)),
    "filter_meta_ne": Filter((Condition("meta:_cost", "!=", "n/a"),)),
    "filter_meta_in": Filter((Condition("meta:_brand", "in", ["Brand#11", "Brand#12", "Brand#3"]),)),
    "filter_meta_not_in": Filter((Condition("meta:_cost", "not_in", ["", "n/a"]),)),
    "filter_meta_contains": Filter((Condition("meta:_brand", "contains", "#1"),)),
    "filter_meta_gt": Filter((Condition("meta:_cost", ">", 820),)),
    "filter_meta_le": Filter((Condition("meta:_cost", "<=", 800),)),
    "filter_meta_between": Filter((Condition("meta:_cost", "between", [790, 830.25]),)),
    "filter_meta_exists": Filter((Condition("meta:_cost", "exists"),)),
    "filter_meta_not_exists": Filter((Condition("meta:_cost", "not_exists"),)),
    "filter_price_variation": Filter((Condition("price", "<=", 20000),), scope=Scope.VARIATION),
    "filter_category_inherited": Filter((Condition("category", "in", CATEGORIES),), scope=Scope.VARIATION),
    "filter_category_inherited_not_in": Filter(
        (Condition("category", "not_in", CATEGORIES),), scope=Scope.VARIATION
    ),
    "filter_variation_size_in": Filter((Condition("attribute:pa_size", "in", SIZES),), scope=Scope.VARIATION),
    "filter_variation_size_not_in": Filter(
        (Condition("attribute:pa_size", "not_in", SIZES),), scope=Scope.VARIATION
    ),
    "filter_variation_size_exists": Filter((Condition("attribute:pa_line", "exists"),), scope=Scope.VARIATION),
    "filter_variation_size_not_exists": Filter(
        (Condition("attribute:pa_line", "not_exists"),), scope=Scope.VARIATION
    ),
    "filter_and_combined": COMBINED,
    "filter_or_mixed": Filter.from_json(
        Filter(
            (
                Condition("price", "<", 905),
                Condition("category", "in", CATEGORIES[:1]),
                Condition("meta:_brand", "=", "Brand#12"),
                Condition("tag", "not_exists"),
                Condition("no_such_field", "=", 1),
            ),
            "or",
        ).to_json()
    ),
    "filter_form_combined": filter_from_form(
        Scope.VARIATION,
        price_min=5000,
        price_max=60000,
        stock_status="instock",
        categories=CATEGORIES,
        tags=TAGS,
        attribute="attribute:pa_size",
        attribute_values=SIZES,
    ),
}


def _filter_query(flt: Filter) -> Query:
    return lambda spark, path: resolve(_catalog(spark, path), flt)


for _name, _filter in FILTERS.items():
    QUERIES[_name] = _filter_query(_filter)


@query
def scan_scope_query(spark: SparkSession, path: str) -> DataFrame:
    return _shown(scan_scope(_catalog(spark, path), Scope.PRODUCT))


@query
def scan_scope_variations(spark: SparkSession, path: str) -> DataFrame:
    return _shown(scan_scope(_catalog(spark, path), Scope.VARIATION))


@query
def applicable_targets(spark: SparkSession, path: str) -> DataFrame:
    required = [REGISTRY.variable("cost"), REGISTRY.get("sale_price")]
    return resolve(_catalog(spark, path), EVERYTHING, required)


@query
def resolve_combined(spark: SparkSession, path: str) -> DataFrame:
    return resolve_sorted(_catalog(spark, path), COMBINED)


@query
def count_combined(spark: SparkSession, path: str) -> DataFrame:
    return count_matches(_catalog(spark, path), COMBINED)


@query
def drop_marked_query(spark: SparkSession, path: str) -> DataFrame:
    return drop_marked(_settled_catalog(spark, path), MARKER_KEY).meta


@query
def drop_marked_objects(spark: SparkSession, path: str) -> DataFrame:
    return _shown(drop_marked(_settled_catalog(spark, path), MARKER_KEY).objects)


@query
def drop_marked_links(spark: SparkSession, path: str) -> DataFrame:
    return drop_marked(_catalog(spark, path), MARKER_KEY).object_terms


# Pages -----------------------------------------------------------------------------------------


@query
def product_page(spark: SparkSession, path: str) -> DataFrame:
    return _shown(views.catalog_page(_catalog(spark, path), EVERYTHING, REGISTRY, page=2))


@query
def variation_page(spark: SparkSession, path: str) -> DataFrame:
    flt = Filter((Condition("attribute:pa_line", "exists"),), scope=Scope.VARIATION)
    return _shown(views.catalog_page(_catalog(spark, path), flt, REGISTRY, page=1, per_page=50))


@query
def attribute_summary(spark: SparkSession, path: str) -> DataFrame:
    return views.attribute_summary(_catalog(spark, path).meta)


@query
def meta_pivot(spark: SparkSession, path: str) -> DataFrame:
    return views.meta_pivot(_catalog(spark, path).meta, {"sale_price": "_sale_price", "cost": "_cost"})


def _variation_log(catalog: Catalog) -> DataFrame:
    action = FormulaAction(PRICE, fm.var(PRICE) + 1)
    return ch.changeset(catalog, ONE_SIZE, [action], PARENT, REGISTRY)


@query
def audit_page(spark: SparkSession, path: str) -> DataFrame:
    catalog = _catalog(spark, path)
    log = snapshot(_variation_log(catalog), "log")
    return views.audit_page(catalog, log, PARENT, page=2, per_page=50)


@query
def audit_sku_search(spark: SparkSession, path: str) -> DataFrame:
    catalog = _catalog(spark, path)
    log = snapshot(_variation_log(catalog), "log")
    return views.audit_page(catalog, log, PARENT, page=1, per_page=200, sku="SKU-1")


@query
def audit_page_total(spark: SparkSession, path: str) -> DataFrame:
    catalog = _settled_catalog(spark, path)
    return views.audit_total(catalog, snapshot(_variation_log(catalog), "log"), PARENT, sku="SKU-1")


@query
def sku_matches(spark: SparkSession, path: str) -> DataFrame:
    return views.sku_matches(_catalog(spark, path), "SKU-1")


@query
def pending_head(spark: SparkSession, path: str) -> DataFrame:
    catalog = _catalog(spark, path)
    return views.pending_head(ch.freeze(catalog, EVERYTHING, [COST_PLUS], PARENT, REGISTRY), PARENT, 50)


# Formulas --------------------------------------------------------------------------------------

FORMULAS: dict[str, dict[str, fm.Formula]] = {
    "derive_price_pct": {"result": fm.percent(PRICE, -10)},
    "derive_margin_ratio": {"result": (fm.var(PRICE) - fm.var("cost")) / (fm.var("stock") - 5)},
    "derive_round": {"result": fm.round_(fm.var(PRICE) * 0.35)},
    "derive_ceil_floor": {
        "up": fm.ceil(fm.var(PRICE) * 0.333),
        "down": fm.floor(fm.var(PRICE) * 0.333),
        "size": fm.abs_(-fm.var(PRICE)),
    },
    "derive_roundto_cost": {"result": COST_PLUS.formula},
    "derive_floor_price": {
        "highest": fm.max_(fm.var(PRICE) * 0.8, fm.var("cost") * 1.1),
        "lowest": fm.min_(fm.var(PRICE) * 0.8, fm.var("cost"), fm.var("sale_price")),
    },
    "derive_numeric_read": {"cost": fm.var("cost") + 0, "sale": +fm.var("sale_price")},
}


def _formula_query(formulas: dict[str, fm.Formula]) -> Query:
    return lambda spark, path: ch.derived_numbers(_catalog(spark, path), EVERYTHING, formulas, REGISTRY)


for _name, _formulas in FORMULAS.items():
    QUERIES[_name] = _formula_query(_formulas)


@query
def values_equal_matrix(spark: SparkSession, path: str) -> DataFrame:
    meta = _catalog(spark, path).meta.where(F.col("meta_key").isin("_regular_price", "_cost"))
    value, form = F.col("meta_value"), F.col("object_id") % 8
    other = (
        F.when(form == 0, value)
        .when(form == 1, F.concat(value, F.lit("0")))
        .when(form == 2, F.concat(F.lit(" "), value, F.lit(" ")))
        .when(form == 3, F.lit(""))
        .when(form == 4, F.concat(value, F.lit("d")))
        .when(form == 5, F.lit("900.1"))
        .when(form == 6, F.concat(F.lit("+"), value))
    )
    return meta.select("object_id", "meta_key", values_equal(value, other).alias("same"))


@query
def decode_entities_query(spark: SparkSession, path: str) -> DataFrame:
    part = Star(spark, path).table("part")
    escaped = F.concat(
        F.col("p_type"),
        F.lit(" &amp; "),
        F.col("p_name"),
        F.lit(" &lt;b&gt; &quot;x&quot; &#039;y&#8217; &amp;lt; caf&eacute; &unknown; &#x41; & "),
        F.col("p_brand"),
    )
    return part.select("p_partkey", decode_entities(escaped).alias("name"))


# Change sets -----------------------------------------------------------------------------------


@query
def preview_formula(spark: SparkSession, path: str) -> DataFrame:
    return ch.preview(_catalog(spark, path), EVERYTHING, [COST_PLUS], REGISTRY)


@query
def preview_set(spark: SparkSession, path: str) -> DataFrame:
    return ch.preview(_catalog(spark, path), COMBINED, [SetValue("stock_status", "outofstock")], REGISTRY)


@query
def omitted_targets(spark: SparkSession, path: str) -> DataFrame:
    return ch.omitted_targets(_catalog(spark, path), EVERYTHING, [COST_PLUS], REGISTRY)


@query
def freeze_targets(spark: SparkSession, path: str) -> DataFrame:
    return ch.freeze(_catalog(spark, path), EVERYTHING, SALE_AFTER_PRICE, PARENT, REGISTRY)


@query
def changeset_formula(spark: SparkSession, path: str) -> DataFrame:
    return ch.changeset(_catalog(spark, path), EVERYTHING, [COST_PLUS], PARENT, REGISTRY)


@query
def changeset_set(spark: SparkSession, path: str) -> DataFrame:
    return ch.changeset(_catalog(spark, path), COMBINED, [SetValue(PRICE, "9.99")], PARENT, REGISTRY)


@query
def changeset_two_actions(spark: SparkSession, path: str) -> DataFrame:
    return ch.changeset(_catalog(spark, path), COMBINED, SALE_AFTER_PRICE, PARENT, REGISTRY)


@query
def changeset_statuses(spark: SparkSession, path: str) -> DataFrame:
    """Targets frozen first; every ninth object is gone by the time they are settled."""
    catalog = _catalog(spark, path)
    frozen = snapshot(ch.freeze(catalog, EVERYTHING, [COST_PLUS], PARENT, REGISTRY), "frozen")
    later = catalog.with_tables(objects=catalog.objects.where(F.col("object_id") % 9 != 0))
    return ch.derive(later, frozen, [COST_PLUS], REGISTRY)


@query
def preview_values(spark: SparkSession, path: str) -> DataFrame:
    return ch.preview_values(_catalog(spark, path), COMBINED, SALE_AFTER_PRICE, REGISTRY, 20)


def _run(catalog: Catalog, actions: list[Action], flt: Filter = EVERYTHING) -> tuple[DataFrame, Catalog]:
    changes = snapshot(ch.changeset(catalog, flt, actions, PARENT, REGISTRY), "changes")
    return changes, ch.apply_changes(catalog, changes, [a.field for a in actions], REGISTRY)


@query
def replay_noop(spark: SparkSession, path: str) -> DataFrame:
    """Settling again, against the changed catalog, leaves every row as it was."""
    changes, after = _run(_catalog(spark, path), [COST_PLUS])
    return ch.derive(after, changes, [COST_PLUS], REGISTRY)


@query
def settle_once(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes reported twice, with the second report differing, count once."""
    catalog = _catalog(spark, path)
    frozen = snapshot(ch.freeze(catalog, EVERYTHING, [COST_PLUS], PARENT, REGISTRY), "frozen")
    outcome = ch.derive(catalog, frozen, [COST_PLUS], REGISTRY).withColumn("seen", F.lit(1))
    replay = outcome.withColumns({"seen": F.lit(2), "new_value": F.lit("0")})
    return ch.settle(frozen, outcome.unionByName(replay), "seen")


@query
def catalog_after_apply(spark: SparkSession, path: str) -> DataFrame:
    _, after = _run(_catalog(spark, path), SALE_AFTER_PRICE, COMBINED)
    return _shown(after.objects.select("object_id", "title", "min_price", "max_price", "stock_quantity"))


@query
def meta_after_apply(spark: SparkSession, path: str) -> DataFrame:
    _, after = _run(_catalog(spark, path), SALE_AFTER_PRICE, COMBINED)
    return after.meta


@query
def objects_after_set(spark: SparkSession, path: str) -> DataFrame:
    actions = [SetValue("stock_status", "onbackorder"), SetValue("stock_quantity", 7), SetValue("meta:note", "x")]
    _, after = _run(_catalog(spark, path), actions, COMBINED)
    return after.objects.select("object_id", "stock_status", "stock_quantity")


# Undo ------------------------------------------------------------------------------------------


def _drifted(catalog: Catalog) -> Catalog:
    """Later edits: every seventh price is raised, and every seventh is only written differently."""
    value, form = F.col("meta_value"), F.col("object_id") % 7
    priced = (F.col("meta_key") == "_regular_price") & (value != "")
    raised = (value.try_cast("decimal(19,2)") + F.lit(5.55).cast("decimal(19,2)")).cast("string")
    rewritten = F.when(value.contains("."), F.concat(value, F.lit("0"))).otherwise(F.concat(value, F.lit(".0")))
    edited = F.when(priced & (form == 0), raised).when(priced & (form == 1), rewritten).otherwise(value)
    return catalog.with_tables(meta=catalog.meta.withColumn("meta_value", edited))


def _undo(catalog: Catalog, policy: str) -> tuple[DataFrame, Catalog]:
    changes, after = _run(catalog, [COST_PLUS])
    edited = _drifted(after)
    return undo.revert_now(edited, changes, PARENT, UNDO, [PRICE], policy, REGISTRY), edited


@query
def undo_targets(spark: SparkSession, path: str) -> DataFrame:
    changes = ch.changeset(_catalog(spark, path), EVERYTHING, [COST_PLUS], PARENT, REGISTRY)
    return undo.undo_targets(changes, PARENT, UNDO)


@query
def undo_changeset_skip(spark: SparkSession, path: str) -> DataFrame:
    return _undo(_catalog(spark, path), "skip")[0]


@query
def undo_changeset_force(spark: SparkSession, path: str) -> DataFrame:
    return _undo(_catalog(spark, path), "force")[0]


@query
def redo_changeset(spark: SparkSession, path: str) -> DataFrame:
    """Undoing the undo: the undo's own rows, reverted on the catalog it left behind."""
    rows, edited = _undo(_catalog(spark, path), "skip")
    undone = snapshot(rows, "undone")
    after = ch.apply_changes(edited, undone, [PRICE], REGISTRY)
    return undo.revert_now(after, undone, UNDO, REDO, [PRICE], "skip", REGISTRY)


@query
def undo_of_frozen_targets(spark: SparkSession, path: str) -> DataFrame:
    """An undo frozen first and settled later, when a part of the parent's deltas has been
    purged: those rows are skipped."""
    changes, after = _run(_catalog(spark, path), [COST_PLUS])
    targets = snapshot(undo.undo_targets(changes, PARENT, UNDO), "targets")
    purged = changes.where(F.col("object_id") % 5 != 0)
    return undo.revert(_drifted(after), purged, targets, PARENT, [PRICE], "skip", REGISTRY)


@query
def undo_preview_sample(spark: SparkSession, path: str) -> DataFrame:
    changes, after = _run(_catalog(spark, path), [COST_PLUS])
    return undo.undo_preview_sample(_drifted(after), changes, PARENT, [PRICE], "skip", REGISTRY, 20)


@query
def undo_preview_totals(spark: SparkSession, path: str) -> DataFrame:
    changes, after = _run(_catalog(spark, path), [COST_PLUS])
    return undo.undo_preview_totals(_drifted(after), changes, PARENT, [PRICE], REGISTRY)


# Logs ------------------------------------------------------------------------------------------


@query
def change_counts(spark: SparkSession, path: str) -> DataFrame:
    return oplog.change_counts(Star(spark, path).changes(), OPERATION)


@query
def operation_summary(spark: SparkSession, path: str) -> DataFrame:
    return oplog.operation_summary(Star(spark, path).changes())


@query
def operation_progress(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return oplog.operation_progress(star.changes(), star.operations())


@query
def operation_counters(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    rows = oplog.recount(star.operations(), star.changes())
    return rows.select("id", "status", "target_count", "processed", "failed")


@query
def recent_operations(spark: SparkSession, path: str) -> DataFrame:
    rows = oplog.recent_operations(Star(spark, path).operations())
    return _shown(rows.select("id", "status", "source", "user_id", "created_at", "completed_at"))


@query
def operation_history(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return _shown(oplog.operation_history(star.operations(), star.users()))


@query
def active_operation(spark: SparkSession, path: str) -> DataFrame:
    return oplog.active_operation(Star(spark, path).operations(), excluding=1).select("id", "status")


@query
def stalled_operations(spark: SparkSession, path: str) -> DataFrame:
    rows = oplog.stalled_operations(Star(spark, path).operations(), LOG_NOW)
    return _shown(rows.select("id", "last_progress_at"))


@query
def operation_final_status(spark: SparkSession, path: str) -> DataFrame:
    return oplog.final_statuses(Star(spark, path).operations())


@query
def completion_report(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return _shown(
        oplog.completion_report(star.operations(), star.changes(), star.rules(), "admin@example.com")
    )


@query
def retention_expired_ops(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return oplog.expired_operations(star.operations(), star.changes(), CUTOFF)


@query
def retention_purge_counts(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return oplog.purge_counts(star.operations(), star.changes(), CUTOFF)


@query
def retention_survivors(spark: SparkSession, path: str) -> DataFrame:
    star = Star(spark, path)
    return oplog.survivors(star.operations(), star.changes(), CUTOFF)


@query
def field_summary(spark: SparkSession, path: str) -> DataFrame:
    """Log rows by the field they refer to: core, metadata, registered by a user, and one that nobody owns any more."""
    registry = FieldRegistry()
    registry.register(Field("supplier", "Supplier", "partner", "supplier_code", meta_key="_supplier"))
    form, of_meta = F.col("object_id") % 5, F.lit("meta")
    kind = F.when(form == 1, of_meta).when(form == 2, F.lit("partner")).when(form == 3, F.lit("gone")).otherwise(F.col("field_type"))
    key = F.when(form == 1, F.lit("_cost")).when(form == 2, F.lit("supplier_code")).otherwise(F.col("field_key"))
    return oplog.field_summary(Star(spark, path).changes().withColumns({"field_type": kind, "field_key": key}), registry)


@query
def formula_variables(spark: SparkSession, path: str) -> DataFrame:
    """All variables of formulas, in a shop that keeps its cost under another key."""
    registry = FieldRegistry(cost_meta_key="_sale_price")
    every = {f"of_{name}": fm.var(name) + 0 for name in registry.variable_names()}
    return ch.derived_numbers(_catalog(spark, path), EVERYTHING, every, registry)


@query
def two_fields_of_one_key(spark: SparkSession, path: str) -> DataFrame:
    """Rows are matched to fields by type and key; of two fields stored in one place the later action stays."""
    _, after = _run(_catalog(spark, path), [SetValue(PRICE, "5"), SetValue("meta:_regular_price", "6")], COMBINED)
    return after.meta


@query
def operation_caps(spark: SparkSession, path: str) -> DataFrame:
    """Whether an operation may run under caps on its objects, and how many rows it then logs."""
    catalog, log, out = _catalog(spark, path), ChangeLog(spark, _folder(spark, "capped")), None
    for number, cap in enumerate((0, 3, 10**9)):
        try:
            rows = run_operation(catalog, COMBINED, SALE_AFTER_PRICE, number, REGISTRY, log, cap).changes
        except TooManyObjects:
            rows = spark.createDataFrame([], CHANGES)
        own = rows.agg(F.count("*").alias("logged")).select(F.lit(cap).cast("bigint").alias("cap"), "logged")
        out = own if out is None else out.unionByName(own)
    return out


# Stored logs -----------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored_log(spark: SparkSession, path: str) -> ChangeLog:
    """Two operations, as they are kept."""
    catalog, log = _catalog(spark, path), ChangeLog(spark, _folder(spark, "log"))
    for operation, flt, actions in ((PARENT, EVERYTHING, [COST_PLUS]), (OPERATION, COMBINED, SALE_AFTER_PRICE)):
        log.write_settled(ch.changeset(catalog, flt, actions, operation, REGISTRY), operation)
    return log


@query
def stored_log_summary(spark: SparkSession, path: str) -> DataFrame:
    return oplog.operation_summary(_stored_log(spark, path).all_settled())


@query
def stored_change_counts(spark: SparkSession, path: str) -> DataFrame:
    """One operation of the stored log: the filter selects its folder."""
    return oplog.change_counts(_stored_log(spark, path).all_settled(), OPERATION)


@query
def stored_frozen_targets(spark: SparkSession, path: str) -> DataFrame:
    rows = ch.freeze(_catalog(spark, path), EVERYTHING, SALE_AFTER_PRICE, PARENT, REGISTRY)
    return ChangeLog(spark, _folder(spark, "frozen")).write_frozen(rows, PARENT)


@query
def stored_operations(spark: SparkSession, path: str) -> DataFrame:
    """Operation rows written twice, the second time as they are once undos have taken effect: the newest version counts."""
    rows, log = Star(spark, path).operations(), OperationLog(spark, _folder(spark, "operations"))
    log.append(rows, 1)
    final = oplog.final_statuses(rows).select("id", F.col("status").alias("__final"))
    log.append(rows.join(final, "id").withColumn("status", F.col("__final")), 2)
    return log.read().select("id", "status", "source", "target_count")


@lru_cache(maxsize=2)
def _archive(spark: SparkSession, path: str) -> LogArchive:
    """The star's log of many operations, added in two parts, one of them twice."""
    rows, kept = snapshot(Star(spark, path).changes(), "changes"), LogArchive(spark, _folder(spark, "archive"))
    kept.add(rows.where(F.col("operation_id") % 3 == 0))
    kept.add(rows)
    return kept


@query
def archived_log_summary(spark: SparkSession, path: str) -> DataFrame:
    return oplog.operation_summary(_archive(spark, path).rows())


@query
def archived_change_counts(spark: SparkSession, path: str) -> DataFrame:
    """One operation of the archive: its bucket, and the row groups that can hold it."""
    return oplog.change_counts(_archive(spark, path).rows(OPERATION), OPERATION)


@query
def archived_audit_page(spark: SparkSession, path: str) -> DataFrame:
    catalog = _catalog(spark, path)
    return views.audit_page(catalog, _archive(spark, path).rows(AUDITED), AUDITED, page=1, per_page=50)


@query
def archived_survivors(spark: SparkSession, path: str) -> DataFrame:
    """What retention leaves once the archive is compacted without expired operations."""
    star, kept = Star(spark, path), LogArchive(spark, _folder(spark, "retained"))
    kept.add(star.changes())
    kept.compact(oplog.expired_operations(star.operations(), kept.rows(), CUTOFF))
    return kept.rows()


@lru_cache(maxsize=2)
def _kept_counters(spark: SparkSession, path: str) -> DataFrame:
    """The star's log counted as it is written: in batches, first pending and then settled, one batch twice, and compacted in between."""
    rows = snapshot(Star(spark, path).changes().select("operation_id", "object_id", "status"), "changes")
    kept = CounterLog(spark, _folder(spark, "counters"))
    kept.append(rows.withColumn("status", F.lit(0)), batch_of(4), 1)
    kept.append(rows, batch_of(4), 2)
    kept.compact()
    kept.append(rows.where(batch_of(4) == 1), 1, 2)
    return kept.counters()


@query
def kept_operation_summary(spark: SparkSession, path: str) -> DataFrame:
    return counters.operation_summary(_kept_counters(spark, path))


@query
def kept_operation_progress(spark: SparkSession, path: str) -> DataFrame:
    return counters.operation_progress(_kept_counters(spark, path), Star(spark, path).operations())


# Chains, parts and indexes ---------------------------------------------------------------------

CHAIN = (11, 12, 13, 14, 15)
CHAIN_FIELDS = [PRICE, "sale_price", "stock_quantity", "meta:_cost"]


#: Conditions that the chain itself does not change.
CHAIN_FILTER = Filter(COMBINED.conditions[1:])


@lru_cache(maxsize=2)
def _chain_log(spark: SparkSession, path: str) -> tuple[Catalog, DataFrame]:
    """Five operations applied in turn to the objects of a filter; the fourth undoes the second. The catalog before them, and the log."""
    catalog, log = _catalog(spark, path), ChangeLog(spark, _folder(spark, "chain"))
    ids = snapshot(resolve(catalog, CHAIN_FILTER), "ids")

    def kept(objects: DataFrame, meta: DataFrame) -> Catalog:
        return catalog.with_tables(objects=snapshot(objects, "objects"), meta=snapshot(meta, "meta"))

    steps = [
        [FormulaAction(PRICE, fm.var(PRICE) + 10), SetValue("stock_quantity", 7)],
        [FormulaAction("sale_price", fm.var(PRICE) - 1)],
        [FormulaAction(PRICE, fm.var("sale_price") * 2)],
        None,
        [FormulaAction(PRICE, fm.var(PRICE) - 1), SetValue("meta:_cost", "5")],
    ]
    # The filter's objects are products, so nothing of a variation is read; once they are alone, no step needs their ids again.
    products = catalog.objects.where(F.col("object_type") == Scope.PRODUCT.value)
    now = kept(*[t.join(ids, "object_id", "left_semi") for t in (products, catalog.meta_of(Scope.PRODUCT))])
    for operation, actions in zip(CHAIN, steps):
        if actions is None:
            rows, fields = undo.revert_now(now, log.settled(CHAIN[1]), CHAIN[1], operation, ["sale_price"], "skip", REGISTRY), ["sale_price"]
        else:
            rows, fields = ch.changeset(now, CHAIN_FILTER, actions, operation, REGISTRY), [a.field for a in actions]
        after = ch.apply_changes(now, log.write_settled(rows, operation), fields, REGISTRY)
        now = kept(after.objects, after.meta)
    return catalog, log.all_settled()


@query
def chain_changeset(spark: SparkSession, path: str) -> DataFrame:
    """Five operations as one change set."""
    return compose(_chain_log(spark, path)[1], CHAIN, OPERATION)


@query
def apply_chain_meta(spark: SparkSession, path: str) -> DataFrame:
    catalog, log = _chain_log(spark, path)
    chain = snapshot(compose(log, CHAIN, OPERATION), "chain")
    return ch.apply_changes(catalog, chain, CHAIN_FIELDS, REGISTRY, Scope.PRODUCT).meta


@query
def undo_chain(spark: SparkSession, path: str) -> DataFrame:
    """All five taken back at once: the metadata is what it was."""
    catalog, log = _chain_log(spark, path)
    chain = snapshot(compose(log, CHAIN, OPERATION), "chain")
    after = ch.apply_changes(catalog, chain, CHAIN_FIELDS, REGISTRY, Scope.PRODUCT)
    undone = snapshot(undo.revert_now(after, chain, OPERATION, UNDO, CHAIN_FIELDS, "skip", REGISTRY, Scope.PRODUCT), "undone")
    return ch.apply_changes(after, undone, CHAIN_FIELDS, REGISTRY, Scope.PRODUCT).meta


@lru_cache(maxsize=2)
def _parted(spark: SparkSession, path: str) -> Catalog:
    catalog, store = _settled_catalog(spark, path), PartedStore(spark, _folder(spark, "parted"))
    changes = snapshot(ch.changeset(catalog, COMBINED, SALE_AFTER_PRICE, PARENT, REGISTRY), "changes")
    store.write(catalog, "v1")
    return store.apply("v1", changes, [a.field for a in SALE_AFTER_PRICE], REGISTRY, "v2")


@query
def parted_meta_after_apply(spark: SparkSession, path: str) -> DataFrame:
    """A version that rewrites the parts of two keys and takes over the others."""
    return _parted(spark, path).meta


@query
def parted_catalog_after_apply(spark: SparkSession, path: str) -> DataFrame:
    return _shown(_parted(spark, path).objects.select("object_id", "title", "min_price", "max_price", "stock_quantity"))


@query
def indexed_sku_contains(spark: SparkSession, path: str) -> DataFrame:
    """A SKU condition answered by a stored trigram index."""
    catalog = _catalog(spark, path)
    return resolve_indexed(catalog, FILTERS["filter_sku_contains"], SkuIndex(spark, _folder(spark, "skus")).write(catalog))


@query
def indexed_sku_matches(spark: SparkSession, path: str) -> DataFrame:
    return SkuIndex(spark, _folder(spark, "skus")).write(_catalog(spark, path)).sku_matches("SKU-1")


@query
def ranked_product_page(spark: SparkSession, path: str) -> DataFrame:
    """A page far down, by the ranks of a stored index."""
    catalog = _catalog(spark, path)
    index = RankIndex(spark, _folder(spark, "ranks")).write(scan_scope(catalog, Scope.PRODUCT).join(resolve(catalog, EVERYTHING), "object_id", "left_semi"))
    return _shown(views.ranked_page(catalog, index.page(4, 25), Scope.PRODUCT, REGISTRY))


# Discovery -------------------------------------------------------------------------------------


@query
def discover_meta_keys(spark: SparkSession, path: str) -> DataFrame:
    return discovery.meta_keys(_catalog(spark, path))


@query
def discover_brands(spark: SparkSession, path: str) -> DataFrame:
    return discovery.brands(_catalog(spark, path), REGISTRY)


@query
def discover_categories(spark: SparkSession, path: str) -> DataFrame:
    return discovery.terms_with_counts(_catalog(spark, path), "product_cat")


@query
def discover_tags(spark: SparkSession, path: str) -> DataFrame:
    return discovery.terms_with_counts(_catalog(spark, path), "product_tag")


@query
def discover_attribute_terms(spark: SparkSession, path: str) -> DataFrame:
    return discovery.attribute_terms(_catalog(spark, path))


@query
def discover_attributes(spark: SparkSession, path: str) -> DataFrame:
    nested = discovery.attributes(_catalog(spark, path))
    line = F.transform("terms", lambda t: F.concat_ws(":", t["term_id"].cast("string"), t["slug"], t["name"]))
    return nested.select("field", "taxonomy", "label", F.array_join(line, ",").alias("terms"))


# Rules -----------------------------------------------------------------------------------------


@query
def due_rules(spark: SparkSession, path: str) -> DataFrame:
    rows = rules.due_rules(Star(spark, path).rules(), NOW)
    return _shown(rows.select("id", "name", "recurrence", "next_run"))


@query
def recent_rules(spark: SparkSession, path: str) -> DataFrame:
    return _shown(rules.recent_rules(Star(spark, path).rules()).select("id", "recurrence", "next_run"))


@query
def advance_rules(spark: SparkSession, path: str) -> DataFrame:
    rows = rules.advance(Star(spark, path).rules(), NOW)
    return _shown(rows.select("id", "recurrence", "status", "next_run", "last_run"))


@query
def rule_run_changeset(spark: SparkSession, path: str) -> DataFrame:
    """All due rules: a change set per template."""
    return due_changesets(_catalog(spark, path), Star(spark, path).rules(), NOW, REGISTRY).changes


@query
def rule_run_templates(spark: SparkSession, path: str) -> DataFrame:
    """Which due rule takes part in which of these change sets."""
    return due_changesets(_catalog(spark, path), Star(spark, path).rules(), NOW, REGISTRY).rules


STOCK_UP = FormulaAction("stock_quantity", fm.var("stock") * 1.5)


@query
def stock_after_formula(spark: SparkSession, path: str) -> DataFrame:
    """What the log says was set, beside what the catalog holds."""
    changes, after = _run(_catalog(spark, path), [STOCK_UP])
    return changes.join(after.objects, "object_id").select("object_id", "old_value", "new_value", changes.status, after.objects.stock_quantity)


@query
def undo_stock_formula(spark: SparkSession, path: str) -> DataFrame:
    changes, after = _run(_catalog(spark, path), [STOCK_UP])
    return undo.revert_now(after, changes, PARENT, UNDO, ["stock_quantity"], "skip", REGISTRY)


@query
def price_too_large(spark: SparkSession, path: str) -> DataFrame:
    """A price that no column can hold is not set."""
    changes, after = _run(_catalog(spark, path), [SetValue(PRICE, "1e16")], COMBINED)
    return _shown(changes.join(after.objects, "object_id").select("object_id", "new_value", changes.status, after.objects.min_price))


@query
def stored_catalog_prices(spark: SparkSession, path: str) -> DataFrame:
    """A catalog written as a version, opened again and read."""
    store = CatalogStore(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    opened = store.write(_settled_catalog(spark, path), "v1")
    return opened.objects.join(opened.meta.where("meta_key = '_regular_price'"), "object_id").select("object_id", "object_type", "sku", "meta_value")


@query
def normalize_start(spark: SparkSession, path: str) -> DataFrame:
    orders = Star(spark, path).table("orders")
    form = F.col("o_orderkey") % 6
    text = (
        F.when(form == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(form == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 2, F.concat(F.lit("  "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ")))
        .when(form == 3, F.lit("  "))
        .when(form == 4, F.lit("soon"))
    )
    return _shown(orders.select("o_orderkey", start_time(text, instant(NOW)).alias("starts_at")))


# Generated catalog -----------------------------------------------------------------------------


def _generated(spark: SparkSession, path: str) -> Catalog:
    """One generated product per part."""
    part = Star(spark, path).table("part")
    return synth_catalog(part.select((F.col("p_partkey") + 1).cast("bigint").alias("n")), 30)


@query
def synth_objects(spark: SparkSession, path: str) -> DataFrame:
    return _shown(_generated(spark, path).objects)


@query
def synth_meta(spark: SparkSession, path: str) -> DataFrame:
    return _generated(spark, path).meta


@query
def synth_links(spark: SparkSession, path: str) -> DataFrame:
    return _generated(spark, path).object_terms


# Streams ---------------------------------------------------------------------------------------


def _events(spark: SparkSession, path: str) -> DataFrame:
    stored = Star(spark, path).table("events").schema
    events = spark.readStream.schema(stored).option("pathGlobFilter", "events.parquet").parquet(path)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") + 1).cast("bigint").alias("operation_id"),
        (F.col("user_id") + 1).cast("bigint").alias("object_id"),
        "event_type",
        F.col("value").cast("decimal(19,2)").cast("string").alias("value"),
    )


def _stream_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def stream_enforcement(spark: SparkSession, path: str) -> DataFrame:
    action = FormulaAction(PRICE, fm.max_(fm.var(PRICE), fm.var("cost") * 1.5))
    flt = Filter((Condition("stock_status", "=", "instock"),))
    targets = snapshot(streams.enforcement_targets(_catalog(spark, path), flt, [action], REGISTRY), "targets")

    def enforce(batch: DataFrame) -> DataFrame:
        return streams.enforce(batch, targets, action, REGISTRY)

    rows = streams.drain_batches(_events(spark, path), enforce, _stream_dir(spark, "enforce"))
    return rows.select("event_id", "object_id", "field_key", "old_value", "new_value", "status")


@query
def stream_admit_once(spark: SparkSession, path: str) -> DataFrame:
    admitted = streams.admit_once(_events(spark, path), ["operation_id", "event_type"], "ts", "60 days")
    return streams.drain(admitted.select("operation_id", "event_type"), _stream_dir(spark, "admit"))


@query
def stream_progress(spark: SparkSession, path: str) -> DataFrame:
    counted = streams.progress(_events(spark, path), "ts", "1 day", "60 days")
    versions = streams.drain_batches(counted, lambda batch: batch, _stream_dir(spark, "progress"))
    rows = streams.newest(versions, ["operation_id", "bucket_start"])
    return _shown(streams.with_stall_flag(rows, STREAM_NOW).select("operation_id", "bucket_start", "changes", "stalled"))


@query
def stream_stalls(spark: SparkSession, path: str) -> DataFrame:
    """Operations that fell silent for a day, found while the stream runs."""
    found = streams.stalls(_events(spark, path), "ts", "1 day", "2 hours")
    return _shown(streams.drain(found, _stream_dir(spark, "stalls")))


VERSION_TIMES = (datetime(2023, 1, 1), datetime(2024, 1, 15))


@query
def stream_enforcement_versions(spark: SparkSession, path: str) -> DataFrame:
    """Updates held against the catalog of their time: in its second version the cost of the combined filter is 2000."""
    catalog = _catalog(spark, path)
    action = FormulaAction(PRICE, fm.max_(fm.var(PRICE), fm.var("cost") * 1.5))
    flt = Filter((Condition("stock_status", "=", "instock"),))
    _, later = _run(catalog, [SetValue("meta:_cost", "2000")], COMBINED)
    known = [(t, streams.enforcement_targets(c, flt, [action], REGISTRY)) for t, c in zip(VERSION_TIMES, (catalog, later))]
    targets = snapshot(streams.versioned_targets(known), "targets")

    def enforce(batch: DataFrame) -> DataFrame:
        return streams.enforce_as_of(batch, targets, VERSION_TIMES, action, REGISTRY)

    rows = streams.drain_batches(_events(spark, path), enforce, _stream_dir(spark, "enforce"))
    return rows.select("event_id", "object_id", "field_key", "old_value", "new_value", "status")
