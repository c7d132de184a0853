"""Change sets: freezing targets, deriving old and new values, applying them.

A change-log row is one (operation, object, action). It starts pending and settles once, as
applied, skipped (there was no new value) or failed (the object is gone).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.catalog import Catalog
from shelfwright.functions.formula import Formula
from shelfwright.functions.numbers import number_text, numeric
from shelfwright.operators.actions import Action, FormulaAction, actions_to_json, check_actions, reads_of
from shelfwright.operators.fields import PRICE_FIELDS, PRICE_META_KEYS, Field, FieldRegistry, unique
from shelfwright.operators.filters import Filter
from shelfwright.operators.resolve import Facts, ManyMatcher, Matcher, all_of
from shelfwright.schema import CHANGE_COLUMNS, CHANGE_KEY, PRICE_TYPE, ChangeStatus, Scope


def preview(catalog: Catalog, flt: Filter, actions: Sequence[Action], registry: FieldRegistry) -> DataFrame:
    """How many objects match, and how many of those the actions can give a value: one pass."""
    check_actions(actions, registry)
    matcher = Matcher(catalog, flt)
    applicable = all_of([matcher.present(f) for f in reads_of(actions, registry)])
    counts = matcher.frame().agg(
        F.count("*").alias("matched"), F.count_if(applicable).alias("applicable")
    )
    return counts.withColumn("omitted", F.col("matched") - F.col("applicable"))


def omitted_targets(
    catalog: Catalog, flt: Filter, actions: Sequence[Action], registry: FieldRegistry
) -> DataFrame:
    """The matching objects the actions cannot give a value."""
    matcher = Matcher(catalog, flt)
    applicable = all_of([matcher.present(f) for f in reads_of(actions, registry)])
    return matcher.frame().where(~applicable).select("object_id")


def freeze(
    catalog: Catalog,
    flt: Filter,
    actions: Sequence[Action],
    operation_id: int,
    registry: FieldRegistry,
) -> DataFrame:
    """Pending rows for every applicable object and action. Write these (see
    ``shelfwright.sources.store``) before anything is applied: the frame itself is lazy and would
    follow later edits of the catalog."""
    check_actions(actions, registry)
    matcher = Matcher(catalog, flt)
    applicable = all_of([matcher.present(f) for f in reads_of(actions, registry)])
    rows = matcher.frame().where(applicable)
    fields = [registry.get(a.field) for a in actions]
    parts = [
        F.struct(
            F.lit(i).cast("int").alias("action_ix"),
            F.lit(f.field_type).alias("field_type"),
            F.lit(f.storage_key).alias("field_key"),
        )
        for i, f in enumerate(fields)
    ]
    return rows.select(
        F.lit(operation_id).cast("bigint").alias("operation_id"),
        F.lit(flt.scope.value).alias("object_type"),
        "object_id",
        F.inline(F.array(*parts)),
    ).select(
        *CHANGE_COLUMNS[:6],
        F.lit(None).cast("string").alias("old_value"),
        F.lit(None).cast("string").alias("new_value"),
        F.lit(int(ChangeStatus.PENDING)).cast("int").alias("status"),
    )


def derive(
    catalog: Catalog, log: DataFrame, actions: Sequence[Action], registry: FieldRegistry
) -> DataFrame:
    """Settle the pending rows of one operation's log against a catalog. Rows that have settled
    before come back unchanged, so running this again does nothing."""
    check_actions(actions, registry)
    is_pending = F.col("status") == int(ChangeStatus.PENDING)
    pending, settled = log.where(is_pending), log.where(~is_pending)
    target = ["operation_id", "object_type", "object_id"]
    if len(actions) == 1:
        targets, flags = pending.select(*target), None
    else:
        marks = [F.bool_or(F.col("action_ix") == i).alias(f"__pending{i}") for i in range(len(actions))]
        targets = pending.groupBy(*target).agg(*marks)
        flags = [F.col(f"__pending{i}") for i in range(len(actions))]
    wide, texts = read_fields(catalog, _fields_of(actions, registry), pending)
    rows = targets.join(wide, "object_id", "left")
    outcome = _evaluate(rows, actions, registry, texts, F.coalesce(F.col("__found"), F.lit(False)), flags)
    return outcome.unionByName(settled.select(*CHANGE_COLUMNS))


def changeset(
    catalog: Catalog,
    flt: Filter,
    actions: Sequence[Action],
    operation_id: int,
    registry: FieldRegistry,
) -> DataFrame:
    """Freeze and derive against one catalog version in a single pass over its tables."""
    check_actions(actions, registry)
    matcher = Matcher(catalog, flt)
    applicable = all_of([matcher.present(f) for f in reads_of(actions, registry)])
    texts = {f.key: matcher.text(f) for f in _fields_of(actions, registry)}
    rows = matcher.frame().where(applicable)
    rows = rows.withColumns(
        {
            "operation_id": F.lit(operation_id).cast("bigint"),
            "object_type": F.lit(flt.scope.value),
        }
    )
    return _evaluate(rows, actions, registry, texts, F.lit(True), None)


def preview_values(
    catalog: Catalog,
    flt: Filter,
    actions: Sequence[Action],
    registry: FieldRegistry,
    limit: int = 20,
) -> DataFrame:
    """Old and new value of the first matching objects, without writing anything."""
    rows = changeset(catalog, flt, actions, 0, registry)
    return (
        rows.orderBy("object_id", "action_ix")
        .limit(limit)
        .select("object_id", "action_ix", "field_key", "old_value", "new_value", "status")
    )


def derived_numbers(
    catalog: Catalog, flt: Filter, formulas: Mapping[str, Formula], registry: FieldRegistry
) -> DataFrame:
    """Results of formulas over every matching object, as doubles; null where one has no result."""
    matcher = Matcher(catalog, flt)
    fields = unique(registry.variable(v) for f in formulas.values() for v in f.variables)
    texts = {f.key: matcher.text(f) for f in fields}
    results = [
        f.column({v: texts[registry.variable(v).key] for v in f.variables}).alias(name)
        for name, f in formulas.items()
    ]
    return matcher.frame().select("object_id", *results)


def read_fields(
    catalog: Catalog, fields: Sequence[Field], targets: DataFrame | None = None, scope: Scope | None = None
) -> tuple[DataFrame, dict[str, Column]]:
    """Current values of some fields, one row per object, as columns to be read after a join with
    ``targets``. ``__found`` tells an object without values from no object. ``scope``: what all targets are, if that is known."""
    ids = None if targets is None else targets.select("object_id")

    def of_targets(table: DataFrame) -> DataFrame:
        return table if ids is None else table.join(ids, "object_id", "left_semi")

    meta, objects = catalog.meta, catalog.objects
    if scope is not None:
        meta, objects = catalog.meta_of(scope), objects.where(F.col("object_type") == scope.value)
    facts = Facts(of_targets(meta), "meta_key", "__v")
    columns = {f.column for f in fields if f.column is not None}
    texts = {
        f.key: f.read(facts.value(f.meta_key) if f.meta_key is not None else F.col(f"__c_{f.column}"))
        for f in fields
    }
    wide = of_targets(objects).select(
        "object_id",
        F.lit(True).alias("__found"),
        *[F.col(c).alias(f"__c_{c}") for c in sorted(columns)],
    )
    meta = facts.frame()
    if meta is not None:
        wide = wide.join(meta, "object_id", "left")
    return wide, texts


def _fields_of(actions: Sequence[Action], registry: FieldRegistry) -> list[Field]:
    return unique([registry.get(a.field) for a in actions] + reads_of(actions, registry))


def _outcomes(
    rows: DataFrame,
    actions: Sequence[Action],
    registry: FieldRegistry,
    texts: Mapping[str, Column],
    found: Column,
    pending: Sequence[Column] | None,
    tag: str = "",
    only: Column | None = None,
) -> tuple[DataFrame, list[dict[str, Column]]]:
    """Run the actions in order; each sees what earlier ones have set on the same object. Gives the columns of a log row per
    action; ``only`` tells for which rows they are computed."""
    staged = dict(texts)
    parts = []
    for i, action in enumerate(actions):
        field, number, name = registry.get(action.field), f"__number{tag}{i}", f"{tag}{i}"
        if isinstance(action, FormulaAction):
            # Its own projection, so that printing the number does not repeat computing it.
            value = action.new_number(registry, staged)
            rows = rows.withColumn(number, value if only is None else F.when(only, value))
            new = number_text(F.col(number))
        else:
            new = action.new_text(registry, staged)
        # The log records what the catalog will hold.
        new = field.hold(new)
        if pending is not None:
            new = F.when(pending[i], new)
        rows = rows.withColumns({f"__old{name}": staged[field.key], f"__new{name}": new})
        old, new = F.col(f"__old{name}"), F.col(f"__new{name}")
        staged[field.key] = F.when(new.isNotNull(), field.read(field.write(new))).otherwise(old)
        status = (
            F.when(~found, int(ChangeStatus.FAILED))
            .when(new.isNull(), int(ChangeStatus.SKIPPED))
            .otherwise(int(ChangeStatus.APPLIED))
        )
        parts.append(
            {
                "action_ix": F.lit(i).cast("int"),
                "field_type": F.lit(field.field_type),
                "field_key": F.lit(field.storage_key),
                "old_value": F.when(found, old),
                "new_value": F.when(found, new),
                "status": status.cast("int"),
            }
        )
    return rows, parts


def _evaluate(
    rows: DataFrame,
    actions: Sequence[Action],
    registry: FieldRegistry,
    texts: Mapping[str, Column],
    found: Column,
    pending: Sequence[Column] | None,
) -> DataFrame:
    rows, parts = _outcomes(rows, actions, registry, texts, found, pending)
    if len(parts) == 1:
        return rows.withColumns(parts[0]).select(*CHANGE_COLUMNS)
    structs = [F.struct(*[c.alias(n) for n, c in part.items()]) for part in parts]
    if pending is not None:
        structs = [F.when(p, s) for p, s in zip(pending, structs)]
    rows = rows.select(
        "operation_id",
        "object_type",
        "object_id",
        F.explode(F.array_compact(F.array(*structs))).alias("__row"),
    )
    return rows.select("operation_id", "object_type", "object_id", "__row.*")


@dataclass(frozen=True)
class Template:
    """A filter with its actions, and the operation id its change set goes under."""

    number: int
    flt: Filter
    actions: tuple[Action, ...]


def changesets(catalog: Catalog, templates: Sequence[Template], registry: FieldRegistry) -> DataFrame | None:
    """The change sets of all templates against one catalog version, in the table passes of one change set per scope.

    All conditions are bits of one row per object. A row is repeated for each template it matches and can be given a value
    by; action lists that several templates share are evaluated in one place."""
    found = None
    for scope in sorted({t.flt.scope for t in templates}, key=lambda s: s.value):
        rows = _scope_changesets(catalog, scope, [t for t in templates if t.flt.scope is scope], registry)
        found = rows if found is None else found.unionByName(rows)
    return found


def _scope_changesets(catalog: Catalog, scope: Scope, templates: Sequence[Template], registry: FieldRegistry) -> DataFrame:
    matcher = ManyMatcher(catalog, scope)
    takers, texts = [], {}
    lists: dict[str, tuple[Sequence[Action], list[int]]] = {}
    for t in templates:
        check_actions(t.actions, registry)
        takes = matcher.test(t.flt) & all_of([matcher.present(f) for f in reads_of(t.actions, registry)])
        takers.append(F.when(takes, F.lit(t.number).cast("bigint")))
        texts |= {f.key: matcher.text(f) for f in _fields_of(t.actions, registry)}
        lists.setdefault(actions_to_json(t.actions), (t.actions, []))[1].append(t.number)
    named = {key: f"__text{i}" for i, key in enumerate(texts)}
    rows = matcher.frame().select(
        "object_id",
        *[texts[key].alias(name) for key, name in named.items()],
        F.explode(F.array_compact(F.array(*takers))).alias("operation_id"),
    )
    rows = rows.withColumn("object_type", F.lit(scope.value))
    chosen, current = None, {key: F.col(name) for key, name in named.items()}
    for i, (actions, numbers) in enumerate(lists.values()):
        mine = F.col("operation_id").isin(*numbers)
        rows, parts = _outcomes(rows, actions, registry, current, F.lit(True), None, f"{i}_", mine)
        structs = F.array(*[F.struct(*[c.alias(n) for n, c in part.items()]) for part in parts])
        chosen = F.when(mine, structs) if chosen is None else chosen.when(mine, structs)
    return rows.select("operation_id", "object_type", "object_id", F.inline(chosen)).select(*CHANGE_COLUMNS)


def settle(log: DataFrame, outcomes: DataFrame, order_by: str | None = None) -> DataFrame:
    """Record outcomes in a log: a pending row takes the first outcome reported for it, a settled
    row takes none. Repeated reports collapse before the shuffle."""
    first = F.struct(*([order_by] if order_by else []), "status", "old_value", "new_value")
    reported = outcomes.groupBy(*CHANGE_KEY).agg(F.min(first).alias("__outcome"))
    takes = (F.col("status") == int(ChangeStatus.PENDING)) & F.col("__outcome").isNotNull()
    joined = log.join(reported, CHANGE_KEY, "left")
    settled = {
        name: F.when(takes, F.col(f"__outcome.{name}")).otherwise(F.col(name))
        for name in ("old_value", "new_value", "status")
    }
    return joined.select(*[settled[c].alias(c) if c in settled else F.col(c) for c in CHANGE_COLUMNS])


def apply_changes(
    catalog: Catalog, changes: DataFrame, fields: Sequence[str], registry: FieldRegistry, scope: Scope | None = None
) -> Catalog:
    """A new catalog version with the applied rows of a change set in place. ``fields`` names
    what the operation can have changed: metadata under other keys passes through without a join,
    and objects are joined only with the (usually few) changed ones. With ``scope``, which says what all objects of the change
    set are, metadata of others also passes through, where the catalog knows the owners.

    ``changes`` is read several times: pass a written change set (``ChangeLog``, ``snapshot``), or it is computed as often."""
    targets = [registry.get(k) for k in fields]
    applied = changes.where(F.col("status") == int(ChangeStatus.APPLIED))
    meta, objects, tables = catalog.meta, catalog.objects, {}
    meta_fields = [f for f in targets if f.meta_key is not None]
    if meta_fields:
        keys = sorted({f.meta_key for f in meta_fields})
        touches = F.col("meta_key").isin(*keys)
        if scope is not None and catalog.owned_meta is not None:
            owned = catalog.owned_meta
            mine = F.coalesce(touches & (F.col("object_type") == scope.value), F.lit(False))
            touched = catalog.meta_of(scope).where(touches)
            rewritten = _rewritten_meta(touched, applied, meta_fields).withColumn("object_type", F.lit(scope.value))
            owned = owned.where(~mine).unionByName(rewritten)
            tables = {"meta": owned.select(*meta.columns), "owned_meta": owned}
        else:
            untouched = meta.where(~touches | F.col("meta_key").isNull())
            tables = {"meta": untouched.unionByName(_rewritten_meta(meta.where(touches), applied, meta_fields))}
    columns = [f for f in targets if f.column is not None]
    prices = [f for f in targets if f.key in PRICE_FIELDS]
    if columns or prices:
        objects = _rewritten_objects(catalog, applied, columns, prices, scope)
    return catalog.with_tables(objects=objects, **(tables or {"meta": meta}))


def _owns(field: Field) -> Column:
    return (F.col("field_type") == field.field_type) & (F.col("field_key") == field.storage_key)


def _rewritten_meta(touched: DataFrame, applied: DataFrame, fields: Sequence[Field]) -> DataFrame:
    key = value = None
    for f in fields:
        new = f.write(F.col("new_value"))
        key = F.when(_owns(f), f.meta_key) if key is None else key.when(_owns(f), f.meta_key)
        value = F.when(_owns(f), new) if value is None else value.when(_owns(f), new)
    updates = applied.select(
        "object_id", key.alias("meta_key"), "action_ix", value.alias("__new")
    ).where(F.col("meta_key").isNotNull())
    if len({f.meta_key for f in fields}) < len(fields):
        # Two fields stored under one key: the later action wins.
        latest = F.max_by("__new", "action_ix").alias("__new")
        updates = updates.groupBy("object_id", "meta_key").agg(latest)
    # The catalog is on the left of both joins: a small change set is broadcast to it, and with a
    # large one a skewed partition of it can be split.
    on = ["object_id", "meta_key"]
    changed = touched.join(updates.select(*on, "__new"), on, "left").select(
        *on, F.coalesce("__new", "meta_value").alias("meta_value")
    )
    present = touched.select(*on).join(updates.select(*on), on, "left_semi")
    added = updates.join(present, on, "left_anti").select(*on, F.col("__new").alias("meta_value"))
    return changed.unionByName(added)


def _rewritten_objects(
    catalog: Catalog, applied: DataFrame, columns: Sequence[Field], prices: Sequence[Field], scope: Scope | None = None
) -> DataFrame:
    objects = catalog.objects
    fields = [*columns, *prices]
    news = {f.key: F.col(f"__set{i}") for i, f in enumerate(fields)}
    if len(fields) == 1:
        changed = applied.where(_owns(fields[0])).select(
            "object_id", F.struct("new_value").alias("__set0")
        )
    else:
        # Structs, so that a field set to null differs from a field not set.
        latest = [
            F.max_by(F.when(_owns(f), F.struct("new_value")), F.when(_owns(f), F.col("action_ix")))
            for f in fields
        ]
        changed = applied.groupBy("object_id").agg(*[c.alias(f"__set{i}") for i, c in enumerate(latest)])
    if prices:
        # The lookup price follows the price fields: the sale price while it is lower.
        meta = catalog.meta if scope is None else catalog.meta_of(scope)
        stored = Facts(meta.join(applied.select("object_id"), "object_id", "left_semi"), "meta_key", "__p")
        texts = {}
        for name, key in zip(PRICE_FIELDS, PRICE_META_KEYS):
            texts[name] = stored.value(key)
        for f in prices:
            new = news[f.key]
            texts[f.key] = F.when(new.isNotNull(), f.write(new["new_value"])).otherwise(texts[f.key])
        regular, sale = (numeric(texts[name]) for name in PRICE_FIELDS)
        price = F.when(sale < regular, sale).otherwise(regular).try_cast(PRICE_TYPE)
        changed = changed.join(stored.frame(), "object_id", "left").withColumn("__price", price)
    rows = objects.join(changed, "object_id", "left")
    replaced: dict[str, Column] = {}
    for f in columns:
        new = news[f.key]
        value = f.write(new["new_value"]).try_cast(objects.schema[f.column].dataType)
        replaced[f.column] = F.when(new.isNotNull(), value).otherwise(F.col(f.column))
    if prices:
        repriced = F.lit(False)
        for f in prices:
            repriced = repriced | news[f.key].isNotNull()
        for name in ("min_price", "max_price"):
            replaced[name] = F.when(repriced, F.col("__price")).otherwise(F.col(name))
    return rows.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in objects.columns])
