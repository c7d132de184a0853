"""Stream jobs: enforcing a rule on updates, admitting each change event once, and progress.

All of them drain what is there and stop (``availableNow``), and restart from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.catalog import Catalog
from shelfwright.functions.times import instant
from shelfwright.operators.actions import Action, check_actions, reads_of
from shelfwright.operators.fields import FieldRegistry, unique
from shelfwright.operators.filters import Filter
from shelfwright.operators.oplog import STALL_MINUTES
from shelfwright.operators.resolve import Matcher
from shelfwright.schema import ChangeStatus

SALT_BUCKETS = 16


def enforcement_targets(
    catalog: Catalog, flt: Filter, actions: Sequence[Action], registry: FieldRegistry
) -> DataFrame:
    """What enforcement has to know of each object a rule covers. Resolve it once and keep it as a
    snapshot; each batch of updates then joins a plain table."""
    check_actions(actions, registry)
    matcher = Matcher(catalog, flt)
    fields = unique([registry.get(a.field) for a in actions] + reads_of(actions, registry))
    texts = [matcher.text(f).alias(f"__f_{f.key}") for f in fields]
    return matcher.frame().select("object_id", *texts)


def enforce(
    updates: DataFrame,
    targets: DataFrame,
    action: Action,
    registry: FieldRegistry,
    updated_field: str = "regular_price",
) -> DataFrame:
    """Corrections for a batch of updates (event_id, ts, object_id, value): the action evaluated
    as if ``value`` had just been written to ``updated_field``. Updates of objects the rule does
    not cover give nothing."""
    return _corrected(updates.join(targets, "object_id"), action, registry, updated_field)


def _corrected(rows: DataFrame, action: Action, registry: FieldRegistry, updated_field: str) -> DataFrame:
    fields = unique([registry.get(action.field), *action.reads(registry)])
    texts = {f.key: F.col(f"`__f_{f.key}`") for f in fields}
    texts[updated_field] = F.col("value")
    field = registry.get(action.field)
    rows = rows.withColumns(
        {"old_value": texts[field.key], "new_value": action.new_text(registry, texts)}
    )
    status = F.when(F.col("new_value").isNull(), int(ChangeStatus.SKIPPED)).otherwise(
        int(ChangeStatus.APPLIED)
    )
    return rows.select(
        "event_id",
        "ts",
        "object_id",
        F.lit(field.field_type).alias("field_type"),
        F.lit(field.storage_key).alias("field_key"),
        "old_value",
        "new_value",
        status.cast("int").alias("status"),
    )


def versioned_targets(versions: Sequence[tuple[datetime, DataFrame]]) -> DataFrame:
    """Enforcement targets of several catalog versions, each in force from its time on until the next one's. What an object says in
    versions on end is one row, ``__first`` to ``__last``; an object that a version does not cover has none for it."""
    ordered = sorted(versions, key=lambda v: v[0])
    rows = None
    for number, (_, targets) in enumerate(ordered):
        own = targets.withColumn("__version", F.lit(number))
        rows = own if rows is None else rows.unionByName(own)
    values = [f"`{c}`" for c in rows.columns if c not in ("object_id", "__version")]
    by_object = Window.partitionBy("object_id").orderBy("__version")  # a row per version
    before = F.lag(F.struct(F.col("__version") + 1, *values)).over(by_object)
    # A run goes on where the version before is there and says the same.
    starts = (~before.eqNullSafe(F.struct("__version", *values))).cast("int")
    runs = rows.withColumn("__start", starts).withColumn("__run", F.sum("__start").over(by_object))
    return runs.groupBy("object_id", "__run", *values).agg(F.min("__version").alias("__first"), F.max("__version").alias("__last")).drop("__run")


def enforce_as_of(
    updates: DataFrame,
    targets: DataFrame,
    times: Sequence[datetime],
    action: Action,
    registry: FieldRegistry,
    updated_field: str = "regular_price",
) -> DataFrame:
    """Like ``enforce``, against the version in force when an update happened. ``targets``: of ``versioned_targets``, kept as a
    snapshot; ``times``: of the versions. The join is on the object alone, whose rows are as many as its changes; updates
    from before the first version give nothing."""
    known = F.array(*[instant(t) for t in sorted(times)])
    version = F.size(F.filter(known, lambda t: t <= F.col("ts"))) - 1
    in_force = (F.col("__version") >= F.col("__first")) & (F.col("__version") <= F.col("__last"))
    current = updates.withColumn("__version", version).join(targets.withColumnRenamed("object_id", "__object"), (F.col("object_id") == F.col("__object")) & in_force)
    return _corrected(current, action, registry, updated_field)


def admit_once(events: DataFrame, key: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Change events without replays that arrive within the watermark. Replays beyond it are
    caught when changes are settled, which takes only pending rows.

    A key that is replayed very often is first thinned out in several tasks, by the input split
    its rows come from; the second pass then sees a bounded number of rows for it. The price is a second state store:
    up to ``SALT_BUCKETS`` entries per key beside the one that counts, kept for the whole ``delay``."""
    watched = events.withWatermark(event_time, delay)
    salt = F.spark_partition_id() % SALT_BUCKETS
    thinned = watched.withColumn("__salt", salt).dropDuplicatesWithinWatermark([*key, "__salt"])
    return thinned.drop("__salt").dropDuplicatesWithinWatermark(list(key))


def progress(events: DataFrame, event_time: str, bucket: str, delay: str) -> DataFrame:
    """Change events per operation and time bucket."""
    watched = events.withWatermark(event_time, delay)
    return (
        watched.groupBy("operation_id", F.window(event_time, bucket).alias("bucket"))
        .agg(F.count("*").alias("changes"), F.max(event_time).alias("last_event"))
        .select("operation_id", F.col("bucket.start").alias("bucket_start"), "changes", "last_event")
    )


def stalls(events: DataFrame, event_time: str, silent_for: str, delay: str) -> DataFrame:
    """Stretches of progress that ended in silence, as soon as it is known: one row per operation and stretch, when nothing has
    come for ``silent_for`` and the watermark, ``delay`` behind the latest event, has passed that.

    Sessions are what Spark merges events into, so append mode gives each once. Of a busy operation, sessions
    can be merged before the shuffle: spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition."""
    watched = events.withWatermark(event_time, delay)
    return (
        watched.groupBy("operation_id", F.session_window(event_time, silent_for).alias("session"))
        .agg(F.count("*").alias("changes"), F.max(event_time).alias("last_event"))
        .select("operation_id", F.col("session.start").alias("started"), "last_event", F.col("session.end").alias("stalled_at"), "changes")
    )


def with_stall_flag(
    rows: DataFrame, now: datetime, silent_for: timedelta = timedelta(minutes=STALL_MINUTES)
) -> DataFrame:
    """Mark the buckets of operations whose latest event is too long ago. The latest event per
    operation is a small table of its own, so a busy operation is not gathered in one task."""
    latest = rows.groupBy("operation_id").agg(F.max("last_event").alias("__latest"))
    joined = rows.join(latest, "operation_id")
    return joined.withColumn("stalled", F.col("__latest") < instant(now - silent_for)).drop("__latest")


def drain(stream: DataFrame, path: str, output: str = "append") -> DataFrame:
    """Run a stream to the end of its input into Parquet, and return what it has written."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output)
        .option("checkpointLocation", f"{path}/checkpoint")
        .option("path", f"{path}/data")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    try:
        return spark.read.schema(stream.schema).parquet(f"{path}/data")
    except AnalysisException:  # nothing has ever arrived
        return spark.createDataFrame([], stream.schema)


def drain_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Apply a batch plan to each micro-batch and keep its rows under the batch's number. A batch
    that is run again after a failure replaces itself."""
    spark = stream.sparkSession
    # A first batch without rows, so that there is something to read before anything arrives.
    none = spark.createDataFrame([], transform(stream).schema)
    none.write.mode("overwrite").parquet(f"{path}/data/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/data")


def newest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The latest version of each row an updating stream has written in batches."""
    values = [c for c in rows.columns if c not in (*key, "batch")]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("__row"))
    return latest.select(*key, "__row.*")
