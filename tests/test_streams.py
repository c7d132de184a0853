from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shelfwright.functions import formula as fm
from shelfwright.operators.actions import FormulaAction
from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Condition, Filter
from shelfwright.sources.store import snapshot
from shelfwright.streaming import streams
from tests.shop import Shop

REGISTRY = FieldRegistry()
EVENT = "event_id LONG, ts TIMESTAMP, operation_id LONG, object_id LONG, event_type STRING, value STRING"


def at(minute, second=0):
    return datetime(2026, 8, 10, 12, minute, second)


def write(spark, path, batch, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{path}/{batch}")


def read(spark, path):
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_enforcement_equals_batch(spark, tmp_path):
    s = Shop(spark)
    s.product(1, "10", meta={"_cost": "10"})
    s.product(2, "10", meta={"_cost": "n/a"})
    s.product(3, "10", stock_status="outofstock", meta={"_cost": "10"})
    catalog = s.catalog()
    action = FormulaAction("regular_price", fm.max_(fm.var("regular_price"), fm.var("cost") * 1.5))
    targets = snapshot(
        streams.enforcement_targets(catalog, Filter((Condition("stock_status", "=", "instock"),)), [action], REGISTRY)
    )
    source = str(tmp_path / "in")
    write(spark, source, 1, [(1, at(1), 1, 1, "u", "12"), (2, at(2), 1, 2, "u", "12"), (3, at(3), 1, 3, "u", "12")])
    write(spark, source, 2, [(4, at(4), 1, 1, "u", "20"), (5, at(5), 1, 77, "u", "20")])

    def enforce(batch):
        return streams.enforce(batch, targets, action, REGISTRY)

    def rows(frame):
        return sorted((r.event_id, r.object_id, r.old_value, r.new_value, r.status) for r in frame.collect())

    got = rows(streams.drain_batches(read(spark, source), enforce, str(tmp_path / "out")))
    assert got == [(1, 1, "12", "15", 1), (2, 2, "12", None, 3), (4, 1, "20", "20", 1)]
    stored = spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(source)
    assert got == rows(enforce(stored))


def test_restart_does_not_repeat(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, source, 1, [(1, at(1), 1, 1, "u", "1")])
    assert streams.drain_batches(read(spark, source), lambda b: b, out).count() == 1
    write(spark, source, 2, [(2, at(2), 1, 1, "u", "1")])
    assert streams.drain_batches(read(spark, source), lambda b: b, out).count() == 2


def test_admit_once(spark, tmp_path):
    """Replays within and across batches are dropped, however many there are of one key."""
    source = str(tmp_path / "in")
    hot = [(i, at(1 + i % 5, i % 60), 1, 1, "a", "x") for i in range(200)]
    write(spark, source, 1, hot + [(1000, at(2), 1, 2, "a", "x")])
    write(spark, source, 2, hot[:50] + [(1001, at(3), 2, 1, "a", "x")])
    admitted = streams.admit_once(read(spark, source), ["operation_id", "object_id"], "ts", "1 hour")
    got = streams.drain(admitted, str(tmp_path / "out")).select("operation_id", "object_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1)]


def test_progress_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, 1, [(i, at(i), 1, i, "a", "x") for i in range(30)])
    write(spark, source, 2, [(i, at(i), i % 2 + 1, i, "a", "x") for i in range(20, 50)])
    counted = streams.progress(read(spark, source), "ts", "10 minutes", "1 hour")
    versions = streams.drain_batches(counted, lambda b: b, str(tmp_path / "out"))
    rows = streams.newest(versions, ["operation_id", "bucket_start"])
    stored = spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(source)
    batch = stored.groupBy("operation_id", F.window("ts", "10 minutes").start.alias("bucket_start")).agg(
        F.count("*").alias("changes"), F.max("ts").alias("last_event")
    )
    columns = ["operation_id", "bucket_start", "changes", "last_event"]
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    flagged = streams.with_stall_flag(rows, datetime(2026, 8, 10, 12, 58, 30))
    assert {r.operation_id: r.stalled for r in flagged.collect()} == {1: True, 2: False}


def test_empty_input(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], EVENT).write.parquet(f"{source}/0")
    assert streams.drain_batches(read(spark, source), lambda b: b, str(tmp_path / "a")).count() == 0
    assert streams.drain(read(spark, source), str(tmp_path / "b")).count() == 0


def test_late_replays_are_caught_when_settling(spark):
    from shelfwright.operators.changes import settle
    from shelfwright.schema import CHANGES

    log = spark.createDataFrame([(1, "product", 1, 0, "post_field", "sku", "a", "b", 1)], CHANGES)
    late = spark.createDataFrame([(1, "product", 1, 0, "post_field", "sku", "b", "c", 1)], CHANGES)
    assert settle(log, late).first()["new_value"] == "b"


def sessions_by_hand(rows, gap, watermark):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[2], []).append(r[1])
    for operation, times in by.items():
        run: list = []
        for t in [*sorted(times), None]:
            if run and (t is None or (t - run[-1]).total_seconds() > gap):
                if (watermark - run[-1]).total_seconds() >= gap:
                    out.append((operation, run[0], run[-1], len(run)))
                run = []
            if t is not None:
                run.append(t)
    return sorted(out)


def test_stalls_come_out_as_they_happen(spark, tmp_path):
    rows = [
        (1, at(0), 7, 1, "c", "1"), (2, at(3), 7, 1, "c", "1"), (3, at(8), 7, 2, "c", "1"), (4, at(2), 8, 1, "c", "1"),
        (5, at(19), 7, 1, "c", "1"), (6, at(24), 7, 1, "c", "1"), (7, at(45), 9, 1, "c", "1"), (8, at(59), 9, 1, "c", "1"),
    ]
    for k, row in enumerate(rows):
        write(spark, tmp_path / "in", k, [row])
    found = streams.stalls(read(spark, str(tmp_path / "in")), "ts", "5 minutes", "1 minute")
    got = streams.drain(found, str(tmp_path / "out"))
    assert sorted((r.operation_id, r.started, r.last_event, r.changes) for r in got.collect()) == sessions_by_hand(rows, 300, at(58))
    assert all((r.stalled_at - r.last_event).total_seconds() == 300 for r in got.collect())
    # It goes on where it ended: one more event closes what was open, and repeats nothing.
    write(spark, tmp_path / "in", 99, [(9, datetime(2026, 8, 10, 14, 0), 1, 1, "c", "1")])
    rows.append((9, datetime(2026, 8, 10, 14, 0), 1, 1, "c", "1"))
    again = streams.drain(streams.stalls(read(spark, str(tmp_path / "in")), "ts", "5 minutes", "1 minute"), str(tmp_path / "out"))
    assert sorted((r.operation_id, r.started, r.last_event, r.changes) for r in again.collect()) == sessions_by_hand(rows, 300, datetime(2026, 8, 10, 13, 59))


def test_updates_meet_the_version_of_their_time(spark):
    def catalog(costs):
        s = Shop(spark)
        for k, cost in costs.items():
            s.product(k, "10", meta={"_cost": cost})
        return s.catalog()

    action = FormulaAction("regular_price", fm.max_(fm.var("regular_price"), fm.var("cost") * 1.5))
    costs = [{1: "10", 2: "20", 3: "30"}, {1: "10", 2: "22"}, {1: "11", 2: "22", 3: "30"}]
    times = [at(0), at(10), at(20)]
    known = [(t, streams.enforcement_targets(catalog(c), Filter(), [action], REGISTRY)) for t, c in zip(times, costs)]
    targets = snapshot(streams.versioned_targets(known[::-1]))
    # An object that says the same in versions on end is one row; one that went and came back is two.
    assert sorted((r.object_id, r["__first"], r["__last"]) for r in targets.collect()) == [(1, 0, 1), (1, 2, 2), (2, 0, 0), (2, 1, 2), (3, 0, 0), (3, 2, 2)]
    updates = spark.createDataFrame([(10 * m + k, at(m), 1, k, "c", "1") for m in (0, 9, 10, 15, 20, 30) for k in (1, 2, 3, 4)] + [(999, datetime(2026, 8, 10, 11, 59), 1, 1, "c", "1")], EVENT)
    got = {r.event_id: r.new_value for r in streams.enforce_as_of(updates, targets, times, action, REGISTRY).collect()}
    want = {}
    for m in (0, 9, 10, 15, 20, 30):
        version = sum(t <= at(m) for t in times) - 1
        want |= {10 * m + k: f"{float(c) * 1.5:g}" for k, c in costs[version].items()}
    assert got == want
