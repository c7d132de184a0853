"""Counters that are kept as changes are written, instead of being recounted from the whole log.

Every write of a batch adds one partial row per operation; rows of one batch replace each other by version, and those of
different batches add up. A batch holds all rows of its objects, so distinct objects add up too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.operators.oplog import progress_rows
from shelfwright.schema import CHANGE_STATUS_LABELS, ChangeStatus

COUNTS = (*CHANGE_STATUS_LABELS.values(), "objects", "processed_objects", "failed_objects")
PARTIALS = "operation_id long, batch long, version long, " + ", ".join(f"{c} long" for c in COUNTS)


def batch_of(batches: int) -> Column:
    """Deals objects to batches, so that no object is in two."""
    return F.pmod(F.xxhash64("object_id"), F.lit(batches).cast("bigint"))


def partials(rows: DataFrame, batch: Column | int, version: int) -> DataFrame:
    """One row per operation and batch of change rows. An object counts once: as failed if any of its rows failed, else as
    processed once any was applied or skipped."""
    of = batch if isinstance(batch, Column) else F.lit(batch).cast("bigint")
    settled = F.col("status").isin(int(ChangeStatus.APPLIED), int(ChangeStatus.SKIPPED))
    per_object = rows.groupBy("operation_id", "object_id", of.alias("batch")).agg(
        *[F.count_if(F.col("status") == s).alias(label) for s, label in CHANGE_STATUS_LABELS.items()],
        F.bool_or(F.col("status") == int(ChangeStatus.FAILED)).alias("__bad"),
        F.bool_or(settled).alias("__done"),
    )
    counted = per_object.groupBy("operation_id", "batch").agg(
        *[F.sum(label).alias(label) for label in CHANGE_STATUS_LABELS.values()],
        F.count("*").alias("objects"),
        F.count_if(F.col("__done") & ~F.col("__bad")).alias("processed_objects"),
        F.count_if("__bad").alias("failed_objects"),
    )
    return counted.select("operation_id", F.col("batch").cast("bigint").alias("batch"), F.lit(version).cast("bigint").alias("version"), *COUNTS)


class CounterLog:
    """Partial rows in folders, one per append. A replayed append repeats rows that are there, which changes no count."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path.rstrip("/")

    def append(self, rows: DataFrame, batch: Column | int, version: int) -> None:
        partials(rows, batch, version).write.parquet(f"{self._path}/{uuid.uuid4().hex}")

    def newest(self) -> DataFrame:
        """The row that counts of every operation and batch."""
        stored = self._spark.read.schema(PARTIALS).option("recursiveFileLookup", "true").parquet(self._path)
        return _newest(stored)

    def counters(self) -> DataFrame:
        """Counts per operation."""
        return self.newest().groupBy("operation_id").agg(*[F.sum(c).alias(c) for c in COUNTS])

    def compact(self) -> None:
        """Put what counts into one folder. The folders it was read from go after that is written; if they stay because the
        job was lost, they say nothing new."""
        jvm, conf = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self._path)
        system = root.getFileSystem(conf)
        folders = [f.getPath().toString() for f in system.listStatus(root) if f.isDirectory()]
        if len(folders) < 2:
            return
        stored = self._spark.read.schema(PARTIALS).option("recursiveFileLookup", "true").parquet(*folders)
        _newest(stored).write.parquet(f"{self._path}/{uuid.uuid4().hex}")
        for folder in folders:
            system.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def _newest(stored: DataFrame) -> DataFrame:
    row = F.max(F.struct("version", *COUNTS)).alias("__row")
    return stored.groupBy("operation_id", "batch").agg(row).select("operation_id", "batch", "__row.*")


def _targets() -> Column:
    first, *others = map(F.col, CHANGE_STATUS_LABELS.values())
    return sum(others, first)


def operation_summary(counters: DataFrame) -> DataFrame:
    """The same as ``oplog.operation_summary`` of the log."""
    return counters.select("operation_id", _targets().alias("targets"), *CHANGE_STATUS_LABELS.values())


def operation_progress(counters: DataFrame, operations: DataFrame) -> DataFrame:
    """The same as ``oplog.operation_progress`` of the log."""
    progress = counters.select(
        "operation_id",
        _targets().alias("target_rows"),
        F.col("objects").alias("target_objects"),
        F.col("processed_objects").alias("processed"),
        F.col("failed_objects").alias("failed"),
    )
    return progress_rows(progress, operations)
