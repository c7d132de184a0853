"""What several of the corpus operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.sources.store import snapshot

__all__ = ["WORD", "count_words", "crc_remainder", "forget_shuffles", "load", "running_total", "snapshot", "split_words", "whole_rows"]

#: A word: a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are written: it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_rows(frame: DataFrame) -> DataFrame:
    """Each row as one value ``d``, so that no column of it can clash with another frame's."""
    return frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("d"))


def count_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in _BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written in decimal, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def running_total(frame: DataFrame, order: list[str], value: str, total: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one in ``order`` (which must be unique).

    Rows are cut into ranges of the order; ranges are summed apart, and only one number per range is
    added up in a single task. The ranged rows are written first, so the ranges stay what they were.
    """
    part, before = f"_part_{uuid.uuid4().hex[:8]}", f"_before_{uuid.uuid4().hex[:8]}"
    ranged = snapshot(
        frame.repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()), "ranged"
    )
    starts = (
        ranged.groupBy(part)
        .agg(F.sum(value).alias(before))
        .withColumn(before, F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn(total, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, part)
        .withColumn(total, F.col(total) + F.col(before))
        .drop(part, before)
    )
