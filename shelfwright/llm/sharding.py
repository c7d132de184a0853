"""Extendible hashing of rows into shards of limited bytes, in DataFrame functions only.

A directory is indexed by the first bits of a row's hash. A bucket over the limit splits on its next bit, and only
such a bucket does, so a shard is a hash prefix as short as its bytes allow, and later data splits a few shards
instead of moving all. The bits are counted once per step of ``STEP`` levels, in a histogram that every task sums first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.common import snapshot

#: Bits of the hash: the most a bucket can be split.
BITS = 60
#: Levels decided by one histogram.
STEP = 12


def hashed(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key as text, as a number; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: int | Column) -> Column:
    return F.shiftright("_h", BITS - bits) if isinstance(bits, int) else F.call_function("shiftright", F.col("_h"), (F.lit(BITS) - bits).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, shard_bytes, shard_rows of every bucket, from rows of _h and bytes.

    Buckets of empty hash ranges are not listed. A bucket still over the limit after all bits (rows of one key) is
    listed at full depth."""
    found, open_rows, top = [], sizes, 0
    total, rows = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    if total <= limit:
        return sizes.sparkSession.createDataFrame([(0, 0, total, rows)], "depth int, prefix long, shard_bytes long, shard_rows long")
    while top < BITS:
        # The first step reaches past the depth at which buckets fit on average.
        bottom = min(top + STEP + (total // limit).bit_length() * (top == 0), BITS)
        bins = open_rows.groupBy(_prefix(bottom).alias("_bin")).agg(F.sum("bytes").alias("_b"), F.count("*").alias("_n"))
        depths = F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth")
        level = snapshot(
            bins.select("*", depths)
            .groupBy("depth", F.call_function("shiftright", F.col("_bin"), F.lit(bottom) - F.col("depth")).alias("prefix"))
            .agg(F.sum("_b").alias("shard_bytes"), F.sum("_n").alias("shard_rows")),
            "level",
        )
        over = snapshot(level.filter(F.col("shard_bytes") > limit).select(F.col("depth").alias("_d"), F.col("prefix").alias("_p")), "over")
        # A bucket stands when it fits, or no bit is left, and the one it was split from did not fit.
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        found.append(
            level.filter(fits).join(over, (F.col("depth") == F.col("_d") + 1) & (F.shiftright("prefix", 1) == F.col("_p")), "left_semi")
        )
        left = over.filter(F.col("_d") == bottom).select("_p")
        if bottom == BITS or left.isEmpty():
            break
        open_rows, top = open_rows.join(left, _prefix(bottom) == F.col("_p"), "left_semi"), bottom
    return reduce(DataFrame.unionByName, found).select("depth", "prefix", "shard_bytes", "shard_rows")


def shard(rows: DataFrame, key: str, size: Column, limit: int, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: the key), bytes, shard (the bucket's bits as text; '' before any split), depth, shard_bytes.

    ``size``: bytes of a row (null: 0). Rows of one key are in one shard while they fit it together; those of a key too large
    for any shard are hashed one by one and split like others, so only a row larger than the limit by itself has a
    shard over it, its own, with an '!' after the bits. Null keys are one key. An empty table gives an empty one. No row is lost."""
    keep = keep or [key]
    by_key = snapshot(
        rows.select(*keep, F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), hashed(F.col(key)).alias("_h"), F.monotonically_increasing_id().alias("_row")), "by_key"
    )
    heavy = by_key.filter(F.col("bytes") <= limit).groupBy("_h").agg(F.sum("bytes").alias("_sum")).filter(F.col("_sum") > limit).select(F.col("_h").alias("_heavy"))
    heavy = snapshot(heavy, "heavy")
    own = F.when(F.col("_heavy").isNull(), F.col("_h")).otherwise(hashed(F.concat_ws(":", F.col("_h").cast("string"), F.col("_row").cast("string"))))
    sizes = by_key if heavy.isEmpty() else snapshot(by_key.join(heavy, F.col("_h") == F.col("_heavy"), "left").withColumn("_h", own).drop("_heavy"), "sizes")
    fitting, large = sizes.filter(F.col("bytes") <= limit), sizes.filter(F.col("bytes") > limit)
    buckets = snapshot(directory(fitting.select("_h", "bytes"), limit), "directory")
    # The directory has an entry for each prefix of its deepest bucket in use; shallow buckets own many entries. Rows ask
    # for their bucket by the few depths in use, so entries need not be written out.
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]
    asked = fitting.withColumn("_try", F.explode(F.array(*[F.lit(d) for d in sorted(depths)])))
    named = lambda depth, prefix: F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, "0"))
    placed = (
        asked.withColumn("_p", _prefix(F.col("_try")))
        .join(buckets.withColumnRenamed("depth", "_depth"), (F.col("_try") == F.col("_depth")) & (F.col("_p") == F.col("prefix")))
        .select(*keep, "bytes", F.concat(named(F.col("_depth"), F.col("prefix")), F.when(F.col("shard_bytes") > limit, "!").otherwise("")).alias("shard"), F.col("_depth").alias("depth"), "shard_bytes")
    )
    alone = large.select(*keep, "bytes", F.concat(named(F.lit(BITS), F.col("_h")), F.lit("!")).alias("shard"), F.lit(BITS).alias("depth"), F.col("bytes").alias("shard_bytes"))
    return placed.unionByName(alone)
