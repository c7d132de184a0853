"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Each source gets words in proportion to its weight, but at most ``epochs`` times its own size; what the
clamped sources leave over is dealt again by weight until none is above its cap. A source then gives whole
repetitions of all its documents, and one fractional repetition: its documents in a seeded order, up to the
word at which the target is met. So a source's taken words are its target, rounded, and at most one of its
documents is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.llm.common import snapshot

#: Hash ranges of a source. Only the range in which the fraction ends has its documents put in order.
RANGES = 1 << 16
_BLANKS = " \t\n\x0b\f\r"


def seeded(doc_id: Column, seed: int, otherwise: Column | None = None) -> Column:
    """A uniform 60-bit number per id and seed; the same in every run and engine. Rows without an id take ``otherwise``."""
    own = doc_id.cast("string") if otherwise is None else F.coalesce(doc_id.cast("string"), otherwise)
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), own).cast("binary")), 1, 15), 16, 10).cast("long")


def row_digest(docs: DataFrame) -> Column:
    """Tells rows that are alike in all columns from others."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])).cast("binary"))


def water_fill(sources: DataFrame, share: float, epochs: int) -> DataFrame:
    """Adds ``target`` (double) to a table of source_size and weight, one row per source.

    Round by round on the written table; a round moves two numbers. The water level rises as sources are clamped,
    so a clamped one stays clamped, and there are at most as many rounds as sources."""
    cap = F.col("source_size") * epochs
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, clamped = 0.0, 0
    while weights:
        level = (share * (words or 0) - clamped) / weights
        clamped, left = sources.agg(
            F.coalesce(F.sum(F.when(cap < F.col("weight") * level, cap)), F.lit(0)),
            F.sum(F.when(cap < F.col("weight") * level, 0).otherwise(F.col("weight"))),
        ).first()
        if left == weights:
            break
        weights = left
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def weigh(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, weight: one row per source, weights repeating in code point order, null last.
    The documents are summed by source in every task first; ordered are only the sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    )


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7, digest: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, digest: one row per row of ``docs``.

    ``size``: words of a row (null: 0). ``digest`` (a text; default: that of the text) tells rows of one id apart, and orders rows
    without one. Rows alike in id, source, size and digest share one place in the order, so which of them is taken in part
    is open, but not how much is. An empty table gives an empty one; sources without words have target 0."""
    told = F.md5(F.coalesce("text", F.lit("")).cast("binary")) if digest is None else digest
    sizes = snapshot(
        docs.select("doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("size"), told.alias("digest"), seeded(F.col("doc_id"), seed, told).alias("_h")), "sizes"
    )
    sources = water_fill(snapshot(weigh(sizes, weights), "sources"), share, epochs)
    plan = sources.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("_whole"),
    ).withColumn("_part", F.round(F.col("target")).cast("long") - F.col("_whole") * F.col("source_size"))

    at = F.shiftright("_h", 60 - RANGES.bit_length() + 1).cast("int")
    # Words of each hash range, and where in it the fraction ends: a row per source and range.
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sizes.groupBy(F.col("source").alias("_source"), at.alias("_range"))
        .agg(F.sum("size").alias("_words"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .join(plan.select(F.col("_source").alias("_s"), "_part"), F.col("_source").eqNullSafe(F.col("_s")))
        .filter((F.col("_before") <= F.col("_part")) & (F.col("_part") < F.col("_before") + F.col("_words")))
        .select(F.col("_source").alias("_s"), F.col("_range").alias("_end"), (F.col("_part") - F.col("_before")).alias("_left"))
    )
    # Written, so that its size is known: a row per source is sent to all tasks while it is small, and no source meets in one.
    plan = snapshot(plan.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"), "plan")
    joined = sizes.withColumn("_range", at).join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = Window.partitionBy("source").orderBy("_h", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        joined.filter(F.col("_range") == F.col("_end"))
        .withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("_extra", F.least(F.greatest(F.col("_left") - F.col("_at"), F.lit(0)), F.col("size")))
        .drop("_at")
    )
    # Without an end the fraction is the whole source, or nothing.
    others = joined.filter(~F.coalesce(F.col("_range") == F.col("_end"), F.lit(False))).withColumn(
        "_extra",
        F.when(F.col("_end").isNotNull(), F.when(F.col("_range") < F.col("_end"), F.col("size")).otherwise(0))
        .when(F.col("_part") > 0, F.col("size"))
        .otherwise(0),
    )
    return others.unionByName(last).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long").alias("taken"), "digest"
    )


#: Copies of one row that one task writes.
COPIES = 1 << 10


def repeat_rows(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the mix takes it, the last time cut after the words taken.

    ``mixed``: of ``mix`` with ``row_digest(docs)``, so that what is taken is known row by row, whatever the ids. Of rows alike in all
    columns the mix can take some more often than others, in one such group per source: these stand for each other, and
    their takes are added up. Rows without words are not part of a mixture of words and go. n_chars, if there, is
    counted anew where a text is cut."""
    key = ["_id", "_source", "_digest"]
    named = mixed.filter("size > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_digest"), "size", "taken")
    groups = snapshot(
        named.groupBy(*key).agg(
            F.first("size").alias("_size"),
            F.min("taken").alias("_least"),
            F.max("taken").alias("_taken"),
            F.sum(F.floor(F.col("taken") / F.col("size"))).alias("_times"),
            F.max(F.col("taken") % F.col("size")).alias("_rest"),
        ),
        "taken",
    )
    of = lambda name: F.col("d").getField(name)
    # The digest is of all columns, id and source included.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), row_digest(docs).alias("_own"))
    alike = groups.filter("_least = _taken AND _taken > 0").drop("_times", "_least")
    times = F.array_repeat(F.lit(0), F.floor(F.col("_taken") / F.col("_size")).cast("int"))
    rest = F.col("_rest").cast("int")
    each = rows.join(alike, F.col("_own") == F.col("_digest")).select("d", F.explode(F.when(rest > 0, F.concat(times, F.array(rest))).otherwise(times)).alias("_cut"))
    # One group per source at most: a row of it, repeated in blocks that tasks share.
    mixed_groups = groups.filter("_least < _taken").select("_digest", "_times", "_rest")
    shared = rows.join(mixed_groups, F.col("_own") == F.col("_digest")).groupBy("_own", "_times", "_rest").agg(F.min("d").alias("d"))
    blocks = shared.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times"), F.lit(COPIES).cast("long"))).alias("_at")).repartition(F.col("_at"))
    cut = F.when((F.col("_at") == 0) & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<int>"))
    whole = F.array_repeat(F.lit(0), F.least(F.lit(COPIES).cast("long"), F.col("_times") - F.col("_at")).cast("int"))
    taken = each.unionByName(blocks.select("d", F.explode(F.concat(whole, cut)).alias("_cut")))
    trimmed = F.btrim(of(text), F.lit(_BLANKS))
    beyond = F.element_at(F.split(trimmed, r"[\x20\x09-\x0D]+", F.col("_cut") + 1), -1)
    first = F.btrim(F.left(trimmed, F.length(trimmed) - F.length(beyond)), F.lit(_BLANKS))
    changed = {text: F.when(F.col("_cut") == 0, of(text)).otherwise(first)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_cut") == 0, of("n_chars")).otherwise(F.length(first).cast("long"))
    return taken.select(*[changed.get(c, of(c)).alias(c) for c in docs.columns])
