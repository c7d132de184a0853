"""The corpus pipeline: stages from documents to packed training sequences.

Each stage takes what its predecessor kept, decides over all of it, and its decisions take effect; all but the last give
rows of the columns of documents. Decisions are about rows: a null or repeated ``doc_id`` does not spread them to other texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.llm import bktree, mixing, packing, quality, runindex
from shelfwright.llm.common import count_words, load, snapshot, whole_rows

TOKENIZER = "word_bpe_49k.json"
#: Shingles of five words. Two texts that share 0.9 of their shingles differ in 6.6 of 64 bits on average, and in 4.6 at 0.95.
WIDTH, RADIUS = 5, 7


def _digest(text: str) -> Column:
    """MD5 of a text; a null text is empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the risk-controlled rules reject."""
    # The rows come along with their verdicts, so nothing is joined back.
    rows = docs.select("doc_id", "lang", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    return quality.rate(rows, load(spark, sf_dir, "labels"), ["doc_id", "lang", "d"]).filter("kept").select("d.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints: the one with the smallest id (nulls last), then digest; of rows
    alike in both, the least."""
    own = docs.select("doc_id", "text", _digest("text").alias("digest"))
    found = bktree.near_duplicates(own, RADIUS, ("digest",), WIDTH).groupBy("label", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("f")
    firsts = snapshot(found.groupBy("label").agg(first).select(F.col("f.doc_id").alias("_id"), F.col("f.digest").alias("_digest"), F.col("f.n").alias("_n")), "firsts")
    is_first = F.col("d.doc_id").eqNullSafe(F.col("_id")) & (_digest("d.text") == F.col("_digest"))
    rows = whole_rows(docs)
    once = rows.join(firsts.filter("_n = 1"), is_first, "left_semi").select("d.*")
    copies = rows.join(firsts.filter("_n > 1"), is_first).groupBy("_id", "_digest").agg(F.min("d").alias("d")).select("d.*")
    return once.unionByName(copies)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that also start earlier in the corpus. A cut inside a character drops what is left of it; a
    document of which nothing is left goes, one that was empty stays."""
    found = runindex.dedupe(docs).filter("n_removed > 0").select("doc_id", "digest", "kept")
    found = snapshot(found.dropDuplicates(["doc_id", "digest"]).withColumnsRenamed({"doc_id": "_id", "digest": "_digest"}), "kept")
    joined = whole_rows(docs).join(found, F.col("d.doc_id").eqNullSafe(F.col("_id")) & (_digest("d.text") == F.col("_digest")), "left")
    cut = F.col("_digest").isNotNull()
    text = F.when(cut, F.replace(F.try_validate_utf8(F.make_valid_utf8(F.col("kept").cast("string"))), F.lit("�"), F.lit(""))).otherwise(F.col("d.text"))
    out = joined.withColumn("_text", text).filter(~cut | (F.length("_text") > 0))
    changed = {"text": F.col("_text"), "n_chars": F.when(cut, F.length("_text").cast("long")).otherwise(F.col("d.n_chars"))}
    return out.select(*[changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; the one at which a source's target is met is cut there."""
    mixed = mixing.mix(docs, count_words(F.col("text")), digest=mixing.row_digest(docs))
    return mixing.repeat_rows(docs, mixed)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("source_mixture", source_mixture),
    ("packed_sequences", packed_sequences),
]

#: Fingerprints, index marks and tokens are not for SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = snapshot(docs, name)
    return docs
