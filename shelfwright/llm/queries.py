"""Named queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.llm import alignment, bktree, context_mixing, cross_polytope, idfiles, langmask, mixing, oracle, packing, prefix_tree, quality, runindex, runs, sharding
from shelfwright.llm.common import count_words, load, snapshot
from shelfwright.sources.store import shared_dir

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    trees = prefix_tree.build(conversations, tokenizer)
    read = snapshot(prefix_tree.read_back(trees, tokenizer), "read")
    return trees.members.join(read.withColumnRenamed("branch", "_b"), F.col("branch") == F.col("_b")).select("conv_id", *[c for c in read.columns if c != "branch"])


def cross_polytopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id", "lang"])
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"), count_words(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)


def run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runindex.dedupe(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(load(spark, sf_dir, "documents"))


def language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmask.predict(load(spark, sf_dir, "documents"))


def bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bktree.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def aligned_tokens(docs: DataFrame, sent: int = alignment.SENT) -> DataFrame:
    """Alignments of byte-level ids with pieces, with a digest of the groups."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    derive = lambda frame: frame.withColumn("groups_sha256", digest).drop("groups")
    aligned = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), derive, sent)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokens(load(spark, sf_dir, "documents"))


def _planted(doc_id: str, n: int) -> tuple[int, int] | None:
    """From which word on a text repeats how many words: one document in ten does."""
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return None
    g = h // 10
    start = g % n
    return start, 1 + (n - start) // (3 + g % 8)


def repeated_words(docs: DataFrame) -> DataFrame:
    """Runs and digests of every document, after one in ten is made to repeat."""
    none = F.lit(None).cast(runs.RUN)
    # Runs come by start and period, so the first of equal exponents stands.
    more = lambda best, r: best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    found = runs.find(docs, _planted).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(load(spark, sf_dir, "documents"))


def id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = idfiles.write(load(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return idfiles.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_chat_trees": chat_trees,
    "op2_cross_polytopes": cross_polytopes,
    "op3_quality_rules": quality_rules,
    "op4_water_filling": water_filling,
    "op5_run_length_index": run_length_index,
    "op6_best_fit_packing": best_fit_packing,
    "op7_extendible_hashing": extendible_hashing,
    "op8_context_mixing": context_mixing_scores,
    "op9_language_filters": language_filters,
    "op10_bk_trees": bk_trees,
    "op11_token_alignment": token_alignment,
    "op12_word_runs": word_runs,
    "op13_id_files": id_files,
}

ORACLES = oracle.ORACLES
