"""Near-duplicates by SimHash: fingerprints linked within a Hamming radius by BK-trees, and their components.

Equal fingerprints are one node from the start, so copies are never paired. Two nodes within the radius agree on some
choice of whole blocks of bits; nodes that agree on one go to the same shard, where a BK-tree (children keyed
by their distance to the parent) answers each node's radius query. A shard with many nodes sends its tree to several
tasks, which share its queries. A task emits a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.common import snapshot

SHINGLE = 4
RADIUS = 4
#: Queries that one task asks of a shard's tree.
QUERIES_PER_TASK = 4096
#: Nodes that a shard should hold on average; more blocks are chosen from when there are more.
SHARD_NODES = 128

#: A byte's bits as eight counters of eight bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; zero if there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts, digest = (ends - lengths).tolist(), xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)
    n = len(hashes)
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(n, 8)]
    # No counter passes 255 within a block of 255 rows.
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = (), width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns ``keep`` of every row; null and blank texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keep])

    schema = ", ".join(["doc_id long", "fp long", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]])
    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, schema)


class BKTree:
    """A metric tree over integers under Hamming distance."""

    def __init__(self, root: int):
        self._root: tuple[int, dict] = (root, {})

    def add(self, value: int) -> None:
        node = self._root
        while distance := (value ^ node[0]).bit_count():
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [self._root]
        while open_nodes:
            own, children = open_nodes.pop()
            distance = (value ^ own).bit_count()
            if distance <= radius:
                found.append(own)
            low, high = distance - radius, distance + radius
            open_nodes += [child for edge, child in children.items() if low <= edge <= high]
        return found


def spanning_links(values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value joined to it) for the links that the queries find among the values."""
    tree = BKTree(values[0])
    for value in values[1:]:
        tree.add(value)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for query in queries:
        for other in tree.within(query, radius):
            a, b = root(query), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def masks(nodes: int, radius: int = RADIUS, average: int = SHARD_NODES) -> list[int]:
    """Bit masks such that two values within the radius agree under at least one of them.

    The 64 bits are cut into blocks; the radius can spoil only that many of them, and a mask is a choice of the
    rest. The more nodes, the more blocks, the longer the masks and the smaller the shards."""
    blocks = radius + 1
    while nodes / 2 ** (64 * (blocks - radius) / blocks) > average and blocks < radius + 5:
        blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(parts, blocks - radius)]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links whose components are those of all pairs of ``nodes.fp`` (distinct) within the radius, u > v."""
    count = nodes.count()
    chosen = [m - (1 << 64) if m >> 63 else m for m in masks(count, radius)]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in chosen])).alias("table", "bucket")
    dealt = snapshot(nodes.select("fp", keys), "dealt")
    parts = F.ceil(F.col("count") / QUERIES_PER_TASK).cast("int")
    large = snapshot(
        dealt.groupBy("table", "bucket").count().filter(F.col("count") > QUERIES_PER_TASK).select(F.col("table").alias("_t"), F.col("bucket").alias("_b"), parts.alias("_parts")), "large"
    )
    shards = max(1, count * len(chosen) // 20_000)
    spread = (
        dealt.join(large, (F.col("table") == F.col("_t")) & (F.col("bucket") == F.col("_b")), "left")
        .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("asks", F.pmod(F.xxhash64("fp"), F.col("_parts")) == F.col("part"))
        .withColumn("shard", F.pmod(F.xxhash64("table", "bucket", "part"), F.lit(shards)))
        .select("shard", "table", "bucket", "part", "fp", "asks")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["table", "bucket", "part", "fp"], ignore_index=True)
        key = pdf[["table", "bucket", "part"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        values = pdf["fp"].to_numpy().view(np.uint64).tolist()
        asks, out = pdf["asks"].to_numpy(), []
        for a, b in itertools.pairwise(cuts):
            if b - a > 1:
                own = values[a:b]
                out += spanning_links(own, [v for v, q in zip(own, asks[a:b]) if q], radius)
        found = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": found.max(axis=1), "v": found.min(axis=1)}) if len(found) else pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})

    return spread.groupBy("shard").applyInPandas(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node (as a long) that each linked node reaches. Edges are u, v with u > v.

    Large-star and small-star rounds: every node is tied to the smallest neighbour until all components are stars,
    in a number of rounds that grows with the logarithm of the longest path. Every round is a written table, and
    the minima are written too, so that a node with many links is split like any other skewed key."""
    edges = snapshot(edges.select("u", "v"), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = snapshot(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
        large = snapshot(both.join(least, F.col("u") == F.col("_u")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = snapshot(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u"), "least")
        joined = large.join(least, F.col("u") == F.col("_u"))
        edges = snapshot(
            joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "small",
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = (), width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id, label (the component's smallest fingerprint) and the columns ``keep`` of every row: component_id is the smallest doc_id whose fingerprint is reachable over
    links of at most ``radius`` differing bits, its own included.

    Rows without words share fingerprint zero and are linked like any others. Repeated rows stay. A null id is never the
    smallest unless a component has no other, and then its component_id is null. Empty in, empty out."""
    marked = snapshot(fingerprints(docs, keep, width), "fingerprints")
    nodes = snapshot(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = snapshot(components(links(nodes.select("fp"), radius)), "labels")
    placed = snapshot(
        nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "placed"
    )
    smallest = snapshot(placed.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "_l"), "smallest")
    named = snapshot(placed.join(smallest, F.col("label") == F.col("_l")).select(F.col("fp").alias("_fp"), "component_id", "label"), "named")
    return marked.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id", "label", *keep)
