"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are dealt by bands of norms. Those of a band are of one length (shorter ones get a coordinate that makes them so,
which turns the largest inner product into the smallest angle), and every query asks every band. They are turned by pseudo-rotations, three rounds of random signs and a fast Hadamard transform, and go to
the bucket of the nearest signed axis, once per table. A query looks into the ``probes`` nearest buckets of each table.
What a bucket holds is ranked by the exact inner product. Equal vectors are one entry with its smallest ids, so a vector
that a third of all rows share is hashed and ranked once. Queries that find too few rows are ranked against all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.llm.common import snapshot


@dataclass(frozen=True)
class Index:
    """``tables`` hash tables of ``probes`` buckets looked into in each band of norms. A bucket is one axis, whatever the
    input, for large ones are cut into blocks; given ``per_hash``, beyond so many entries it is two axes of two rotations, and
    so on, for smaller buckets of which the same probes see less."""

    tables: int = 8
    probes: int = 24
    per_hash: int | None = None
    seed: int = 11
    #: Vectors, or queries, of a bucket that meet in one block.
    block: int = 8192
    #: Bytes of vectors that a task ranks at a time.
    group_bytes: int = 1 << 25


def _hadamard(rows: np.ndarray) -> np.ndarray:
    n, step = rows.shape[1], 1
    while step < n:
        pairs = rows.reshape(len(rows), -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(-1, n)
        step *= 2
    return rows


def rotate(rows: np.ndarray, table: int, hash_number: int, index: Index) -> np.ndarray:
    """The rows (padded to a power of two) after the pseudo-rotation of a table's hash, up to a constant factor."""
    signs = np.random.default_rng([index.seed, table, hash_number]).integers(0, 2, (3, rows.shape[1])) * 2 - 1
    for s in signs:
        rows = _hadamard(rows * s)
    return rows


def signed_axes(rotated: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest signed axes of each row, nearest first, and their coordinates. Axis k + n is minus axis k."""
    both = np.concatenate([rotated, -rotated], axis=1)
    count = min(count, both.shape[1])
    near = np.argpartition(-both, count - 1, axis=1)[:, :count]
    values = np.take_along_axis(both, near, 1)
    order = np.lexsort((near, -values), axis=1)
    return np.take_along_axis(near, order, 1), np.take_along_axis(values, order, 1)


def buckets(rows: np.ndarray, table: int, hashes: int, probes: int, index: Index) -> np.ndarray:
    """The ``probes`` buckets of each row in a table, best first: combinations of axes by the sum of coordinates."""
    found, score = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1))
    for h in range(hashes):
        axes, values = signed_axes(rotate(rows, table, h, index), probes)
        found = (found[:, :, None] * (2 * rows.shape[1]) + axes[:, None, :]).reshape(len(rows), -1)
        score = (score[:, :, None] + values[:, None, :]).reshape(len(rows), -1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
    return found


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, most: int) -> DataFrame:
    """rep, embedding, members: the different vectors with their ``most`` smallest ids; rep is the smallest."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    return (
        vectors.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
        .select(F.get("members", F.lit(0)).alias("rep"), "embedding", "members")
    )


def nearest(table: DataFrame, is_query: Column, k: int = 20, index: Index = Index()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, by inner product in double precision on the
    vectors as given, ties to the smaller vec_id; all, if there are fewer.

    Vectors that are not ``usable`` take no part, nor do null ids. An id that comes twice counts once, with the smaller
    vector. Vectors of different dimensions have no inner product and never meet. No usable query: an empty table."""
    vectors = snapshot(
        table.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors"
    )
    classes = snapshot(entries(vectors, k + 1), "classes")
    asked = snapshot(
        vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_e")).join(classes.select("rep", "embedding"), F.col("_e") == F.col("embedding")).select("query_id", "rep"), "asked"
    )
    squared = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # Bands of norms, a factor of 1.41 wide; unit vectors are in the middle of one.
    banded = snapshot(classes.withColumn("s", squared).withColumn("d", F.size("embedding")).withColumn("band", F.coalesce(F.round(F.log2("s")), F.lit(-2000)).cast("int")), "banded")
    bands = {(r["d"], r["band"]): r for r in banded.groupBy("d", "band").agg(F.count("*").alias("n"), F.max("s").alias("longest"), F.min("s").alias("shortest")).collect()}
    count, dim = sum(r["n"] for r in bands.values()), max((d for d, _ in bands), default=0)
    hashes = 1
    while index.per_hash and count > index.per_hash**hashes:
        hashes += 1
    # Only bands of unlike lengths need the extra coordinate.
    reach = {b: r["longest"] if r["longest"] - r["shortest"] > 1e-6 * r["longest"] else None for b, r in bands.items()}

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def dealt(given: np.ndarray, reps: np.ndarray, extra: np.ndarray | None, asks: bool, own_bands: list[int]) -> Iterator[pd.DataFrame]:
            own = given if extra is None else np.column_stack([given, extra])
            rows = np.zeros((len(own), 1 << (own.shape[1] - 1).bit_length()))
            rows[:, : own.shape[1]] = own
            unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            for t in range(index.tables):
                found = buckets(unit, t, hashes, index.probes if asks else 1, index)
                at = np.repeat(np.arange(len(given)), found.shape[1])
                for band in own_bands:
                    yield pd.DataFrame({"dim": given.shape[1], "band": band, "t": t, "bucket": found.ravel(), "asks": asks, "rep": reps[at], "vector": [given[i].tobytes() for i in at]})

        for frame in frames:
            for (dim, band), part in frame.groupby(["d", "band"]):
                given, far = np.stack(part["embedding"].to_list()).astype(np.float64), reach[dim, band]
                extra = None if far is None else np.sqrt(np.maximum(far - (given**2).sum(1), 0))
                yield from dealt(given, part["rep"].to_numpy(), extra, False, [band])
            for dim, part in frame[frame["asks"]].groupby("d"):
                given = np.stack(part["embedding"].to_list()).astype(np.float64)
                for plain in (True, False):
                    if alike := [b for (d, b), far in reach.items() if d == dim and (far is None) == plain]:
                        yield from dealt(given, part["rep"].to_numpy(), None if plain else np.zeros(len(given)), True, alike)

    queries = asked.select(F.col("rep").alias("_q")).distinct()
    flagged = banded.join(queries, F.col("rep") == F.col("_q"), "left").select("rep", "embedding", "d", "band", F.col("_q").isNotNull().alias("asks"))
    schema = "dim int, band int, t int, bucket long, asks boolean, rep long, vector binary"
    lists = _met(flagged.mapInPandas(hashed, schema), classes, k, index, count * index.tables * (dim or 0))

    # Each list holds k rows and the query itself, or all rows there are; what is shorter is ranked again, against all.
    rows = classes.groupBy(F.size("embedding").alias("_d")).agg(F.sum(F.size("members")).alias("rows"))
    listed = flagged.filter("asks").join(rows, F.col("d") == F.col("_d")).join(lists.select("q", F.size("best").alias("found")), F.col("rep") == F.col("q"), "left")
    short = snapshot(listed.filter(F.coalesce("found", F.lit(0)) < F.least("rows", F.lit(k + 1))).select(F.col("rep").alias("_q"), F.col("d").alias("_d")), "short")
    if not short.isEmpty():

        def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                vectors = [np.asarray(x, np.float64).tobytes() for x in frame["embedding"]]
                yield pd.DataFrame({"dim": frame["d"], "band": 0, "t": -1, "bucket": 0, "asks": frame["asks"], "rep": frame["rep"], "vector": vectors})

        asking = flagged.join(short, F.col("rep") == F.col("_q"), "left_semi")
        against = flagged.join(short.select("_d").distinct(), F.col("d") == F.col("_d"), "left_semi").withColumn("asks", F.lit(False))
        again = _met(asking.unionByName(against).mapInPandas(whole, schema), classes, k, index, count * (dim or 0))
        lists = lists.join(short, F.col("q") == F.col("_q"), "left_anti").unionByName(again)
    # Queries with one vector share a list, less their own id.
    return (
        asked.join(lists, F.col("rep") == F.col("q"))
        .select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
    )


def _met(dealt: DataFrame, classes: DataFrame, k: int, index: Index, numbers: int) -> DataFrame:
    """q, best: the k + 1 best of the vectors that share a bucket with each query, as (minus the score, vec_id). numbers: of
    components of all vectors dealt."""
    dealt = snapshot(dealt, "dealt")
    key = ["dim", "band", "t", "bucket"]
    sizes = snapshot(
        dealt.groupBy(*key).agg(F.sum((~F.col("asks")).cast("int")).alias("nv"), F.sum(F.col("asks").cast("int")).alias("nq"))
        .filter("nv > 0 AND nq > 0").select(*[F.col(c).alias(f"_{c}") for c in key], *[F.ceil(F.col(c) / index.block).cast("int").alias(f"_{c}") for c in ("nv", "nq")]), "sizes"
    )
    # A block of a bucket's vectors meets every block of its queries.
    part, other = F.pmod(F.xxhash64("rep"), F.when(F.col("asks"), F.col("_nq")).otherwise(F.col("_nv"))), F.when(F.col("asks"), F.col("_nv")).otherwise(F.col("_nq"))
    # A query's best are ranked once per group of buckets it looks into, so groups are as large as a task can hold.
    groups = max(8, numbers * 8 // index.group_bytes)
    blocks = (
        dealt.join(sizes, [F.col(c) == F.col(f"_{c}") for c in key])
        .select(*key, "asks", "rep", "vector", part.alias("own"), F.explode(F.sequence(F.lit(0), other - 1)).alias("with"))
        .withColumn("pv", F.when(F.col("asks"), F.col("with")).otherwise(F.col("own")))
        .withColumn("pq", F.when(F.col("asks"), F.col("own")).otherwise(F.col("with")))
        .withColumn("g", F.pmod(F.xxhash64(*key, "pv", "pq"), F.lit(groups)))
        .select("g", *key, "pv", "pq", "asks", "rep", "vector")
    )
    keep = k + 12  # a few more than needed, for the sums of a matrix product are not yet the last word

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, block in pdf.groupby([*key, "pv", "pq"], sort=False):
            ask = block["asks"].to_numpy()
            if ask.all() or not ask.any():
                continue
            reps, rows = block["rep"].to_numpy(), np.frombuffer(b"".join(block["vector"]), np.float64).reshape(len(block), -1)
            own, asking = rows[~ask], rows[ask]
            scores = asking @ own.T
            most = min(keep, scores.shape[1])
            top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            at = np.repeat(np.arange(len(asking)), most)
            pair = top.ravel()
            # Row by row, so that a pair's score does not hang on the pairs beside it.
            exact = (asking[at] * own[pair]).sum(axis=1)
            found.append(pd.DataFrame({"q": reps[ask][at], "rep": reps[~ask][pair], "score": exact}))
        if not found:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        merged = pd.concat(found).drop_duplicates(["q", "rep"]).sort_values(["q", "score", "rep"], ascending=[True, False, True])
        return merged.groupby("q").head(k + 1)

    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    top = (
        blocks.groupBy("g").applyInPandas(ranked, "q long, rep long, score double")
        .groupBy("q", "rep").agg(F.max("score").alias("score"))
        .withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    )
    ordered = F.struct((-F.col("score")).alias("s"), F.col("vec_id"))
    return snapshot(
        top.join(classes.select(F.col("rep").alias("_r"), "members"), F.col("rep") == F.col("_r"))
        .select("q", "score", F.explode("members").alias("vec_id"))
        .groupBy("q").agg(F.slice(F.sort_array(F.collect_list(ordered)), 1, k + 1).alias("best")), "lists"
    )
