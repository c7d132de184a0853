from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwright.llm import mixing, quality, sharding
from shelfwright.llm.common import count_words, running_total
from shelfwright.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.llm.helpers import documents, odd_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


def plain_features(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_features(spark):
    rows = odd_rows() + [(20, "a b c d e f g h " * 3), (21, "x\ny\nx\n \n\ny y"), (22, "# * $ \x0b%&\x0c|<>"), (23, "é" * 4 + " " + "a b c d e f g h i a b c d e f g h")]
    got = quality.features(documents(spark, rows), ["doc_id"]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    expected = [(r[0], *plain_features(r[1])) for r in rows]
    seen = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]
    assert sorted(seen, key=key) == sorted(expected, key=key)


def binomial_limit(n, risk, level):
    total, best = 0.0, -1
    for k in range(n):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        if total > level:
            return best
        best = k
    return best


def test_allowed_rejections_are_exact(spark):
    sizes = [0, 1, 50, 299, 300, 545, 1000, 5000, 40_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = {r.n: r.k for r in rows.select("n", quality.allowed(F.col("n"), 0.01, F.lit(0.05 / 12)).alias("k")).collect()}
    assert got == {n: binomial_limit(n, 0.01, 0.05 / 12) if n else -1 for n in sizes}


def test_cutoffs_limit_false_rejections(spark):
    """Bad documents have symbol shares from 3000 on, good ones below 500 but for a few; a stratum with few labels has no rule."""
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        share = 3000 + i % 700 if bad else (4000 if i % 601 == 1 else i % 500)
        rows.append((i, "en", share, 0, 0))
        labels.append((i, 0 if bad else 1))
    rows += [(5000 + i, "fr", 9000 if i % 2 else 0, 0, 0) for i in range(60)] + [(7000, None, 9000, 0, 0)]
    labels += [(5000 + i, 1 - i % 2) for i in range(60)] + [(7000, None), (None, 0)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, symbol_share int, dup_line_share int, repeat_share int")
    cut = {r.lang: r.asDict() for r in quality.cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int"), "lang").collect()}
    assert set(cut) == {"en"}
    assert 499 <= cut["en"]["symbol_share"] < 3000
    assert cut["en"]["dup_line_share"] is None
    good = [s for (i, l, s, *_), (_, q) in zip(rows, labels) if l == "en" and q == 1]
    assert sum(s > cut["en"]["symbol_share"] for s in good) <= binomial_limit(len(good), 0.01, 0.05 / 3)


def test_rating_keeps_every_row(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = odd_rows()
    got = quality.rate(documents(spark, rows), labels, ["doc_id", "lang"])
    assert got.count() == len(rows)
    assert {r.kept for r in got.filter("doc_id IN (1, 2, 4)").collect()} == {False}
    assert quality.rate(documents(spark, []), labels, ["doc_id", "lang"]).count() == 0


def fill(sizes, weights, share, epochs):
    cap = {s: epochs * n for s, n in sizes.items()}
    clamped = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap[s] for s in clamped)
        total = sum(weights[s] for s in sizes if s not in clamped)
        level = left / total if total else 0
        more = {s for s in sizes if s not in clamped and cap[s] < weights[s] * level}
        if not more:
            return {s: cap[s] if s in clamped else min(cap[s], weights[s] * level) for s in sizes}
        clamped |= more


def test_mixture(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), "en", f"s{i % 7 if i % 3 else 0}") for i in range(500)]
    rows += [(900, None, None, None), (901, "", "en", "empty"), (902, "a b c", "en", None), (902, "a b c", "en", None), (None, "q r", "en", "s1")]
    docs = documents(spark, rows)
    mixed = mixing.mix(docs, count_words(F.col("text")))
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    expected = fill(sizes, weights, 1.5, 2)
    for s in order:
        assert target[s] == pytest.approx(expected[s])
        # Rows alike in id, source and size share a place in the order, so both may be the one taken in part.
        assert abs(taken[s] - target[s]) <= 3.5
    assert sorted(map(repr, mixing.mix(docs, count_words(F.col("text"))).collect())) == sorted(map(repr, got))

    mixed = mixing.mix(docs, count_words(F.col("text")), digest=mixing.row_digest(docs))
    got = mixed.collect()
    out = mixing.repeat_rows(docs, mixed)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    for r in got:
        if r.doc_id not in (None, 902):
            assert words.get(r.doc_id, 0) == r.taken
    assert mixing.mix(documents(spark, []), count_words(F.col("text"))).count() == 0


def test_shards_fit_their_limit(spark):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(2000)] + [(5000, "y" * 4000), (None, "z"), (6000, None)] + [(7000, "r" * 300)] * 5
    got = sharding.shard(documents(spark, rows), "doc_id", F.octet_length("text"), 1000).collect()
    assert len(got) == len(rows)
    sums, alone = defaultdict(int), set()
    for r in got:
        sums[r.shard] += r.bytes
        assert r.depth == len(r.shard.rstrip("!"))
    for r in got:
        assert sums[r.shard] == r.shard_bytes or r.shard.endswith("!")
        if r.shard.endswith("!"):
            alone.add(r.doc_id)
        else:
            assert r.shard_bytes <= 1000
    # The rows of a key that are too many for one shard are split; only a single row can be too large.
    assert alone == {5000}
    # No shard could have been left unsplit: its sibling and it together are over the limit.
    whole = {s: b for s, b in sums.items() if not s.endswith("!")}
    for s in whole:
        together = sum(b for t, b in whole.items() if t.startswith(s[:-1])) + sum(b for t, b in sums.items() if t.endswith("!") and t.startswith(s[:-1]) and b <= 1500)
        assert together > 1000
    assert sharding.shard(documents(spark, []), "doc_id", F.octet_length("text"), 1000).count() == 0


def test_running_total(spark):
    rows = spark.createDataFrame([(i * 37 % 1000, i) for i in range(1000)], "k long, v long")
    got = {r.k: r.t for r in running_total(rows, ["k"], "v", "t").collect()}
    value, total = {i * 37 % 1000: i for i in range(1000)}, 0
    for k in range(1000):
        assert got[k] == total
        total += value[k]
