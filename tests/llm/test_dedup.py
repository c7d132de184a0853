from __future__ import annotations

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwright.llm import bktree, runindex
from tests.llm.helpers import documents, near_copies, odd_rows, removed_repeats


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(rows):
    prints = {i: simhash(t) for i, t in rows}
    label = dict(prints)
    changed = True
    values = sorted(set(prints.values()))
    joined = {v: v for v in values}
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 4 and joined[a] > joined[b]:
                    joined[a], changed = joined[b], True
    first = {}
    for i, p in prints.items():
        first[joined[p]] = min(first.get(joined[p], i), i)
    return {i: (prints[i], first[joined[p]]) for i, p in label.items()}


def test_fingerprints_and_components(spark):
    rows = near_copies(3) + [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, " \n")]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in bktree.near_duplicates(documents(spark, rows)).collect()}
    assert got == smallest_reachable(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 5


def test_odd_documents_have_one_row_each(spark):
    rows = odd_rows()
    got = bktree.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert (by[1], by[2], by[3], by[7]) == (1, 1, 1, 6)
    assert bktree.near_duplicates(documents(spark, [])).count() == 0


def test_queries_of_a_large_shard_are_shared(spark, monkeypatch):
    """A shard over the limit sends its tree to several tasks; links stay whole."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    signed = [(v - 2**64 if v >> 63 else v,) for v in values]
    monkeypatch.setattr(bktree, "QUERIES_PER_TASK", 20)
    edges = bktree.links(spark.createDataFrame(signed, "fp long"))
    labels = {r.node: r.label for r in bktree.components(edges).collect()}
    assert len({labels.get(v[0], v[0]) for v in signed}) == 1


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 6))
@settings(max_examples=60, deadline=None)
def test_tree_finds_all_within_the_radius(values, radius):
    tree = bktree.BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    assert sorted(tree.within(values[-1], radius)) == sorted(v for v in values if (v ^ values[-1]).bit_count() <= radius)


def test_masks_miss_no_pair_within_the_radius():
    rng = random.Random(2)
    for nodes in (1, 10**6, 10**8, 10**10):
        chosen = bktree.masks(nodes)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in chosen)


def test_chains_and_stars_become_components(spark):
    chain = [(i + 1, i) for i in range(100, 160)]
    star = [(k, 1) for k in range(2, 40)]
    got = {r.node: r.label for r in bktree.components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert {got[k] for k in range(101, 161)} == {100}
    assert {got[k] for k in range(2, 40)} == {1}


def passages(seed):
    rng = random.Random(seed)
    shared = [" ".join(f"p{rng.randrange(900)}" for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(30):
        words = [f"d{rng.randrange(10**6)}" for _ in range(40)]
        words.insert(rng.randrange(40), rng.choice(shared)[: rng.choice((99, 100, 101, 300))])
        if i % 5 == 0:
            words.append("ha " * 120)
        rows.append((i, " ".join(words)))
    return [*rows, (31, rows[4][1]), (32, rows[4][1] + " end"), (40, None), (41, ""), (42, "é" * 150), (43, "x" + "é" * 150)]


def removed(spark, rows):
    found = runindex.dedupe(documents(spark, rows)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}


def test_repeats_equal_the_brute_force(spark):
    for seed in (1, 2):
        rows = passages(seed)
        assert removed(spark, rows) == removed_repeats(rows)


def test_hot_cores_are_dealt_again(spark, monkeypatch):
    """More different segments of a core than a task takes: longer and longer cores, the same marks."""
    rng = random.Random(5)
    middle = "".join(rng.choice("abcdefgh") for _ in range(90))
    rows = [(i, f"{rng.random()}{middle}{rng.choice('xyz')}{rng.choice('xyz')}{'q' * rng.randrange(9)}{rng.random()}") for i in range(80)]
    monkeypatch.setattr(runindex, "GROUP_LIMIT", 3)
    assert removed(spark, rows) == removed_repeats(rows)


def test_sketches_reach_the_driver_as_bytes(spark, monkeypatch):
    """Every hash's bit and no other, whatever the pieces; rows of the driver are pieces, not words."""
    taken = []
    whole = type(spark.range(0)).toLocalIterator
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda *_: 1 / 0)
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda *_: 1 / 0)
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda frame: (taken.append(row) or row for row in whole(frame)))
    rng = np.random.default_rng(3)
    for n, piece in ((0, 1 << 17), (1, 1 << 17), (5_000, 1 << 17), (5_000, 1 << 10), (40_000, 1 << 17)):
        monkeypatch.setattr(runindex, "SKETCH_PIECE", piece)
        hashes = rng.integers(-(1 << 63), (1 << 63) - 1, n, np.int64)
        frame = spark.createDataFrame([(int(h),) for h in hashes], "h long")
        taken.clear()
        words = runindex._sketch(frame)
        bits = 64 * len(words)
        assert bits >= max(1 << 16, min(runindex.BITS_EACH * n, runindex.SKETCH_BITS)) and len(taken) <= -(-bits // piece)
        want = np.zeros(bits, np.uint8)
        want[hashes & (bits - 1)] = 1
        assert (np.unpackbits(words.astype("<i8").view(np.uint8), bitorder="little") == want).all()
        assert runindex._sketched(words, hashes.view(np.uint64)).all()


def test_odd_texts(spark):
    rows = odd_rows()
    got = runindex.dedupe(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[7].n_removed == by[7].n_bytes and by[7].n_spans == 1
    assert by[9].n_removed == 4900 + 99 or by[9].n_removed == removed_repeats([(9, "x" * 5000)])[9][1]
    assert by[1].n_bytes == 0 and by[2].n_removed == 0
    assert runindex.dedupe(documents(spark, [])).count() == 0


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(runindex, "BLOCK", 256)
    rows = passages(9)
    texts = [(t or "").encode() for _, t in rows]
    found = {(int(n), int(a), int(b)) for number, _, _, first, last in runindex._scan(texts) for n, a, b in zip(number, first, last)}
    windows = sorted((n, w) for n, a, b in found for w in range(a, b + 1))
    assert windows == [(n, w) for n, t in enumerate(texts) for w in range(max(0, len(t) - 99))]


def test_repeats_within_a_text_of_several_blocks(spark):
    """The passages stand in one text only, farther off than a block; one goes over a border of blocks."""
    rng = random.Random(6)
    size = runindex.BLOCK
    text = "".join(rng.choices("abcdefghij ", k=3 * size + 500))
    for source, target in ((1_000, 2 * size + 9_000), (5_000, size - 60), (size + 700, 3 * size + 100)):
        text = text[:target] + text[source : source + 160] + text[target + 160 :]
    rows = [(1, text), (2, "".join(rng.choices("klmnop ", k=2 * size)))]
    got = removed(spark, rows)
    assert got == removed_repeats(rows)
    assert got[1][1] >= 480


@given(st.lists(st.binary(min_size=6, max_size=14), min_size=1, max_size=12, unique=True))
@settings(max_examples=80, deadline=None)
def test_index_marks_what_starts_earlier(segs):
    segs = [bytes(b % 3 for b in s) for s in segs]
    segs = list(dict.fromkeys(segs))
    got = {(k, x) for k, a, b in runindex.later_repeats(segs, np.arange(len(segs)) << 20, 6) for x in range(a, b)}
    seen, expected = set(), set()
    for k, s in enumerate(segs):
        for at in range(len(s) - 5):
            if s[at : at + 6] in seen:
                expected |= {(k, x) for x in range(at, at + 6)}
            seen.add(s[at : at + 6])
    assert got == expected


def test_run_ends_are_sampled():
    text = np.frombuffer(b"banana\0bandana\0", np.uint8).astype(np.int64) + 1
    text[[6, 14]] = 0
    index = runindex.RunLengthIndex(text, 7)
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    bwt = [text[i - 1] for i in order]
    heads = [k for k in range(len(bwt)) if k == 0 or bwt[k] != bwt[k - 1]]
    assert index.heads.tolist() == heads
    assert index.samples[0].tolist() == [order[k] for k in heads]
    rows = np.arange(len(text))
    shared = lambda r: next((k for k, (a, b) in enumerate(zip(text[order[r] :], text[order[r - 1] :])) if a != b), len(text) - max(order[r], order[r - 1])) if r else 0
    matched = np.array([min(shared(r), 7) for r in rows])
    after, found = index.step(rows, matched, 7)
    assert after.tolist() == [order.index((order[r] - 1) % len(text)) for r in rows]
    inner = [k for k in rows if text[order[k] - 1]]  # streaming ends before a separator
    assert [found[k] for k in inner] == [min(shared(after[k]), 7) for k in inner]


def test_nothing_but_runs_is_kept():
    text = np.frombuffer(b"abracadabra\0abracadabra abracadabra\0", np.uint8).astype(np.int64) + 1
    text[[11, len(text) - 1]] = 0
    index = runindex.RunLengthIndex(text, 6)
    sizes = {k: np.size(v) for k, v in vars(index).items() if isinstance(v, np.ndarray)}
    assert set(sizes) == {"ends", "end_rows", "heads", "symbols", "samples", "targets", "matches"}
    runs = len(index.heads)
    assert all(n <= 2 * runs for k, n in sizes.items()) and runs < len(text) - 10
