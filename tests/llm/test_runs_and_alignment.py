from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwright.llm import alignment, queries, runs
from shelfwright.llm.common import load
from tests.llm.helpers import documents, near_copies, odd_rows

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(r[0], r[1]) for r in odd_rows()]


# Runs


def plain_runs(words, least=24, times=3):
    """(start, length, period) of maximal runs, by looking at every stretch of equal words at every lag."""
    found, n = {}, len(words)
    for lag in range(1, n // times + 1):
        at = 0
        while at < n - lag:
            stop = at
            while stop < n - lag and words[stop] == words[stop + lag]:
                stop += 1
            length = stop - at + lag
            if stop > at and length >= max(least, times * lag):
                found.setdefault((at, length), lag)  # lags ascend: the first is the smallest period
            at = stop + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    """What the query returns for a document, from the definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def repeating_texts(seed):
    """Texts in which stretches of few words repeat, next to and inside others, and nearly repeat."""
    rng, out = random.Random(seed), []
    for _ in range(60):
        words = []
        while len(words) < rng.randrange(40, 400):
            kind = rng.randrange(4)
            if kind == 0:
                words += [f"x{rng.randrange(300)}" for _ in range(rng.randrange(20))]
            elif kind == 1:
                own = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
                words += (own * rng.randrange(2, 12))[: rng.randrange(1, 60)]
            elif kind == 2:
                inner = [rng.choice("ab") for _ in range(rng.randrange(1, 3))] * rng.randrange(3, 30)
                words += (inner + [rng.choice("cd")]) * rng.randrange(2, 5)
            else:
                words += [rng.choice("ab") for _ in range(rng.randrange(40))]
        out.append(" ".join(words))
    return out


def collected(frame, columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_runs_equal_the_definition(spark):
    planted = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 10 == 0][:40]
    rows = [(100_000 + k, t) for k, t in enumerate(repeating_texts(1))]
    rows += [(d, " ".join(f"w{(i * i) % 37}" for i in range(5 * k))) for k, d in enumerate(planted)]
    rows += [r for r in ODD if len(r[1] or "") < 10_000]
    got = collected(queries.repeated_words(documents(spark, rows)), RUN_COLUMNS)
    assert got == Counter(plain_row(*r) for r in rows)
    assert sum(1 for r in got if r[1]) > 40


def test_runs_of_the_table_equal_the_definition(spark):
    rows = [(r.doc_id, r.text) for r in load(spark, SMALL, "documents").collect() if len(r.text or "") < 20_000]
    got = collected(queries.word_runs(spark, SMALL), RUN_COLUMNS)
    assert sum(got.values()) == load(spark, SMALL, "documents").count()
    assert not Counter(plain_row(*r) for r in rows) - got
    assert runs.find(documents(spark, [])).count() == 0


@given(st.lists(st.integers(0, 2), max_size=120), st.integers(1, 12), st.integers(0, 60))
@settings(max_examples=400, deadline=None)
def test_lag_scan_finds_all_runs(words, period, extra):
    words = words + [words[k % period] if words and period <= len(words) else 0 for k in range(extra)] + words[:20]
    assert runs.runs_of(np.array(words, np.int64), np.array([0, len(words)])) == plain_runs(words)
    assert sorted(runs.lag_scan(np.array(words, np.int64))) == plain_runs(words)


def test_hash_collisions_only_cost_time(monkeypatch):
    words = [0, 1, 2] * 9 + [5, 6] + [1, 1, 2] * 12
    monkeypatch.setattr(runs, "_MULTIPLIER", np.uint64(0))  # all blocks look alike
    assert sorted(runs.lag_scan(np.array(words))) == plain_runs(words)


def test_splitting_keeps_what_runs_can_lie_in():
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") for _ in range(3000)]
    words[500:900] = (["p", "q", "r", "s"] * 100)
    words[1500:1503] = ["only", "these", "once"]
    codes = np.unique(words, return_inverse=True)[1].astype(np.int64)
    for rounds in (1, 2, 64):
        kept = runs.split_rare(codes, np.array([0, 1000, 3000]), rounds=rounds)
        assert all(b - a >= runs.LEAST for a, b in kept) and not any(a < 1500 < b for a, b in kept if rounds > 1)
        assert any(a <= 500 and 900 <= b for a, b in kept)
    for a, b in runs.split_rare(codes, np.array([0, 1000, 3000])):
        assert min(Counter(codes[a:b].tolist()).values()) >= 3


def test_long_texts_of_one_word_and_of_long_periods():
    one = np.zeros(300_000, np.int64)
    assert runs.runs_of(one, np.array([0, len(one)])) == [(0, 300_000, 1)]
    long = np.tile(np.random.default_rng(1).permutation(20_000), 4)[:70_001].astype(np.int64)
    assert runs.runs_of(long, np.array([0, len(long)])) == [(0, 70_001, 20_000)]


# Alignment


_WHOLE: list = []


def encoders():
    if not _WHOLE:
        a = Tokenizer.from_file(A)
        a.encode_special_tokens = True
        alphabet = alignment._byte_alphabet()
        _WHOLE[:] = [a, sentencepiece.SentencePieceProcessor(model_file=B), alphabet]
    return _WHOLE


def plain_alignment(text):
    """A ids, B ids, groups and links of a text encoded whole; None for texts without tokens."""
    a, b, alphabet = encoders()
    if not text:
        return None
    found_a = a.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(alphabet[c] for c in t) for t in found_a.tokens]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, b_ids)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    a_ends, b_ends = (np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes))
    common = sorted(set(a_ends) & set(b_ends))
    groups, i, j = [], 0, 0
    for end in common:
        p, q = a_ends.index(end) + 1, b_ends.index(end) + 1
        groups.append(",".join(map(str, found_a.ids[i:p])) + "|" + ",".join(map(str, b_ids[j:q])))
        i, j = p, q
    links, j = [], 0
    for x, (start, end) in enumerate(zip([0, *a_ends], a_ends)):
        for y, (other, stop) in enumerate(zip([0, *b_ends], b_ends)):
            if start < stop and other < end:
                links.append((found_a.ids[x], b_ids[y]))
    return found_a.ids, b_ids, groups, links


def plain_rows(rows):
    found = [(d, plain_alignment(t)) for d, t in rows]
    counts = Counter(p for _, x in found if x for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = Counter()
    for d, x in found:
        if x is None:
            out[d, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        a, b, groups, links = x
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out[d, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha] += 1
    return out


ALIGN_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SHORT = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "foo"), (5, "foo"), (6, "foo "), (7, "foo  bar\n\n  baz \n x"), (None, "no id at all"), (8, "a▁b c"),
    (9, "ÄÖ é\x00 ñ 中文 😀 <|endoftext|> <s></s>"), (10, "don't we'll 123 ½ x=1;\r\n\t\tend."), (11, "é  x　 y\xa0 z\x85 w é "), (12, "x" * 5000),
    (13, "same words same words same words"), (14, "   lead"), (15, "Straße ŉ İstanbul ǆ"), (16, "ﬁ ① ㎏ Å"), (17, "..." * 40 + " ," * 30), (18, "<0x0A> ▁"),
]


@pytest.mark.parametrize("sent", [alignment.SENT, 5, 0])
def test_alignments_equal_whole_encoding(spark, sent):
    rows = SHORT + near_copies(2, 3, 5, 40)
    got = collected(queries.aligned_tokens(documents(spark, rows).repartition(3), sent), ALIGN_COLUMNS)
    assert got == plain_rows(rows)
    assert queries.aligned_tokens(documents(spark, []), sent).count() == 0


def test_alignments_of_the_table_equal_whole_encoding(spark):
    rows = [(r.doc_id, r.text) for r in load(spark, SMALL, "documents").filter("length(text) < 3000").collect()]
    got = collected(queries.aligned_tokens(documents(spark, rows)), ALIGN_COLUMNS)
    assert got == plain_rows(rows)


@given(st.lists(st.lists(st.sampled_from(["a", "The", "é", "ß", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", " ", "'s", "'", "1", "½", ".", "--", "▁", "<s>", "<|endoftext|>", "\x00", "中", "😀", "̌", "ę", "©", "¯"]), max_size=12), max_size=4))
@settings(max_examples=300, deadline=None)
def test_chunks_are_encoded_as_in_whole_texts(parts):
    texts = [t for t in map("".join, parts) if t]
    if not texts:
        return
    aligned = alignment.Aligned(alignment.tokenizers(A, B), pa.array(texts))
    written, links = aligned.groups().to_pylist(), aligned.links()
    starts = np.cumsum(aligned.n_links) - aligned.n_links
    for k, text in enumerate(texts):
        own, want = aligned.index[aligned.bounds[k] : aligned.bounds[k + 1]], plain_alignment(text)
        assert bool(aligned.whole[k]) == (want is not None)
        if want:
            assert ";".join(written[c] for c in own) == ";".join(want[2])
            found = [p for c in own for p in links[starts[c] : starts[c] + aligned.n_links[c]].tolist()]
            assert Counter((p >> 32, p & 0xFFFFFFFF) for p in found) == Counter(want[3])


@given(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)))
@settings(max_examples=200, deadline=None)
def test_slices_of_a_shape(a, b):
    a, b = sorted(a | {31}), sorted(b | {31})
    n, order, behind, link_a, link_b = alignment.slice_shape(a, b)
    assert n == len(set(a) & set(b)) and sorted(order) == list(range(len(a) + len(b))) and behind[-1] == 0
    overlap = {(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])}
    assert sorted(zip(link_a, link_b)) == sorted(overlap)


@pytest.mark.parametrize("sent", [alignment.SENT, 0])
def test_alignment_reads_every_text_once(spark, sent):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = SHORT + near_copies(3, 3, 5, 40)
    docs = documents(spark, rows).withColumn("text", seen("text"))
    assert collected(queries.aligned_tokens(docs, sent), ALIGN_COLUMNS) == plain_rows(rows)
    assert read.value == len(rows)


@pytest.mark.parametrize("batch", [1, 4, 500])
def test_stored_pairs_are_the_links(monkeypatch, batch):
    monkeypatch.setattr(alignment, "BATCH", batch)
    texts = [t or "" for _, t in SHORT] + [t for _, t in near_copies(4, 2, 3, 30)]
    parts = list(alignment._aligned(alignment.tokenizers(A, B), pa.array(texts)))
    assert [len(p["pairs"]) for p in parts] == [min(batch, len(texts) - a) for a in range(0, len(texts), batch)]
    pairs, times, groups = ([x for p in parts for x in p[c].to_pylist()] for c in ("pairs", "times", "groups"))
    for k, text in enumerate(texts):
        want = plain_alignment(text)
        assert groups[k] == (";".join(want[2]) if want else "")
        assert len(pairs[k]) == len(set(pairs[k]))
        assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(pairs[k], times[k])} == Counter(want[3] if want else [])
    empty = list(alignment._aligned(alignment.tokenizers(A, B), pa.array(["", ""])))
    assert [x for p in empty for x in p["pairs"].to_pylist()] == [[], []]
