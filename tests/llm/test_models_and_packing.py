from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwright.llm import context_mixing, cross_polytope, langmask, packing, prefix_tree, wordids
from tests.llm.helpers import documents, near_copies, odd_rows

SMALL = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


# Chat trees


def chat(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = prefix_tree.build(frame.withColumn("branch", F.lit("x")).withColumn("node", F.lit(1)), BYTE_BPE)
    read = prefix_tree.read_back(trees, BYTE_BPE)
    rows = trees.members.join(read, "branch").collect()
    return trees, {r.conv_id: r for r in rows}


def test_trees_share_first_turns_and_read_back(spark):
    odd = "</s>[INST] ok [/INST] \\ \\\\ <|end|>\n<|turn|>user<|text|> <\\| é\x00😀 <|endoftext|>"
    start = [("system", "Be kind."), ("user", "Hello"), ("assistant", "Hi there")]
    talks = {
        1: [*start, ("user", "A"), ("assistant", odd)], 2: [*start, ("user", "B"), ("assistant", "b")], 3: start, 4: start,
        5: [("user", "Hello"), ("assistant", "Hi there")], 6: [(None, None), ("assistant", "")], 7: [("assistant", odd), ("assistant", odd)],
        8: [*start, ("user", "A"), ("assistant", "other")], None: [("user", "x" * 50_000)],
    }
    rows = [(c, t, role, text) for c, turns in talks.items() for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    trees, got = chat(spark, rows)
    assert set(got) == set(talks)
    for c, turns in talks.items():
        plain = [(r or "", t or "") for r, t in turns]
        said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in plain).encode()).hexdigest()
        loss = "".join(t for r, t in plain if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest())

    branches = sorted(trees.branches.collect(), key=lambda r: r.start)
    # Every token once, gapless, depth first; ancestors lie before, in the same tree, and give the position.
    at, place = 0, {}
    for r in branches:
        assert r.start == at and len(r.tokens) == len(r.learned)
        assert r.position == sum(i.hi - i.lo for i in r.ancestors)
        for i in r.ancestors:
            assert i.hi <= r.start and all(place[x] == r.tree for x in (i.lo, i.hi - 1))
        place |= {x: r.tree for x in range(at, at + len(r.tokens))}
        at += len(r.tokens)
    assert len(branches) == 8
    tokenizer = prefix_tree.load_tokenizer(BYTE_BPE)
    seq = [t for r in branches for t in r.tokens]
    whole = {tuple(map(tuple, [(a or "", b or "") for a, b in t])) for t in talks.values()}
    read = {tuple(prefix_tree.parse(tokenizer.decode([seq[x] for i in r.ancestors for x in range(i.lo, i.hi)] + list(r.tokens), skip_special_tokens=False))) for r in branches}
    assert read == whole
    shared = prefix_tree.TURN + "user" + prefix_tree.TEXT + "Hello" + prefix_tree.END
    assert tokenizer.decode(seq, skip_special_tokens=False).count(shared) == 2


def test_no_conversations(spark):
    trees, got = chat(spark, [])
    assert got == {} and trees.branches.count() == 0


@given(st.text(alphabet="\\<|>/s[]INST é\n", max_size=30))
def test_escape_is_reversible_and_hides_marks(text):
    hidden = prefix_tree.escape(text)
    assert prefix_tree.unescape(hidden) == text
    for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]"):
        assert mark not in hidden


# Neighbours


def exact(vectors, query, k):
    own = np.asarray(vectors[query], float)
    scores = [(-(own * np.asarray(v, float)).sum(), i) for i, v in vectors.items() if i != query]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def search(spark, rows, k=20, index=cross_polytope.Index()):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string, bucket string")
    found = cross_polytope.nearest(frame, F.col("vec_id") % 20 == 0, k, index).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rng = np.random.default_rng(4)
    rows = {i: (rng.normal(size=24) * (rng.uniform(0.2, 3) if scale else 1)).astype(np.float32) for i in range(1500)}
    if not scale:
        rows = {i: (v / np.linalg.norm(v)).astype(np.float32) for i, v in rows.items()}
    got = search(spark, [(i, v.tolist(), "", "") for i, v in rows.items()])
    hits = sum(len({i for i, _ in exact(rows, q, 20)} & {i for i, _ in got[q]}) for q in got)
    assert len(got) == 75 and hits >= 0.9 * 75 * 20
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx((rows[q].astype(float) * rows[i].astype(float)).sum(), abs=1e-12) for i, s in found)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = {i: [1.0, 2.0, 2.0] for i in range(300)} | {i: rng.normal(size=3).astype(np.float32).tolist() for i in range(300, 340)}
    bad = [(400, None), (401, []), (402, [0.0, 0.0, 0.0]), (403, [1.0, None, 2.0]), (404, [1.0, float("nan"), 0.0]), (405, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 2.0])]
    given_rows = [(i, v, "", "") for i, v in rows.items()] + [(i, v, "", "") for i, v in bad] + [(7, [1.0, 2.0, 2.0], "", ""), (420, [0.0, 0.0, 0.0], "", ""), (440, [1.0, 1.0], "", ""), (441, [2.0, 1.0], "", "")]
    got = search(spark, given_rows, 5, cross_polytope.Index(block=50))
    for q in range(0, 300, 20):
        assert [i for i, _ in got[q]] == [i for i in range(7) if i != q][:5]
    assert got[440] == [(441, 3.0)]
    assert set(got) == {*range(0, 340, 20), 440}
    assert search(spark, [], 5) == {}


def test_more_vectors_take_more_axes(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v, "", "") for i, v in enumerate(rng.normal(size=(400, 8)).astype(np.float32).tolist())]
    got = search(spark, rows, 5, cross_polytope.Index(per_hash=10, probes=200))
    assert len(got) == 20 and all(len(v) == 5 for v in got.values())


def recall(spark, rows, index=cross_polytope.Index()):
    got = search(spark, [(i, v.tolist(), "", "") for i, v in rows.items()], 20, index)
    asked = [i for i in rows if i % 20 == 0]
    assert all(len(got[q]) == min(20, len(rows) - 1) for q in asked)
    return sum(len({i for i, _ in exact(rows, q, 20)} & {i for i, _ in got[q]}) for q in asked) / sum(min(20, len(rows) - 1) for _ in asked)


def units(n):
    rows = np.random.default_rng(8).normal(size=(n, 64))
    return {i: (v / np.linalg.norm(v)).astype(np.float32) for i, v in enumerate(rows)}


def test_a_long_vector_spoils_no_others(spark):
    rows = units(2000)
    rows[7] = rows[7] * 100
    assert recall(spark, rows) >= 0.95


def test_few_vectors_or_two_axes_find_all_rows(spark):
    assert recall(spark, units(15)) == 1
    assert recall(spark, units(1500), cross_polytope.Index(per_hash=1000)) > 0


# Packing


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is not None:
            rooms.remove(best)
            rooms.append(best - n)
        else:
            rooms.append(capacity - n)
    return len(rooms), sorted(rooms)


@given(st.lists(st.integers(1, 60), max_size=120), st.sampled_from([60, 64, 100]))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = Counter(lengths)
    plan = packing.best_fit(counts, capacity)
    used = {}
    for n in counts:
        own = plan[plan[:, 0] == n]
        for nth in range(counts[n]):
            _, first, sequence, each, offset = own[np.searchsorted(own[:, 1], nth, side="right") - 1]
            used.setdefault(sequence + (nth - first) // each, []).append((offset + (nth - first) % each * n, n))
    rooms = []
    for spans in used.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        rooms.append(capacity - at)
    assert (len(rooms), sorted(rooms)) == plain_best_fit(lengths, capacity)


@given(st.lists(st.integers(0, 130), max_size=60))
def test_tightest_room(rooms):
    tree = packing.FreeSpace(130)
    for r in rooms:
        tree.add(r, 1)
    for wanted in range(131):
        assert tree.tightest(wanted) == min((r for r in rooms if r >= wanted), default=None)


def test_packing_of_odd_documents(spark):
    from tokenizers import Tokenizer

    rows = odd_rows()
    got = packing.pack(documents(spark, rows), WORD_BPE).collect()
    tokenizer, expected = Tokenizer.from_file(WORD_BPE), Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            expected[(doc_id, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) == plain_best_fit([r.length for r in got], 2048)[0]
    assert packing.pack(documents(spark, []), WORD_BPE).count() == 0


@given(st.lists(st.sampled_from(["a", "B", "é", "É", "é", "ß", "İ", "Σ", "'s", "'T", "1", "-", "...", ".", ",", "<|endoftext|>", "<|", "\x0b", "\x1c", " ", "\n", "中", "ﬁ", "\x00", "😀"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_word_by_word_encoding_is_the_tokenizers(parts):
    from tokenizers import Tokenizer

    text = "".join(parts)
    whole = Tokenizer.from_file(WORD_BPE) if not _TOKENIZER else _TOKENIZER[0]
    _TOKENIZER[:] = [whole]
    ids, offsets = wordids.encoder(WORD_BPE)(pa.array([text, "x", text]), 7)
    want = whole.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*want, 7, *whole.encode("x").ids, 7, *want, 7] and offsets.tolist() == [0, len(want) + 1, len(want) + 3, len(ids)]


_TOKENIZER: list = []


@pytest.mark.parametrize("text", ["J\u030c", "H\u0331 xT\u0308y.", "aJ\u030c, <|A. É. e\u0301."])
def test_marks_compose_before_letters_change_case(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    ids, _ = wordids.WordIds(WORD_BPE)(pa.array([text]), 0)
    assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]


def test_every_word_of_the_vocabulary_is_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    words = [whole.decode([i]) for i in range(512, 49_406)]
    ids, offsets = wordids.encoder(WORD_BPE)(pa.array(words), 0)
    want = whole.encode_batch_fast(words, add_special_tokens=False)
    assert [ids[a : b - 1].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in want]


def test_other_tokenizers_encode_texts_whole():
    from tokenizers import Tokenizer

    other = wordids.WordIds(BYTE_BPE)
    assert other._quick is None
    texts = ["Two  words\n", "", "<|endoftext|> é"]
    ids, offsets = other(pa.array(texts), 5)
    whole = Tokenizer.from_file(BYTE_BPE)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*whole.encode(t, add_special_tokens=False).ids, 5] for t in texts]


def test_slices_are_bounded_by_bytes():
    texts = ["a" * 10, None, "b" * 50, "c", "d" * 3]
    assert [(at, s.to_pylist()) for at, s in wordids.slices(pa.array(texts), 12)] == [(0, ["a" * 10, ""]), (2, ["b" * 50]), (3, ["c", "d" * 3])]
    assert list(wordids.slices(pa.array([], pa.string()))) == []


# Language model


def test_base_score_and_a_proper_model(spark):
    rows = odd_rows() + near_copies(8, groups=4, size=8)
    got = context_mixing.score(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = [(i, [*(t or "").encode().lower().split(), b""]) for i, t, *_ in rows]
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in texts}
    c = Counter(w for i, ws in texts if not held[i] for w in ws)
    n = sum(c.values())
    key = lambda i, k: (i is None, i or 0, k)
    expected = sorted((key(i, len(ws)), held[i], sum(w in c for w in ws), sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws)) for i, ws in texts)
    seen = sorted(got, key=lambda r: key(r.doc_id, r.n_tokens))
    for r, (k, h, known, base) in zip(seen, expected):
        assert (key(r.doc_id, r.n_tokens), r.held_out, r.n_known, r.train_tokens) == (k, h, known, n)
        assert r.base_score == pytest.approx(base) and r.score < 0 and r.bits_per_byte > 0
    assert context_mixing.score(documents(spark, [])).count() == 0


def test_words_and_kinds_of_many_texts_at_once():
    texts = [b"", None, b"  The\x0bcat \t", "Ünï Ü a b".encode(), b"the the\n", "x 漢字 y".encode(), b"\xff bad \x80\xc3", "é".encode(), b"z"]
    for chosen in (texts, texts[:3], [b"a"], [None], [" ж".encode()]):
        words, codes, kinds, starts = context_mixing.coded(context_mixing.as_text(pa.array(chosen, pa.binary())))
        got = list(zip((words[c].as_py() for c in codes.tolist()), kinds.tolist()))
        for text, a, b in zip(chosen, starts, starts[1:]):
            want, kind = [], 0
            for word in [*(text or b"").lower().split(), b""]:
                want.append((word, kind))
                kind = next((c % 16 + 1 for c in reversed(word) if c > 127), kind)
            assert got[a:b] == want, text
        assert len(set(words.to_pylist())) == len(words) and starts[-1] == len(codes)


def test_scores_do_not_depend_on_how_texts_are_cut(spark, monkeypatch):
    """Words counted in many small runs, or few of them listed, give the same scores."""
    docs = documents(spark, odd_rows() + near_copies(8, groups=4, size=8)).repartition(3, "doc_id")
    want = sorted(context_mixing.score(docs).collect(), key=str)
    for name, value in (("_SLICE", 300), ("_HELD", 30), ("FREQUENT", 20)):
        monkeypatch.setattr(context_mixing, name, value)
    got = sorted(context_mixing.score(docs).collect(), key=str)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_equal_beginnings_are_predicted_once():
    words, kinds = [b"abc", b"abc", b"abd", b"ab", b"abda", b"", b"xyz", b"abd", b"xy z"], np.array([0, 1, 0, 0, 0, 2, 0, 0, 0], np.int8)
    n = np.arange(1, len(words) + 1)
    spell = context_mixing.Spelled.of_words(words, kinds)
    flat, starts, keys = context_mixing.spelled(words, kinds)
    assert spell.byte[spell.of].tolist() == flat.tolist() and all((a[spell.of] == b).all() for a, b in zip(spell.keys, keys))
    assert len(spell.byte) < len(flat) and spell.total(n).sum() == 8 * sum(k * (len(w) + 1) for k, w in zip(n.tolist(), words))
    got, want = np.zeros((2, len(context_mixing.ORDERS), 2 << context_mixing.BITS))
    context_mixing.count(got, words, kinds, n)
    node, bit = context_mixing.decisions(flat)
    for k, key in enumerate(keys):
        np.add.at(want[k], context_mixing.slots(key, node) * 2 + bit, np.broadcast_to(np.repeat(n, np.diff(np.append(starts, len(flat)))), bit.shape))
    assert (got == want).all()
    model = context_mixing.learn_mixing(got.astype(np.float32).reshape(len(context_mixing.ORDERS), -1, 2), words, kinds, n)
    alone = [model.log10([w], kinds[i : i + 1])[0] for i, w in enumerate(words)]
    assert model.log10(words, kinds) == pytest.approx(np.array(alone))


def test_nine_contexts_predict():
    """How many bytes back each predictor looks, and which of them know the kind; each has a weight of its own."""
    word, at = bytes(range(97, 111)), 13
    keys = lambda w, kind: [int(k[at]) for k in context_mixing.spelled([w], np.array([kind]))[2]]
    own, other = keys(word, 0), keys(word, 3)
    changed = {back: keys(word[: at - back] + b"!" + word[at - back + 1 :], 0) for back in range(1, 14)}
    reach = [{back for back, x in changed.items() if x[k] != own[k]} for k in range(len(own))]
    assert reach == [set(range(1, n + 1)) for n in (1, 2, 3, 4, 6, 12, 3, 5, 12)]
    assert [x != y for x, y in zip(own, other)] == [True] * 6 + [False] * 3
    assert len(set(own)) == 9

    words, kinds, n = [b"abcd", b"abce", b"xbcd"], np.zeros(3, np.int8), np.array([5, 3, 2])
    counts = np.zeros((9, 2 << context_mixing.BITS))
    context_mixing.count(counts, words, kinds, n)
    assert (counts.sum(axis=1) == n.sum() * 5 * 8).all()
    model = context_mixing.learn_mixing(counts.astype(np.float32).reshape(9, -1, 2), words, kinds, n)
    used = np.abs(model.weights - context_mixing.START).max(axis=0)
    assert used.shape == (10,) and (used > 0).all()
    assert context_mixing.untrained(model.counts).weights[:, :9].sum(axis=1) == pytest.approx(1.2)
    zeros, ones = model.counts[..., 0], model.counts[..., 1]
    for k, seen in zip(context_mixing.SEEN, range(2)):
        assert (model.without[1][seen].reshape(-1, 2)[:, 1] == context_mixing.amount(zeros[k] + np.maximum(ones[k] - 1, 0))).all()
    assert (model.without[0].reshape(9, -1, 2)[..., 0] == context_mixing.logit(np.maximum(zeros - 1, 0), ones)).all()


def test_bits_of_all_words_sum_to_one():
    """Over one byte: the probabilities of all 256 continuations add up."""
    counts = np.zeros((len(context_mixing.ORDERS), 1 << context_mixing.BITS, 2), np.float32)
    words = [b"abc", b"abd", b"xyz"] * 30
    for part, in context_mixing.chunks(words):
        flat, starts, keys = context_mixing.spelled(part, np.zeros(len(part), np.int64))
        node, bit = context_mixing.decisions(flat)
        for k, key in enumerate(keys):
            np.add.at(counts[k], (context_mixing.slots(key, node), bit), 1)
    model = context_mixing.learn_mixing(counts, words[:30], np.zeros(30, np.int64))
    total = 0.0
    for byte in range(256):
        flat, starts, keys = context_mixing.spelled([b"ab" + bytes([byte])], np.zeros(1, np.int64))
        node, bit = context_mixing.decisions(flat)
        logits, gate = model.inputs(keys, node)
        x = model.mixed(logits, gate)
        one = (context_mixing.squash(x) + model.refine(x, gate)[0]) / 2
        total += np.where(bit == 1, one, 1 - one)[:, 2].prod()
    assert total == pytest.approx(1, abs=1e-6)
    seen, other = model.log10([b"abc", b"qqq"], np.zeros(2, np.int64))
    assert seen > other + 2


def test_weights_and_map_learn_from_every_word(spark):
    """More words than any sample held, over several tasks: the same model as from all of them in one place."""
    words, n = [f"w{i:05d}".encode() for i in range(25_000)], np.arange(25_000) % 3 + 1
    counts = np.zeros((len(context_mixing.ORDERS), 1 << context_mixing.BITS, 2), np.float32)
    vocabulary = spark.range(25_000).selectExpr("cast(format_string('w%05d', id) as binary) word", "cast(0 as byte) kind", "id % 3 + 1 n").repartition(3)
    got = context_mixing.learn_from(counts, vocabulary)
    want = context_mixing.learn_mixing(counts, words, np.zeros(len(words), np.int64), n)
    assert np.allclose(got.weights, want.weights, atol=1e-4) and np.allclose(got.refined, want.refined, atol=1e-4)
    cells = context_mixing.gathered(got, words, np.zeros(len(words), np.int64), n, True)[:, : context_mixing._STEPS]
    assert cells.sum() == n.sum() * 7 * 8


def test_held_out_words_cost_less_than_guessing(spark):
    got = context_mixing.score(spark.read.parquet(f"{SMALL}/documents.parquet")).filter("held_out")
    bits = got.agg(F.sum(F.col("score")) / F.sum(F.col("score") / F.col("bits_per_byte"))).first()[0]
    assert bits < 3


# Languages


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langmask.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_odd_texts_have_a_language_or_none(spark):
    rows = odd_rows() + [(30, "123 ... !", "en", "s"), (31, "le chat et la souris", None, "s")] + [(100 + i, "der hund und die katze", "de", "s") for i in range(8)]
    got = langmask.predict(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (1, 2, 3, 30, 10)} == {"und"} and by[30].score == 0
    assert by[100].lang_pred == "de" and by[5].lang_pred == "en"
    assert by[31].lang_pred in ("de", "en")
    assert langmask.predict(documents(spark, [])).count() == 0
    nothing = langmask.predict(documents(spark, [(1, "abc", None, "s")])).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_filter_has_no_false_negatives():
    grams = np.unique(langmask.trigrams(["the quick brown fox", "über"])[0])
    masks = np.zeros(langmask.SLOTS, np.int64)
    for at in langmask.slots(grams):
        masks[at] |= 2
    first, *others = langmask.slots(grams)
    found = masks[first]
    for at in others:
        found &= masks[at]
    assert (found == 2).all()


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_strings", "source_mixture", "packed_sequences"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.snapshot(stage(spark, docs, SMALL), name)
        assert after.columns == docs.columns
        if name != "source_mixture":
            assert 0 < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_pipeline_bears_odd_documents(spark):
    plain = [(50 + i, " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest()[:6] for k in range(60))) for i in range(5)]
    docs = documents(spark, odd_rows() + plain)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.snapshot(stage(spark, docs, SMALL), name)
    assert docs.count() > 0
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_pipeline_decides_about_rows(spark):
    """Null and repeated ids spread no verdict to other texts, and of copies one row stays, whatever the ids."""
    clean = [" ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest()[:6] for k in range(60)) for i in range(6)]
    given_rows = [(None, clean[0]), (None, "# # #"), (1, clean[1]), (1, "# # #"), (2, clean[2]), (None, clean[2]), (None, clean[3]), (None, clean[3]), (3, clean[4]), (3, clean[4]), (3, clean[5])]
    docs = documents(spark, given_rows)
    rated = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, docs, SMALL).collect())
    assert rated == Counter(r for r in given_rows if r[1] != "# # #")
    unlike = documents(spark, [r for r in given_rows if r[1] != "# # #"])
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, unlike, SMALL).collect())
    assert left == Counter([(None, clean[0]), (1, clean[1]), (2, clean[2]), (None, clean[3]), (3, clean[4]), (3, clean[5])])
