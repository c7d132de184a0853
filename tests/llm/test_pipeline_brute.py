"""Every stage of the corpus pipeline against a plain version of it, over rows with null and repeated ids, ties and near copies."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfwright.llm import mixing, oracle, runindex, sharding
from shelfwright.llm.common import count_words, load, snapshot
from tests.compare import connect
from tests.llm.helpers import documents, odd_rows
from tests.llm.test_models_and_packing import plain_best_fit
from tests.llm.test_rules_and_mixing import fill

SMALL = "/root/testdata/sf0.001"


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, words, share):
    """A copy with about this share of its five-word shingles kept: single words replaced, far from each other."""
    out, n = list(words), len(words) - 4
    changes = round((1 - share) / (1 + share) * n / 5)
    for at in rng.sample(range(5, len(words) - 5, 10), changes):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def similarity(a, b, width=5):
    x, y = ({tuple(t[i : i + width]) for i in range(len(t) - width + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def rows_with_copies(seed=1):
    rng, rows = random.Random(seed), [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 3000]
    for k in range(25):
        base = prose(rng, 220)
        rows += [(100 + 3 * k, " ".join(base)), (None if k % 5 == 0 else 101 + 3 * k, " ".join(edited(rng, base, 0.95)))]
        if k % 4 == 0:
            rows += [(50, " ".join(base)), (None, " ".join(base))]
    rows += [(7, "same words here"), (7, "other words there"), (None, "same words here")]
    rng.shuffle(rows)
    return rows


# Near duplicates


def simhash(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def kept_by_hand(rows):
    prints = [simhash(t, corpus_pipeline.WIDTH) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= corpus_pipeline.RADIUS:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[root(i)].append((doc_id is None, doc_id or 0, hashlib.md5((text or "").encode()).digest(), text or ""))
    return Counter((None if g[0] else g[1], g[3]) for g in map(min, groups.values()))


def test_near_duplicates_stage(spark):
    rows = rows_with_copies()
    got = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), SMALL).collect())
    assert got == kept_by_hand(rows)


@pytest.mark.parametrize("share, least", [(0.97, 0.9), (0.95, 0.9), (0.9, 0.5), (0.8, 0.05)])
def test_how_many_near_copies_are_found(share, least):
    """Pairs of 220 words with this share of shingles in common; the README states these figures."""
    rng, found, n = random.Random(2), 0, 150
    for _ in range(n):
        base = prose(rng, 220)
        copy = edited(rng, base, share)
        assert abs(similarity(base, copy) - share) < 0.02
        found += (simhash(" ".join(base), 5) ^ simhash(" ".join(copy), 5)).bit_count() <= corpus_pipeline.RADIUS
    print(f"near copies of similarity {share}: {found / n:.2f} found")
    assert found >= least * n
    unlike = sum((simhash(" ".join(prose(rng, 220)), 5) ^ simhash(" ".join(prose(rng, 220)), 5)).bit_count() <= corpus_pipeline.RADIUS for _ in range(n))
    assert unlike == 0


# Quality rules


def test_quality_stage_keeps_what_the_sql_keeps(spark):
    docs = load(spark, SMALL, "documents")
    kept = {r[0] for r in connect(SMALL).execute(f"SELECT doc_id FROM ({oracle.QUALITY}) WHERE kept").fetchall()}
    got = [r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SMALL).collect()]
    assert sorted(got) == sorted(kept) and 0 < len(kept) < docs.count()


# Repeated strings


def cut_by_hand(rows, length=100):
    """Rows of one id and text are one document, which comes where its first row does."""
    seen, out = set(), {}
    order = sorted({(d is None, d or 0, hashlib.md5((t or "").encode()).digest(), t or "") for d, t in rows})
    for none, doc_id, _, text in order:
        data, mark = text.encode(), set()
        for at in range(len(data) - length + 1):
            if data[at : at + length] in seen:
                mark.update(range(at, at + length))
            seen.add(data[at : at + length])
        left = bytes(c for i, c in enumerate(data) if i not in mark)
        out[None if none else doc_id, text] = text if not mark else left.decode("utf-8", "ignore").replace("�", "")
    return Counter((d, out[d, t or ""]) for d, t in rows if out[d, t or ""] or not t)


def test_repeated_strings_stage(spark):
    rng = random.Random(3)
    passage, rows = " ".join(prose(rng, 60)) + " é中", [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 3000]
    for k in range(30):
        own = prose(rng, 40)
        rows.append((None if k % 7 == 0 else 60 + k // 2, " ".join(own) + (f" {passage} " if k % 3 == 0 else " ") + " ".join(prose(rng, 20))))
    rows += [(500, passage), (501, f"{passage} {passage}")]
    got = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.repeated_strings(spark, documents(spark, rows), SMALL).collect())
    assert got == cut_by_hand(rows)


def test_repeated_strings_take_no_rows_to_the_driver_but_sketches(spark, monkeypatch):
    """The driver takes few pieces of sketches as bytes, not a row for each word of them that is used."""
    rng, taken = random.Random(5), []
    passages = [" ".join(prose(rng, 60)) for _ in range(300)]
    rows = [(k, f"{passages[k % 300]} {' '.join(prose(rng, 5))}") for k in range(600)]
    frame = type(spark.range(0))
    whole = frame.toLocalIterator
    with monkeypatch.context() as m:
        m.setattr(frame, "toPandas", lambda *_: 1 / 0)
        m.setattr(frame, "toLocalIterator", lambda own: (taken.append(len(row.words)) or row for row in whole(own)))
        got = corpus_pipeline.repeated_strings(spark, documents(spark, rows), SMALL)
    assert 0 < len(taken) < 20 and max(taken) <= runindex.SKETCH_PIECE // 8
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == cut_by_hand(rows)


# Mixing


def words_by_source(rows):
    out = defaultdict(int)
    for source, text in rows:
        out[source] += len((text or "").split())
    return out


def test_mixture_takes_its_targets_exactly(spark):
    rng = random.Random(4)
    rows = [(None if k % 3 == 0 else k // 2, " ".join(prose(rng, rng.randrange(0, 30))), "en", f"s{k % 4}") for k in range(400)]
    rows += [(None, "three words here", "en", "hot")] * 700 + [(None, f"three words {k}", "en", "hot") for k in range(300)] + [(5, "a b c", None, None)] * 9
    rows += [(6, None, "en", "s1"), (6, "", "en", "s1")]
    docs = documents(spark, rows)
    got = corpus_pipeline.source_mixture(spark, docs, SMALL)
    assert got.columns == docs.columns
    got = got.collect()
    sizes = words_by_source((r[3], r[1]) for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = words_by_source((r.source, r.text) for r in got)
    assert {s: taken.get(s, 0) for s in order} == {s: round(target[s]) for s in order}
    # Whole rows come as often as the source's repetitions or once more; at most one row a source is cut.
    have, want = Counter((r.source, r.doc_id, r.text) for r in got), Counter((r[3], r[0], r[1]) for r in rows if (r[1] or "").split())
    cut = [k for k in have if k not in want]
    assert len(cut) <= len(order) and all(have[k] == 1 for k in cut) and len({k[0] for k in cut}) == len(cut)
    for key, n in want.items():
        whole = int(target[key[0]] // sizes[key[0]])
        assert n * whole <= have.get(key, 0) <= n * (whole + 1)
    assert all(r.n_chars == len(r.text) for r in got)


def test_hot_rows_without_ids_meet_their_target(spark):
    docs = documents(spark, [(None, "one two three", "en", "a")] * 1500 + [(None, f"one two {k}", "en", "a") for k in range(500)])
    mixed = mixing.mix(docs, count_words(F.col("text")), share=1.3, digest=mixing.row_digest(docs))
    out = mixing.repeat_rows(docs, mixed).collect()
    assert mixed.agg(F.sum("taken")).first()[0] == sum(len(r.text.split()) for r in out) == 7800


# Packing


def test_packed_stage(spark):
    rows = rows_with_copies(5) + [(900, " ".join(prose(random.Random(1), 1500)))]
    whole = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = corpus_pipeline.packed_sequences(spark, documents(spark, rows), SMALL).collect()
    lengths = Counter()
    for _, text in rows:
        n = len(whole.encode(text or "", add_special_tokens=False).ids) + 1
        lengths.update([2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))
    assert Counter(r.length for r in got) == lengths
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert len(ends) == plain_best_fit(list(lengths.elements()), 2048)[0]


# Shards


def test_rows_of_a_heavy_key_are_split(spark):
    rows = [(None, "n" * 500)] * 10 + [(1, "a" * 400)] * 7 + [(2, "b" * 300)] * 3 + [(3, "c" * 4000)] + [(k, "d" * 90) for k in range(10, 60)]
    got = sharding.shard(documents(spark, rows), "doc_id", F.octet_length("text"), 1000).collect()
    assert Counter((r.doc_id, r.bytes) for r in got) == Counter((d, len(t)) for d, t in rows)
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.bytes
    for r in got:
        assert sums[r.shard] == r.shard_bytes and (r.shard_bytes <= 1000 or (r.doc_id == 3 and r.shard.endswith("!")))
    # A key that fits stays together.
    assert len({r.shard for r in got if r.doc_id == 2}) == 1
