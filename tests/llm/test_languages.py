"""Language filters against a plain version: sets of slots per language, one text at a time."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from shelfwright.llm import langmask
from tests.llm.helpers import documents, odd_rows

MASK = (1 << 64) - 1


def plain_grams(text):
    out, word = [], []
    for c in [*(text or ""), " "]:
        if c.isalpha():
            word.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif word:
            padded = [0, *word, 0]
            # A single letter stands between two blanks, and is no trigram.
            out += [tuple(padded[i : i + 3]) for i in range(len(padded) - 2) if padded[i] or padded[i + 2]]
            word = []
    return out


def plain_slots(gram):
    x = ((gram[0] << 42) | (gram[1] << 21) | gram[2]) * 0x9E3779B97F4A7C15 & MASK
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & MASK
    return [(x >> (64 - 20 * (k + 1))) & (langmask.SLOTS - 1) for k in range(langmask.PROBES)]


def plain_predictions(rows):
    """rows: (doc_id, text, lang) to (doc_id, lang_pred, score)."""
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 != 2 and lang is not None and text is not None:
            counts[lang].update(plain_grams(text))
    counts = {k: v for k, v in counts.items() if v}
    share = {k: {g: n / sum(v.values()) for g, n in v.items()} for k, v in counts.items()}
    top = defaultdict(float)
    for own in share.values():
        for g, x in own.items():
            top[g] = max(top[g], x)
    filters = {}
    for k, own in share.items():
        filters[k] = {s for g, x in own.items() if x >= langmask.PRESENCE * top[g] and x * langmask.RARE >= 1 for s in plain_slots(g)}
    chance = {k: (len(f) / langmask.SLOTS) ** langmask.PROBES for k, f in filters.items()}
    out = []
    for doc_id, text, _ in rows:
        grams = plain_grams(text)
        hits = {}
        for k, f in filters.items():
            n = sum(all(s in f for s in plain_slots(g)) for g in grams)
            hits[k] = max(n - len(grams) * chance[k], 0) / max(1 - chance[k], 1e-9)
        if not filters or not any(c.isalpha() for c in text or ""):
            out.append((doc_id, "und", 0.0))
            continue
        best = max(sorted(hits), key=lambda k: hits[k])
        total = sum(hits.values())
        out.append((doc_id, best, round(hits[best] / total, 9) if total else 0.0))
    return sorted(out, key=repr)


def invented(seed, languages):
    rng, rows = random.Random(seed), []
    for k in range(languages):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéñ") for _ in range(rng.randrange(2, 4))) for _ in range(9)]
        for i in range(6):
            words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
            rows.append((1000 * k + i, " ".join(words) + ("." if i else " ÄÖ a 1 b."), f"l{k:03}"))
    return rows


def found(spark, rows):
    got = langmask.predict(documents(spark, [(d, t, lang, "s") for d, t, lang in rows])).collect()
    return sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got), key=repr)


def test_predictions_equal_the_plain_version(spark):
    rows = [(r[0], r[1], "en" if k % 2 else None) for k, r in enumerate(odd_rows()) if len(r[1] or "") < 10_000] + invented(1, 5)
    assert found(spark, rows) == plain_predictions(rows)


def test_any_number_of_languages(spark):
    rows = invented(2, 140)
    got = found(spark, rows)
    assert got == plain_predictions(rows)
    assert len({r[1] for r in got}) > 130
