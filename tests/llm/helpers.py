"""Small tables with the odd cases every operator must bear, and plain Python versions of what operators compute."""

from __future__ import annotations

import hashlib
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source). Columns that operators might use for themselves come along."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s0")), len(r[1]) if r[1] is not None else None) for r in rows]
    frame = spark.createDataFrame(full, DOCS)
    clashing = ("_id", "_words", "_h", "h", "fp", "size", "row", "seg", "digest", "kept", "start", "n", "_cut", "spans")
    return frame.selectExpr("*", *[f"'x' AS `{c}`" for c in clashing])


def odd_rows():
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "The cat sat on the mat."), (5, "The cat sat on the mat."), (6, long_text),
        (7, long_text), (None, "a text without an id"), (8, "ÄÖ é\x00 ñ 中文 😀 <|endoftext|>"), (9, "x" * 5000), (10, None, None, None),
    ]


def near_copies(seed: int, groups: int = 6, size: int = 5, words: int = 60):
    """Texts in groups that differ in a word or two, with some exact copies."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"t{rng.randrange(5000)}" for _ in range(words)]
        for k in range(size):
            own = list(base)
            for _ in range(k % 3):
                own[rng.randrange(words)] = f"u{rng.randrange(50)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return [(i + 20, t) for i, t in enumerate(out)]


def removed_repeats(rows, length: int = 100):
    """(doc_id, text) to {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} by looking at every window."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                mark[at : at + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, m in zip(data, mark) if not m)
        runs = sum(1 for k, m in enumerate(mark) if m and (k == 0 or not mark[k - 1]))
        out[doc_id] = (len(data), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out
