"""Periodic runs of words: stretches that repeat with a smallest period, found by frequency splitting and lag scans.

A run of period q is at least ``times`` periods and ``least`` words long and cannot be extended. Each of its words occurs
at least ``times`` times in it, so a word that is rarer within a segment is in no run there and splits the segment. Segments are
split anew until none of their words is rare; only those left, few and short in ordinary text, are scanned lag by lag.

Documents are independent of each other: no shuffle, and a task holds a slice of a batch, or one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.wordids import slices

LEAST, TIMES = 24, 3
#: Splitting a text that loses one word a round stops here; what is left is scanned as it is, with the same result.
ROUNDS = 64
#: Bytes of text that are split together.
SLICE = 8 << 20

RUN = "struct<start: long, length: long, period: long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def split_rare(codes: np.ndarray, firsts: np.ndarray, least: int = LEAST, times: int = TIMES, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """The stretches [start, stop) of ``codes`` that runs can lie in. ``firsts`` are where texts begin, and the end."""
    starts, stops = firsts[:-1], firsts[1:]
    kinds, stable = (int(codes.max()) + 1 if len(codes) else 1), []
    for _ in range(rounds):
        long = stops - starts >= least
        starts, stops = starts[long], stops[long]
        if not len(starts):
            break
        sizes = stops - starts
        inner = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) + np.repeat(starts - inner, sizes)
        owner = np.repeat(np.arange(len(starts)), sizes)
        _, index, n = np.unique(owner * kinds + codes[places], return_inverse=True, return_counts=True)
        rare = n[index] < times
        splits = np.add.reduceat(rare, inner) > 0
        stable += zip(starts[~splits].tolist(), stops[~splits].tolist())
        # What is left of the others: from behind a rare word, or the start, to the next one, or the end.
        stays = ~rare & splits[owner]
        begins = stays & np.concatenate([[True], ~stays[:-1] | (owner[1:] != owner[:-1])])
        ends = stays & np.concatenate([~stays[1:] | (owner[1:] != owner[:-1]), [True]])
        starts, stops = places[begins], places[ends] + 1
    else:
        stable += [(a, b) for a, b in zip(starts.tolist(), stops.tolist()) if b - a >= least]
    return sorted(stable)


def _same_until(codes: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on that differs from the one ``lag`` further, or has none there."""
    step = 64
    while at + lag < len(codes):
        n = min(step, len(codes) - lag - at)
        other = np.flatnonzero(codes[at : at + n] != codes[at + lag : at + lag + n])
        if len(other):
            return at + int(other[0])
        at, step = at + n, 2 * step
    return at


def _same_from(codes: np.ndarray, at: int, lag: int) -> int:
    """The least start of places up to ``at`` that all equal the ones ``lag`` further."""
    step = 64
    while at:
        n = min(step, at)
        other = np.flatnonzero(codes[at - n : at] != codes[at - n + lag : at + lag])
        if len(other):
            return at - n + int(other[-1]) + 1
        at, step = at - n, 2 * step
    return at


def lag_scan(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, for ``times`` of at least 3.

    A run of period q holds two neighbouring blocks of q words that start at multiples of q, so at lag q only those are
    compared, by their hashes, and equal ones extended word by word: about n log n comparisons for all lags. Blocks inside
    a run of a smaller period have that period, so they are passed over; what remains has q as its smallest period."""
    n, runs = len(codes), []
    covered = np.zeros(n + 1, np.int64)  # how far a known run reaches that holds this place
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULTIPLIER)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[:n], dtype=np.uint64)])
        for lag in range(1, n // times + 1):
            blocks = np.diff(sums[::lag])
            places = np.flatnonzero(blocks[1:] == blocks[:-1] * powers[lag]) * lag
            places = places[covered[places] < places + 2 * lag]
            for at in places.tolist():
                if covered[at] >= at + 2 * lag:
                    continue
                stop = _same_until(codes, at, lag)
                if stop - at < lag:  # equal hashes of other words
                    continue
                start, stop = _same_from(codes, at, lag), stop + lag
                if stop - start >= max(least, times * lag):
                    runs.append((start, stop - start, lag))
                    covered[start:stop] = np.maximum(covered[start:stop], stop)
            if covered[0] >= n:
                break
    return runs


def runs_of(codes: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of all texts, by start and period; starts are places in ``codes``."""
    return sorted((a + s, n, q) for a, b in split_rare(codes, firsts) for s, n, q in lag_scan(codes[a:b]))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and where each text's begin."""
    parts = pc.ascii_split_whitespace(texts)
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    is_word = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(is_word)])
    return flat.filter(pa.array(is_word)), before[bounds - bounds[0]]


def find(docs: DataFrame, rewrite: Callable[[str, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed: the words joined by one space, those left out that any run
    holds after its first period.

    ``rewrite``, given a document's id in decimal (null: empty) and its number of words, may tell from which word on to
    repeat how many words; the text is then taken as rewritten so. Null, empty and blank texts have no words, no runs
    and an empty collapsed text. Every row is its own document, whatever its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                doc_ids = batch.column(0).slice(first, len(texts))
                words, firsts = words_of(texts)
                source = np.arange(len(words))
                for doc_id, a, b in zip(doc_ids.to_pylist(), firsts.tolist(), firsts[1:].tolist()) if rewrite else ():
                    if b > a and (repeat := rewrite("" if doc_id is None else str(doc_id), b - a)):
                        start, period = repeat
                        source[a + start : b] = a + start + np.arange(b - a - start) % period
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[source]
                runs, kept = runs_of(codes, firsts), np.ones(len(words), bool)
                for start, length, period in runs:
                    kept[start + period : start + length] = False
                before = np.concatenate([[0], np.cumsum(kept)])[firsts]
                left = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.take(pa.array(source[kept])))
                starts = np.array([r[0] for r in runs], np.int64)
                owner = np.searchsorted(firsts, starts, "right") - 1
                fields = [starts - firsts[owner], *(np.array([r[k] for r in runs], np.int64) for k in (1, 2))]
                nested = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["start", "length", "period"])
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(np.diff(firsts)), pa.ListArray.from_arrays(pa.array(cuts), nested), pc.binary_join(left, " ")],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)
