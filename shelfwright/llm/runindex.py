"""Exact removal of repeated byte strings by run-length compressed Burrows-Wheeler indexes.

A string of ``LENGTH`` bytes that also starts earlier in the corpus is removed. Three steps:

1. Windows of LENGTH bytes are dealt by content. The least of a window's short substrings (its anchor) lies at the same
   place in every copy of the window, and the bytes around it, left or right, are the window's core. Runs of neighbouring
   windows with one core make a segment. Only cores that more than one text holds, or one text twice, can matter.
2. The segments of a core go to one shard. Equal ones are one from here on (the first of them counts, the others are repeats
   through and through; each task has merged its own before). For the different ones the shard builds the run-length compressed BWT of their text, with samples of
   the suffix array at run ends; nothing else of the suffix array is kept. Every segment is streamed through it backwards, all in
   step, with its row and its matching statistic: how many bytes it shares with the row above, which grows by one within a run
   and is the match of two samples at a run's head. Rows that match LENGTH bytes are a class with the row above. A
   class's first occurrence stays, the others are marked.
3. Marks are merged by document and cut out.

A core with very many segments is not left to one task: its windows are dealt again by longer cores, until the
groups are small or the core is the window itself, of which there is one segment only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.common import forget_shuffles, snapshot

#: Bytes of a repeated string, of an anchor, and of a core.
LENGTH, ANCHOR, CORE = 100, 16, 58
_SLACK = LENGTH - CORE
#: Bytes of text looked at in one go.
BLOCK = 1 << 16
#: The most bits of the sketch that spares rows a shuffle, and bits per hash in it while it is smaller. A full sketch spares
#: none, and what follows is exact.
SKETCH_BITS, BITS_EACH = 1 << 28, 16
#: Bits of a sketch that reach the driver in one row.
SKETCH_PIECE = 1 << 17
#: Segments of a core that one task takes; segments of a shard.
GROUP_LIMIT, SHARD_SEGMENTS = 8_000, 20_000

_RANDOM = np.random.default_rng(5).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _MIX) ^ (b + (b >> np.uint64(29)))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core hash, core start, first window, last window) of every segment of a block; ends: where its texts end.

    Windows do not cross texts. A segment's windows all hold its core, and what they are depends on their own bytes only."""
    empty = (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    n = len(data)
    if n < LENGTH:
        return empty
    h1 = _RANDOM[data]
    h2 = _join(h1[:-1], h1[1:])
    h4 = _join(h2[:-2], h2[2:])
    h8 = _join(h4[:-4], h4[4:])
    h16 = _join(h8[:-8], h8[8:])
    # The place in the low bits makes the leftmost of equal anchors the least.
    least = (_finish(h16) & ~_PLACE) | np.arange(len(h16), dtype=np.uint64)
    width, reach = LENGTH - ANCHOR + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least & _PLACE).astype(np.int64)
    start = np.arange(len(anchor))
    inside = np.searchsorted(ends, start, side="right") == np.searchsorted(ends, start + LENGTH - 1, side="right")
    left = start <= anchor - _SLACK
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    core = np.where(left[first], anchor[first] - _SLACK, anchor[first])
    hashes = _finish(_join(_join(h16[core], h16[core + 16]), _join(h16[core + 32], h16[core + CORE - 16])))
    return hashes, core, first, last


def _scan(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, core hash, core start, first, last window in the text), block by block. Long texts are cut into
    blocks that share LENGTH - 1 bytes, so every window is in exactly one."""
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple:
        ends = np.cumsum([len(p) for _, _, p in group])
        starts = ends - np.array([len(p) for _, _, p in group])
        hashes, core, first, last = segments(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), ends)
        at = np.searchsorted(ends, first, side="right")
        shift = np.array([o for _, o, _ in group])[at] - starts[at]
        return np.array([k for k, _, _ in group])[at], hashes, core + shift, first + shift, last + shift

    for number, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            part = text[offset : offset + BLOCK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            group.append((number, offset, part))
            size += len(part)
            if size >= BLOCK:
                yield flush()
                group, size = [], 0
    if group:
        yield flush()


def repeated_cores(docs: DataFrame) -> DataFrame:
    """h: core hashes that two different texts hold, or one text twice. Equal texts count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            marks = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
            for number, hashes, _, first, _ in _scan(texts):
                # A core that a text holds again, in the same block or in another, goes under another mark.
                order = np.lexsort((hashes, number))
                again = np.zeros(len(order), bool)
                again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (number[order[1:]] == number[order[:-1]])
                own = _join(marks[number], (first // BLOCK).astype(np.uint64)) + again.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(own.view(np.int64))], ["h", "mark"])

    found = docs.select(F.col("text").cast("binary")).filter(F.octet_length("text") >= LENGTH).mapInArrow(run, "h long, mark long")
    return found.groupBy("h").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("a <> b").select("h")


def _sketch(cores: DataFrame) -> np.ndarray:
    """A bit per hash, in words; as many as the hashes need, at most SKETCH_BITS. Tasks set the bits of pieces, and the driver takes
    these one partition at a time: all it holds is the sketch, in bytes, however many words of it are used."""
    bits = 1 << 16
    count = cores.count()
    while bits < min(BITS_EACH * count, SKETCH_BITS):
        bits *= 2
    piece_bits = min(bits, SKETCH_PIECE)
    width, shift = piece_bits // 64, piece_bits.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, int] = {}
        words = np.zeros(0, np.int64)
        for batch in batches:
            slot = batch.column(0).to_numpy()
            pieces, of = np.unique(slot >> shift, return_inverse=True)
            place = np.array([places.setdefault(k, len(places)) for k in pieces.tolist()], np.int64)
            words = np.append(words, np.zeros(len(places) * width - len(words), np.int64))
            np.bitwise_or.at(words, place[of] * width + (slot >> 6 & (width - 1)), np.int64(1) << (slot & 63))
        for k, own in zip(places, words.reshape(-1, width)):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([own.astype("<i8").tobytes()], pa.binary())], ["piece", "words"])

    slots = cores.select(F.col("h").bitwiseAND(F.lit(bits - 1).cast("long")).alias("slot"))
    found = slots.repartition(F.shiftright("slot", shift)).mapInArrow(run, "piece long, words binary")
    out = np.zeros((bits // piece_bits, width), np.int64)
    for piece, words in found.toLocalIterator():
        out[piece] = np.frombuffer(words, "<i8")
    return out.reshape(-1)


def _sketched(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a sketch."""
    at = hashes.view(np.int64) & (64 * len(words) - 1)
    return ((words[at >> 6] >> (at & 63)) & 1).astype(bool)


#: A document's place in the corpus: its id, and its text for ids that come twice.
DOC = ["doc_id", "digest"]
#: Rows without a core hash say that the bytes from start to ``end`` are repeats.
_SEGMENT = "doc_id long, digest binary, start long, end long, core long, h long, seg binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("core", pa.int64()), ("h", pa.int64()), ("seg", pa.binary())])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def candidates(docs: DataFrame, cores: DataFrame) -> DataFrame:
    """Segments whose core may be repeated: doc_id, digest, start and end in the text, core (its place in seg), h, seg.

    A task keeps the first of equal segments only. The others repeat it from end to end, which the rows without h say."""
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(cores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, kept = shared.value, {}
        for batch in batches:
            ids, digests, texts = (batch.column(i).to_pylist() for i in range(3))
            covered: dict[tuple, list[tuple[int, int]]] = {}
            for number, hashes, core, first, last in _scan(texts):
                hit = np.flatnonzero(_sketched(bits, hashes))
                for k, a, b, c, h in zip(number[hit].tolist(), first[hit].tolist(), last[hit].tolist(), core[hit].tolist(), hashes[hit].view(np.int64).tolist()):
                    seg, own = texts[k][a : b + LENGTH], (ids[k] is None, ids[k] or 0, digests[k], a)
                    before = kept.get(seg)
                    if before is None:
                        kept[seg] = (own, c - a, h)
                        continue
                    if own < before[0]:
                        kept[seg], own = (own, c - a, h), before[0]
                    elif own == before[0]:
                        continue
                    covered.setdefault(own[:3], []).append((own[3], own[3] + len(seg)))
            rows = [(None if d[0] else d[1], d[2], a, b, None, None, None) for d, spans in covered.items() for a, b in _merged(spans)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
        # Segments of one core lie together, where they compress well.
        left = sorted(kept.items(), key=lambda x: x[1][2])
        for at in range(0, len(left), 10_000):
            rows = [(None if d[0] else d[1], d[2], d[3], d[3] + len(seg), c, h, seg) for seg, (d, c, h) in left[at : at + 10_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return docs.select("doc_id", "digest", F.col("text").cast("binary")).filter(F.octet_length("text") >= LENGTH).mapInArrow(run, _SEGMENT)


def split_windows(many: DataFrame, core_length: int) -> tuple[DataFrame, int]:
    """Segments dealt anew by cores half the remaining slack longer, to the left or to the right."""
    slack = LENGTH - core_length
    half = slack // 2
    new_length = core_length + max(half, slack - half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, digest, start, core, h, seg in zip(*(c.to_pylist() for c in batch.columns)):
                windows = len(seg) - LENGTH + 1
                longer = new_length - core_length
                # Windows that start in [0, border) hold the longer core on the left, the others that on the right.
                border = min(max(core - longer + 1, 0), windows)
                for a, b, at in ((0, border, core - longer), (border, windows, core)):
                    if a < b:
                        own = seg[a : b + LENGTH - 1]
                        deeper = xxhash.xxh64_intdigest(own[at - a : at - a + new_length], h & 0xFFFF) - (1 << 63)
                        rows.append((doc_id, digest, start + a, start + a + len(own), at - a, deeper, own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return many.select("doc_id", "digest", "start", "core", "h", "seg").mapInArrow(run, _SEGMENT), new_length


class RunLengthIndex:
    """The run-length compressed BWT of a text, with suffix array samples at both ends of every run."""

    def __init__(self, text: np.ndarray, length: int):
        """text: bytes plus one, segments ended by 0 (at the end too). length: of the matches to tell apart."""
        n = len(text)
        packed, depth = np.zeros(n, np.int64), min(7, length)
        for k in range(depth):
            packed[: n - k] |= text[k:].astype(np.int64) << (9 * (depth - 1 - k))
        rank = self._ranked(packed)
        while True:
            if rank.max() == n - 1:
                break
            beyond = np.full(n, -1, np.int64)
            beyond[: max(n - depth, 0)] = rank[depth:]
            rank, depth = self._ranked(rank * (n + 1) + beyond + 1), 2 * depth
        rows = np.empty(n, np.int64)
        rows[rank] = np.arange(n)
        self.segments = int(np.count_nonzero(text == 0))
        #: Rows of the segment ends, in text order: where streaming starts.
        self.ends = np.sort(rows[: self.segments])
        self.end_rows = rank[self.ends]
        bwt = text[rows - 1]
        heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.heads, self.symbols = heads, bwt[heads]
        self.samples = np.stack([rows[heads], rows[np.append(heads[1:], n) - 1]])
        lengths = np.diff(np.append(heads, n))
        order = np.argsort(self.symbols, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        # LF of a run's first row: rows of smaller symbols, and earlier runs of its own. Rows of one run stay together.
        self.targets = np.empty(len(heads), np.int64)
        self.targets[order] = before
        self.matches = self._matches(text, length, order)

    def _matches(self, text: np.ndarray, length: int, order: np.ndarray) -> np.ndarray:
        """How many symbols, at most ``length``, the suffix at each run's head shares with the one at the end of the run of its
        symbol before it: what the samples at run ends are compared for. -1 where there is no such run."""
        out = np.full(len(self.heads), -1, np.int64)
        follows = self.symbols[order[1:]] == self.symbols[order[:-1]]
        run, above = order[1:][follows], order[:-1][follows]
        a, b = self.samples[1][above], self.samples[0][run]
        out[run], live = length, np.arange(len(run))
        for k in range(length):
            # A suffix shares nothing beyond the text's end.
            same = (text[np.minimum(a[live] + k, len(text) - 1)] == text[np.minimum(b[live] + k, len(text) - 1)]) & (np.maximum(a[live], b[live]) + k < len(text))
            out[run[live[~same]]] = k
            live = live[same]
            if not len(live):
                break
        return out

    @staticmethod
    def _ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        return rank

    def step(self, rows: np.ndarray, matched: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes one symbol longer, and how many symbols (at most ``length``) each shares with the row above it.

        Within a run the row above is extended by the same symbol, so the match grows by it. At a run's head the row
        above is now the extension of another run's end, and the match is the one between the samples there."""
        run = np.searchsorted(self.heads, rows, side="right") - 1
        matched = np.where(rows == self.heads[run], self.matches[run], matched) + 1
        return self.targets[run] + rows - self.heads[run], np.minimum(matched, length)


def later_repeats(segs: list[bytes], place: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, first byte, end) of maximal runs of bytes under strings of ``length`` that another window of ``segs`` with a
    lesser place holds too. place: the place of a segment's first byte; the next ones follow on."""
    sizes = np.array([len(s) for s in segs])
    text = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8).astype(np.int64) + 1
    text[np.cumsum(sizes + 1) - 1] = 0
    index = RunLengthIndex(text, length)
    rows, matched, live = index.end_rows.copy(), np.zeros(len(segs), np.int64), np.arange(len(segs))
    found_seg, found_at, found_row, found_same = [], [], [], []
    for back in range(1, int(sizes.max()) + 1):
        live = live[sizes[live] >= back]
        rows[live], matched[live] = index.step(rows[live], matched[live], length)
        if back >= length:
            found_seg.append(live), found_at.append(sizes[live] - back), found_row.append(rows[live]), found_same.append(matched[live] >= length)
    seg, at, row, same = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_seg, found_at, found_row, found_same))
    if not len(seg):
        return []
    # Windows that share all their bytes are neighbours among the rows: a class begins where the row above does not match.
    order = np.argsort(row)
    seg, at, cls = seg[order], at[order], np.cumsum(~same[order].astype(bool))
    size = np.bincount(cls)
    seg, at, cls = (x[size[cls] > 1] for x in (seg, at, cls))
    if not len(seg):
        return []
    where = place[seg] + at
    order = np.lexsort((where, cls))
    first = np.concatenate(([True], cls[order[1:]] != cls[order[:-1]]))
    seg, at = seg[order[~first]], at[order[~first]]
    order = np.lexsort((at, seg))
    seg, at = seg[order], at[order]
    cut = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (at[1:] > at[:-1] + length)))) if len(seg) else np.empty(0, int)
    last = np.append(cut[1:], len(seg)) - 1
    return [(int(seg[a]), int(at[a]), int(at[b]) + length) for a, b in zip(cut, last)]


_MARK = "doc_id long, digest binary, start long, end long"


def marks(found: DataFrame) -> DataFrame:
    """doc_id, digest, start, end: bytes of ``candidates`` that are under a string that starts earlier."""
    found = snapshot(found, "candidates")
    out, core_length, level = found.filter("h IS NULL").select(*DOC, "start", "end"), CORE, found.filter("h IS NOT NULL")
    while True:
        # Counted by core first. The rows of a core with few go to its shard in one step.
        sizes = snapshot(level.groupBy("h").count().filter(F.col("count") > GROUP_LIMIT).select(F.col("h").alias("_h")), "hot")
        is_hot = F.col("h") == F.col("_h")
        out = out.unionByName(_indexed(level.join(sizes, is_hot, "left_anti")))
        if sizes.isEmpty():
            return out
        # Segments of the others are compared whole, in as many tasks as there are different ones, and dealt anew. A list
        # has at most an entry per task that found the segment.
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "start", "end")
        same = snapshot(
            level.join(sizes, is_hot, "left_semi").groupBy("h", "seg").agg(F.array_sort(F.collect_list(order)).alias("all"), F.first("core").alias("core")), "same"
        )
        out = out.unionByName(same.select(F.inline(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))))).select(*DOC, "start", "end"))
        if core_length == LENGTH:
            return out
        first = F.get("all", F.lit(0)).alias("f")
        level, core_length = split_windows(same.select(first, "core", "h", "seg").select("f.doc_id", "f.digest", "f.start", "core", "h", "seg"), core_length)
        level = snapshot(level, "split")


def _indexed(level: DataFrame) -> DataFrame:
    """Marks within the segments of each core: of repeats of a whole segment, and of what the index finds in different ones."""
    shards = max(1, level.count() // SHARD_SEGMENTS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*DOC, "start"], ignore_index=True, na_position="last")
        again = pdf.duplicated(["h", "seg"]).to_numpy()
        pdf["end"] = pdf["start"] + pdf["seg"].str.len()
        whole, pdf = pdf[again][[*DOC, "start", "end"]], pdf[~again]
        pdf = pdf[pdf.duplicated(["h"], keep=False)].reset_index(drop=True)
        found = []
        if len(pdf):
            ids, digests = pdf["doc_id"], pdf["digest"]
            new = (digests != digests.shift()) | ((ids != ids.shift()) & ~(ids.isna() & ids.shift().isna()))
            found = later_repeats(pdf["seg"].tolist(), (new.cumsum().to_numpy().astype(np.int64) << 40) + pdf["start"].to_numpy())
        seg, a, b = (list(x) for x in zip(*found)) if found else ([], [], [])
        own = pdf.iloc[seg][[*DOC, "start"]].reset_index(drop=True)
        own = own.assign(end=own["start"] + np.array(b, np.int64), start=own["start"] + np.array(a, np.int64))
        out = pd.concat([whole, own], ignore_index=True)
        return out.astype({"doc_id": "Int64", "start": "int64", "end": "int64"})

    keyed = level.select(*DOC, "start", "h", "seg", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    return keyed.groupBy("shard").applyInPandas(run, _MARK)


def dedupe(docs: DataFrame) -> DataFrame:
    """doc_id, digest (MD5 of the text), n_bytes, n_removed, n_spans, kept_sha256, kept (what is left as bytes where something
    was removed and something is left, else null): one row per row of ``docs``.

    A null text is empty. A document's order is its id (nulls last), then its digest; rows of equal id and text are one
    document and fare alike. The text itself is never shuffled but where it has repeats."""
    empty = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), empty.alias("text"), F.unhex(F.md5(empty.cast("binary"))).alias("digest"))
    listed = snapshot(own.select(*DOC, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), "listed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    firsts = snapshot(listed.groupBy("digest").agg(F.min(order).alias("first")).withColumnRenamed("digest", "_digest"), "firsts")
    known = snapshot(listed.join(firsts, F.col("digest") == F.col("_digest")).withColumn("copy", (order != F.col("first")) & (F.col("n_bytes") >= LENGTH)).drop("_digest", "first"), "known")

    found = candidates(own, snapshot(repeated_cores(docs), "cores"))
    forget_shuffles(docs.sparkSession)
    copies = known.filter("copy").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    is_doc = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    # Copies go whole; what was found in them is not needed.
    spans = snapshot(
        marks(found).join(snapshot(copies, "copies"), is_doc, "left_anti").groupBy(*DOC).agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "_id", "digest": "_digest"}), "spans"
    )

    forget_shuffles(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, digest, text, spans in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                kept, at, runs = [], 0, _merged([(s["start"], s["end"]) for s in spans])
                for start, end in runs:
                    kept.append(text[at:start])
                    at = end
                left = b"".join([*kept, text[at:]])
                out.append((doc_id, digest, len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = pa.schema([("_id", pa.int64()), ("_digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    # Texts without marks are left out before the join as far as a sketch can tell.
    marked = docs.sparkSession.sparkContext.broadcast(_sketch(spans.select(F.xxhash64("_id", "_digest").alias("h"))))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_sketched(marked.value, batch.column(3).to_numpy())))

    likely = own.select(*DOC, F.col("text").cast("binary"), F.xxhash64("doc_id", "digest").alias("at")).mapInArrow(sketched, "doc_id long, digest binary, text binary, at long")
    texts = likely.join(spans, is_doc).dropDuplicates(DOC)
    result = snapshot(
        texts.select(*DOC, "text", "spans").mapInArrow(cut, "_id long, _digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary"), "cut"
    )
    joined = known.join(result, is_doc, "left")
    return joined.select(
        *DOC,
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(~F.col("copy"), F.col("kept")).alias("kept"),
    )
