"""Two tokenizers' ids of the same texts, aligned where tokens of both end at the same byte.

The cumulative ends of both id lists, and the ends both have, slice the lists into groups, and within a group every pair of
tokens whose byte ranges overlap is a link. How often an id pair is linked is counted over the whole corpus, in documents,
and every document's links are rated by these counts.

Both tokenizers part a text before a space that follows another character than white space. Texts are cut there into chunks;
the different chunks of a batch are encoded and sliced once, so what is done per occurrence are array operations. Texts are
read and encoded once: what is stored of a document's links are its different pairs and how often it has each, which
counting and rating read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfwright.llm.common import snapshot
from shelfwright.llm.wordids import _byte_alphabet, gather, slices

#: Bytes of text that are aligned together.
SLICE = 12 << 20
#: The most frequent pairs, at most so many, are sent to every worker (17 bytes each); the others are joined.
SENT = 1 << 21
#: Documents whose links are put together and handed on at once: few enough for them to be sorted in cache.
BATCH = 500

#: ``pairs``: the different id pairs a document has linked, and how often each (``times``).
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
_SHIFT = 32
_SEPARATORS = pa.array(["", ",", "|", ";"])
_PLAIN = "^ [!-~À-ÖØ-öø-ſ]+$"
_WORDS = r"\n|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"


def slice_shape(a_ends: list[int] | np.ndarray, b_ends: list[int] | np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the tokens that end at these bytes, ascending, the last of both alike: how many; the tokens in the order they
    are written, those of B numbered after those of A; the separator behind each (an index of ``_SEPARATORS``); and the links'
    places in A and in B."""
    a_ends, b_ends = np.asarray(a_ends, np.int64), np.asarray(b_ends, np.int64)
    size = int(a_ends[-1]) if len(a_ends) else 0
    last = np.zeros((2, size), bool)
    last[0, a_ends - 1], last[1, b_ends - 1] = True, True
    # Between neighbouring ends of either there is one token of A and one of B: a link.
    ends_a, ends_b = last[:, last[0] | last[1]]
    link_a, link_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    closes = ends_a & ends_b
    group = np.cumsum(closes) - closes
    in_a, in_b = group[ends_a], group[ends_b]
    until_a, until_b = link_a[closes] + 1, link_b[closes] + 1
    at_a = np.arange(len(a_ends)) + np.concatenate([[0], until_b])[in_a]
    at_b = np.arange(len(b_ends)) + until_a[in_b]
    order, behind = np.empty((2, len(a_ends) + len(b_ends)), np.int64)
    order[at_a], order[at_b] = np.arange(len(a_ends)), np.arange(len(a_ends), len(order))
    behind[at_a], behind[at_b] = 1 + closes[ends_a], 1 + 2 * closes[ends_b]
    behind[-1:] = 0
    return int(closes.sum()), order, behind, link_a, link_b


class Tokenizers:
    """Ids of chunks by both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self._a.encode_special_tokens = True
        with open(a_file, encoding="utf-8") as f:
            file = json.load(f)
        if (file.get("normalizer"), (file.get("pre_tokenizer") or {}).get("type")) != (None, "ByteLevel"):
            raise ValueError(f"{a_file} is not a byte-level tokenizer")
        alphabet, vocab = _byte_alphabet(), file["model"]["vocab"]
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, rank in vocab.items():
            a_bytes[rank] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{b_file} has pieces of several words")
        if "" in vocab or "" in pieces:
            raise ValueError("a token without bytes has no place between others")
        b_bytes = [bytes([int(p[1:-1], 16)]) if self._b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [pc.binary_length(x).to_numpy() for x in self.bytes]
        self.texts = pa.array([str(k) for k in range(max(len(a_bytes), len(b_bytes)))])
        # Words can be encoded by ranks where merges are in the order of ids and none of the file's options say otherwise.
        model, specials = file["model"], {t["content"] for t in file.get("added_tokens", [])}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        own = [t for t in sorted(vocab, key=vocab.get) if t not in specials]
        plain = own[256:] == merged and not file["pre_tokenizer"]["add_prefix_space"] and file["pre_tokenizer"].get("use_regex", True)
        plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        ranks = {a_bytes[vocab[t]]: vocab[t] for t in own}
        self._quick = tiktoken.Encoding("chunks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self._line_feed = ranks.get(b"\n")

    def a_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, chunk after chunk, and how many each chunk has."""
        starts, lengths = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False) & (self._quick is not None)
        flat = np.empty(0, np.int64)
        if plain.any():
            own = chunks.filter(pa.array(plain))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n")[0].as_py() + "\n"
            ids = self._quick.encode_to_numpy(joined, disallowed_special=()).astype(np.int64)
            ends = np.flatnonzero(ids == self._line_feed)
            starts[plain] = np.concatenate([[0], ends[:-1] + 1])
            lengths[plain] = ends - starts[plain]
            flat = ids
        if not plain.all():
            found = [e.ids for e in self._a.encode_batch_fast(chunks.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
            n = np.array([len(x) for x in found], np.int64)
            starts[~plain], lengths[~plain] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int64, n.sum())])
        return gather(flat, starts, lengths)[0], lengths

    def b_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # The model puts the space before the text itself.
        found = self._b.encode(pc.utf8_slice_codeunits(chunks, 1).to_pylist(), num_threads=1)
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, n.sum()), n

    def same_bytes(self, which: int, ids: np.ndarray, lengths: np.ndarray, chunks: pa.Array) -> np.ndarray:
        """Which chunks are what their tokens' bytes, joined, say."""
        tokens = self.bytes[which].take(pa.array(ids))
        firsts = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.frombuffer(tokens.buffers()[1], np.int32)[firsts]
        joined = pa.BinaryArray.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(bounds), tokens.buffers()[2]])
        return pc.equal(chunks.cast(pa.binary()), joined).to_numpy(zero_copy_only=False)


#: Of this worker process, for all the tasks it runs.
_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    if (a_file, b_file) not in _LOADED:
        _LOADED[a_file, b_file] = Tokenizers(a_file, b_file)
    return _LOADED[a_file, b_file]


def cut_chunks(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that each begin with a space: at a text, and before a space, not the text's last
    character, that follows another character than white space. White space beside ASCII is told by its last bytes."""
    is_space = data == 0x20
    blank = data <= 0x20
    far = np.zeros(len(data), bool)
    tail = np.flatnonzero(data >= 0x80)
    tail = tail[tail > 0]
    # U+0085, U+00A0, U+1680, U+2000 to U+206F and U+3000 end so; some other characters do, and are not cut behind.
    far[tail] = np.isin(data[tail], (*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)) & np.isin(data[tail - 1], (0x80, 0x81, 0x9A, 0xC2))
    begins = np.zeros(len(data), bool)
    begins[1:] = is_space[1:] & ~blank[:-1] & ~far[:-1]
    begins[firsts[1:] - 1] = False
    begins[firsts[:-1]] = True
    return np.flatnonzero(begins)


class Aligned:
    """The alignment of a slice of texts, none of them null or empty: numbers per different chunk, and the chunks of each text."""

    def __init__(self, pair: Tokenizers, texts: pa.Array):
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        firsts = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False), dtype=np.int64)])
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[: firsts[-1]]  # just made: it has no rows before
        begins = cut_chunks(data, firsts)
        offsets = np.append(begins, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        chunks = coded.dictionary
        self._texts = pair.texts
        found = pair.a_ids(chunks), pair.b_ids(chunks)
        whole = pair.same_bytes(0, *found[0], chunks) & pair.same_bytes(1, *found[1], chunks)
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.searchsorted(begins, firsts)
        #: Texts all of whose bytes both tokenizers keep.
        self.whole = np.logical_and.reduceat(whole[self.index], self.bounds[:-1])
        # Chunks that are not whole are given no tokens: texts that hold them have none.
        (self._a, self.n_a), (self._b, self.n_b) = ((ids[np.repeat(whole, n)], np.where(whole, n, 0)) for ids, n in found)
        a_ends, b_ends = (np.cumsum(pair.sizes[k][ids], dtype=np.int64) for k, ids in enumerate((self._a, self._b)))
        # Both end at the end of each chunk, so the chunks in a row are sliced as one.
        _, self._order, self._behind, *self._linked = slice_shape(a_ends, b_ends)
        self._cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        ends = self._cuts[1:][self.n_a > 0]
        self._behind[ends - 1] = 0
        self.n_groups = np.diff(np.concatenate([[0], np.cumsum(self._behind == 2)])[self._cuts])
        self.n_links = np.diff(np.searchsorted(self._linked[0], np.concatenate([[0], np.cumsum(self.n_a)])))

    def links(self) -> np.ndarray:
        """The id pairs of all links, chunk after chunk; ``n_links`` has how many each chunk has."""
        return (self._a[self._linked[0]] << _SHIFT) | self._b[self._linked[1]]

    def groups(self) -> pa.Array:
        """Every chunk's groups as text."""
        ids = np.concatenate([self._a, self._b])[self._order]
        written = pc.binary_join_element_wise(self._texts.take(pa.array(ids)), _SEPARATORS.take(pa.array(self._behind)), "")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self._cuts.astype(np.int32)), written), "")

    def totals(self, per_chunk: np.ndarray) -> np.ndarray:
        """Sums over the chunks of every text; 0 for texts without tokens."""
        before = np.concatenate([[0], np.cumsum(per_chunk[self.index])])
        return np.where(self.whole, np.diff(before[self.bounds]), 0)


def store_links(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Every document's alignment and its different id pairs; ``row`` numbers the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = tokenizers(a_file, b_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                for columns in _aligned(pair, texts):
                    n = len(columns["n_a"])
                    own = {"row": np.arange(row, row + n), "doc_id": batch.column(0).slice(first, n)} | columns
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in own.values()], list(own))
                    row, first = row + n, first + n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def _aligned(pair: Tokenizers, texts: pa.Array) -> Iterator[dict[str, np.ndarray | pa.Array]]:
    """What is stored of these texts, some texts at a time."""
    filled = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    columns = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    span = np.zeros((2, len(texts)), np.int64)
    index, written, codes, names = np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    starts = n_links = np.empty(0, np.int64)
    if len(filled):
        aligned = Aligned(pair, texts.take(pa.array(filled)))
        for name, values in columns.items():
            values[filled] = aligned.totals(getattr(aligned, name))
        # Rows without tokens take no chunks.
        span[0, filled[aligned.whole]] = aligned.bounds[:-1][aligned.whole]
        span[1, filled[aligned.whole]] = np.diff(aligned.bounds)[aligned.whole]
        index, written, n_links = aligned.index, aligned.groups(), aligned.n_links
        names, codes = np.unique(aligned.links(), return_inverse=True)
        starts = np.cumsum(n_links) - n_links
    for a in range(0, len(texts), BATCH):
        part = slice(a, min(a + BATCH, len(texts)))
        own, cuts = gather(index, *span[:, part])
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), written.take(pa.array(own))), ";")
        held, inner = gather(codes, starts[own], n_links[own])
        doc = np.repeat(np.arange(len(cuts) - 1), np.diff(inner[cuts]))
        once, times = np.unique(doc * max(len(names), 1) + held, return_counts=True)
        doc, held = np.divmod(once, max(len(names), 1))
        bounds = pa.array(np.searchsorted(doc, np.arange(len(cuts))).astype(np.int32))
        pairs, times = (pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (names[held], times.astype(np.int32)))
        yield {c: v[part] for c, v in columns.items()} | {"groups": groups, "pairs": pairs, "times": times}


def _frequent(pairs: DataFrame, sent: int) -> tuple[DataFrame, bool]:
    """The most frequent pairs, at most ``sent`` of them, and whether these are all. Counts are dealt into steps of a tenth;
    a row per step reaches the driver."""
    step = F.floor(F.log(1.1, F.col("n"))).alias("step")
    steps = sorted(pairs.groupBy(step).agg(F.count("*").alias("pairs")).collect(), reverse=True)
    taken, least = 0, None
    for at, n in steps:
        if taken + n > sent:
            break
        taken, least = taken + n, at
    return pairs.filter(step >= least) if least is not None else pairs.limit(0), not steps or least == steps[-1][0]


def align(docs: DataFrame, a_file: str, b_file: str, derive: Callable[[DataFrame], DataFrame] = lambda f: f, sent: int = SENT) -> DataFrame:
    """Every document's alignment and how its links are rated: doc_id, n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2,b3``), n_best (links whose pair is its A id's most frequent one, ties included) and count_sum.

    ``derive`` is applied to the groups before anything is stored, for callers that want but a digest of them; it keeps the columns it does not
    know. Texts null, empty or not wholly kept by both tokenizers have no tokens: zeros, and empty groups. Every row is a document of its own,
    whatever its id."""
    session = docs.sparkSession
    aligned = snapshot(derive(store_links(docs, a_file, b_file)), "aligned")
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    by_a = Window.partitionBy(F.shiftright("pair", _SHIFT))  # at most B's vocabulary a group
    pairs = snapshot(counted.withColumn("best", F.col("n") == F.max("n").over(by_a)), "pairs")
    frequent, all_sent = _frequent(pairs, sent)
    table = frequent.toPandas().sort_values("pair")
    rates = session.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    rated = _rated(aligned, rates)
    if all_sent:  # the only case in which no link is left to be joined
        return rated.drop("row", "rest", "rest_times")
    rated = snapshot(rated, "rated")
    rest = rated.select(F.col("row").alias("_row"), F.inline(F.arrays_zip("rest", "rest_times")).alias("_pair", "_times"))
    found = rest.join(pairs, F.col("_pair") == F.col("pair")).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("_best"), F.sum(F.col("_times") * F.col("n")).alias("_sum")
    )
    more = {"n_best": "_best", "count_sum": "_sum"}
    joined = rated.drop("rest", "rest_times").join(found, F.col("row") == F.col("_row"), "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(F.col(x), F.lit(0)) for c, x in more.items()}).drop("row", "_row", *more.values())


def _rated(aligned: DataFrame, rates) -> DataFrame:
    """n_best and count_sum over the pairs that were sent, in the place of ``pairs``; the others are the ``rest``."""
    kept = aligned.drop("pairs", "times").schema
    names = kept.names
    more = T.StructType().add("n_best", "long").add("count_sum", "long").add("rest", T.ArrayType(T.LongType())).add("rest_times", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = rates.value
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                pairs, times = (batch.column(c) for c in ("pairs", "times"))
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False), dtype=np.int64)])
                links, times = (x.flatten().to_numpy(zero_copy_only=False) for x in (pairs, times))
                at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
                known = keys[at] == links if len(keys) else np.zeros(len(links), bool)
                n, is_best = (np.where(known, v[at] if len(keys) else 0, 0) * times for v in (counts, best))
                rated = {c: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds]) for c, v in (("n_best", is_best), ("count_sum", n))}
                cuts = pa.array(np.concatenate([[0], np.cumsum(~known)])[bounds].astype(np.int32))
                rest = {c: pa.ListArray.from_arrays(cuts, pa.array(v[~known])) for c, v in (("rest", links), ("rest_times", times))}
                own = {c: batch.column(c) for c in names} | {c: pa.array(v) for c, v in rated.items()} | rest
                yield pa.RecordBatch.from_arrays(list(own.values()), list(own))

    return aligned.mapInArrow(run, T.StructType(kept.fields + more.fields))
