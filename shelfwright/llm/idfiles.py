"""Files of token ids: every document a zstandard frame of its own, all of them compressed with one shared dictionary.

Layout of a file: a header (magic, bytes an id takes, SHA-256 of the dictionary), the frames one after the other, and an
index of three columns (document id and whether it is null, where its frame begins, ids of the file's documents before it), closed by the
number of documents, the place of the index and the magic. A document is found by reading header, index and one frame. Files are in ascending
order of documents; a manifest lists them, so what a lost task left behind is no part of the data.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.llm.common import snapshot
from shelfwright.llm.wordids import encoder, slices

MAGIC = b"IDFRAME1"
_HEADER, _FOOTER = struct.Struct("<8sB32s"), struct.Struct("<QQ8s")
_DICTIONARY = "dictionary"

#: The dictionary learns from about this many documents, drawn over the whole table, and from a stretch of each.
SAMPLE, SAMPLE_IDS = 2048, 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Bytes of ids that a reader hands on together.
READ = 4 << 20

ENCODED = "doc_id long, n_tokens long, frame binary"
MANIFEST = "part int, path string, n_docs long, n_tokens long, first_id long, last_id long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there. Hadoop's names of S3 are S3's."""
    return fs.FileSystem.from_uri("s3://" + path.split("://", 1)[1] if path.startswith(("s3a://", "s3n://")) else path)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialised ids. Samples too few to train on are the dictionary themselves."""
    total = sum(map(len, samples))
    size = min(size, total // 8)
    if size >= 1024 and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Codec:
    """Compresses and reads the ids of one document."""

    def __init__(self, dictionary: bytes, width: int):
        self.hash, self.dtype = hashlib.sha256(dictionary).digest(), np.dtype(f"<u{width}")
        shared = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        self._decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress

    def frame(self, ids: np.ndarray) -> bytes:
        return self._compress(ids.astype(self.dtype, copy=False).tobytes())

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self._decompress(frame), self.dtype)


class IdFileWriter:
    """Writes one file, batch by batch; what it keeps of a document until the end are four numbers."""

    def __init__(self, path: str, dictionary: bytes, width: int):
        system, name = _at(path)
        self._path, self._out = path, system.open_output_stream(name)
        self._out.write(_HEADER.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))
        self._doc_ids, self._is_null, self._sizes, self._tokens = [], [], [], []

    def add(self, doc_ids: pa.Array, n_tokens: pa.Array, frames: pa.Array) -> None:
        buffers = [f.as_buffer() for f in frames]
        for buffer in buffers:
            self._out.write(buffer)
        self._sizes.append(np.array([b.size for b in buffers], np.int64))
        self._doc_ids.append(doc_ids.fill_null(0).to_numpy())
        self._is_null.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self._tokens.append(n_tokens.to_numpy())

    def close(self) -> dict:
        """Ends the file; gives what the manifest says of it."""
        ids, null = np.concatenate(self._doc_ids), np.concatenate(self._is_null)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self._sizes))]) + _HEADER.size
        starts = np.concatenate([[0], np.cumsum(np.concatenate(self._tokens))])
        for column, kind in ((ids, "<i8"), (null, "<u1"), (offsets, "<u8"), (starts, "<u8")):
            self._out.write(column.astype(kind).tobytes())
        self._out.write(_FOOTER.pack(len(ids), int(offsets[-1]), MAGIC))
        self._out.close()
        known = ids[~null].tolist()
        first, last = (known[0], known[-1]) if known else (None, None)
        return {"path": self._path, "n_docs": len(ids), "n_tokens": int(starts[-1]), "first_id": first, "last_id": last}


class IdFile:
    """One file, read by document."""

    def __init__(self, path: str, dictionary: bytes):
        system, name = _at(path)
        self._file = system.open_input_file(name)
        magic, width, digest = _HEADER.unpack(self._read(0, _HEADER.size))
        self.n_docs, index, closing = _FOOTER.unpack(self._read(self._file.size() - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or closing != MAGIC:
            raise ValueError(f"{path} is not a whole file of ids")
        self._codec = Codec(dictionary, width)
        if digest != self._codec.hash:
            raise ValueError(f"{path} was written with another dictionary")
        data = self._read(index, self._file.size() - _FOOTER.size - index)
        n = self.n_docs
        self.doc_ids = np.frombuffer(data, "<i8", n)
        self.is_null = np.frombuffer(data, "<u1", n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(data, "<u8", n + 1, 9 * n)
        self.starts = np.frombuffer(data, "<u8", n + 1, 9 * n + 8 * (n + 1))

    def _read(self, at: int, n: int) -> bytes:
        return self._file.read_at(n, at)

    def document(self, nth: int) -> np.ndarray:
        a, b = int(self.offsets[nth]), int(self.offsets[nth + 1])
        return self._codec.ids(self._read(a, b - a))

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with an id; several if it is repeated."""
        known = self.n_docs - int(self.is_null.sum())  # nulls come last
        first, stop = (int(np.searchsorted(self.doc_ids[:known], doc_id, side)) for side in ("left", "right"))
        return [self.document(k) for k in range(first, stop)]

    def blocks(self, size: int = READ) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, some at a time: the number of the first, and their ids. Frames are read together."""
        first = 0
        while first < self.n_docs:
            stop = max(first + 1, int(np.searchsorted(self.starts, int(self.starts[first]) + size // 4, "right")) - 1)
            stop = min(stop, self.n_docs)
            base = int(self.offsets[first])
            data = self._read(base, int(self.offsets[stop]) - base)
            cuts = (self.offsets[first : stop + 1].astype(np.int64) - base).tolist()
            yield first, [self._codec.ids(data[a:b]) for a, b in zip(cuts, cuts[1:])]
            first = stop

    def close(self) -> None:
        self._file.close()


@dataclass(frozen=True)
class IdFiles:
    """Written files: the folder, the dictionary they share, and one manifest row per file."""

    path: str
    dictionary: bytes
    manifest: DataFrame


def _samples(docs: DataFrame, tokenizer_file: str, end_id: int, width: int) -> list[bytes]:
    """Serialised ids of about ``SAMPLE`` documents, each a stretch from somewhere in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rng = encoder(tokenizer_file), np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                ids, offsets = encode(texts, end_id)
                out = []
                for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                    a += int(rng.integers(0, max(1, b - a - SAMPLE_IDS + 1)))
                    out.append(ids[a : min(b, a + SAMPLE_IDS)].astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    rows = docs.count()
    drawn = docs.select(F.col("text").cast("string")).sample(min(1.0, SAMPLE / max(rows, 1)), 7)
    return [bytes(r[0]) for r in drawn.mapInArrow(run, "ids binary").collect()]


def _encoded(docs: DataFrame, tokenizer_file: str, end_id: int, dictionary: bytes, width: int) -> DataFrame:
    """Every document's number of ids and frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, codec = encoder(tokenizer_file), Codec(dictionary, width)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, offsets = encode(texts, end_id)
                small, cuts = ids.astype(codec.dtype), offsets.tolist()
                frames = pa.array([codec.frame(small[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(np.diff(offsets)), frames], ["doc_id", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> IdFiles:
    """Writes the ids of every text (null: empty) and ``end_id`` after each, in ascending order of ``doc_id`` with nulls
    last. Rows of one id are in order of length and content; alike rows have any order. An empty table has no files."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train(_samples(docs, tokenizer_file, end_id, width))
    folder, name = _at(path)
    folder.create_dir(name)
    with folder.open_output_stream(f"{name}/{_DICTIONARY}") as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            if len(batch):
                writer = writer or IdFileWriter(f"{path}/part-{part:06d}-{uuid.uuid4().hex}", dictionary, width)
                writer.add(batch.column(0), batch.column(1), batch.column(2))
        if writer:
            row = {"part": part} | writer.close()
            types = {"part": pa.int32(), "path": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.int64())) for k, v in row.items()], list(row))

    # The last column only parts the rows of one dominant id or text.
    ordering = [F.col("doc_id").asc_nulls_last(), F.col("n_tokens"), F.xxhash64("frame"), F.col("_row")]
    frames = snapshot(_encoded(docs, tokenizer_file, end_id, dictionary, width), "frames").withColumn("_row", F.monotonically_increasing_id())
    written = frames.repartitionByRange(*ordering).sortWithinPartitions(*ordering).select("doc_id", "n_tokens", "frame").mapInArrow(run, MANIFEST)
    written.write.parquet(f"{path}/manifest")
    return open_files(docs.sparkSession, path)


def open_files(spark: SparkSession, path: str) -> IdFiles:
    system, name = _at(path)
    with system.open_input_file(f"{name}/{_DICTIONARY}") as f:
        dictionary = f.read()
    return IdFiles(path, dictionary, spark.read.schema(MANIFEST).parquet(f"{path}/manifest"))


def read(files: IdFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids: every document with the number of ids of all documents before it, and its ids as
    little-endian unsigned 32-bit integers. One task per file."""
    dictionary = files.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = IdFile(row["path"], dictionary)
                if (file.n_docs, int(file.starts[-1])) != (row["n_docs"], row["n_tokens"]):
                    raise ValueError(f"{row['path']} is not what the manifest says")
                for first, found in file.blocks():
                    part = slice(first, first + len(found))
                    doc_ids = pa.array(file.doc_ids[part], pa.int64(), mask=file.is_null[part])
                    starts = file.starts[part].astype(np.int64) + row["start"]
                    sizes = np.array([len(x) for x in found], np.int64)
                    ids = pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes), ids], ["doc_id", "start", "n_tokens", "ids"])
                file.close()

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return placed.repartition(max(1, files.manifest.count())).mapInArrow(run, DOCUMENTS)
