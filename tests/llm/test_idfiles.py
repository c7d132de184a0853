from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwright.llm import idfiles, queries
from shelfwright.llm.common import load
from shelfwright.sources.store import shared_dir
from tests.llm.helpers import documents, near_copies, odd_rows

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def expected(rows):
    """(doc_id, start, n_tokens, crc) by encoding each text whole, in order of ids."""
    whole, at, out = Tokenizer.from_file(WORD_BPE), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def written(spark, rows, docs=None):
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    return idfiles.write(documents(spark, rows).repartition(3) if docs is None else docs, path, WORD_BPE, 1)


def read_rows(files):
    return sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in idfiles.read(files).collect()), key=lambda r: r[1])


def test_round_trip_of_odd_documents(spark):
    rows = [*((r[0], r[1]) for r in odd_rows()), *near_copies(3)]
    assert read_rows(written(spark, rows)) == expected(rows)
    assert read_rows(written(spark, [])) == []
    assert read_rows(written(spark, [(None, None)])) == [(None, 0, 1, zlib.crc32(b"\1\0\0\0"))]


def test_the_query_equals_whole_encoding(spark):
    rows = [(r.doc_id, r.text) for r in load(spark, SMALL, "documents").collect()]
    got = sorted((tuple(r) for r in queries.id_files(spark, SMALL).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_documents_are_found_alone_and_files_are_in_order(spark):
    rows = [*near_copies(5, 20, 10), (7, "the same id"), (7, "and again it")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = written(spark, rows)
        manifest = files.manifest.orderBy("part").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(manifest) > 1 and all(a.last_id < b.first_id for a, b in zip(manifest, manifest[1:]))
    whole, seen = Tokenizer.from_file(WORD_BPE), 0
    for m in manifest:
        file = idfiles.IdFile(m.path, files.dictionary)
        for doc_id, text in rows:
            if m.first_id <= doc_id <= m.last_id:
                wanted = [[*whole.encode(t).ids, 1] for d, t in rows if d == doc_id]
                assert sorted(x.tolist() for x in file.find(doc_id)) == sorted(wanted)
                seen += 1
        assert file.find(-1) == []
        # Blocks of any size give all documents in order.
        assert [x.tolist() for _, b in file.blocks(1) for x in b] == [file.document(k).tolist() for k in range(file.n_docs)]
    assert seen == len(rows)


def test_short_documents_gain_by_the_dictionary(spark):
    docs = load(spark, SMALL, "documents")
    files = written(spark, None, docs)
    assert len(files.dictionary) > 1000
    alone = idfiles.Codec(b"", 2)
    shared = idfiles.Codec(files.dictionary, 2)
    from shelfwright.llm.wordids import encoder

    short = [r.text for r in docs.filter("length(text) between 50 and 800").collect()]
    ids, offsets = encoder(WORD_BPE)(pa.array(short), 1)
    cuts = list(zip(offsets, offsets[1:]))
    assert sum(len(shared.frame(ids[a:b])) for a, b in cuts) < 0.9 * sum(len(alone.frame(ids[a:b])) for a, b in cuts)


def test_other_dictionaries_and_torn_files_are_refused(spark):
    files = written(spark, near_copies(4))
    path = files.manifest.first().path
    with pytest.raises(ValueError, match="another dictionary"):
        idfiles.IdFile(path, b"something else")
    local = path.replace("file://", "")
    with open(local, "rb") as f:
        data = f.read()
    with open(local + "-torn", "wb") as f:
        f.write(data[:-5])
    with pytest.raises(ValueError, match="not a whole file"):
        idfiles.IdFile(path + "-torn", files.dictionary)
    # It is in no manifest, so readers do not see it.
    assert len(read_rows(idfiles.open_files(spark, files.path))) == len(near_copies(4))


def test_wide_ids_take_four_bytes():
    codec = idfiles.Codec(b"", 4)
    ids = np.array([0, 70_000, 2**32 - 1], np.uint32)
    assert codec.ids(codec.frame(ids)).tolist() == ids.tolist()
