"""Ids of whole texts, for a tokenizer of words: every different word of a batch is encoded once, all of them in one call.

Texts come as Arrow arrays; splitting, dictionary encoding and putting the ids of words together are array operations.
Nothing is remembered from batch to batch, so memory is bounded by ``SLICE`` bytes of text and one text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together.
SLICE = 8 << 20

#: What the quick way relies on: marks compose, white space parts words, letters are lower-cased, and runs of letters, single
#: digits and runs of other characters are encoded apart.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
#: Words of these characters alone have no marks that compose, and one lower case wherever a letter stands.
_PLAIN = "^[!-~À-ÖØ-öø-įı-ſ]*$"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes as."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _reads_words(file: dict) -> bool:
    """Whether the file is a tokenizer of the kind the quick way is for."""
    model, parts = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    by_rank = sorted(model["vocab"], key=model["vocab"].get)
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    return (
        (file.get("normalizer") or {}).get("normalizers") == _NORMALIZER
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": _PARTS}
        and parts[0]["behavior"] == "Removed"
        and parts[0]["invert"]
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
        and not file.get("post_processor")
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix") == _WORD_END
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        # Merges in the order of their ids, after the bytes alone and the bytes that end a word.
        and by_rank[512:] == merged
        and all(t["special"] and not t["normalized"] and t["content"].startswith("<|") for t in file.get("added_tokens", []))
    )


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of at most ``size`` bytes, or one text, with the row at which each starts; nulls become ''."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        stop = max(stop, at + 1)
        yield at, texts.slice(at, stop - at)
        at = stop


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` one after the other, and where each begins in the result (one number more)."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1], dtype=np.int64)
    index += np.repeat(starts - offsets[:-1], lengths)
    return values[index], offsets


class WordIds:
    """``ids, offsets = encoder(texts, end_id)``: unsigned 32-bit ids of all texts, the ``end_id`` after each, and where each
    text begins in them. Texts must not be null; use ``slices``.

    The same as encoding each text whole without special tokens added. For tokenizers of another kind than ``_reads_words``
    tells, texts are encoded whole."""

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            file = json.load(f)
        self._quick = None
        if _reads_words(file):
            vocab, alphabet = file["model"]["vocab"], _byte_alphabet()
            # The end of a word is written as a line feed, which no word holds.
            ranks = {}
            for token, rank in vocab.items():
                ends = token.endswith(_WORD_END)
                own = token[: -len(_WORD_END)] if ends else token
                ranks[bytes(alphabet[c] for c in own) + b"\n" * ends] = rank
            self._ends = np.zeros(max(vocab.values()) + 1, bool)
            self._ends[[rank for token, rank in vocab.items() if token.endswith(_WORD_END)]] = True
            self._quick = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if self._quick is None:
            flat, starts, lengths = self._slow(texts.to_pylist())
            index, firsts = np.arange(len(texts)), np.arange(len(texts) + 1)
        else:
            words = pc.ascii_split_whitespace(texts)
            coded = words.flatten().dictionary_encode()
            flat, starts, lengths = self._words(coded.dictionary)
            index, firsts = coded.indices.to_numpy(zero_copy_only=False), words.offsets.to_numpy().astype(np.int64)
            firsts -= firsts[0]
        # The end id is one more word, after the last of each text.
        index = np.insert(index.astype(np.int64), firsts[1:], len(starts))
        starts, lengths = np.append(starts, len(flat)), np.append(lengths, 1)
        ids, bounds = gather(np.append(flat, np.uint32(end_id)), starts[index], lengths[index])
        return ids, bounds[firsts + np.arange(len(firsts))]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words: all of them, where each word's start, and how many it has."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        quick = plain.to_numpy(zero_copy_only=False)
        flat, starts, lengths = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for chosen, encode in ((quick, self._plain), (~quick, lambda w: self._slow(w.to_pylist()))):
            if chosen.any():
                own, first, n = encode(words.filter(pa.array(chosen)))
                starts[chosen], lengths[chosen] = first + sum(map(len, flat)), n
                flat.append(own)
        return (np.concatenate(flat) if flat else np.empty(0, np.uint32)), starts, lengths

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lower = pc.utf8_lower(words)
        letters = pc.match_substring_regex(lower, r"^\p{L}+$")
        marked = pc.binary_join_element_wise(lower, "\n", "")
        mixed = pc.replace_substring_regex(lower.filter(pc.invert(letters)), f"({_PARTS})", "\\1\n")
        marked = pc.replace_with_mask(marked, pc.invert(letters), mixed)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(marked)], pa.int32()), marked), "")[0].as_py()
        ids = self._quick.encode_to_numpy(joined, disallowed_special=()).astype(np.uint32, copy=False)
        ends = np.zeros(1 + pc.sum(pc.count_substring(marked, "\n")).as_py(), np.int64)
        ends[1:] = np.flatnonzero(self._ends[ids]) + 1
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum(pc.count_substring(marked, "\n").to_numpy(zero_copy_only=False), out=bounds[1:])
        bounds = ends[bounds]
        return ids, bounds[:-1], np.diff(bounds)

    def _slow(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [e.ids for e in self._whole.encode_batch_fast(texts, add_special_tokens=False)]
        bounds = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=bounds[1:])
        return np.fromiter((i for x in found for i in x), np.uint32, bounds[-1]), bounds[:-1], np.diff(bounds)


#: Of this worker process, for all the tasks it runs.
_ENCODERS: dict[str, WordIds] = {}


def encoder(tokenizer_file: str) -> WordIds:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = WordIds(tokenizer_file)
    return _ENCODERS[tokenizer_file]
