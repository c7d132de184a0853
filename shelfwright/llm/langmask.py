"""Language identification by bit-sliced Bloom filters of n-grams.

A language's n-grams are the letter trigrams that are common in it beside the language that uses them most. The filter
is one array of slots with a bit per language, so the AND of an n-gram's slots names all languages that
(probably) contain it. A text's trigrams are looked up, hits are counted per language, and the hits that the filter
gives by chance are taken off; the language with most is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.llm.common import crc_remainder, snapshot

UNKNOWN = "und"
#: Slots of the filter and slots per trigram; languages that one word of a slot has bits for.
SLOTS, PROBES, WORD = 1 << 20, 3, 63
#: A trigram belongs to a language if its share there is at least this part of the largest share anywhere ...
PRESENCE = 0.2
#: ... and one in this many of the language's trigrams.
RARE = 1_000_000
_BLOCK = 1 << 17


def _letters() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter (of one code point), else 0."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of the texts' words (a blank before and after each word included) and the text of each.

    A trigram is three code points of 21 bits. Anything but a letter parts words."""
    joined = "".join(f"\0{t}\0" for t in texts)
    points = _table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    a, b, c = points[:-2], points[1:-1], points[2:]
    used = (b != 0) & ((a != 0) | (c != 0))
    return ((a[used] << np.uint64(42)) | (b[used] << np.uint64(21)) | c[used]), owner[1:-1][used]


def slots(grams: np.ndarray) -> list[np.ndarray]:
    mixed = grams * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return [((mixed >> np.uint64(64 - 20 * (k + 1))) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]


def _blocks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows of about one block of text; a longer text is a run of its own."""
    size = frame["text"].str.len().fillna(0).cumsum() // _BLOCK
    for _, part in frame.groupby(size, sort=False):
        yield part


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with a language and a text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, own in frame.groupby("lang"):
                total = pd.Series(dtype="int64")
                for part in _blocks(own):
                    grams, counts = np.unique(trigrams(part["text"].tolist())[0], return_counts=True)
                    total = total.add(pd.Series(counts, index=grams.view(np.int64)), fill_value=0)
                yield pd.DataFrame({"lang": lang, "gram": total.index.astype("int64"), "n": total.to_numpy("int64")})

    counted = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").mapInPandas(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """``masks``: (word, slot): a slot's languages as bits, ``WORD`` of them a word, in the order of ``languages``. ``chance``: of a
    false hit, per language."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray


def learn(labelled: DataFrame) -> Model:
    """The filter of all labelled rows (lang, text); null languages and texts teach nothing.

    Counts are summed in the tasks. What reaches the driver is the filter, whatever the number of documents: a number per language, and
    at most ``SLOTS`` slots of 8 bytes for every 63 languages."""
    counts = snapshot(count_grams(labelled), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r[0] for r in totals.select("lang").collect())
    words = -(-len(languages) // WORD)
    masks = np.zeros((words, SLOTS), np.int64)
    if languages:
        shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
        bits = shares.sparkSession.createDataFrame([(name, k // WORD, 1 << k % WORD) for k, name in enumerate(languages)], "lang string, word int, bit long")
        top = Window.partitionBy("gram")  # a row per language
        kept = shares.withColumn("top", F.max("share").over(top)).where((F.col("share") >= PRESENCE * F.col("top")) & (F.col("share") * RARE >= 1))
        named = kept.join(bits, "lang").groupBy("gram", "word").agg(F.bit_or("bit").alias("mask"))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in slots(frame["gram"].to_numpy().view(np.uint64)):
                    yield pd.DataFrame({"word": frame["word"], "slot": at, "mask": frame["mask"]})

        placed = named.select("gram", "word", "mask").mapInPandas(place, "word int, slot long, mask long")
        used = placed.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
        masks[used["word"].to_numpy(), used["slot"].to_numpy()] = used["mask"].to_numpy()
    filled = np.array([np.count_nonzero(masks[k // WORD] & (1 << k % WORD)) for k in range(len(languages))]) / SLOTS
    return Model(languages, masks, filled**PROBES)


def decide(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """A language and a score from 0 to 1 (its part of all corrected hits) per text."""
    grams, owner = trigrams(texts)
    first, *others = slots(grams)
    found = model.masks[:, first]
    for at in others:
        found &= model.masks[:, at]
    n = np.bincount(owner, minlength=len(texts))
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model.languages:
        hits = np.stack([np.bincount(owner, weights=(found[k // WORD] >> k % WORD) & 1, minlength=len(texts)) for k in range(len(model.languages))])
        chance = model.chance[:, None]
        hits = np.maximum(hits - n * chance, 0) / np.maximum(1 - chance, 1e-9)
        best, total = hits.argmax(axis=0), hits.sum(axis=0)
        top = hits[best, np.arange(len(texts))]
        scores = np.where(total > 0, top / np.maximum(total, 1e-300), 0.0)
        letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        scores = np.where(letters, scores, 0.0)
    return names, np.clip(scores, 0, 1).tolist()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. ``und`` and 0 where the text is null or has no letter, or nothing
    was learned; ties go to the language first in code point order. The language of a row is not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = frame["text"].fillna("")
            for part in _blocks(frame):
                names, scores = decide(part["text"].tolist(), shared.value)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "lang_pred": names, "score": scores})

    return docs.select(F.col("doc_id").cast("long"), (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text").mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def predict(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, and predicts all."""
    return identify(docs, learn(docs.filter(crc_remainder(F.col("doc_id"), 4) != 2)))
