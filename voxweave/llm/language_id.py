"""Language identification by bit-sliced Bloom filters of byte n-grams.

A slot of the filter is a bitmask with one bit per language, in words of 63 languages each. An n-gram has ``HASHES`` slots; the AND of their masks
names every language whose filter holds the n-gram, so that one lookup answers for all languages. A document's count
for a language is corrected for the filter's rate of false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.runtime import cut

from .words import mix, slices, utf8

GRAM, HASHES, SLOT_BITS, WORD = 4, 2, 20, 63
_STEP = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte n-grams of texts (letters in lower case, other ASCII as a space) with the text of each, in steps."""
    for at in range(0, len(data), _STEP):
        part = _FOLD[data[at:at + _STEP + GRAM - 1]]
        n = len(part) - GRAM + 1
        if n <= 0:
            return
        gram = np.zeros(n, np.uint32)
        for i in range(GRAM):
            gram = (gram << np.uint32(8)) | part[i:i + n]
        start = np.arange(at, at + n)
        text = np.searchsorted(offsets, start, "right") - 1
        # n-grams lie in one text, and two spaces in a row say nothing
        good = (start + GRAM <= offsets[text + 1]) & ~((part[:n] == 32) & (part[1:n + 1] == 32)) & ~((part[GRAM - 2:n + GRAM - 2] == 32) & (part[GRAM - 1:n + GRAM - 1] == 32))
        yield gram[good], text[good]


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram.astype(np.uint64))
    return [(h >> np.uint64(i * 24)) & np.uint64((1 << SLOT_BITS) - 1) for i in range(HASHES)]


def _counts(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    number = {x: i for i, x in enumerate(languages)}
    for batch in batches:
        for a, b in slices(batch["text"]):
            part = batch.slice(a, b - a)
            lang = np.array([number[x] for x in part["lang"].to_pylist()], np.uint64)
            for gram, text in _grams(*utf8(part["text"])):
                key, n = np.unique((lang[text] << np.uint64(32)) | gram, return_counts=True)
                yield pa.record_batch({"key": key.view(np.int64), "n": n.astype(np.int64)})


class Model:
    """Filter slots, the languages' names and rates of false positives, and the most frequent language."""

    def __init__(self, masks: np.ndarray, languages: list[str], common: str):
        self.masks, self.languages, self.common = masks, languages, common  # masks[i // 63] has the bit of language i
        fill = np.array([((masks[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false_rate = np.minimum(fill ** HASHES, 0.99)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = utf8(column)
        n, k = len(offsets) - 1, len(self.languages)
        total, counts = np.zeros(n), np.zeros((n, k))
        for gram, text in _grams(data, offsets):
            slots = _slots(gram)
            total += np.bincount(text, minlength=n)
            for word, masks in enumerate(self.masks):
                mask = None
                for slot in slots:
                    found = masks[slot]
                    mask = found if mask is None else mask & found
                for i in range(word * WORD, min(k, (word + 1) * WORD)):
                    counts[:, i] += np.bincount(text, ((mask >> np.uint64(i % WORD)) & np.uint64(1)).astype(np.float64), minlength=n)
        true = np.maximum(0.0, (counts - total[:, None] * self.false_rate) / (1 - self.false_rate)) if k else counts
        texts, names, scores = column.to_pylist(), [], np.zeros(n)
        for i in range(n):
            raw = data[offsets[i]:offsets[i + 1]]
            letters = bool(((raw | 32) - 97 < 26).any()) or any(c.isalpha() for c in texts[i] or "")
            if not letters or not k:
                names.append("und")
            elif not true[i].any():
                names.append(self.common)
            else:
                best = int(true[i].argmax())
                names.append(self.languages[best])
                scores[i] = min(1.0, true[i, best] / true[i].sum())
        return names, scores


def train(docs: DataFrame, least_count: int = 2, share: float = 0.5) -> Model:
    """Learn the filters from docs(text, lang), all rows with a non-null lang and text.

    An n-gram is put into a language's filter if it occurs there ``least_count`` times and its frequency there is at
    least ``share`` of its highest frequency in any language. n-grams are counted in batches and summed in Spark. The
    driver receives the filter, 2**20 slots at most for each 63 languages, and the list of languages.
    """
    docs = docs.where("lang is not null and text is not null").select("lang", "text")
    sizes = docs.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model(np.zeros((0, 1 << SLOT_BITS), np.uint64), [], "und")
    common = min(sizes, key=lambda r: (-r["count"], r["lang"]))["lang"]
    counted = (docs.mapInArrow(lambda it: _counts(it, languages), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
               .select(F.shiftright("key", 32).cast("int").alias("lang"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("gram"), "n"))
    counted = cut(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language
    rated = counted.join(F.broadcast(totals), "lang").withColumn("f", F.col("n") / F.col("total"))
    peak = rated.groupBy("gram").agg(F.max("f").alias("peak"), F.collect_list(F.struct("lang", "n", "f")).alias("each"))
    word = F.floor(F.col("x.lang") / WORD).cast("int")
    chosen = (peak.select("gram", "peak", F.explode("each").alias("x")).where((F.col("x.n") >= least_count) & (F.col("x.f") >= share * F.col("peak")))
              .select("gram", word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("x.lang", F.lit(WORD)).cast("int")).alias("mask")))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot in _slots(np.asarray(batch["gram"]).astype(np.uint32)):
                yield pa.record_batch({"word": batch["word"], "slot": slot.astype(np.int64), "mask": batch["mask"]})

    filled = chosen.mapInArrow(slots, "word int, slot long, mask long").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()
    masks = np.zeros((-(-len(languages) // WORD), 1 << SLOT_BITS), np.uint64)
    masks[filled["word"].to_numpy(np.int64), filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    return Model(masks, languages, common)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score (share of the evidence, 0 to 1). One row per input row.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Letters without a known
    n-gram: the most frequent learned language, score 0. Equal evidence: the first language by name. Null or repeated
    doc_id: rows are independent. Empty table: no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB for each 63 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], 1 << 20):
                part = batch.slice(a, b - a)
                names, scores = shared.value.predict(part["text"])
                yield pa.record_batch({"doc_id": part["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": scores})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
