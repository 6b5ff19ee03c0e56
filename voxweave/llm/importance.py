"""Importance resampling towards a target's distribution of hashed n-grams: whole batches of texts at a time.

A batch's texts are joined by a sentinel that no word holds, and one regex pass over the bytes finds all words. The
document of a word follows from a binary search of its position among the documents' offsets; an n-gram whose words
belong to two documents is masked before features are counted by bucket.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxweave.runtime import cut, with_running

from .words import slices, utf8

SENTINEL = b"\n"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_AT_ONCE = 1 << 18  # words taken from the pass at a time


def joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """Texts in lower case (A-Z) with a sentinel after each, and where each begins."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    both = SENTINEL.join([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]) + SENTINEL
    return both.lower(), offsets[:-1] + np.arange(len(offsets) - 1)


def features(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket, length in words) of all runs of 1 to ``longest`` words, some words at a time."""
    both, begins = joined(column)
    found = _WORD.finditer(both)
    last_words, last_docs = [], np.zeros(0, np.int64)
    while some := list(islice(found, _AT_ONCE)):
        words = last_words + [m.group() for m in some]
        starts = np.fromiter((m.start() for m in some), np.int64, len(some))
        docs = np.r_[last_docs, np.searchsorted(begins, starts, "right") - 1]
        old = len(last_words)
        codes = [crc32(w) for w in words]
        spaced = [b" " + w for w in words] if longest > 1 else words
        for n in range(1, longest + 1):
            if n > 1:
                codes = [crc32(w, c) for w, c in zip(spaced[n - 1:], codes)]  # the code of what is put together
            one = docs[:len(codes)] == docs[n - 1:]
            one[:max(0, old - n + 1)] = False  # given before
            yield docs[:len(codes)][one], np.array(codes, np.int64)[one] % buckets, np.full(int(one.sum()), n)
        keep = min(longest - 1, len(words))
        last_words, last_docs = words[len(words) - keep:], docs[len(docs) - keep:]


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket. A task gives one row a bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in slices(batch["text"]):
                for _, at, _ in features(batch["text"].slice(a, b - a), longest, buckets):
                    total += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": some.astype(np.int32), "n": total[some]})

    out = np.zeros(buckets, np.int64)
    for row in texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of the smoothed shares of each bucket."""
    size = float(len(source))
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + size) / ((a + 1.0) * (t + size)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel value) from the first 32 bits of sha256("seed:doc_id"); a null id reads as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """docs(doc_id, text, ...), target(text, ...) -> doc_id, n_features, weight, score, rank: one row per input row.

    Features are the runs of 1 to ``longest`` words, hashed into ``buckets``. A document's weight is the floored mean of
    its features' gains; its score adds noise. Of the N documents of ``least_words`` or more, floor(percent * N / 100)
    are drawn, by score, ties to the smaller doc_id, then to more features; rank is 1, 2, 3 and so on, else null.

    Texts are read twice and not shuffled; each task sends one row a bucket, the driver gets as many. Scores are whole
    numbers between -200,000 and 200,000 whatever the counts, so the counts by score that set the least score drawn are
    bounded too; only documents with that score or more are sorted, by range.

    Null or empty text: no features, weight 0. Null doc_id: noise of the empty id, last among ties. Repeated rows are
    drawn each for itself. No target texts: the target's shares are even. Empty table: no rows. Other columns are ignored.
    """
    longest, percent = int(longest), int(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                words, n, total = (np.zeros(len(part), np.int64) for _ in range(3))
                for doc, at, size in features(part["text"], longest, buckets):
                    n += np.bincount(doc, minlength=len(part))
                    words += np.bincount(doc[size == 1], minlength=len(part))
                    total += np.bincount(doc, weights=table.value[at], minlength=len(part)).astype(np.int64)
                yield pa.record_batch({"doc_id": part["doc_id"], "n_words": words, "n_features": n, "weight": total // np.maximum(n, 1)})

    scored = docs.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("place", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least_words
    counts = sorted(((r["score"], r["n"]) for r in scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    left, least = draw, None
    for score, n in counts:
        if left <= 0:
            break
        left, least = left - n, score
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = fit & (F.col("score") >= least)
    ranked = with_running(scored.where(near), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("place")], ordinal="above")
    rank = F.when(F.col("above") < draw, F.col("above") + 1).cast("long")
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
