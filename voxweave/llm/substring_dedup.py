"""Removal of passages that an earlier document holds: Rabin-Karp hashes of every window of words, counted in Spark."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACED, Words, utf8

SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first:long,words:long>>"
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id
_BUCKET, _STORED = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def remove_repeats(docs: DataFrame, window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document with a smaller doc_id.

    docs(doc_id, text, ...) -> doc_id, n_words, n_removed, kept_text (kept words joined by one space), removed
    (maximal intervals: first word, number of words). One row per input row.

    Documents are dealt into blocks of about ``block_bytes``. A block reports each distinct window once, with its
    first document in the block, to the bucket that one hash of the window names; the bucket sees the second hash of
    64 bits. It finds each window's first document of all and answers one bit for each window of a block. The same
    exchange of the texts serves both passes. Two windows count as equal if the second hash and the bucket are equal.

    Null or empty text: no words. Null doc_id: comes after all others, and is not an earlier document of another
    null. Rows that repeat a doc_id are not earlier than one another. Empty table: empty result. Other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, ceil(size / block_bytes))
    buckets = max(1, ceil(size / (3 * block_bytes)))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def report(key, table):
        found = _distinct(table, window, buckets)
        rows = {"bucket": [], "block": [], "hashes": [], "docs": []}
        cuts = np.searchsorted(found.bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            doc = found.doc[part]
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            runs = np.diff(np.r_[head, len(doc)])
            rows["bucket"].append(int(b)), rows["block"].append(key[0].as_py())
            rows["hashes"].append(found.stored[part].tobytes())
            rows["docs"].append(_pack(found.ids[doc[head]], runs))
        return pa.table(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())]))

    def judge(table):
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]]
        docs = np.concatenate([_unpack(x.as_py()) for x in table["docs"]])
        every = np.concatenate(hashes)
        order = np.argsort(every)
        head = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
        first = np.minimum.reduceat(docs[order], head)
        late = np.empty(len(every), bool)
        late[order] = docs[order] > np.repeat(first, np.diff(np.r_[head, len(every)]))
        bits, at = [], 0
        for h in hashes:
            bits.append(pa.compress(np.packbits(late[at:at + len(h)]).tobytes(), "zstd", asbytes=True))
            at += len(h)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    def remove(texts, answers):
        found = _distinct(texts, window, buckets)
        late = np.zeros(len(found.doc), bool)
        cuts = np.searchsorted(found.bucket, np.arange(buckets + 1))
        for b, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
            n = cuts[b + 1] - cuts[b]
            raw = np.frombuffer(pa.decompress(bits, (n + 7) // 8, "zstd", asbytes=True), np.uint8)
            late[cuts[b]:cuts[b + 1]] = np.unpackbits(raw, count=n)
        hit = late[found.place] | (found.ids[found.own] > found.ids[found.doc[found.place]])
        return _kept(found, found.at[hit], window, texts["doc_id"])

    reports = dealt.groupBy("block").applyInArrow(report, "bucket int, block int, hashes binary, docs binary")
    answers = reports.groupBy("bucket").applyInArrow(judge, "block int, bucket int, bits binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, SCHEMA)


class _distinct:
    """The distinct windows of a block ordered by bucket, first document and hash; ``place`` leads each window there."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        self.words = w = Words(*utf8(table["text"]), SPACED)
        ids = np.asarray(table["doc_id"].combine_chunks().fill_null(_LAST))
        self.ids, rank = np.unique(ids, return_inverse=True)
        self.at, stored = w.windows(window, _STORED)
        bucket = (w.windows(window, _BUCKET)[1] % np.uint64(buckets)).astype(np.int64)
        self.own = rank[w.text_of()[self.at]] if len(self.at) else np.zeros(0, np.int64)
        order = np.lexsort((self.own, stored)) if buckets == 1 else np.lexsort((self.own, stored, bucket))
        s, b = stored[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)
        stored, bucket, doc = s[head], b[head], self.own[order][head]
        again = np.argsort(bucket * len(self.ids) + doc, kind="stable")
        self.stored, self.bucket, self.doc = stored[again], bucket[again], doc[again]
        back = np.empty(len(again), np.int64)
        back[again] = np.arange(len(again))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = back[np.cumsum(new) - 1]


def _pack(ids: np.ndarray, runs: np.ndarray) -> bytes:
    """Document ids and how many windows each has, as byte planes: small numbers leave planes of zeros."""
    both = np.stack([np.diff(ids, prepend=np.int64(0)), runs.astype(np.int64)])
    planes = np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1))
    return len(ids).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], 16 * n, "zstd", asbytes=True), np.uint8)
    delta, runs = np.ascontiguousarray(raw.reshape(2, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(2, n)
    return np.repeat(np.cumsum(delta), runs)


def _kept(found: _distinct, starts: np.ndarray, window: int, ids: pa.ChunkedArray) -> pa.Table:
    w = found.words
    cover = np.zeros(len(w.starts) + 1, np.int32)
    cover[starts] += 1
    cover[starts + window] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), w.first[:-1]) * (w.counts() > 0) if len(w.first) > 1 else np.zeros(0, np.int64)
    data, texts, spans = w.data.tobytes(), [], []
    for i in range(len(w.first) - 1):
        part = data[w.offsets[i]:w.offsets[i + 1]].split()
        if removed[i]:
            mask = gone[w.first[i]:w.first[i + 1]]
            edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
            spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
            kept, at = [], 0
            for a, b in zip(edges[::2], edges[1::2]):
                kept += part[at:a]
                at = b
            part = kept + part[at:]
        else:
            spans.append([])
        texts.append(b" ".join(part))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    return pa.table({"doc_id": ids, "n_words": w.counts().astype(np.int64), "n_removed": removed,
                     "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "removed": pa.array(spans, kind)})
