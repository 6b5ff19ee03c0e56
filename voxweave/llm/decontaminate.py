"""Benchmark passages in documents: a set join on word shingles, filtered by the rarest shingle of each passage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.runtime import cut

from .probe import bitmap, probe
from .words import ALNUM_LOWER, Words, slices, utf8

_BY = 0x8EBC6AF09C88C6E3
_SALTS = 16


def _lower(w: Words) -> bytes:
    return w.kind.fold[w.data].tobytes()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Words of documents inside occurrences of item windows.

    docs(doc_id, text, ...), items(item_id, text, ...) -> doc_id, n_words, n_hit, n_items, item_ids (distinct, sorted
    as strings), hits array<struct<first, words>> (occurrences, by position), text_key (hash of the text). One row per
    input document.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. The
    tokens of the join are shingles of ``shingle`` words (the whole window where it is shorter). Containment is full,
    so that every shingle of a window is necessary and the prefix is one token: the one in fewest documents, counted
    over all documents. A window with a shingle that no document holds is dropped. Documents list the places of prefix
    tokens; the place less the token's offset must lie in the document (positional bound) and leave room for the
    window (length bound), and then the words themselves are compared.

    Null texts have no words. Null item_id: its windows count as hits, but it is not listed. Equal items are listed
    each under its own id. Empty tables give rows without hits or no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    tokens = cut(items.mapInArrow(lambda it: _item_windows(it, window, shingle), "item_id string, words string, n int, offset int, h long"))
    sizes = sorted(r["k"] for r in tokens.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` values
    shingles = tokens.select("h").distinct()
    wanted = bitmap(shingles, F.col("h"))
    spread = (docs.mapInArrow(lambda it: _document_counts(it, sizes, wanted), "h long, n long").groupBy("h").agg(F.sum("n").alias("df")))
    rarity = shingles.join(spread, "h")
    ranked = (tokens.select("words", "n", "offset", "h").distinct().join(rarity, "h", "left")
              .groupBy("words", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("p")))
    prefix = cut(ranked.where("p.df > 0").select("words", "n", F.col("p.h").alias("h"), F.col("p.offset").alias("offset")))
    wanted = bitmap(prefix.select("h").distinct(), F.col("h"))
    scanned = cut(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("text_key", F.xxhash64("text")).mapInArrow(
        lambda it: _candidates(it, sizes, wanted, window, shingle),
        "row long, doc_id long, text_key long, n_words long, places array<struct<h:long,at:long,from:long,around:string>>"))
    # A frequent token: its places are dealt over salts, the windows (few per token) are repeated for each.
    places = (scanned.where(F.size("places") > 0).select("row", "n_words", F.inline("places"))
              .withColumn("salt", F.pmod(F.hash("row"), F.lit(_SALTS))))
    salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    begin = F.col("at") - F.col("offset")
    inside = (begin >= 0) & (begin + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), F.greatest((begin - F.col("from")).cast("int") + 1, F.lit(1)), F.col("n")), " ") == F.col("words")
    # `from` is at most `begin` whenever `begin` lies in the document.
    found = places.join(salted, ["h", "salt"]).where(F.when(inside, same).otherwise(False)).select("row", begin.alias("first"), F.col("n").cast("long").alias("n"), "words")
    found = cut(found)
    cover = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
                        lambda s, h: F.struct((s["hit"] + F.greatest(F.lit(0), h["first"] + h["words"] - F.greatest(s["end"], h["first"]))).alias("hit"),
                                              F.greatest(s["end"], h["first"] + h["words"]).alias("end")), lambda s: s["hit"])
    hits = (found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", F.col("n").alias("words")))).alias("hits"))
            .withColumn("n_hit", cover))
    owners = tokens.where("item_id is not null").select("words", "item_id").distinct()
    listed = (found.select("row", "words").distinct().join(owners, "words").select("row", "item_id").distinct()
              .groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids")))
    none = F.array().cast("array<string>")
    no_hits = F.array().cast("array<struct<first:long,words:long>>")
    return (scanned.select("row", "doc_id", "text_key", "n_words").join(hits, "row", "left").join(listed, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size(F.coalesce("item_ids", none)), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("hits", no_hits).alias("hits"), "text_key"))


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """A row per shingle of each window of each item."""
    for batch in batches:
        for at, to in slices(batch["text"]):
            part = batch.slice(at, to - at)
            w = Words(*utf8(part["text"]), ALNUM_LOWER)
            low, rows = _lower(w), {"item_id": [], "words": [], "n": [], "offset": [], "h": []}
            by_size = {}
            for i, item in enumerate(part["item_id"].to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if a == b:
                    continue
                n = min(window, b - a)
                k = min(shingle, n)
                if k not in by_size:
                    by_size[k] = dict(zip(*(x.tolist() for x in _shingles(w, k))))
                words = [low[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b])]
                for s in range(b - a - n + 1):
                    joined = " ".join(words[s:s + n])
                    for o in range(n - k + 1):
                        rows["item_id"].append(item), rows["words"].append(joined), rows["n"].append(n)
                        rows["offset"].append(o), rows["h"].append(by_size[k][a + s + o])
            yield pa.record_batch(rows, pa.schema([("item_id", pa.string()), ("words", pa.string()), ("n", pa.int32()), ("offset", pa.int32()), ("h", pa.int64())]))


def _shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, h = w.windows(size, _BY)
    return at, h.view(np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch], sizes: list[int], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """In how many documents of the batch each wanted shingle is."""
    for batch in batches:
        for at, to in slices(batch["text"]):
            w = Words(*utf8(batch["text"].slice(at, to - at)), ALNUM_LOWER)
            text, hashes = w.text_of(), []
            for size in sizes:
                first, h = _shingles(w, size)
                hit = probe(wanted, h.view(np.uint64))
                pairs = np.unique(np.stack([h[hit], text[first[hit]]]), axis=1)
                hashes.append(pairs[0])
            h, n = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.int64), return_counts=True)
            yield pa.record_batch({"h": h, "n": n.astype(np.int64)})


def _candidates(batches: Iterator[pa.RecordBatch], sizes: list[int], wanted: np.ndarray, window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Each document with the places of wanted shingles and the words around them."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("from", pa.int64()), ("around", pa.string())]))
    for batch in batches:
        for start, to in slices(batch["text"]):
            part = batch.slice(start, to - start)
            w = Words(*utf8(part["text"]), ALNUM_LOWER)
            low, text = None, w.text_of()
            places: list[list[dict]] = [[] for _ in range(len(part))]
            for size in sizes:
                first, h = _shingles(w, size)
                for p in np.flatnonzero(probe(wanted, h.view(np.uint64))):
                    low = low or _lower(w)
                    at, t = int(first[p]), int(text[first[p]])
                    a, b = max(int(w.first[t]), at - (window - shingle)), min(int(w.first[t + 1]), at + window)
                    around = b" ".join(low[w.starts[i]:w.ends[i]] for i in range(a, b))
                    places[t].append({"h": int(h[p]), "at": at - int(w.first[t]), "from": a - int(w.first[t]), "around": around.decode()})
            yield pa.record_batch({"row": part["row"], "doc_id": part["doc_id"], "text_key": part["text_key"], "n_words": w.counts().astype(np.int64), "places": pa.array(places, kind)})
