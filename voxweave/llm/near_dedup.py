"""Near-duplicate documents: b-bit MinHash signatures, candidates by bands, links confirmed on full shingle sets.

1. Each document's set of word shingles gets a key of 128 bits. Equal sets form a class, which its first row stands for.
2. A class has ``BANDS`` band keys over its minima, and the low bits of the minima packed into a signature.
3. In each band bucket all classes are paired with the bucket's first class. Signatures estimate the similarity; pairs
   that may reach the threshold are confirmed on the full sets, and links are contracted to components.
4. A bucket whose classes fell into several components may hide links among the others. Such buckets are joined to
   clusters; a cluster is dealt into blocks of bounded size, and each pair of blocks compares, on full sets, the pairs
   of different components that the signatures let through. Buckets that are one component by then, such as those of a
   large group of near copies, need no further comparison. No pair is left out for the size of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxweave.runtime import cut

from .components import components
from .probe import bitmap, probe
from .words import SPACED_LOWER, Words, constants, mix, slices, utf8

MINIMA, BANDS, BITS = 192, 64, 4
_BY, _SALTS, _BLOCK, _LARGE = 0x9FB21C651E98DF25, 16, 512, 1000


def near_duplicates(docs: DataFrame, threshold: float = 0.85, shingle: int = 5) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    docs(doc_id, text, ...) -> doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included),
    kept (doc_id = component_id), text_key (hash of the text, which with doc_id names the row). One row per input row.

    Words are folded to lower case (A-Z). A set holds the distinct runs of ``shingle`` words; a text of fewer words is
    one run. Null and wordless texts have an empty set and no links. Null doc_id: never the smallest of a component
    unless all are null; then component_id is null and the row is kept. Rows that repeat a doc_id are separate nodes
    with that id; all of them are kept if the id is the component's. Empty table: no rows. Other columns are ignored.

    Band keys take so many minima that a pair at the threshold shares at least one key with a probability above
    0.9999. Signatures reject a pair only if the estimate is five deviations below the threshold. Similarity is the
    exact quotient of set sizes over shingle hashes of 64 bits.
    """
    sketches, at_class = _grouped(docs, threshold, shingle)
    several = at_class.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    named = _named(at_class, several)
    return (sketches.select("row", "doc_id", "text_key", "n_shingles").join(named.withColumn("_in", F.lit(True)), "row", "left")
            .withColumn("component_id", F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key"))


def one_of_each(docs: DataFrame, threshold: float = 0.85, shingle: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text_key, n_shingles, one: as :func:`near_duplicates`, but ``one`` is true for
    just one row of each component, that of the smallest doc_id (null ids last) and of these the first. Wordless texts
    have no component: always true."""
    sketches, at_class = _grouped(docs, threshold, shingle)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    several = at_class.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.col("first.row").alias("first"))
    return (sketches.select("row", "doc_id", "text_key", "n_shingles").join(_named(at_class, several), "row", "left")
            .select("doc_id", "text_key", "n_shingles", F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("one")))


def _named(at_class: DataFrame, several: DataFrame) -> DataFrame:
    """Rows of components of several rows, with the columns of ``several``."""
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return at_class.select("row", "root").withColumn("salt", F.pmod(F.hash("row"), F.lit(_SALTS))).join(several, ["root", "salt"], "inner").drop("root", "salt")


def _grouped(docs: DataFrame, threshold: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their signatures, and the rows with words (row, doc_id, root) with the root of their component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows_per_band = max(1, int(log(0.19) / log(threshold)))
    sketches = cut(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("text_key", F.xxhash64("text")).mapInArrow(
        lambda it: _sketch(it, shingle, rows_per_band),
        "row long, doc_id long, text_key long, n_shingles long, set_key binary, bands binary, bits binary"))
    full = sketches.where("n_shingles > 0")
    groups = full.groupBy("set_key").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("n"))
    shared = groups.where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = full.select("row", "doc_id", "set_key", F.pmod(F.hash("row"), F.lit(_SALTS)).alias("salt"))
    member = cut(salted.join(shared, ["set_key", "salt"], "left").select("row", "doc_id", F.coalesce("class", "row").alias("class")))
    copies = member.where("row <> class").select("row")
    classes = full.join(copies, "row", "left_anti").select(F.col("row").alias("id"), "bands", "bits")

    keys = classes.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(
        i.alias("band"), F.substring("bands", 1 + 8 * i, F.lit(8)).alias("key")))).alias("k")).select("id", F.xxhash64("k.band", "k.key").alias("key"))
    buckets = cut(_star(keys))
    least = threshold - 5 * (threshold * (1 - threshold) / MINIMA) ** 0.5 / (1 - 2.0 ** -BITS) ** 0.5
    star = _estimated(buckets.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes, least)
    links = cut(_confirmed(star, docs, sketches, threshold, shingle))
    label = components(links)

    known = buckets.join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_keys = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("hub")).where("low < high")
    rest = cut(known.join(open_keys.select("key", "hub"), "key").select("hub", "id", "root").distinct())
    more = _clusters_confirmed(rest, classes, docs, sketches, threshold, least, shingle)
    # The further links join components that are known: only their roots take part.
    upper = components(_rooted(more, label))
    roots = label.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = upper.join(label.select("node"), "node", "left_anti")
    roots = roots.unionByName(alone)

    at_class = (member.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("row", "doc_id", F.coalesce("root", "class").alias("root")))
    return sketches, cut(at_class)


def _rooted(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links between the roots of their ends."""
    for end in ("a", "b"):
        named = label.select(F.col("node").alias(end), F.col("root").alias("to"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return links.select("a", "b")


def _star(keys: DataFrame) -> DataFrame:
    """keys(id, key) -> key, hub, id: each row of a bucket of several but the bucket's smallest id, with that id."""
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    large = bitmap(hubs.where(F.col("n") > _LARGE).select("key"), F.col("key"), 16)
    # One test of the key decides for both sides: a small bucket that shares its low bits with a large one is dealt too.
    hubs = hubs.withColumn("salt", F.explode(F.when(_may(large), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salted = keys.withColumn("salt", F.when(_may(large), F.pmod(F.hash("id"), F.lit(_SALTS))).otherwise(0))
    return salted.join(hubs, ["key", "salt"]).where("id <> hub").select("key", "hub", "id")


def _may(large: np.ndarray) -> Column:
    """Whether the bitmap of large buckets has the bit of ``key``."""
    if not large.any():
        return F.lit(False)
    words = F.array(*[F.lit(int(x)) for x in large.view(np.int64)])
    low = F.col("key").bitwiseAND(F.lit((64 * len(large)) - 1))
    word = F.element_at(words, F.shiftright(low, 6).cast("int") + 1)
    return F.call_function("shiftright", word, low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _sets(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each text's begin."""
    n = w.counts()
    at, h = w.windows(shingle, _BY)
    text = w.text_of()[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < shingle))
    extra = np.zeros(len(short), np.uint64)
    for k in range(1, shingle):
        first, hk = w.windows(k, _BY)
        whole = np.searchsorted(first, w.first[short[n[short] == k]])
        extra[n[short] == k] = hk[whole]
    h, text = np.concatenate([h, extra]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(n) + 1))


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int, per_band: int) -> Iterator[pa.RecordBatch]:
    factors, shifts = constants(MINIMA, 7) | np.uint64(1), constants(MINIMA, 11)
    chosen = np.stack([np.argsort(constants(MINIMA, 1000 + b))[:per_band] for b in range(BANDS)])
    for batch in batches:
        for at, to in slices(batch["text"], 1 << 20):
            part = batch.slice(at, to - at)
            h, first = _sets(Words(*utf8(part["text"]), SPACED_LOWER), shingle)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            minima = np.empty((len(full), MINIMA), np.uint32)
            keys = np.empty((len(full), 2), np.uint64)
            if len(full):
                head = first[:-1][full]
                for i in range(MINIMA):
                    minima[:, i] = np.minimum.reduceat(((h * factors[i] + shifts[i]) >> np.uint64(32)).astype(np.uint32), head)
                for i, seed in enumerate(constants(2, 13)):
                    keys[:, i] = np.add.reduceat(mix(h ^ seed), head) + sizes[full].astype(np.uint64)
            bands = np.zeros((len(full), BANDS), np.uint64)
            for i in range(per_band):
                bands = mix(bands + minima[:, chosen[:, i]])
            low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint8)
            packed = low[:, 0::2] | (low[:, 1::2] << 4)
            place = np.full(len(part), -1)
            place[full] = np.arange(len(full))
            pick = lambda x: pa.array([x[p].tobytes() if p >= 0 else None for p in place], pa.binary())
            yield pa.record_batch({"row": part["row"], "doc_id": part["doc_id"], "text_key": part["text_key"], "n_shingles": sizes.astype(np.int64),
                                   "set_key": pick(keys), "bands": pick(bands), "bits": pick(packed)})


def similarity_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (rows of bytes) by counting equal groups of bits."""
    x = np.bitwise_xor(a, b).view(np.uint64)
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(x).sum(-1) / MINIMA
    by_chance = 2.0 ** -BITS
    return (equal - by_chance) / (1 - by_chance)


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule out the threshold."""
    bits = classes.select("id", "bits")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("bits_a", "bits_b"))
                yield batch.select(["a", "b"]).filter(pa.array(similarity_estimate(a, b) >= least))

    both = (pairs.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), "a")
            .join(bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")), "b"))
    return cut(both.mapInArrow(keep, "a long, b long"))


def _set_table(ids: DataFrame, docs: DataFrame, sketches: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the sorted shingle hashes of the given classes, from their texts."""
    named = ids.join(sketches.select(F.col("row").alias("id"), "doc_id", "text_key"), "id")
    wanted = bitmap(named, F.xxhash64("doc_id", "text_key"), 23)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(probe(wanted, np.asarray(batch["at"]).view(np.uint64))))
            for start, to in slices(batch["text"]):
                part = batch.slice(start, to - start)
                h, first = _sets(Words(*utf8(part["text"]), SPACED_LOWER), shingle)
                yield pa.record_batch({"doc_id": part["doc_id"], "text_key": part["text_key"],
                                       "items": pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())})

    keyed = docs.withColumn("text_key", F.xxhash64("text")).withColumn("at", F.xxhash64("doc_id", "text_key"))
    found = keyed.mapInArrow(chosen, "doc_id long, text_key long, items binary")
    joined = named.alias("named").join(found.alias("found"), F.expr("named.doc_id <=> found.doc_id and named.text_key = found.text_key"))
    return cut(joined.select("named.id", "found.items").dropDuplicates(["id"]))


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= threshold * (len(a) + len(b) - common) - 1e-9


def _confirmed(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, threshold: float, shingle: int) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _set_table(ids, docs, sketches, shingle)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c: (np.frombuffer(x.as_buffer(), np.uint64) for x in batch[c])
            yield batch.select(["a", "b"]).filter(pa.array([_alike(x, y, threshold) for x, y in zip(read("set_a"), read("set_b"))], pa.bool_()))

    # A hub may have very many members: its set is repeated for some salts, and its members are dealt over them.
    salted = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(4)))
    hubs = pairs.select("a").distinct().withColumnRenamed("a", "id").join(sets, "id")
    hubs = hubs.select(F.col("id").alias("a"), F.col("items").alias("set_a"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("salt"))
    both = salted.join(sets.select(F.col("id").alias("b"), F.col("items").alias("set_b")), "b").join(hubs, ["a", "salt"])
    return both.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def _clusters_confirmed(rest: DataFrame, classes: DataFrame, docs: DataFrame, sketches: DataFrame, threshold: float, least: float, shingle: int) -> DataFrame:
    """Links between classes of different components that share a bucket."""
    clusters = components(rest.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    inside = (rest.select("id", "root").distinct().join(clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")), "id")
              .join(classes.select("id", "bits"), "id"))
    sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sets = _set_table(inside.select("id"), docs, sketches, shingle)
    dealt = (inside.join(sets, "id").join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("n") / _BLOCK).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    low = lambda i: F.least("block", i)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(low(i).alias("i"), F.greatest("block", i).alias("j")))
    spread = dealt.select("cluster", "id", "root", "block", "bits", "items", F.inline(pairs))

    def compare(table):
        ids, block = np.asarray(table["id"]), np.asarray(table["block"])
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        items = [np.frombuffer(x.as_buffer(), np.uint64) for c in table["items"].chunks for x in c]
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
        size = np.array([len(x) for x in items])
        _, start = np.unique(np.asarray(table["root"]), return_inverse=True)
        parent = np.arange(start.max() + 1)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out_a, out_b = [], []
        for x in left:
            others = right[right > x] if i == j else right
            others = others[start[others] != start[x]]
            small, large = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
            others = others[small >= threshold * large - 1e-9]
            if len(others):
                others = others[similarity_estimate(bits[others], bits[x]) >= least]
            for y in others:
                a, b = root(start[x]), root(start[y])
                if a != b and _alike(items[x], items[y], threshold):
                    parent[b] = a
                    out_a.append(int(ids[x])), out_b.append(int(ids[y]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return cut(spread.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long"))
