"""Product codes, token counts and importance resampling against plain models: real rows, odd rows, empty tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxweave.llm import importance, queries, token_counts, vector_codes

from .test_operators import SF, odd_rows

VECTORS = "vec_id long, embedding array<float>, label int, codes int, salt string"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


# -- product codes -----------------------------------------------------------------------
def coded(rows, parts=4, entries=256, rounds=4, scale=1024):
    """vec_id, code, error, label_error, digest by plain loops over whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    split = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(s[p]) for s in split[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    best = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for s in split:
                groups.setdefault(best(s[p], books[p]), []).append(s[p])
            for k, some in groups.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = [[best(s[p], books[p]) for p in range(parts)] for s in split]
    errors = [sum(far(s[p], books[p][c[p]]) for p in range(parts)) for s, c in zip(split, codes)]
    labels = Counter()
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] += e
    return [(i, "".join(f"{x:02x}" for x in c), e, labels[lab], digest) for (i, _, lab), c, e in zip(kept, codes, errors)]


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)], i % 3 if i % 7 else None) for i in range(60)]
    same = rows[3][1]
    rows += [(100 + i, list(same), 1) for i in range(40)]  # many equal vectors
    rows += [(7, rows[8][1], 1), (7, rows[9][1], 2), (7, rows[9][1], 2), (None, rows[10][1], None), (None, rows[10][1], None)]
    rows += [(200, None, 1), (201, [None] * 8, 1), (202, [float("nan")] * 8, 1), (203, [1.0] * 7 + [float("inf")], 0), (204, [0.5, -0.5] * 4, None), (205, [-0.0] * 8, 0)]
    return rows


@pytest.mark.parametrize("entries,rounds,block", [(5, 4, 4096), (16, 3, 13), (256, 2, 64)])
def test_codes_equal_model(spark, entries, rounds, block):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, -1, "x") for r in rows], VECTORS).repartition(3)
    got = vector_codes.codes_and_errors(df, entries=entries, rounds=rounds, block=block)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(got) == Counter(coded(rows, entries=entries, rounds=rounds))


def test_codes_of_nothing_and_of_other_lengths(spark):
    assert vector_codes.codes_and_errors(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.codes_and_errors(spark.createDataFrame([(1, None, 1, 0, ""), (2, [], 1, 0, "")], VECTORS)).collect() == []
    mixed = spark.createDataFrame([(1, [0.1] * 8, 1, 0, ""), (2, [0.1] * 4, 1, 0, "")], VECTORS)
    assert [r["vec_id"] for r in vector_codes.codes_and_errors(mixed).collect()] == [1]
    with pytest.raises(ValueError, match="do not divide"):
        vector_codes.codes_and_errors(spark.createDataFrame([(1, [0.1] * 6, 1, 0, "")], VECTORS))


def test_tree_covers_its_points():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (12, 6))
    points = np.concatenate([centres[rng.integers(0, 12, 900)] + rng.integers(-6, 7, (900, 6)), np.tile(centres[:1], (200, 1))])
    tree = vector_codes.CoverTree.build(points)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and (points[tree.order] == tree.points).all()
    for k in range(len(tree.begin)):
        under = tree.points[tree.begin[k]:tree.end[k]]
        assert np.sqrt(((under - tree.points[tree.centre[k]]) ** 2).sum(1)).max() <= tree.radius[k] + 1e-9
        below = range(tree.child[k], tree.child[k] + tree.children[k])
        if tree.children[k]:
            assert tree.begin[below[0]] == tree.begin[k] and tree.end[below[-1]] == tree.end[k]
            middle = tree.points[tree.centre[list(below)]]
            gaps = np.sqrt(((middle[:, None] - middle[None]) ** 2).sum(2)) + np.eye(len(middle)) * 1e9
            assert gaps.min() >= tree.radius[list(below)].max() - 1e-9  # no two centres are nearer than any point to its own
    far = ((points[:, None] - centres[None]) ** 2).sum(2)
    code, error = tree.codes(centres)
    assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
    whole, _, exact, _ = tree.assign(centres)
    assert len(exact) == 0 and len(whole) < 60  # clusters are given whole


def test_large_components_stay_exact():
    points = np.array([[200_000_000, 1, 2, 3], [-200_000_000, 1, 2, 3], [200_000_001, 1, 2, 3]])
    assert vector_codes.squares(points, points)[0].tolist() == [0, 400_000_000 ** 2, 1]
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.squares(points * 20, points)


# -- token counts ------------------------------------------------------------------------
def token_rows(rows, limit=4096):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_file(token_counts.DEFAULT_MODEL))
    return Counter((i, len((t or "").encode()), n, n > limit) for i, t in rows for n in [len(model.encode(t or ""))])


ODD_TEXTS = [(20, " "), (21, "  a  b "), (22, "▁a▁▁b"), (23, "</s><s><unk><0x0A>"), (24, "\x00\t\r\n"), (25, "日本語のテキスト"), (26, "a" * 70_000), (27, "2024-12-31"), (None, "x"), (None, "x")]


def test_token_counts_equal_library(spark):
    rows = odd_rows() + ODD_TEXTS
    df = spark.createDataFrame([(*r, 1, "b", "r") for r in rows], "doc_id long, text string, n_tokens int, block string, run string")
    got = token_counts.count_tokens(df.repartition(3), limit=100, block_bytes=50_000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(got) == token_rows(rows, 100)
    assert token_counts.count_tokens(df.limit(0)).collect() == []


def test_token_query_equals_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.QUERIES["op12_token_counts"](spark, SF)) == token_rows(rows)


def test_runs_rejoin_to_the_text(monkeypatch):
    monkeypatch.setattr(token_counts, "_SLICE", 5)
    read = token_counts.PreTokens(token_counts.tokenizer_file(token_counts.DEFAULT_MODEL))
    for _, text in odd_rows()[:1] + ODD_TEXTS:
        runs = [r for some in read.of(text[:3000]) for r in some]
        assert "".join(runs) == " " + text[:3000].replace("▁", " ")


# -- importance resampling ---------------------------------------------------------------
def grams(text, longest):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, longest, buckets, least, percent, seed):
    bucket = lambda g: crc32(g.encode()) % buckets
    source = Counter(bucket(g) for _, x in docs for g in grams(x, longest)[1])
    wanted = Counter(bucket(g) for _, x in target for g in grams(x, longest)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        words, found = grams(x, longest)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    ranks = {}
    for k, r in enumerate(fit[:percent * len(fit) // 100], 1):
        ranks.setdefault(r, []).append(k)
    return Counter((*r[:4], (ranks.get(r) or [None]).pop(0) if ranks.get(r) else None) for r in out)


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 40), (3, 100), (1, 0)])
def test_resample_equals_model(spark, longest, percent):
    rows = odd_rows() + [(None, "alpha beta " * 12), (None, "alpha beta " * 12), (16, "É ÀB x\ny"), (17, "tail beta " * 30), (17, "tail beta " * 30)]
    target = [(1, "alpha beta x1"), (2, None), (3, ""), (None, "日本 É tail tail")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, rank int").repartition(4)
    items = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(docs, items, longest=longest, buckets=50, least_words=5, percent=percent, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == drawn(rows, target, longest, 50, 5, percent, 7)


def test_resample_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resample(empty, some).collect() == []
    assert rows_of(importance.resample(some, empty, least_words=1, percent=50)) == drawn([(1, "a b"), (2, None)], [], 1, 10_000, 1, 50, 2024)


@pytest.mark.parametrize("at_once", [1, 3, 1 << 18])
def test_ngrams_stay_within_documents(monkeypatch, at_once):
    monkeypatch.setattr(importance, "_AT_ONCE", at_once)
    texts = ["a b c", None, "", "d", "E f!g h", "..", "i"]
    found = [(int(d), int(b)) for docs, at, _ in importance.features(pa.array(texts, pa.string()), 3, 1 << 32) for d, b in zip(docs, at)]
    assert Counter(found) == Counter((i, crc32(g.encode())) for i, x in enumerate(texts) for g in grams(x, 3)[1])


def test_query_ranks(spark):
    got = queries.QUERIES["op13_importance"](spark, SF)
    ranks = sorted(r["rank"] for r in got.where(F.col("rank").isNotNull()).collect())
    fit = got.where("n_features >= 20").count()
    assert ranks == list(range(1, 10 * fit // 100 + 1))
