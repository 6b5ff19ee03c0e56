"""Encoding of texts into the pieces of a SentencePiece vocabulary and back: best paths by a max-plus scan.

The lattice is that of the unigram algorithm over the model's pieces and scores: a space is put before the text, pieces
hold spaces, and a character without a piece of its own costs the least score less 10 and becomes byte pieces. Of equal
paths the one whose last piece is longest wins, then the one whose piece before that is longest, and so on.

A long text is split into chunks anywhere. The state at a border is the number of characters by which a piece reaches
into the next chunk. A chunk gives a matrix of best scores from each state at its start to each state at its end; these
are combined by the associative max-plus product, which names the state at every border; then every chunk finds its own
path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.runtime import cut

from .words import hash_spans, slices, utf8

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
_LONGEST_UNIT = 64  # bytes; longer units are rare and take the plain loop
_NONE = float("-inf")


class Pieces:
    """A vocabulary: ``known`` maps a string to (score, id), with spaces as spaces; ``raw`` has each id's bytes."""

    def __init__(self, rows: list[tuple[str, float, str]]):
        self.known, self.byte, self.raw = {}, {}, []
        for i, (piece, score, kind) in enumerate(rows):
            text = piece.replace("▁", " ")
            if kind == "byte":
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif kind == "normal":
                self.known.setdefault(text, (score, i))
                self.raw.append(text.encode())
            else:
                self.raw.append(b"")
        self.longest = max(map(len, self.known), default=1)
        self.lacking = min((s for s, _ in self.known.values()), default=0.0) - 10
        self.begins = {p[:k] for p in self.known for k in range(1, len(p) + 1)}
        spaced = any(re.search(r"[^ ] ", p) for p in self.known)
        lined = any("\n" in p and len(p) > 1 for p in self.known)
        self.unit = re.compile("(?s).+" if spaced else "(?s) +[^ ]*|[^ ]+" if lined else r" +[^ \n]*|[^ \n]+|\n")
        self.simple = not spaced and not lined
        self.next = self.sizes = None

    def _build(self) -> None:
        """Tables for whole batches: a byte trie and each node's piece."""
        nodes, rows = {b"": 0}, []
        ids = [-1]
        for piece, (_, i) in self.known.items():
            raw = piece.encode()
            for k in range(1, len(raw) + 1):
                if raw[:k] not in nodes:
                    nodes[raw[:k]] = len(nodes)
                    ids.append(-1)
                    rows.append((nodes[raw[:k - 1]], raw[k - 1], nodes[raw[:k]]))
            ids[nodes[raw]] = i
        self.next = np.zeros((len(nodes), 256), np.int32)  # 0: no such prefix
        a, b, c = np.array(rows, np.int64).reshape(-1, 3).T
        self.next[a, b] = c
        self.piece_of = np.array(ids, np.int32)
        self.score_of = np.zeros(len(self.raw) + 1)
        for s, i in self.known.values():
            self.score_of[i] = s
        self.score_of[-1] = self.lacking
        self.byte_ids = np.array([self.byte.get(b, 0) for b in range(256)], np.int32)

    def _build_bytes(self) -> None:
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.bytes_at = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, given as the bytes of texts that begin where a unit begins; first id of each text."""
        if self.next is None:
            self._build()
        if not self.simple:
            coded = [np.frombuffer(self.spaced(data[a:b].tobytes().decode()), np.int32) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate([np.zeros(0, np.int32), *coded]), np.cumsum([0, *map(len, coded)])
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = (data[1:] == 10) | (data[:-1] == 10) | ((data[1:] == 32) & (data[:-1] != 32))
        begin[offsets] = True
        begin[-1] = False
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        h = hash_spans(data, starts, ends)
        _, some, which = np.unique(h, return_index=True, return_inverse=True)
        ids, first = self._units(data, starts[some], ends[some])
        count = np.diff(first)[which]
        at = np.cumsum(count) - count
        out = ids[np.repeat(first[:-1][which] - at, count) + np.arange(count.sum())]
        text_first = np.r_[at, len(out)][np.searchsorted(starts, offsets)]
        return out, text_first

    def _units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units and the first of each, all units in step."""
        n = ends - starts
        long = np.flatnonzero(n > _LONGEST_UNIT)
        plain = {int(k): np.frombuffer(self.path(data[starts[k]:ends[k]].tobytes().decode()), np.int32) for k in long}
        n = np.where(n > _LONGEST_UNIT, 0, n)
        base = np.cumsum(n + 1) - (n + 1)  # a unit has a slot for each of its positions and one for its end
        unit = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        source = starts[unit] + offset
        slot = base[unit] + offset
        left = n[unit] - offset
        # every prefix of a piece from every position
        node, live, size = np.zeros(len(unit), np.int32), np.arange(len(unit)), 0
        found = []
        width = np.select([data[source] >= 0xF0, data[source] >= 0xE0, data[source] >= 0xC0, data[source] >= 0x80], [4, 3, 2, 0], 1)
        lone = width > 0
        while len(live):
            node = self.next[node, data[source[live] + size]]
            size += 1
            good = node > 0
            live, node = live[good], node[good]
            hit = self.piece_of[node] >= 0
            found.append((live[hit], np.full(int(hit.sum()), size), self.piece_of[node[hit]]))
            lone[live[hit][width[live[hit]] == size]] = False
            good = left[live] > size
            live, node = live[good], node[good]
        alone = np.flatnonzero(lone)
        found.append((alone, width[alone], np.full(len(alone), -1, np.int32)))
        where, size, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(offset[where].astype(np.uint8), kind="stable")
        where, size, piece = where[order], size[order], piece[order]
        cuts = np.searchsorted(offset[where], np.arange(_LONGEST_UNIT + 1))
        best, back, by = np.full(int((n + 1).sum()), _NONE), np.zeros(int((n + 1).sum()), np.int64), np.full(int((n + 1).sum()), -1, np.int32)
        best[base] = 0.0
        for k in range(_LONGEST_UNIT):
            part = slice(cuts[k], cuts[k + 1])
            frm = slot[where[part]]
            to, value = frm + size[part], best[frm] + self.score_of[piece[part]]
            better = value > best[to]  # one piece of each size: no target twice
            best[to[better]], back[to[better]], by[to[better]] = value[better], frm[better], piece[part][better]
        # walk back, all units at once
        at, rows, steps = base + n, np.flatnonzero(n), []
        while len(rows):
            here = at[rows]
            steps.append((rows, back[here], here, by[here]))
            at[rows] = back[here]
            rows = rows[at[rows] > base[rows]]
        if steps:
            rank = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
            rows, frm, to, piece = (np.concatenate(x) for x in zip(*steps))
            order = np.lexsort((-rank, rows))
            rows, frm, to, piece = rows[order], frm[order], to[order], piece[order]
        else:
            rows = frm = to = np.zeros(0, np.int64)
            piece = np.zeros(0, np.int32)
        many = np.where(piece < 0, to - frm, 1)
        ids = np.repeat(piece, many)
        lead = np.repeat(starts[rows] + frm - base[rows], many) + np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
        ids = np.where(ids < 0, self.byte_ids[data[lead]] if len(ids) else ids, ids).astype(np.int32)
        count = np.bincount(rows, many, len(n)).astype(np.int64)
        first = np.r_[0, np.cumsum(count)]
        if plain:
            parts = [plain.get(k, ids[first[k]:first[k + 1]]) for k in range(len(n))]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, first

    def decode_many(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of several lists of ids, without the space put before a text."""
        if self.sizes is None:
            self._build_bytes()
        size = self.sizes[ids]
        at = np.cumsum(size) - size
        out = self.all_bytes[np.repeat(self.bytes_at[ids] - at, size) + np.arange(size.sum())]
        offsets = np.r_[at, len(out)][first]
        full = offsets[:-1] < offsets[1:]
        drop = np.zeros(len(out) + 1, bool)
        drop[offsets[:-1][full]] = out[offsets[:-1][full]] == 32
        gone = np.r_[0, np.cumsum(drop[:-1])]
        return out[~drop[:-1]], offsets - gone[offsets]

    def __reduce__(self):
        rows = [("", 0.0, "other")] * len(self.raw)
        for b, i in self.byte.items():
            rows[i] = (f"<0x{b:02X}>", 0.0, "byte")
        for p, (s, i) in self.known.items():
            rows[i] = (p, s, "normal")
        return Pieces, (rows,)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    def forward(self, text: str, stop: int, start: int = 0) -> tuple[list[float], list[int]]:
        """Best score of each position and where its last piece begins, from ``start``; pieces begin before ``stop``."""
        known, begins, lacking = self.known, self.begins, self.lacking
        n = min(len(text), stop + self.longest)
        best, back = [_NONE] * (n + 1), [-1] * (n + 1)
        best[start] = 0.0
        for i in range(start, stop):
            here = best[i]
            if here == _NONE:
                continue
            single = True
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                if piece not in begins:
                    break
                hit = known.get(piece)
                if hit is not None:
                    if j == i + 1:
                        single = False
                    if here + hit[0] > best[j]:
                        best[j], back[j] = here + hit[0], i
            if single and here + lacking > best[i + 1]:
                best[i + 1], back[i + 1] = here + lacking, i
        return best, back

    def ids(self, text: str, back: list[int], end: int, start: int = 0) -> bytes:
        out = []
        while end > start:
            i = back[end]
            hit = self.known.get(text[i:end])
            out += [hit[1]] if hit else [self.byte[b] for b in reversed(text[i:end].encode())]
            end = i
        return np.array(out[::-1], np.int32).tobytes()

    def path(self, text: str) -> bytes:
        """The ids of a unit as int32 bytes."""
        return self.ids(text, self.forward(text, len(text))[1], len(text))

    def spaced(self, text: str) -> bytes:
        """The ids of a text that begins where a unit begins, unit by unit."""
        return b"".join(map(self.path, self.unit.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.spaced(" " + text) if text else b"", np.int32)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def cuts(self, text: str, n: int) -> tuple[int, int]:
        """First and last place in 1..n that no piece can reach across; (n + 1, 0) if there is none."""
        places = [m.start() for m in self.unit.finditer(text) if 0 < m.start() <= n]
        return (places[0], places[-1]) if places else (n + 1, 0)

    def matrix(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best scores from each state at the start of text[:n] to each state at its end; which start is preferred
        among equals. ``text`` reaches beyond n by the length of a piece less one, if there is more. Scores are relative:
        what every path through the chunk has in common, between its first and last place to cut, is left out."""
        size = self.longest
        first, last = self.cuts(text, n)
        scores, ranks = np.full((size, size), _NONE), np.zeros((size, size), np.int32)

        def ends(best: list[float]) -> list[float]:
            return [best[n + s] if n + s < len(best) else _NONE for s in range(size)]

        if first > n:
            ways = [[] for _ in range(size)]
            for s in range(min(size, n + 1)):
                best, back = self.forward(text, n, s)
                scores[s] = ends(best)
                for e in range(size):
                    if scores[s, e] > _NONE:
                        ways[e].append((_lengths(back, n + e, s), s))
            for e in range(size):
                for r, (_, s) in enumerate(sorted(ways[e])):
                    ranks[s, e] = r
            for s in range(n + 1, size):  # a piece that covers the whole chunk
                scores[s, s - n] = 0.0
            return scores, ranks
        heads = []
        for s in range(min(size, first + 1)):
            best, back = self.forward(text[:first], first, s)
            heads.append((_lengths(back, first, s), s, best[first]))
        tail = np.array(ends([_NONE] * last + self.forward(text[last:], n - last)[0]))
        for r, (_, s, head) in enumerate(sorted(heads)):
            scores[s], ranks[s] = head + tail, r
        return scores, ranks

    def between(self, text: str, n: int, enter: int, leave: int) -> bytes:
        """The ids of the pieces that begin in text[:n], from one state to another."""
        if enter >= n:
            return b""
        first, last = self.cuts(text, n)
        if first > n or enter > first:
            return self.ids(text, self.forward(text, n, enter)[1], n + leave, enter)
        head = text[:first]
        middle = np.frombuffer(text[first:last].encode(), np.uint8)
        out = self.ids(head, self.forward(head, first, enter)[1], first, enter) + self.encode_many(middle, np.array([0, len(middle)]))[0].tobytes()
        tail = text[last:]
        return out + self.ids(tail, self.forward(tail, n - last)[1], n - last + leave)


def _lengths(back: list[int], end: int, start: int) -> list[int]:
    """Lengths of a path's pieces, the last first; the piece that reaches in from before is longer than any."""
    out = []
    while end > start:
        out.append(end - back[end])
        end = back[end]
    return [*out, 1 << 30]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of (stacks of) matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def prefixes(matrices: np.ndarray) -> np.ndarray:
    """All prefix products of a stack of matrices, in a logarithmic number of rounds."""
    out, step = matrices.copy(), 1
    while step < len(out):
        parts = range(step, len(out), 256)  # a bounded number of products at a time
        out[step:] = np.concatenate([product(out[i - step:i + 256 - step][:len(out) - i], out[i:i + 256]) for i in parts])
        step *= 2
    return out


def states(scores: np.ndarray, ranks: np.ndarray) -> list[int]:
    """The state at the start of each chunk on the best path of all, and 0 at the end."""
    # Only differences count; without the largest score of each chunk, sums over a long text stay exact.
    scores = scores - scores.max((1, 2), keepdims=True)
    reach = prefixes(scores)[:, 0, :]
    out = [0]
    for k in range(len(scores) - 1, 0, -1):
        total = reach[k - 1] + scores[k][:, out[-1]]
        equal = np.flatnonzero(total == total.max())
        out.append(int(equal[ranks[k][equal, out[-1]].argmax()]))
    return [0, *out[::-1]] if len(scores) > 1 else [0, 0]


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids array<int>: one row per input row.

    ``model`` is read on the driver; its pieces, a fixed number, are broadcast. Texts of more than ``chunk`` characters
    are split into chunks, which tasks share out. Null and empty texts have no pieces. U+2581 in a text is not a space
    and is encoded as bytes, so that every text can be decoded exactly. Null or repeated doc_id: rows are independent.
    Empty table: no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    reach = shared.value.longest - 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], 1 << 18):
                part = batch.slice(a, b - a)
                ids, first = shared.value.encode_many(*_led(*utf8(part["text"])))
                yield pa.record_batch({"doc_id": part["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.matrix(t, n) for t, n in zip(batch["part"].to_pylist(), batch["n"].to_pylist())]
            yield pa.record_batch({"row": batch["row"], "k": batch["k"], "scores": pa.array([s.tobytes() for s, _ in found], pa.binary()),
                                   "ranks": pa.array([r.tobytes() for _, r in found], pa.binary())})

    def scan(table):
        table = table.sort_by("k")
        size = shared.value.longest
        read = lambda c, t: np.stack([np.frombuffer(x, t).reshape(size, size) for x in table[c].to_pylist()])
        at = np.array(states(read("scores", np.float64), read("ranks", np.int32)), np.int32)
        return pa.table({"row": table["row"], "k": table["k"], "enter": at[:-1], "leave": at[1:]})

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("part", "n", "enter", "leave")]
            yield pa.record_batch({"row": batch["row"], "doc_id": batch["doc_id"], "k": batch["k"], "ids": _lists([shared.value.between(*x) for x in zip(*cols)])})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*[batch[c].to_pylist() for c in ("row", "doc_id", "text")]):
                for at in range(0, len(text), 64 * chunk):
                    firsts = range(at, min(at + 64 * chunk, len(text)), chunk)
                    yield pa.record_batch({"row": pa.array([row] * len(firsts), pa.int64()), "doc_id": pa.array([doc] * len(firsts), pa.int64()),
                                           "k": pa.array([f // chunk for f in firsts], pa.int32()), "part": pa.array([text[f:f + chunk + reach] for f in firsts], pa.string()),
                                           "n": pa.array([min(chunk, len(text) - f) for f in firsts], pa.int32())})

    short = docs.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids array<int>")
    long = docs.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(F.lit(" "), "text").alias("text"))
    pieces = long.mapInArrow(split, "row long, doc_id long, k int, part string, n int")
    pieces = cut(pieces.repartition("row", "k"))
    border = pieces.select("row", "k", "part", "n").mapInArrow(matrices, "row long, k int, scores binary, ranks binary")
    at = border.groupBy("row").applyInArrow(scan, "row long, k int, enter int, leave int")
    coded = pieces.join(at, ["row", "k"]).mapInArrow(paths, "row long, doc_id long, k int, ids array<int>")
    joined = (coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
              .select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")))
    return short.unionByName(joined)


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Add text, the text of ``ids``. Null ids: null text. Other columns are kept, but for one named text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))
    encoded = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 32):
                part = batch.slice(at, 32)
                lists = part["ids"]
                first = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))]
                raw, offsets = shared.value.decode_many(np.asarray(lists.flatten(), np.int64), first)
                texts = [None if not ok else raw[a:b].tobytes().decode("utf-8", "replace") for ok, a, b in zip(lists.is_valid().to_pylist(), offsets[:-1], offsets[1:])]
                yield part.append_column("text", pa.array(texts, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")


def _led(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each, but for empty ones."""
    full = np.diff(offsets) > 0
    moved = offsets + np.r_[0, np.cumsum(full)]
    out = np.full(len(data) + int(full.sum()), 32, np.uint8)
    text = np.ones(len(out), bool)
    text[moved[:-1][full]] = False
    out[text] = data
    return out, moved


def _lists(rows: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) // 4 for x in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))
