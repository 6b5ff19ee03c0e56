"""Numbers of tokens: pieces are counted once per distinct pre-token and summed by each document's pre-token counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices

DEFAULT_MODEL = "piece_bpe_32k.model"
_SLICE = 1 << 20  # characters split at a time
_SPACE, _PROBE = "▁", " a  ﬁ　Ａ "


class PreTokens:
    """Runs that no piece crosses, and the number of pieces of a run as the model's own library gives it.

    Merges join neighbours into pieces of the vocabulary alone. Where no piece holds two characters side by side, none
    reaches from one to the other, so a text is cut there and its parts are encoded independently.
    """

    def __init__(self, file: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [m.id_to_piece(i).replace(_SPACE, " ") for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any("\n" in p for p in pieces) or m.decode(m.encode(_PROBE)) != _PROBE:
            raise ValueError(f"{file}: pieces hold line feeds, or its normaliser changes texts")
        pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.place = np.zeros(0x110000, np.uint16)  # 0: alone in every piece
        for i, c in enumerate(sorted({c for p in pairs for c in p}), 1):
            self.place[ord(c)] = i
        self.beside = np.zeros((int(self.place.max()) + 1,) * 2, bool)
        for a, b in pairs:
            self.beside[self.place[ord(a)], self.place[ord(b)]] = True
        self.before = len(m.encode("\n"))

    def of(self, text: str) -> Iterator[list[str]]:
        """The runs of a text with the space that the library puts before it, some at a time."""
        text = " " + text.replace(_SPACE, " ") if text else ""
        at, size = 0, _SLICE
        while at < len(text):
            part = text[at:at + size]
            k = self.place[np.frombuffer(part.encode("utf-32-le"), np.uint32)]
            cuts = (np.flatnonzero(~self.beside[k[:-1], k[1:]]) + 1).tolist()
            if at + len(part) == len(text):
                cuts.append(len(part))
            if not cuts:  # one run fills the part: take more of it
                size *= 2
                continue
            yield [part[a:b] for a, b in pairwise([0, *cuts])]
            at, size = at + cuts[-1], _SLICE

    def count(self, runs: list[str]) -> list[int]:
        """Pieces of each run; a line feed before it keeps the library's own space out of it."""
        return [len(ids) - self.before for ids in self.model.encode(["\n" + r for r in runs], num_threads=1)]


@cache
def _loaded(file: str) -> PreTokens:
    return PreTokens(file)


def tokenizer_file(name: str) -> str:
    """The file of a public vocabulary by name; a path stays."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, model: str = DEFAULT_MODEL, limit: int = 4096, block_bytes: int = 32 << 20) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): one row per input row.

    Tokens are those of the library's encode() without begin or end; strings of special tokens in a text are plain text
    to it. ``model`` is a name of a public vocabulary or a path that every executor can read; it must keep spaces at the
    front of pieces and leave texts as they are, else a ValueError is raised.

    Neighbouring documents are packed into blocks of about ``block_bytes``. A block reports each distinct pre-token once,
    so that no pre-token has more rows than there are blocks. The reports of a pre-token meet and lie together,
    so each distinct one of all is counted once; the counts go back to the blocks, which join them to each document's
    pre-token frequencies and sum. One
    exchange of the packed texts serves both passes. No ids are made but those of one pre-token at a time.

    Null or empty text: no tokens. Null or repeated doc_id: rows are independent. Empty table: no rows. Other columns
    are ignored. A text, and a run without spaces, must fit in a task's memory.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], block_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                    out.write_batch(batch.slice(a, b - a).cast(schema))
                packed = sink.getvalue().to_pybytes()
                yield pa.record_batch({"block": pa.array([int.from_bytes(blake2b(packed, digest_size=8).digest(), "little", signed=True)]), "packed": pa.array([packed], pa.binary())})

    def unpack(table: pa.Table) -> pa.Table:
        return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["packed"]])

    def report(key, table):
        read, seen = _loaded(tokenizer_file(model)), set()
        for text in unpack(table)["text"]:
            for runs in read.of(text.as_py()):
                seen.update(runs)
        runs = sorted(seen)
        return pa.table({"block": pa.repeat(key[0], len(runs)), "place": pa.array(range(len(runs)), pa.int32()), "run": pa.array(runs, pa.string())})

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, last = _loaded(tokenizer_file(model)), {}
        for batch in batches:
            coded = batch["run"].dictionary_encode()
            runs = coded.dictionary.to_pylist()
            fresh = [r for r in runs if r not in last]  # rows of a run lie together, also across batches
            pieces = last | dict(zip(fresh, read.count(fresh)))
            last = {r: pieces[r] for r in runs[-1:]}
            yield pa.record_batch({"block": batch["block"], "place": batch["place"], "pieces": pa.array([pieces[r] for r in runs], pa.int32()).take(coded.indices)})

    def total(key, texts, answers):
        read, texts, known, found = _loaded(tokenizer_file(model)), unpack(texts), {}, []
        for text in texts["text"]:
            own = Counter()
            for runs in read.of(text.as_py()):
                own.update(runs)
            ids = np.fromiter((known.setdefault(r, len(known)) for r in own), np.int32, len(own))
            found.append((ids, np.fromiter(own.values(), np.int32, len(own))))
        order = np.array(sorted(range(len(known)), key=list(known).__getitem__), np.int64)
        pieces = np.empty(len(known), np.int64)
        pieces[order[answers["place"].to_numpy()]] = answers["pieces"].to_numpy()
        tokens = [int(pieces[ids] @ n) for ids, n in found]
        return pa.table({"doc_id": texts["doc_id"], "n_bytes": pc.binary_length(texts["text"]).cast(pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    dealt = docs.mapInArrow(pack, "block long, packed binary")
    reports = dealt.groupBy("block").applyInArrow(report, "block long, place int, run string")
    answers = reports.repartition("run").sortWithinPartitions("run").mapInArrow(lengths, "block long, place int, pieces int")
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    over: Column = F.col("n_tokens") > F.lit(limit)
    return out.withColumn("over_limit", over)
