"""Personal data in texts: exact patterns, and a character-level bidirectional LSTM with a CRF that finds more.

The network is trained in numpy on labelled spans in a bounded sample of texts: the patterns' own, and spans set in at
spaces in the ways of writing that the patterns do not know (other separators, national and 00 prefixes, addresses with
spelled-out signs), beside numbers that are no personal data. All four kinds hold a digit, an at sign or a bracketed
"at", so the windows that it reads are laid around those of the whole text; where there is none, nothing can be found
and nothing is computed. Windows overlap by half. Each is decoded on its own, and a character takes its tag from the
window in which it is most central; spans are read off the reconciled tags, grown or trimmed to whole words, and kept
if they hold for their kind.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import constants, slices, utf8

#: The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, CONTEXT = 48, 24, 12
_TAGS = 1 + 2 * len(KINDS)  # outside, and first and further characters of each kind
_CLASSES = 32

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[(\[]at[)\]]", re.I)
#: What a span of the network must look like, besides its digits.
_SHAPES = (re.compile(r"[\w.%+-]+(?: ?@ ?| ?[(\[]at[)\]] ?)[\w-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]+)+", re.I),
           re.compile(r"[0-9]{1,3}(\.|,| \. |\[\.\]|\(\.\))[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}"),
           re.compile(r"[0-9](?:[ .-]?[0-9])+"),
           re.compile(r"\+? ?(?:[ ./-]?(?:\([0-9]++\)|[0-9]++))++"))
LONGEST = 320  # characters of an address
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    total = sum(digits[-1::-2])
    return (total + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])) % 10 == 0


def _valid(kind: str, text: str) -> bool:
    """Whether the digits of a match of the patterns hold for its kind."""
    d = _digits(text)
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def settle(kind: int, start: int, end: int, text: str) -> tuple[int, int, int] | None:
    """A span of the network with its ends at those of its words, or None if it does not hold for its kind."""
    if kind == 0:
        while start > 0 and end - start <= LONGEST and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        while end < len(text) and end - start <= LONGEST and (text[end].isalnum() or text[end] == "-" or text[end] == "." and text[end + 1:end + 2].isalnum()):
            end += 1
    else:
        first = "0123456789(+" if kind == 3 else "0123456789"
        while start < end and text[start] not in first:
            start += 1
        while end > start and text[end - 1] not in "0123456789":
            end -= 1
        if kind == 3 and (prefix := re.search("(?<![0-9])(?:[+]|00)[0-9]{1,3}[ ./-]?$", text[max(start - 8, 0):start])):
            start -= len(prefix[0])
        ahead, behind = text[max(start - 2, 0):start], text[end:end + 2]
        if re.search(r"[\w+]$|[0-9][./-]$", ahead) or re.match(r"\w|[./:-][0-9]", behind):  # a part of something longer
            return None
        if " " in text[start:end] and (re.search("[0-9] $", ahead) or re.match(" [0-9]", behind)):
            return None
    if kind == 0 and end - start > LONGEST:
        return None
    found = text[start:end]
    shape, d = _SHAPES[kind].fullmatch(found), _digits(found)
    if not shape:
        return None
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        # Numbers with a comma at each thousand are no address.
        holds = all(int(p) <= 255 for p in parts) and not (shape[1] == "," and (all(len(p) == 3 for p in parts[1:]) or max(map(len, parts)) < 3))
        if not holds or shape[1] == "," and (re.search("[0-9],$", ahead) or re.match(",[0-9]", behind)):
            return None
    elif kind == 2 and not _valid("card", found):
        return None
    elif kind == 3:  # two gaps at least, or one behind a prefix; no list of years
        groups = re.findall("[0-9]+", found) if 9 <= len(d) <= 15 else []
        if len(groups) + (found[0] in "+0") < 3 or all(re.fullmatch("(19|20)[0-9][0-9]", g) for g in groups):
            return None
    return kind, start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; leftmost matches that don't overlap, failing ones left out."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            out.append((0, start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _valid("card", m.group())]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _classes(codes: np.ndarray) -> np.ndarray:
    """Classes of characters: digits 1, letters by five sets, signs one each, 0 for padding."""
    table = np.full(128, 2, np.int64)
    table[48:58] = 1
    table[65:91], table[97:123] = 3, 4
    for i, c in enumerate("@.-+() _%:/,;#$&*!?\n\t'\"=[]"):
        table[ord(c)] = 5 + i
    table[0] = 0
    return np.where(codes < 128, table[np.minimum(codes, 127)], 31)


class Tagger:
    """Embedded character classes, one LSTM in each direction, linear scores of tags, CRF transitions."""

    def __init__(self, hidden: int = 16, embedded: int = 8, seed: int = 5):
        draw = iter(np.split((constants(1 << 15, seed) >> np.uint64(11)) / 2.0 ** 53 * 2 - 1, 8))
        take = lambda n, shape, scale: (np.resize(next(draw), n) * scale).reshape(shape)
        h, e = hidden, embedded
        self.h = h
        self.p = {"E": take(_CLASSES * e, (_CLASSES, e), 0.5), "W": take(2 * (e + h) * 4 * h, (2, e + h, 4 * h), (e + h) ** -0.5),
                  "b": np.zeros((2, 1, 4 * h)), "V": take(2 * h * _TAGS, (2 * h, _TAGS), 0.3), "c": np.zeros(_TAGS), "T": np.zeros((_TAGS, _TAGS))}
        self.p["b"][:, :, h:2 * h] = 1

    def run(self, x: np.ndarray, keep: bool = False):
        """Scores of tags (batch, time, tag) of classes (batch, time)."""
        n, t, h = *x.shape, self.h
        emb = self.p["E"][x]
        both = np.stack([emb, emb[:, ::-1]])
        state, cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        out, steps = np.empty((2, n, t, h)), []
        for k in range(t):
            z = np.concatenate([both[:, :, k], state], -1)
            g = z @ self.p["W"] + self.p["b"]
            s = 1 / (1 + np.exp(-g[..., :3 * h]))
            i, f, o, u = s[..., :h], s[..., h:2 * h], s[..., 2 * h:], np.tanh(g[..., 3 * h:])
            before, cell = cell, f * cell + i * u
            c = np.tanh(cell)
            state = o * c
            out[:, :, k] = state
            if keep:
                steps.append((z, i, f, o, u, before, c))
        joined = np.concatenate([out[0], out[1][:, ::-1]], -1)
        scores = joined @ self.p["V"] + self.p["c"]
        return (scores, joined, steps) if keep else scores

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss (negative log-likelihood of the CRF) and its gradients."""
        n, t = x.shape
        scores, joined, steps = self.run(x, True)
        T = self.p["T"]
        # Forward and backward sums as probabilities, scaled at each character.
        top, P = scores.max(2, keepdims=True), np.exp(T - T.max())
        e, fwd, bwd, scale = np.exp(scores - top), np.empty_like(scores), np.ones_like(scores), np.empty((n, t, 1))
        for k in range(t):
            now = e[:, k] if k == 0 else (fwd[:, k - 1] @ P) * e[:, k]
            scale[:, k] = now.sum(1, keepdims=True)
            fwd[:, k] = now / scale[:, k]
        for k in range(t - 2, -1, -1):
            bwd[:, k] = (e[:, k + 1] * bwd[:, k + 1] / scale[:, k + 1]) @ P.T
        z = (np.log(scale) + top).sum((1, 2)) + (t - 1) * T.max()
        rows = np.arange(n)[:, None]
        gold = scores[rows, np.arange(t), y].sum(1) + T[y[:, :-1], y[:, 1:]].sum(1)
        dscore = fwd * bwd
        dscore[rows, np.arange(t), y] -= 1
        pair = P * np.tensordot(fwd[:, :-1], (e * bwd / scale)[:, 1:], ((0, 1), (0, 1)))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g = {"T": pair / n}
        dscore /= n
        h = self.h
        g["V"], g["c"] = np.tensordot(joined, dscore, ((0, 1), (0, 1))), dscore.sum((0, 1))
        dj = dscore @ self.p["V"].T
        dout = np.stack([dj[..., :h], dj[..., h:][:, ::-1]])
        gw, gb, de = np.zeros_like(self.p["W"]), np.zeros_like(self.p["b"]), np.zeros((2, n, t, self.p["E"].shape[1]))
        dstate, dcell, width = np.zeros((2, n, h)), np.zeros((2, n, h)), de.shape[-1]
        for k in range(t - 1, -1, -1):
            zin, i, f, o, u, before, c = steps[k]
            ds = dout[:, :, k] + dstate
            dc = ds * o * (1 - c * c) + dcell
            dg = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), ds * c * o * (1 - o), dc * i * (1 - u * u)], -1)
            gw += zin.transpose(0, 2, 1) @ dg
            gb += dg.sum(1, keepdims=True)
            dz = dg @ self.p["W"].transpose(0, 2, 1)
            de[:, :, k], dstate, dcell = dz[..., :width], dz[..., width:], dc * f
        g["W"], g["b"], g["E"] = gw, gb, np.zeros_like(self.p["E"])
        np.add.at(g["E"], x, de[0] + de[1][:, ::-1])
        return float((z - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, updates: int = 500, batch: int = 96, rate: float = 0.02) -> float:
        """Adam over windows in a fixed order; the last batch's loss."""
        first, second, loss = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0.0
        m, v = first
        order = np.argsort(constants(len(x), 17))
        for k in range(updates):
            pick = order[np.arange(k * batch, (k + 1) * batch) % len(x)]
            loss, g = self.step(x[pick], y[pick])
            norm = np.sqrt(sum((d * d).sum() for d in g.values()))
            step = rate * (1 - k / updates) + 1e-4
            for name, d in g.items():
                d = d * min(1.0, 5 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.99 * v[name] + 0.01 * d * d
                self.p[name] = self.p[name] - step * (m[name] / (1 - 0.9 ** (k + 1))) / (np.sqrt(v[name] / (1 - 0.99 ** (k + 1))) + 1e-8)
        return loss

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags of each window."""
        scores, T = self.run(x), self.p["T"]
        best, back = scores[:, 0], np.empty(scores.shape, np.int64)
        for k in range(1, x.shape[1]):
            both = best[:, :, None] + T
            back[:, k] = both.argmax(1)
            best = both.max(1) + scores[:, k]
        tags = np.empty(x.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        for k in range(x.shape[1] - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(len(x)), k, tags[:, k]]
        return tags


def _windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of overlapping windows around digits and at signs of the whole text, and its character codes."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    marks = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    spelled = [m.start() + 1 for m in _AT.finditer(text)]
    if spelled:
        marks = np.concatenate([marks, spelled])
    # cell i is text[i * STRIDE:(i + 1) * STRIDE]; windows start at cells and are two cells long
    near = np.unique(np.concatenate([(marks + d) // STRIDE for d in (-CONTEXT, 0, CONTEXT)]))
    starts = np.unique(np.concatenate([near - 1, near])) * STRIDE
    return starts[(starts > -WINDOW) & (starts < len(codes))], codes


def _cells(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    return np.where((at >= 0) & (at < len(codes)), _classes(codes[np.clip(at, 0, len(codes) - 1)]), 0)


def _spans(tags: np.ndarray, starts: np.ndarray, text: str) -> list[tuple[int, int, int]]:
    """Spans of tags; a character's tag is that of the window whose middle is nearest."""
    quarter = STRIDE // 2
    middle = tags[:, quarter:quarter + STRIDE].ravel()
    at = (starts[:, None] + quarter + np.arange(STRIDE)).ravel()
    good = (at >= 0) & (at < len(text)) & (middle > 0)
    out = []
    for p, tag in zip(at[good].tolist(), middle[good].tolist()):
        kind, begins = (tag - 1) // 2, tag % 2 == 1
        if out and out[-1][0] == kind and out[-1][2] == p and not begins:
            out[-1][2] = p + 1
        else:
            out.append([kind, p, p + 1])
    return [tuple(x) for x in out]


def written(kind: int, draw: random.Random) -> str:
    """Made-up personal data of a kind in one of many ways of writing."""
    digits = lambda n: "".join(draw.choices("0123456789", k=n))
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyzéüñ", weights=[9] * 26 + [1] * 3, k=draw.randint(2, 9)))
    if kind == 0:
        at, dot = draw.choice(["@", "@", " @ ", " (at) ", " [at] ", "(at)", "[at]", " (AT) "]), "."
        if "t" in at.lower() and draw.random() < 0.6:
            dot = at.lower().replace("at", "dot")
        name = draw.choice([".", "_", "-", ""]).join(word() for _ in range(draw.randint(1, 2))) + draw.choice(["", "", digits(2)])
        name = name.capitalize() if draw.random() < 0.2 else name
        return name + at + dot.join([word() for _ in range(draw.randint(1, 2))] + [draw.choice(["com", "org", "net", "de", "es", "fr"])])
    if kind == 1:
        return draw.choice([".", "[.]", "(.)", " . ", ","]).join(str(draw.choice([draw.randint(0, 255), draw.randint(100, 255)])) for _ in range(4))
    if kind == 2:
        sizes, seps = draw.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (16,)]), draw.choice([" ", "-", ".", " -.", "-."])
        return "".join(digits(n) + draw.choice(seps) for n in sizes)[:-1]
    sep = draw.choice(" -./")
    return draw.choice([f"({digits(3)}) {digits(3)}{draw.choice(' -.')}{digits(4)}", sep.join([digits(3), digits(3), digits(4)]),
                        f"{draw.choice(['00', '+'])}{draw.randint(1, 99)} " + sep.join([digits(draw.randint(2, 3)), digits(draw.randint(3, 4)), digits(4)]),
                        sep.join(["0" + digits(draw.randint(1, 3)), digits(draw.randint(3, 4)), digits(4)]),
                        f"0{digits(draw.randint(2, 4))}/{digits(draw.randint(6, 8))}", f"+{draw.randint(1, 99)}-{digits(3)}-{digits(3)}-{digits(4)}"])


def harmless(draw: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    digits = lambda n: draw.choice("123456789") + "".join(draw.choices("0123456789", k=n - 1))
    year, month, day, hour, minute = draw.randint(1900, 2030), draw.randint(1, 12), draw.randint(1, 28), draw.randint(0, 23), draw.randint(0, 59)
    return draw.choice([
        f"{year}-{month:02}-{day:02}", f"{year}-{month:02}-{day:02} {hour:02}:{minute:02}", f"{day:02}.{month:02}.{year} {hour:02}:{minute:02}",
        f"{day:02}/{month:02}/{year}", f"{hour:02}:{minute:02}:{day:02}", f"{year}-{year + day}", f"{year} {year + 1} {year + 2}", f"{digits(3)},{digits(3)},{digits(3)}",
        f"{digits(1)},{digits(3)},{digits(3)},{digits(3)}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}",
        f"v{digits(1)}.{digits(2)}", f"#{digits(draw.randint(6, 12))}", digits(draw.randint(5, 12)), f"{digits(3)}-{digits(3)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        f"ISBN {digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(1)}, {digits(1)}, {digits(2)}, {digits(2)}", ",".join(digits(2) for _ in range(draw.randint(3, 8))),
        " ".join(digits(2) for _ in range(draw.randint(3, 7))), "".join(draw.choices("0123456789abcdef", k=32)), f"{digits(2)} x {digits(2)} = {digits(3)}",
        "(at) noon", "[at] home", "@ home", f"{digits(2)} @ {digits(1)}.{digits(2)}", f"A{digits(4)}-{digits(4)}-{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(2)}%"])


def planted(text: str, draw: random.Random, pieces: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with ``pieces`` made-up spans and harmless numbers set in at spaces, and all its spans with those of the patterns."""
    spans = base_spans(text)
    free = [i for i in draw.choices(range(len(text)), k=4 * pieces) if not any(s <= i < e for _, s, e in spans)] if text else []
    spots = {at for i in free if (at := text.find(" ", i, i + 200)) >= 0 and not any(s <= at < e for _, s, e in spans)}
    parts, labels, done, shift = [], [], 0, {}
    for at in sorted(draw.sample(sorted(spots), min(pieces, len(spots)))):
        kind = draw.randrange(-3, len(KINDS))
        piece = written(kind, draw) if kind >= 0 else harmless(draw)
        parts += [text[done:at], " ", piece]
        done, before = at, sum(shift.values())
        if kind >= 0:
            labels.append((kind, at + before + 1, at + before + 1 + len(piece)))
        shift[at] = len(piece) + 1
    moved = lambda p: p + sum(n for at, n in shift.items() if at < p)
    return "".join(parts) + text[done:], sorted(labels + [(k, moved(s), moved(s) + e - s) for k, s, e in spans])


def train(docs: DataFrame, sample: int = 600, windows: int = 6000, pieces: int = 5, passage: int = 20000) -> Tagger:
    """Train on a passage of at most ``passage`` characters of each of at most ``sample`` texts with a digit or an at
    sign, chosen by a hash of the row, and at most ``windows`` windows of them. ``sample`` times the next passage in
    turn is taken with ``pieces`` made-up spans or harmless numbers set in, so that small tables train as well as large
    ones. The bounds hold for training alone. No such text: an untrained tagger that is biased to find nothing."""
    marked = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("doc_id", "text").alias("h"))
    chosen = marked.select("h").orderBy("h").limit(sample).collect()  # numbers alone, so that tasks send little
    start = 1 + F.pmod("h", F.greatest(F.length("text") - passage + 1, F.lit(1)))
    part = F.substring("text", start.cast("int"), F.lit(passage)).alias("text")
    texts = marked.where(F.col("h") <= chosen[-1]["h"]).select("h", part).orderBy("h", "text").limit(sample).select("text").toPandas()["text"] if chosen else []
    xs, ys = [], []
    for i in range(sample if len(texts) else 0):
        text, labels = planted(texts[i % len(texts)], random.Random(i), pieces)
        starts, codes = _windows(text)
        tags = np.zeros(len(codes), np.int64)
        for kind, a, b in labels[::-1]:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
        if len(starts):
            at = starts[:, None] + np.arange(WINDOW)
            xs.append(_cells(codes, starts))
            ys.append(np.where((at >= 0) & (at < len(codes)), tags[np.clip(at, 0, max(len(codes) - 1, 0))], 0))
    tagger = Tagger()
    if xs:
        x, y = np.concatenate(xs), np.concatenate(ys)
        pick = np.sort(np.argsort(constants(len(x), 23))[:windows])
        tagger.fit(x[pick], y[pick])
    else:
        tagger.p["c"][0] = 100.0
    return tagger


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, base, added: array<struct<kind, start, end>> of the patterns' spans and of
    the network's further spans, and redacted, the text with every span replaced by its kind in angle brackets.

    One row per input row. Positions are code points, the end exclusive; base spans are sorted by kind, then start. A
    span of the network is added if it overlaps no base span and holds for its kind (``settle``: the shape, the digits of
    a number, Luhn sum, parts of an address). Null and empty text: no spans; redacted is null or empty. Null or repeated doc_id: rows are
    independent. Empty table: no rows. Other columns are kept after these, but for columns of these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # some thousand numbers
    others = [c for c in docs.columns if c not in ("doc_id", "text", "base", "added", "redacted")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], 2 << 20):
                part = batch.slice(a, b - a)
                base, added, redacted = _scan(part["text"], shared.value)
                row = lambda spans: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in spans], kind)
                yield pa.record_batch([part["doc_id"], row(base), row(added), redacted, *(part[c] for c in others)], names=["doc_id", "base", "added", "redacted", *others])

    fields = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.mapInArrow(run, f"doc_id long, base {spans}, added {spans}, redacted string{fields}")


def _apart(base: list, more: list) -> list:
    """Those of ``more`` that overlap neither a base span nor an earlier one of their own, by kind, then start."""
    taken = sorted(x[1:] for x in base)
    firsts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken] or [0])
    out, free = [], 0
    for span in sorted(more, key=lambda x: x[1:]):
        before = bisect_left(firsts, span[2])  # spans that start ahead of this one's end
        if span[1] >= free and (not before or reach[before - 1] <= span[1]):
            out.append(span)
            free = span[2]
    return sorted(out)


def _scan(column: pa.Array, tagger: Tagger) -> tuple[list, list, pa.Array]:
    data, offsets = utf8(column)
    marks = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    if len(data) > 3:  # a bracketed "at"
        low = data | 32
        marks = np.concatenate([marks, np.flatnonzero(((data[:-3] == 40) | (data[:-3] == 91)) & (low[1:-2] == 97) & (low[2:-1] == 116))])
    some = np.unique(np.searchsorted(offsets, marks, "right") - 1)
    base, added = [[] for _ in range(len(column))], [[] for _ in range(len(column))]
    texts = {int(i): column[int(i)].as_py() for i in some}
    cells, owner = [], []
    for i, text in texts.items():
        base[i] = base_spans(text)
        starts, codes = _windows(text)
        cells.append(_cells(codes, starts))
        owner.append((i, starts))
    every = np.concatenate(cells) if cells else ()
    if len(every):
        tags = np.concatenate([tagger.decode(every[k:k + 512]) for k in range(0, len(every), 512)])
        at = 0
        for i, starts in owner:
            added[i] = _apart(base[i], [y for x in _spans(tags[at:at + len(starts)], starts, texts[i]) if (y := settle(*x, texts[i]))])
            at += len(starts)
    if not texts:
        return base, added, column.cast(pa.string())
    out = column.to_pylist()
    for i, text in texts.items():
        parts, end = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in base[i] + added[i]):
            if s >= end:
                parts += [text[end:s], f"<{KINDS[k].upper()}>"]
            end = max(end, e)
        out[i] = "".join(parts) + text[end:]
    return base, added, pa.array(out, pa.string())
