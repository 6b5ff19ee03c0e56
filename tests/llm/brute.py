"""Plain models of the operators' results on small tables."""

from __future__ import annotations

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def repeats(rows, window=13):
    words = [(d, SPACED.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            least = first.get(tuple(w[i:i + window]))
            if least is not None and (d is None or least < d):
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def leaks(rows, items, window=10):
    where = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            where[tuple(w[k:k + n])].add(i)
    out = []
    for d, t in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in where}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in where:
                    found |= where[tuple(w[k:k + n])]
                    hit[k:k + n] = [True] * n
        listed = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), sum(hit), len(listed), sha(",".join(listed)), any(hit)))
    return out


def groups(rows, percent=85):
    sets = {}
    for d, t in rows:
        w = SPACED.findall(lower(t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), root(d), root(d) == d) for d in sets]


def rules(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w, seen, dup = SPACED.findall(t), set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        n = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        hit = [0] * len(w)
        for i in range(len(w) - 2):
            if n[tuple(w[i:i + 3])] > 1:
                hit[i:i + 3] = [1] * 3
        failed = len(w) < 50 or 100 * sum(hit) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(hit), failed))
    return out


def verdicts(rows):
    """(doc_id, kept) of rows (doc_id, text, source): own rules, and the rates of the host under beta priors."""
    over, hosts = [], collections.defaultdict(list)
    for (d, t, h), (_, words, chars, symbols, dup, _, failed) in zip(rows, rules([r[:2] for r in rows])):
        n_lines = sum(bool(SPACED.search(x)) for x in (t or "").split("\n"))
        wide = len("".join(SPACED.findall(t or "")).encode()) >= 2 * chars
        long = 0 if wide or not words else chars / words / 10
        over.append((h, failed, symbols / words / 0.1 if words else 0, dup / n_lines / 0.4 if n_lines else 0, max(long, 3 * words / chars if chars else 0)))
        if h is not None:
            hosts[h].append([failed, *(x > 1 for x in over[-1][2:])])
    rates = collections.defaultdict(lambda: [0] * 4)
    for k in range(4):
        sizes = {h: len(v) for h, v in hosts.items()}
        fails = {h: sum(x[k] for x in v) for h, v in hosts.items()}
        n, squares = sum(sizes.values()), sum(x * x for x in sizes.values())
        if not n:
            break
        mean = sum(fails.values()) / n
        noise, below = mean * (1 - mean), n - squares / n - (len(sizes) - 1)
        between = sum(fails[h] ** 2 / sizes[h] for h in sizes) - n * mean * mean
        spread = (between - (len(sizes) - 1) * noise) / below if below else 0
        strength = max(1, min(1e9, noise / spread - 1)) if spread > 0 else 1e9
        for h in sizes:
            rates[h] = [*rates[h][:k], (fails[h] + mean * strength) / (sizes[h] + strength), *rates[h][k + 1:]]
    out = []
    for (d, _, h), (_, failed, *own) in zip(rows, over):
        rate = rates[h] if h is not None else [0] * 4
        out.append((d, not failed and max(rate) < 0.9 and all(x <= 1 - r / 2 for x, r in zip(own, rate[1:]))))
    return out


SECRETS = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]


def secrets(rows):
    out = []
    for d, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(SECRETS) for m in re.finditer(p, t or "") if len(m.group(g)) >= n)
        out.append((d, *(sum(s[1] == k for s in spans) for k in range(3)), sha(",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in spans))))
    return out


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(digits)) % 10 == 0


def count(text):
    return sum(c in "0123456789" for c in text)


PERSONAL = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= count(x) <= 19 and luhn(x)),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= count(x) <= 15)]


def personal(rows):
    out = []
    for d, t in rows:
        spans = [(k, m.start(), m.end()) for k, p, ok in PERSONAL for m in re.finditer(p, t or "") if ok(m.group())]
        out.append((d, *(sum(s[0] == k for s in spans) for k, _, _ in PERSONAL), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    return out
