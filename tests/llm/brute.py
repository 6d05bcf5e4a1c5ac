"""Plain-Python versions of the operators, for small tables."""
import hashlib
import math
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def base_counts(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def js_distance(counts, reference):
    p, q = (np.array(x, float) / sum(x) for x in (counts, reference))
    m = (p + q) / 2
    part = [sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0) for x in (p, q)]
    return math.sqrt(max(sum(part) / 2, 0))


def substring(docs, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        d = LAST if i is None else i
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            first[key] = min(d, first.get(key, 1 << 63))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (LAST if i is None else i):
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return by_text(out)


def lines(docs, least):
    seqs, first, out = {}, {}, []
    for i, t in docs:
        key = (LAST if i is None else i, t or "")
        seqs[key] = [(n, x) for n, x in enumerate(key[1].split("\n")) if WORD.search(x)]
    for key, s in seqs.items():
        for p in range(len(s) - least + 1):
            run, at = tuple(x for _, x in s[p:p + least]), (key[0], p)
            first[run] = min(at, first.get(run, at))
    for i, t in docs:
        key = (LAST if i is None else i, t or "")
        s, gone = seqs[key], set()
        for p in range(len(s) - least + 1):
            if first[tuple(x for _, x in s[p:p + least])] < (key[0], p):
                gone |= {n for n, _ in s[p:p + least]}
        kept = "\n".join(x for n, x in enumerate(key[1].split("\n")) if n not in gone)
        out.append((i, t if t is None else kept, len(gone)))
    return by_text(out)


def vectors(rows, cosine=0.95):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links, joined, dims = [0] * len(rows), Union(len(rows)), {}
    for i, (_, v) in enumerate(rows):
        if usable(v):
            dims.setdefault(len(v), []).append(i)
    for group in dims.values():
        x = np.array([rows[i][1] for i in group], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for k in range(len(group)):
            for j in np.flatnonzero(x[k + 1:] @ x[k] >= cosine - 1e-12) + k + 1:
                links[group[k]] += 1
                links[group[j]] += 1
                joined.join(group[k], group[j])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[joined.find(i)] = min(d, least.get(joined.find(i), LAST))
    return by_text((d, links[i], least.get(joined.find(i)), d is not None and d == least[joined.find(i)])
                   for i, (d, _) in enumerate(rows))


def simhash(text, k=3):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    runs = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(docs, radius=3):
    prints = [simhash(t) for _, t in docs]
    joined = Union(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                joined.join(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[joined.find(i)] = min(d, least.get(joined.find(i), LAST))
    return by_text((d, f"{prints[i]:016x}", least.get(joined.find(i))) for i, (d, _) in enumerate(docs))
