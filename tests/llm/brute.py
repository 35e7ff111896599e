"""The contracts in plain Python, for small tables."""

import collections
import hashlib
import itertools
import re
import zlib
from fractions import Fraction

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_duplicates(rows):
    sets = {}
    for doc, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        sets[doc] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(d for d in sets if sets[d])
    for k, a in enumerate(docs):
        for b in docs[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def decontamination(rows, items):
    wins = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k:k + n])].add(str(item))
    out = {}
    for doc, text in rows:
        w, hit, met = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    met |= wins[tuple(w[k:k + n])]
        out[doc] = (len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit))
    return out


def substrings(rows, length=35):
    words = [(d, SPACED.findall(t or "")) for d, t in rows]
    seen = collections.Counter(tuple(w[i:i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = []
    for doc, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text, spans = text or "", []
    spans += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    n = collections.Counter(s[2] for s in spans)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))


def luhn(digits):
    double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in double) % 10 == 0


def personal_data(text):
    text, spans = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans += [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(2, m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [(3, m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    n = collections.Counter(s[3] for s in spans)
    return n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(spans)))


PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def licenses(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    hits = [(i, label) for i in range(len(w)) for p, label in PHRASES.items() if tuple(w[i:i + len(p)]) == p]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def runs(words):
    """(start, length, period) of maximal stretches of six words and four periods at least, each with its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def planted(doc, text):
    words, h = SPACED.findall(text or ""), zlib.crc32(("" if doc is None else str(doc)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def periodic(doc, text):
    words = planted(doc, text)
    found = runs(words)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(found), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in sorted(found, key=lambda r: (r[0], r[2])))),
            sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def overlaps(a_bytes, b_bytes):
    """Groups and links of two tokenizations given as lists of byte strings: every pair is tried."""
    def ranges(tokens):
        ends = list(itertools.accumulate(map(len, tokens)))
        return [(e - len(t), e) for t, e in zip(tokens, ends, strict=True)]

    a, b = ranges(a_bytes), ranges(b_bytes)
    common = sorted({e for _, e in a} & {e for _, e in b})
    groups = [([i for i, r in enumerate(a) if low < r[1] <= high], [j for j, r in enumerate(b) if low < r[1] <= high])
              for low, high in zip([0, *common], common)]
    return groups, [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]]
