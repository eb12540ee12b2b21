"""Plain versions of the operators, over lists of rows held in memory."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if held := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= held
        out.append((doc, len(w), len(hit), sorted(map(str, found))))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def classes(docs, threshold=0.8, band=0.02):
    """(links surely there, links possibly there) between different texts, by plain Jaccard similarity."""
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    shared = Counter()
    for held in by.values():
        held = sorted(held)
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                shared[a, b] += 1
    sure, maybe = set(), set()
    for (a, b), n in shared.items():
        j = n / (len(sets[a]) + len(sets[b]) - n)
        if j >= threshold + band:
            sure.add((a, b))
        if j >= threshold - band:
            maybe.add((a, b))
    return sure, maybe


def connected(docs, links):
    up = {d: d for d in docs}

    def root(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {d: root(d) for d in docs}
