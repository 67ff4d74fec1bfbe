"""Plain versions of the operators for small tables."""

import re
from collections import Counter, defaultdict

import numpy as np

WHITE = r"[\x20\x09-\x0D]+"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(rows, size):
    """rows: (id, text). Words, removed words and kept text of each."""
    first = {}
    for i, text in rows:
        w, at = words(text), float("inf") if i is None else i
        for j in range(len(w) - size + 1):
            key = tuple(w[j:j + size])
            first[key] = min(first.get(key, at), at)
    out = []
    for i, text in rows:
        w, at = words(text), float("inf") if i is None else i
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j:j + size])] < at:
                gone[j:j + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def strings(texts, size):
    """Bytes, kept bytes and spans of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[j:j + size] for b in raw for j in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for j in range(len(b) - size + 1):
            if seen[b[j:j + size]] > 1:
                gone[j + 1:j + 1 + size] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        spans = [(int(s), int(e - s)) for s, e in zip(edges[::2], edges[1::2])]
        out.append((len(b), bytes(x for x, g in zip(b, gone[1:]) if not g), spans))
    return out


def classes(rows, size=5, threshold=0.8):
    """Class number of each row by weighted Jaccard similarity of tf-idf shingles."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(Counter([tuple(w[j:j + size]) for j in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []))
    df = Counter(k for s in sets for k in s)
    n = len(rows)
    weights = [{k: c * (np.log((n + 1) / (df[k] + 1)) + 1) for k, c in s.items()} for s in sets]
    label = list(range(n))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for k in s:
            holders[k].add(i)
    for i, j in {(i, j) for h in holders.values() for i in h for j in h if i < j}:
        common = sum(min(weights[i][k], weights[j][k]) for k in weights[i].keys() & weights[j].keys())
        if common >= threshold * (sum(weights[i].values()) + sum(weights[j].values()) - common) - 1e-9:
            a, b = sorted((top(i), top(j)))
            label[b] = a
    return [top(i) for i in range(n)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
