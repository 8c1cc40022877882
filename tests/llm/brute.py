"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def substring_dedup(rows: list[tuple], size: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha256 of the kept words) of (doc_id, text)."""
    first: dict[tuple, int] = {}
    for doc, text in rows:
        found = words_of(text)
        for s in range(len(found) - size + 1):
            if doc is not None:
                key = tuple(found[s : s + size])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        found = words_of(text)
        gone = set()
        for s in range(len(found) - size + 1):
            if doc is not None and first[tuple(found[s : s + size])] < doc:
                gone.update(range(s, s + size))
        kept = " ".join(w for i, w in enumerate(found) if i not in gone)
        out.append((doc, len(found), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def jaccard_components(rows: list[tuple], size: int, num: int, den: int) -> dict:
    """doc_id -> (set size, smallest doc_id reachable by links)."""
    sets = {}
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = words_of(low)
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        sets[doc] = grams or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    for d, s in sets.items():
        shared: dict = defaultdict(int)
        for g in s:
            for other in index[g]:
                if other < d:
                    shared[other] += 1
        for other, both in shared.items():
            if den * both >= num * (len(s) + len(sets[other]) - both):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}
