"""Brute-force forms that the tests compare with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").translate(UPPER)


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_pairs(sets):
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    both = Counter((a, b) for ds in where.values() for a in ds for b in ds if a < b)
    return [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
