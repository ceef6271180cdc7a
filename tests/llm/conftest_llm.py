"""Brute-force versions for the tests."""

import re
from collections import Counter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def brute_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        if i is not None:
            for j in range(len(t) - n + 1):
                first[t[j : j + n]] = min(i, first.get(t[j : j + n], i))
    out = Counter()
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for j in range(len(t) - n + 1):
            if i is not None and first[t[j : j + n]] < i:
                gone[j : j + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i, len(t), spans, bytes(b for b, g in zip(t, gone) if not g)] += 1
    return out
