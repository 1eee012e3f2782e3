"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def near_groups(docs, width, percent):
    """docs: [(doc_id, text)] -> {(doc_id, n, component)}, by all pairs that share a shingle."""
    sets = [(d, shingles(t, width)) for d, t in docs]
    holders = defaultdict(list)
    for k, (d, s) in enumerate(sets):
        if d is not None:
            for x in s:
                holders[x].append(k)
    common = defaultdict(int)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                common[a, b] += 1
    links = [(sets[a][0], sets[b][0]) for (a, b), n in common.items()
             if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n)]
    root = roots({d for d, _ in docs if d is not None}, links)
    return sorted(((d, len(s), root.get(d)) for d, s in sets), key=str)


def windows(docs, width=50):
    """docs: [(doc_id, text)] -> rows of substring dedup over words."""
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def substrings(docs, width=400):
    """docs: [(doc_id, text)] -> rows of substring dedup over bytes."""
    data = [(d, (t or "").encode()) for d, t in docs]
    times = defaultdict(int)
    for _, b in data:
        for i in range(len(b) - width + 1):
            times[b[i:i + width]] += 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if times[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)
