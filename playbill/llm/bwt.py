"""Common prefixes of a text's suffixes from its Burrows-Wheeler transform.

Boundaries between neighbouring suffixes get the length of their common prefix
by breadth-first backward extension: an interval of suffixes that share a
prefix w is extended to c + w for the letters c before it, so a boundary found
at one length puts boundaries one letter longer.  Lengths are derived in
increasing order, and the search stops at the length asked for: boundaries
not reached by then have at least that much in common.
"""

from __future__ import annotations

import numpy as np

#: letters of the key that suffixes are first sorted by
FIRST = 7
#: places looked at one by one for the end of an interval
STEPS = 64


def letters(records: list[bytes]) -> np.ndarray:
    """Records in a row, each ended by 0; bytes are 1..256."""
    flat = np.frombuffer(b"".join(r + b"\0" for r in records), np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(r) + 1 for r in records]) - 1
    flat[ends] = 0
    return flat


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first_key): suffixes sorted, ends of records being distinct and
    smallest, in their order.  Suffixes that are alone with their rank rest."""
    n = len(text)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(FIRST, text.dtype)]).astype(np.int64)
    live = np.ones(n, bool)
    for k in range(FIRST):
        letter = np.where(live, padded[k:k + n], 0)
        key = key * 512 + letter
        live &= letter > 0
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]) | (ranked[1:] % 512 == 0)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    step = FIRST
    while True:
        more = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # places in groups of two and more
        if not len(more):
            return order, ranked
        at = order[more]
        # a suffix in a group has no record end in its first ``step`` letters
        both = rank[at] * (n + 1) + rank[np.minimum(at + step, n - 1)]
        sub = np.argsort(both, kind="stable")
        order[more] = at[sub]
        both = both[sub]
        fresh[more[1:]] = both[1:] != both[:-1]
        fresh[more[0]] = True
        head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order[more]] = head[more]
        step *= 2


def _next(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Next marked place behind each of ``at``; the last place is marked."""
    if len(at) > len(marked) >> 6:
        edges = np.flatnonzero(marked)
        return edges[np.searchsorted(edges, at, "right")]
    out = at + 1
    open_ = np.flatnonzero(~marked[out])
    for _ in range(STEPS):
        if not len(open_):
            return out
        out[open_] += 1
        open_ = open_[~marked[out[open_]]]
    edges = np.flatnonzero(marked)
    out[open_] = edges[np.searchsorted(edges, out[open_])]
    return out


def shared_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, long): ``long[r]`` says that suffixes ``order[r - 1]`` and
    ``order[r]`` share at least ``least`` letters."""
    n = len(text)
    order, key = suffix_order(text)
    before = text[order - 1]  # the transform; the first suffix has a record end before it
    back = np.argsort(before, kind="stable")
    leads = np.empty(n, np.int64)  # rank of the suffix one letter longer
    leads[back] = np.arange(n)
    same = np.empty(n, np.int64)  # last place above with the same letter
    sorted_letters = before[back]
    same[back[1:]] = np.where(sorted_letters[1:] == sorted_letters[:-1], back[:-1], -1)
    same[back[0]] = -1
    # lengths below FIRST are read off the keys suffixes were first sorted by
    length = np.full(n + 1, -1, np.int32)
    length[0] = length[n] = 0
    prior = key[:-1]
    common = np.zeros(n - 1, np.int32)
    alike = np.ones(n - 1, bool)
    for k in range(FIRST):
        a, b = (prior >> (9 * (FIRST - 1 - k))) & 511, (key[1:] >> (9 * (FIRST - 1 - k))) & 511
        alike &= (a == b) & (a > 0)
        common += alike
    found = common < FIRST
    length[1:n][found] = common[found]
    reached = length >= 0
    now = np.flatnonzero(length[:n] == FIRST - 1)
    for _ in range(FIRST, least):
        if not len(now):
            break
        count = _next(reached, now) - now
        source = np.repeat(now, count)
        place = source + np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
        last = same[place]
        ok = (last >= 0) & (last < source) & (before[place] > 0)
        target = leads[place[ok]]  # no place twice: intervals of one length do not overlap
        now = target[~reached[target]]
        reached[now] = True
    return order, ~reached[:n]


def repeated_starts(records: list[bytes], least: int) -> list[np.ndarray]:
    """Places in each record whose ``least`` bytes also start at another
    place in any of the records."""
    text = letters(records)
    if not len(text):
        return [np.zeros(0, int) for _ in records]
    order, long = shared_prefixes(text, least)
    hit = np.zeros(len(text), bool)
    hit[order[long]] = True
    hit[order[np.flatnonzero(long) - 1]] = True
    at = np.cumsum([0] + [len(r) + 1 for r in records])
    return [np.flatnonzero(hit[a:b - 1]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
