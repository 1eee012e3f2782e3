"""Words and hashes of many texts at once, with numpy.

Texts of an Arrow column are one byte buffer with offsets.  There are three
hashes, by what they are good for:

* ``Stretches``: sums of powers modulo 2**64, from two prefix values.  Cheap at
  any length, but long sequences can be made that collide under every base, so
  they only find candidates and hash short words (SHORT bytes at most);
* ``windows``: windows of one length, halves hashed together level by level
  with bits mixed in between.  64 bits; equality rests on two lanes;
* ``digest``: 128 bits of any bytes by a cryptographic hash, for whole texts,
  long words and stretches.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: bytes of text worked on at a time; a longer text is worked on alone
SLICE = 1 << 18
SPACES = (9, 10, 11, 12, 13, 32)
#: bytes up to which a word is hashed by a sum of powers
SHORT = 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, lane: int, inverse: bool = False) -> np.ndarray:
    """First ``n`` powers of the lane's base, or of its inverse modulo 2**64."""
    have = _powers.get((lane, inverse))
    if have is None or len(have) < n:
        base = _BASE[lane]
        if inverse:
            base = pow(base, -1, 1 << 64)
        have = np.full(max(n, SLICE + 1024), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[lane, inverse] = have
    return have[:n]


class Stretches:
    """Hashes of stretches of a sequence of 64-bit values, for candidates."""

    def __init__(self, values: np.ndarray, lane: int = 0):
        self.lane = lane
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values), lane), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(len(self.sums), self.lane, True)
        value = (self.sums[end] - self.sums[start]) * back[start]
        return mixed(value ^ (end - start).astype(np.uint64))


def windows(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of every window of ``width`` values.  Hashes of ``2 * k`` values
    combine those of their halves; the last step joins two that overlap."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    left, right = np.uint64(_BASE[lane]), np.uint64(_BASE[1 - lane] ^ 0x5851F42D4C957F2C)
    h, size = mixed(values + left), 1
    while size < width:
        step = min(size, width - size)
        a, b = h[:len(h) - step], h[step:]
        h, size = mixed(a * left + (b ^ (b >> np.uint64(29))) * right + np.uint64(step)), size + step
    return h


def digest(raw) -> tuple[int, int]:
    """128 bits of bytes, as two signed integers."""
    d = blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, mark: np.ndarray | None = None) -> np.ndarray:
    """Rows of two signed integers: the digest of each range of ``data``,
    together with an integer ``mark`` if given."""
    view, out = memoryview(np.ascontiguousarray(data)), np.zeros((len(start), 2), np.int64)
    marks = [b""] * len(start) if mark is None else [b"%d:" % m for m in mark.tolist()]
    for k, (a, b, m) in enumerate(zip(start.tolist(), end.tolist(), marks, strict=True)):
        h = blake2b(m, digest_size=16)
        h.update(view[a:b])
        out[k] = np.frombuffer(h.digest(), np.int64)
    return out


def slices(texts: pa.Array, limit: int = SLICE):
    """(first row, bytes, offsets) of consecutive rows of at most ``limit``
    bytes together; a longer text comes alone.  Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(int(np.searchsorted(off, off[at] + limit, "right")) - 1, at + 1)
        yield at, data[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


class Words:
    """Words of a slice: byte range, row, hash.  Words are the maximal runs of
    bytes that are no ``breaks``, by default ``[^\\x20\\x09-\\x0D]+``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, breaks: np.ndarray = _IS_SPACE):
        if lower:
            data = LOWER[data]
        self.data, self.off = data, off
        word = ~breaks[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words before each row
        self.upto = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.upto))

    @classmethod
    def of_ranges(cls, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Words:
        """Given ranges as the words of one row."""
        self = cls.__new__(cls)
        self.data, self.off = data, np.array([0, len(data)])
        self.start, self.end, self.upto = start, end, np.array([0, len(start)])
        self.row = np.zeros(len(start), np.int64)
        return self

    def hashes(self, lane: int = 0) -> np.ndarray:
        out = Stretches(_BYTE[lane][self.data], lane).hash(self.start, self.end)
        long = np.flatnonzero(self.end - self.start > SHORT)
        if len(long):
            out[long] = digests(self.data, self.start[long], self.end[long])[:, lane].view(np.uint64)
        return out


def byte_stretches(data: np.ndarray, lane: int = 0) -> Stretches:
    return Stretches(_BYTE[lane][data], lane)


def byte_windows(data: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    return windows(_BYTE[lane][data], width, lane)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of every window of ``width``.

    Two running minima per block of ``width``; ties go to the left.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    pad = -n % width
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    block = np.concatenate([values, np.full(pad, top, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[:n - width + 1], ahead[width - 1:n])
    # leftmost place: the running minimum that has it, and where it last fell
    place = np.arange(len(block.ravel())).reshape(block.shape)
    fell = np.ones(block.shape, bool)
    a2 = ahead.reshape(block.shape)
    fell[:, 1:] = a2[:, 1:] < a2[:, :-1]
    at_ahead = np.maximum.accumulate(np.where(fell, place, 0), axis=1).ravel()
    b2 = back.reshape(block.shape)
    own = block == b2
    at_back = np.minimum.accumulate(np.where(own, place, len(place.ravel()))[:, ::-1], axis=1)[:, ::-1].ravel()
    left = back[:n - width + 1] == low
    return np.where(left, at_back[:n - width + 1], at_ahead[width - 1:n])
