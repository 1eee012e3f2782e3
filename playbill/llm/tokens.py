"""Tokenizing texts inside tasks, each distinct word once per task.

A public tokenizer file is a parameter; nothing is trained.  Both kinds of
tokenizers used here cut texts at white space before they merge, so the ids of
a text are the ids of its units in a row:

``leading``  byte-level files: a unit is a word with the white space before it
``words``    files that drop white space: a unit is a word
``whole``    any other file: the text itself

Texts with unusual white space, where rules of tokenizers differ, and texts
that hold the string of an added token, which the library takes out before
anything else, are encoded whole.  Units are told apart by their bytes.  A new
unit of plain Latin letters, with marks like
full stops or hashes behind it, goes straight to the library's merge model, as the
file's own rules would pass it on; any other unit goes through the whole
tokenizer.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable
from itertools import chain, count

import numpy as np
import pyarrow as pa

from .grams import LOWER, Words, slices

#: a word of Latin letters and ASCII marks behind it, but for the apostrophe, which rules of tokenizers look at
_LATIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: units a task remembers, and bytes of them; of a full memory those met again stay, which costs time only
MEMORY, MEMORY_BYTES = 1_000_000, 1 << 26
#: words and marks whose ids are at hand while units are told
PIECES = 100_000
#: bytes of text worked on at a time
TEXT = 1 << 19


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level files write for each byte: printable bytes
    stand for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


def odd_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with white space other than ASCII's, or with separators that some
    rules take for white space."""
    d = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = d[:-2], d[1:-1], d[2:]
    hit = (a >= 0x1C) & (a <= 0x1F)
    two = np.flatnonzero(a >= 0xC2)
    a, b, c = a[two], b[two], c[two]
    hit[two] = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) \
        | ((a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | (b == 0x81))) \
        | ((a == 0xE3) & (b == 0x80)) | ((a == 0xEF) & (b == 0xBB))
    return np.diff(np.append(0, np.cumsum(hit))[off]) > 0


class Numbers(dict):
    """unit -> number; a unit met for the first time gets the next one and is
    listed in ``new``."""

    def __init__(self, units: Iterable[bytes] = ()):
        super().__init__(zip(units, count()))
        self.new: list[bytes] = []

    def __missing__(self, unit: bytes) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class Encoder:
    """Ids of columns of texts, as unsigned 32-bit arrays."""

    def __init__(self, path: str, units: str, memory: int = MEMORY):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        #: strings of added tokens; files that lower-case texts look for them in lower case too
        self.added = sorted({t.content.encode().translate(LOWER.tobytes()) for t in self.whole.get_added_tokens_decoder().values()} - {b""})
        self.merge, self.letters = self.whole.model.tokenize, _byte_letters()
        self.units, self.memory = units, memory
        self.pieces: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        #: ids of unit k are flat[starts[k]:starts[k + 1]]; again[k]: met in a later slice than its first
        self.known = Numbers()
        self.held = 0
        self.flat, self.starts, self.again = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _forget(self) -> None:
        """Keep the units that were met again, at most half of what fits."""
        keep = np.flatnonzero(self.again)
        held = [u for u, k in zip(self.known, self.again.tolist(), strict=True) if k]
        size = np.diff(self.starts)[keep]
        if len(keep) > self.memory // 2 or sum(map(len, held)) > MEMORY_BYTES // 2:
            return self._clear()
        total = np.append(0, np.cumsum(size))
        self.flat = self.flat[np.repeat(self.starts[keep] - total[:-1], size) + np.arange(total[-1])]
        self.known, self.starts, self.held = Numbers(held), total, sum(map(len, held))
        self.again = np.zeros(len(keep), bool)

    def _with_added(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Rows that hold the string of an added token in any case."""
        out = np.zeros(len(off) - 1, bool)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                if at + len(token) <= off[row + 1]:
                    out[row] = True
                at = raw.find(token, at + 1)
        return out

    def _written(self, text: str) -> str:
        """``text`` in the letters of byte-level files."""
        return text.encode().decode("latin-1").translate(self.letters)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, word: str) -> list[int]:
        """Ids of a word or of marks that are not at hand."""
        if len(self.pieces) >= min(PIECES, self.memory):
            self.pieces.clear()
        ids = self.pieces[word] = [t.id for t in self.merge(word)]
        return ids

    def _unit_ids(self, units: list[str]) -> list[list[int]]:
        lower, space = self.units == "words", self._written(" ")
        at_hand, told = self.pieces.get, _LATIN.fullmatch
        out, odd = [], []
        for k, unit in enumerate(units):
            found = told(unit)
            if found is None:
                odd.append(k)
                out.append(None)
                continue
            lead, word, tail = found.groups()
            if lower:
                word = word.lower()
            if not word.isascii():
                word = self._written(word)
            if lead:
                word = space + word
            ids = at_hand(word) or self._merged(word)
            out.append(ids + (at_hand(tail) or self._merged(tail)) if tail else ids)
        for k, ids in zip(odd, self._ids([units[k] for k in odd]), strict=True):
            out[k] = ids
        return out

    def _ranges(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every unit with the white space before it, and
        units before each row."""
        off, upto = words.off, words.upto
        begin = np.concatenate([np.zeros(1, np.int64), words.end[:-1]])[:len(words.end)]
        has = np.diff(upto) > 0
        begin[upto[:-1][has]] = off[:-1][has]
        # white space at the end of a text is a unit of its own
        last = off[:-1].copy()
        last[has] = words.end[upto[1:][has] - 1]
        tail = np.flatnonzero(last < off[1:])
        place = upto[1:][tail]
        return np.insert(begin, place, last[tail]), np.insert(words.end, place, off[1:][tail]), \
            upto + np.searchsorted(tail, np.arange(len(off)))

    def encode(self, texts: pa.Array):
        """(row, ids) of every text in order; a null text has none."""
        for first, data, off in slices(texts, TEXT):
            if len(self.known) > self.memory or self.held > MEMORY_BYTES:
                self._forget()
            raw, known, bounds = data.tobytes(), self.known, off.tolist()
            if self.units == "words":
                rows = [raw[a:b].split() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]  # bytes: ASCII white space only
                units = list(chain.from_iterable(rows))
                upto = np.append(0, np.cumsum([len(r) for r in rows]))
            else:
                begin, end, upto = self._ranges(Words(data, off))
                units = [raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
            n = len(known)
            unit = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
            self.again[unit[unit < n]] = True
            if known.new:
                new, known.new = known.new, []
                collects = gc.isenabled()
                gc.disable()  # many small lists that live on
                found = self._unit_ids([u.decode() for u in new])
                if collects:
                    gc.enable()
                self.held += sum(map(len, new))
                self.starts = np.append(self.starts, self.starts[-1] + np.cumsum([len(x) for x in found]))
                self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32))
                self.again = np.append(self.again, np.zeros(len(new), bool))
            size = self.starts[unit + 1] - self.starts[unit]
            total = np.append(0, np.cumsum(size))
            ids = self.flat[np.repeat(self.starts[unit] - total[:-1], size) + np.arange(total[-1])]
            odd = odd_rows(data, off) if self.units == "leading" else np.full(len(off) - 1, self.units == "whole")
            odd |= self._with_added(LOWER[data].tobytes(), off)
            cuts = total[upto].tolist()
            for k, strange in enumerate(odd.tolist()):
                if strange:
                    yield first + k, np.array(self._ids([data[bounds[k]:bounds[k + 1]].tobytes().decode()])[0], np.uint32)
                else:
                    yield first + k, ids[cuts[k]:cuts[k + 1]]


_made: dict = {}


def encoder(path: str, units: str, memory: int = MEMORY) -> Encoder:
    """One encoder per Python worker; another takes its place."""
    if (path, units, memory) not in _made:
        _made.clear()
        _made[path, units, memory] = Encoder(path, units, memory)
    return _made[path, units, memory]


def drop_encoders() -> None:
    """A worker that goes on to other stages holds none."""
    _made.clear()
