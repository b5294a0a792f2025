"""Whole-batch text work on Arrow buffers: words, hashes and n-grams without a Python object per word.

All functions take texts as one byte buffer plus row offsets, so a batch costs a
fixed number of numpy passes.  Temporary arrays are held to ``CHUNK`` bytes of text
at a time; what is kept per row grows with that row only.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15

_byte = np.arange(256, dtype=np.uint8)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
IS_ALNUM = (((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90))
            | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128))
IS_BLACK = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
#: Words are 1, runs of other visible characters 2.
CLASSES = np.where(IS_ALNUM, 1, np.where(IS_BLACK & (_byte > 32), 2, 0)).astype(np.uint8)
_VALUE = np.random.Generator(np.random.PCG64(7)).integers(1, MASK, 256, dtype=np.uint64)


def per_process(name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, made once per worker process and name (tasks get new copies of this module)."""
    made = sys.__dict__.setdefault("_regionlens_llm", {})
    if name not in made:
        made[name] = build()
    return made[name]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK:
        return _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
    if 0 not in _POWERS:
        _POWERS[0] = _powers(BASE, CHUNK), _powers(pow(BASE, -1, 1 << 64), CHUNK)
    a, b = _POWERS[0]
    return a[:n], b[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of up to ``limit`` bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def _cuts(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``CHUNK`` that end after a byte outside any word."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            gaps = np.flatnonzero(is_word[data[at:to]] == 0)
            while not len(gaps) and to < n:
                further = min(n, to + CHUNK)
                gaps = np.flatnonzero(is_word[data[to:further]] == 0) + (to - at)
                to = further
            if len(gaps) and to < n:
                to = at + int(gaps[-1]) + 1
        yield at, to
        at = to


def word_spans(data: np.ndarray, is_word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero class of ``is_word`` in ``data``;
    ``bounds`` are row starts, where runs end."""
    kind = is_word[data]
    inside = kind > 0
    change = kind[1:] != kind[:-1]
    begins = inside.copy()
    begins[1:] &= change
    stops = inside.copy()
    stops[:-1] &= change
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    begins[cut] = inside[cut]
    stops[cut - 1] = inside[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_ALNUM
                ) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 64-bit hash of every word of the rows, A-Z lower-cased, in text order."""
    rows, hashes = [], []
    start = int(offsets[0])
    data = data[start:int(offsets[-1])]
    offsets = offsets - start
    for a, b in _cuts(data, is_word):
        part = LOWER[data[a:b]]
        s, e = word_spans(part, is_word, offsets - a)
        if not len(s):
            continue
        power, inverse = _power_tables(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power, dtype=np.uint64, out=total[1:])
        rows.append(np.searchsorted(offsets, s + a, side="right") - 1)
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def shingles(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``n`` words within one row."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for j in range(n):
        out = out * np.uint64(BASE) + hashes[j:j + k]
    at = np.flatnonzero(rows[:k] == rows[n - 1:])
    return at, mix(out[at])


def byte_grams(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each ``n``-byte window of the lower-cased words, in which only
    the first or last byte may stand outside a word (that byte counts as a space)."""
    start = int(offsets[0])
    data, offsets = data[start:int(offsets[-1])], offsets - start
    rows, hashes = [], []
    for a in range(0, len(data), CHUNK):
        part = data[a:a + CHUNK + n - 1]
        k = len(part) - n + 1
        if k <= 0:
            continue
        inside = IS_ALNUM[part]
        part = np.where(inside, LOWER[part], np.uint8(32))
        whole = inside[1:1 + k].copy()
        for j in range(2, n - 1):
            whole &= inside[j:j + k]
        at = np.flatnonzero(whole)
        row = np.searchsorted(offsets, at + a, side="right") - 1
        same = at + a + n <= offsets[row + 1]
        at, row = at[same], row[same]
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out = out * np.uint64(BASE) + _VALUE[part[at + j]]
        rows.append(row)
        hashes.append(mix(out ^ np.uint64(0x5BD1E995)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


class HashSet:
    """Membership of 64-bit hashes in a fixed sorted set, with a bit table in front."""

    def __init__(self, members: np.ndarray):
        self.members = np.unique(members.astype(np.uint64))
        bits = min(24, max(10, int(len(self.members)).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.front = np.zeros(1 << bits, bool)
        self.front[self.members >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are members, and each one's place in ``members``."""
        at = np.flatnonzero(self.front[hashes >> self.shift])
        place = np.searchsorted(self.members, hashes[at])
        place[place == len(self.members)] = 0
        good = self.members[place] == hashes[at] if len(self.members) else np.zeros(0, bool)
        return at[good], place[good]
