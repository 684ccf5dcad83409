"""Vectorised words and word shingles of whole texts, straight from Arrow buffers.

Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64 (taken from prefix sums, so no loop over words) followed by a
bijective mixer; a shingle's hash combines the hashes of its words in order.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words when ASCII marks and white space separate: letters, digits and all bytes of other scripts.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Code points of scripts that are written without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han and others.
UNSPACED = ((0xE00, 0xE3A), (0xE40, 0xE4E), (0xE50, 0xE59), (0xE80, 0xEFF), (0x1000, 0x1049), (0x1050, 0x109F), (0x1780, 0x17D3),
            (0x17D7, 0x17D7), (0x17DC, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1A9F), (0xF00, 0xF00), (0xF40, 0xF84), (0xF90, 0xFBC),
            (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x303C), (0x3041, 0x309F), (0x30A1, 0x30FA),
            (0x30FC, 0x312F), (0x31A0, 0x9FFF), (0xA000, 0xA48F), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
            (0x17000, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(m, base, dtype=_U)
            p[0] = 1
            _powers[key] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each) of a large_string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


@lru_cache(1 << 16)
def _kind(point: int) -> int:
    """0: separates words, 1: a character of words, 2: a word of its own."""
    for low, high in UNSPACED:
        if low <= point <= high:
            return 2
    kind = unicodedata.category(chr(point)) if point < 0x110000 else "Cn"
    return 0 if kind[0] in "PZ" or kind in ("Cc", "Cf") else 2 if kind[0] == "S" else 1


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte is part of a word, whether a word ends before it for sure): letters and digits of all scripts
    are, marks and spaces are not; characters of scripts without spaces, and symbols beyond ASCII, are words of their own."""
    inside = LETTERS[data]
    cut = np.zeros(len(data) + 1, bool)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int64)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        point = b & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = data[np.minimum(lead + k, len(data) - 1)] & 0x3F
            point = np.where(k < size, point << 6 | more, point)
        seen, which = np.unique(point, return_inverse=True)
        kind = np.array([_kind(p) for p in seen.tolist()])[which]
        for k in range(4):
            at = lead[(kind == 0) & (k < size)] + k
            inside[at[at < len(data)]] = False
        alone = kind == 2
        cut[lead[alone]] = True
        cut[np.minimum(lead[alone] + size[alone], len(data))] = True
    return inside, cut


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray | None = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word with the total at the end, byte starts, byte ends). Bytes
    of words are those in ``of``; with None, ``marks`` tells."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64), z, z
    if of is None:
        inside, cut = marks(data)
    else:
        inside, cut = of[data], np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(closes) + 1
    up, down = _power_tables(n)
    total = np.empty(n + 1, dtype=_U)
    total[0] = 0
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * up[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    return h, np.searchsorted(starts, offsets).astype(np.int64), starts, ends


def shingles(h: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, index of each text's first shingle with the total at the end), in word order, repeats
    included. A text of fewer words than ``width`` but at least one has its whole sequence as one shingle, or none
    if not ``short``."""
    count = np.diff(first)
    n = len(h)
    rolled = np.zeros(n, dtype=_U)
    for j in range(width):
        rolled[: max(0, n - j)] = (rolled[: max(0, n - j)] + h[j:]) * _U(0xD6E8FEB86659FD93)
        rolled ^= rolled >> _U(32)
    whole = np.maximum(count - width + 1, (count > 0).astype(np.int64) if short else 0)
    at = np.concatenate([[0], np.cumsum(whole)]).astype(np.int64)
    keep = np.ones(n, dtype=bool)
    last = np.arange(n) - np.repeat(first[:-1], count)  # place in its text
    keep &= last < np.repeat(whole, count)
    out = mix(rolled[keep])
    for i in np.flatnonzero((count > 0) & (count < width) & short):
        seq = 0x5851F42D4C957F2D + int(count[i])
        for x in h[first[i]: first[i + 1]].tolist():
            seq = ((seq ^ x) * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1)
            seq ^= seq >> 29
        out[at[i]] = seq
    return out, at


def distinct(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, with the same kind of index."""
    sh = sh.copy()
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s > 1:
            sh[s:e].sort()
    if not len(sh):
        return sh, at
    new = np.ones(len(sh), dtype=bool)
    new[1:] = sh[1:] != sh[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    return sh[new], np.concatenate([[0], np.cumsum(new)])[at].astype(np.int64)
