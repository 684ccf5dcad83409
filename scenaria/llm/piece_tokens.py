"""Encoding into pieces of a BPE sentence-piece model with seeded merge-dropout, and lossless decoding.

A text gets a leading word mark, its spaces become marks, and it falls into units: marks and the characters up to
the next mark. No piece of the vocabulary reaches over a unit's end (checked), so units are encoded on their own.

In a unit an agenda holds every pair of neighbouring symbols that make up a piece, best score first, leftmost
first among equals. A pair taken from the agenda is skipped when a hash keyed by (seed, text, unit, number of the
unit in its text, place, piece) says so, with probability ``dropout``; else it is merged and its new neighbours enter.
A skipped pair enters again only if one of its symbols changes. So each occurrence of a word is drawn on its own,
the same text always in the same way. With dropout 0 the result is the model's own.

What is remembered between occurrences is only what follows from a unit and the pairs skipped in it: the pairs that
come up next if nothing more is skipped, and the pieces. An occurrence walks from one such trace to the next, at each
skip, so that its own draws decide alone.

Characters without a piece, and a word mark that stands in the text itself, become byte pieces; decoding so gives
back every text. A null text counts as empty; an empty text has no pieces.

The vocabulary's tables are made on the driver and sent with the job; their size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.llm.common import released, text_chunks
from scenaria.llm.shingles import buffers, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_U = np.uint64
_NONE = np.int64(2**62)
_ALL = 2**64 - 1
#: Units of more characters are encoded one by one.
LONG = 48
#: Traces remembered in a task; at more, all are forgotten.
REMEMBERED = 600_000


class Vocabulary:
    """Plain tables of a model: pieces by id, merges by pair, byte pieces."""

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.size = n
        self.bytes = np.full(256, -1, np.int64)
        self.spelled: list[bytes] = [b""] * n
        normal: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[piece] = i
                self.spelled[i] = piece.replace(MARK, " ").encode()
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces, so decoding would lose characters")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
            raise ValueError("a piece reaches over a word's end")
        order = sorted(normal.values(), key=lambda i: (-sp.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        pairs = sorted((normal[p[:k]] * n + normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p))
                       if p[:k] in normal and p[k:] in normal)
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int64)
        self.rank = np.full(n, _NONE)
        self.rank[list(rank)] = list(rank.values())
        self.by_rank = np.array([*order, -1], np.int64)
        single = {ord(p): i for p, i in normal.items() if len(p) == 1}
        self.single = np.arange(max(single, default=0) + 2) + n
        self.single[list(single)] = list(single.values())
        # ranks by pair, the rows of a table of pairs laid over one another: a pair's cell is its left side's shift + its right side
        left, right = self.pair // n, self.pair % n
        order = np.argsort(-np.bincount(left, minlength=n)[left], kind="stable")
        packed, sides = left << 32 | self.rank[self.merged], np.split(order, np.flatnonzero(np.diff(left[order])) + 1)
        self.shift, cells, room = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64), 3 * len(self.pair)
        rng = np.random.default_rng(0)
        for side in sides if len(order) else ():
            places, shift = right[side], 0
            while (cells[shift + places] >= 0).any():
                shift = int(rng.integers(room))
                room += 8  # so that a place is found in the end
                if shift + n >= len(cells):
                    cells = np.concatenate([cells, np.full(shift + n + 1 - len(cells), -1, np.int64)])
            cells[shift + places] = packed[side]
            self.shift[left[side[0]]] = shift
        self.cells = cells

    def symbols(self, code_points: np.ndarray) -> np.ndarray:
        """Piece ids of characters; size + code point where there is none."""
        return np.where(code_points < len(self.single), self.single[np.minimum(code_points, len(self.single) - 1)], self.size + code_points)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece made of two neighbours, -1 if there is none."""
        key = np.where((left < self.size) & (right < self.size) & (left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], -1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece made of two neighbours, the number of ranks if there is none; symbols are not negative."""
        left = np.minimum(left, self.size)
        found = self.cells[self.shift[left] + np.minimum(right, self.size)]
        return np.where(found >> 32 == left, found & 0xFFFFFFFF, len(self.by_rank) - 1)

    def rank_of_one(self, left: int, right: int) -> int:
        """pair_ranks of a single pair."""
        found = int(self.cells[self.shift[left] + right]) if left < self.size and right < self.size else -1
        return found & 0xFFFFFFFF if found >> 32 == left else len(self.by_rank) - 1


def _salt(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return mix(place.astype(_U) * _U(0x9E3779B97F4A7C15) + piece.astype(_U))


def _least(dropout: float) -> int:
    """The least of the 53 leading bits of a hash that does not skip."""
    return math.ceil(min(1.0, max(0.0, dropout)) * 2.0**53)


def _skips(unit: np.ndarray, salt: np.ndarray, dropout: float) -> np.ndarray:
    """Whether a pair is skipped; ``unit`` is the unit's hash and the occurrence's key in one, ``salt`` the pair's."""
    return mix(unit + salt) >> _U(11) < _U(_least(dropout))


def _unit_hash(points: np.ndarray) -> np.ndarray:
    """A hash of each row of code points (-1 fills up)."""
    h = np.zeros(len(points), _U)
    for k in range(points.shape[1]):
        c = points[:, k]
        h = np.where(c >= 0, mix(h + c.astype(_U) + _U(0x632BE59BD9B4E019)), h)
    return h


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    base = np.cumsum(count) - count
    return np.repeat(start - base, count) + np.arange(int(count.sum()))


def _points(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all units, number of each)."""
    return (np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32),
            np.fromiter(map(len, units), np.int64, len(units)))


def _rows(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of code points for each unit; -1 fills up."""
    out = np.full((len(size), int(size.max())), -1, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = points[_ragged(start, size)]
    return out


def _cut_many(v: Vocabulary, units: list[str], key: int | np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all units, number of each); all agendas advance together, one pair of each unit a round."""
    points, size = _points(units)
    points = _rows(points, np.cumsum(size) - size, size)
    unit = _unit_hash(points) + np.asarray(key, _U)
    return _cut_rows(v, points, lambda turn, rows, place, piece: _skips(unit[rows], _salt(place, piece), dropout))


def _cut_rows(v: Vocabulary, points: np.ndarray, skips) -> tuple[np.ndarray, np.ndarray]:
    """_cut_many of rows of code points; ``skips`` (round, rows, places, pieces) tells the pairs to skip."""
    n, width = points.shape
    # a row for each place, one more at both ends. A merged pair stays at its left place, so places never move; what is
    # on either side of a symbol is told by before and after, and the best pair by the least of rank and place in one number
    bits = (width + 1).bit_length()
    none = len(v.by_rank) - 1 << bits
    fill, gone = np.iinfo(np.int32).max, -1
    sym = np.full((width + 2, n), fill, np.int32)
    sym[1:-1] = np.where(points >= 0, v.symbols(points), fill).T
    agenda = np.full((width + 1, n), none, np.int32 if none < 2**31 - 2**bits else np.int64)
    agenda[1:] = (v.pair_ranks(sym[1:-1], sym[2:]) << bits) + np.arange(1, width + 1)[:, None]
    after = np.arange(n, (width + 3) * n)
    before = np.arange(-n, (width + 1) * n)
    flat, pairs = sym.reshape(-1), agenda.reshape(-1)
    turn = 0
    while True:
        best = agenda.min(axis=0)
        row = np.flatnonzero(best < none)
        if not len(row):
            break
        best = best[row].astype(np.int64)
        piece, place = v.by_rank[best >> bits], best & (1 << bits) - 1
        at = place * n + row
        skip = skips(turn, row, place - 1, piece)
        turn += 1
        if skip is not None and skip.any():
            pairs[at[skip]] = none
            go = np.flatnonzero(~skip)
            piece, place, at = piece[go], place[go], at[go]
        lost, left = after[at], before[at]
        right = after[lost]
        flat[at] = piece
        flat[lost] = gone
        pairs[lost] = none
        after[at] = right
        before[right] = at
        # the two pairs the merged one is part of are looked up anew
        pairs[at] = (v.pair_ranks(piece, flat[right]) << bits) + place
        pairs[left] = (v.pair_ranks(flat[left], piece) << bits) + left // n
    out = sym[1:-1].T
    keep = (out != gone) & (out != fill)
    return out[keep].astype(np.int64), keep.sum(axis=1)


def _mix_one(h: int) -> int:
    """mix of a single number."""
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _ALL
    return h ^ h >> 31


def _cut_one(v: Vocabulary, unit: str, key: int, dropout: float) -> np.ndarray:
    """Symbols of one unit of any length, by an agenda on a heap; the same result as _cut_many."""
    points = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    own = 0  # _unit_hash of a single unit
    for c in points.tolist():
        own = _mix_one(own + c + 0x632BE59BD9B4E019 & _ALL)
    own = own + key & _ALL
    least = _least(dropout) << 11
    points = v.symbols(points)
    sym = points.tolist()
    after = [*range(1, len(sym)), -1]
    before = list(range(-1, len(sym) - 1))
    none, ranks, by_rank = len(v.by_rank) - 1, v.rank_of_one, v.by_rank.tolist()
    first = v.pair_ranks(points, np.append(points[1:], v.size)).tolist()
    # a pair that no longer stands has a side that is gone or another piece
    heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(first) if r < none]
    heapq.heapify(heap)
    while heap:
        r, i, one, two = heapq.heappop(heap)
        j = after[i]
        if sym[i] != one or j < 0 or sym[j] != two:
            continue
        m = by_rank[r]
        if _mix_one(own + _mix_one(i * 0x9E3779B97F4A7C15 + m & _ALL) & _ALL) < least:
            continue
        sym[i] = m
        sym[j] = None
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            r = ranks(m, sym[k])
            if r < none:
                heapq.heappush(heap, (r, i, m, sym[k]))
        k = before[i]
        if k >= 0:
            r = ranks(sym[k], m)
            if r < none:
                heapq.heappush(heap, (r, k, sym[k], m))
    return np.array([s for s in sym if s is not None], np.int64)


def _large(texts: list[str] | pa.Array) -> pa.Array:
    return texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units of all texts, number of each text's), word marks written as spaces; a mark that stands in the text itself is a unit."""
    some = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    counts = np.zeros(len(texts), np.int64)
    if not some.any():
        return pa.array([], pa.large_string()), counts
    space = pa.scalar(" ", pa.large_string())
    data, ends = buffers(pa.compute.binary_join_element_wise(space, texts.filter(pa.array(some)), pa.scalar("", pa.large_string())))
    begins = np.zeros(len(data) + 1, bool)
    is_space = data == 32
    begins[1:-1] = is_space[1:] & ~is_space[:-1]
    begins[ends[:-1]] = True
    own = MARK.encode()
    mark = np.flatnonzero((data[:-2] == own[0]) & (data[1:-1] == own[1]) & (data[2:] == own[2]))
    begins[mark] = begins[mark + 3] = True
    begins[-1] = False
    start = np.flatnonzero(begins)
    counts[some] = np.diff(np.searchsorted(start, ends))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data)), counts


def _marked(units: pa.Array) -> list[str]:
    """The strings of units, with word marks; cut out of one string."""
    whole = buffers(units)[0].tobytes().decode().replace(" ", MARK)
    return [whole[a:b] for a, b in pairwise([0, *np.cumsum(pa.compute.utf8_length(units).to_numpy(zero_copy_only=False)).tolist()])]


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate([self.held[:self.n], np.zeros(max(n, 2 * len(self.held)) - self.n, self.held.dtype)])
        self.held[self.n: n] = values
        self.n = n

    def __getitem__(self, at):
        return self.held[at]


class _Traces:
    """What follows from a unit and the turns of its agenda at which the pair was skipped: the pairs of the later turns if
    none of them is skipped (with the trace to go on with if it is; -1 where not known yet), and the pieces."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.root: dict[str, int] = {}
        self.points = _Column(np.int32)
        # of each trace: its unit, the trace it leaves and the turn after that, its pairs, its pieces
        self.unit, self.size, self.hash = _Column(np.int64), _Column(np.int64), _Column(_U)
        self.parent, self.turn = _Column(np.int64), _Column(np.int64)
        self.start, self.count = _Column(np.int64), _Column(np.int64)
        self.at, self.length = _Column(np.int64), _Column(np.int64)
        self.salt, self.child, self.ids = _Column(_U), _Column(np.int32), _Column(np.int32)

    def __len__(self) -> int:
        return self.parent.n

    def _learn(self, unit: np.ndarray, size: np.ndarray, parent: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Numbers of the new traces that leave ``parent`` (-1: none, and so for all) when the pair before ``turn`` is skipped."""
        number = np.zeros(len(unit), np.int64)
        order = np.argsort(size, kind="stable")
        bound = np.searchsorted(size[order], (0, 6, 8, 10, 12, 16, 24, LONG), "right")
        for s, e in zip(bound[:-1].tolist(), bound[1:].tolist()):
            for lo in range(s, e, 8_000):
                part = order[lo: min(e, lo + 8_000)]
                number[part] = self._cut(unit[part], size[part], parent[part], turn[part])
        return number

    def _cut(self, unit: np.ndarray, size: np.ndarray, parent: np.ndarray, turn: np.ndarray) -> np.ndarray:
        n, new = len(unit), len(self)
        forced = np.zeros((n, int(turn.max()) + 1), bool)
        row, up, last = np.arange(n), parent, turn
        while len(row := row[(go := up >= 0)]):
            up, last = up[go], last[go]
            forced[row, last - 1] = True
            up, last = self.parent[up], self.turn[up]
        log: list = []

        leaves = parent[0] >= 0

        def skips(k, rows, place, piece):
            if not leaves:
                log.append((rows, place, piece))
                return None
            later = turn[rows] <= k
            log.append((rows[later], place[later], piece[later]))
            return forced[rows, k] if k < forced.shape[1] else None
        points = _rows(self.points.held, unit, size)
        flat, length = _cut_rows(self.v, points, skips)
        row, place, piece = (np.concatenate([x[c] for x in log]) if log else np.zeros(0, np.int64) for c in range(3))
        order = np.argsort(row, kind="stable")
        count = np.bincount(row, minlength=n)
        ids, wide = spelled(self.v, flat)
        first = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(length)])]
        known = self.hash[parent] if leaves else _unit_hash(points)
        for column, values in ((self.unit, unit), (self.size, size), (self.hash, known), (self.parent, parent), (self.turn, turn),
                               (self.start, self.salt.n + np.cumsum(count) - count), (self.count, count), (self.at, self.ids.n + first[:-1]),
                               (self.length, np.diff(first)), (self.salt, _salt(place[order], piece[order])),
                               (self.child, np.full(len(order), -1, np.int32)), (self.ids, ids)):
            column.add(values)
        return np.arange(new, new + n)

    def walk(self, units: list[str], which: np.ndarray, keys: np.ndarray, dropout: float) -> np.ndarray:
        """The trace at which each occurrence (of the distinct ``units``, by number) ends; the same pieces as _cut_many with its key."""
        new = [x for x in units if x not in self.root]
        if new:
            points, size = _points(new)
            begin = self.points.n + np.cumsum(size) - size
            self.points.add(points)
            self.root.update(zip(new, self._learn(begin, size, np.full(len(new), -1), np.zeros(len(new), np.int64)).tolist()))
        node = np.fromiter(map(self.root.__getitem__, units), np.int64, len(units))[which]
        who = np.arange(len(which) if dropout > 0 else 0)
        while len(who):
            at = node[who]
            count = self.count[at]
            pair = _ragged(self.start[at], count)
            mine = np.repeat(np.arange(len(who)), count)
            hit = np.flatnonzero(_skips((self.hash[at] + keys[who])[mine], self.salt[pair], dropout))
            first = np.ones(len(hit), bool)
            first[1:] = mine[hit[1:]] != mine[hit[:-1]]
            hit = hit[first]
            pair, at, who = pair[hit], at[mine[hit]], who[mine[hit]]
            dark = np.flatnonzero(self.child[pair] < 0)
            if len(dark):
                unknown, one = np.unique(pair[dark], return_index=True)
                leaves = at[dark[one]]
                turns = self.turn[leaves] + unknown - self.start[leaves] + 1
                known = self._learn(self.unit[leaves], self.size[leaves], leaves, turns)
                self.child.held[unknown] = known
            node[who] = self.child[pair]
        return node


def spelled(v: Vocabulary, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of symbols, number of each): a character without a piece gives its UTF-8 bytes' pieces."""
    c = symbols - v.size
    wide = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    if (c < 0).all():
        return symbols.astype(np.int32), wide
    c, n = np.repeat(c, wide), np.repeat(wide, wide)
    k = _ragged(np.zeros(len(wide), np.int64), wide)
    low = np.maximum(c, 0) >> 6 * (n - 1 - k)
    byte = np.where(n == 1, low & 127, np.where(k == 0, (0xF00 >> n) & 255 | low, 128 | low & 63)) & 255
    return np.where(c < 0, c + v.size, v.bytes[byte]).astype(np.int32), wide


class Encoder:
    """``variants`` is accepted from earlier callers and has no effect: every occurrence is drawn on its own."""

    def __init__(self, vocabulary: Vocabulary, seed: int, dropout: float, variants: int = 4, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.v, self.dropout = vocabulary, dropout
        self.salt = hashlib.blake2b(f"pieces:{seed}".encode(), digest_size=16).digest()
        self.own = vocabulary.bytes[list(MARK.encode())].astype(np.int32)
        self.traces = _Traces(vocabulary)

    def units(self, text: str) -> list[str | None]:
        """The text's units; None for a mark that stands in the text itself."""
        units, _ = _units(pa.array([text], pa.large_string()))
        return [None if x == MARK else x.replace(" ", MARK) for x in units.to_pylist()]

    def keys(self, texts: list[str] | pa.Array, counts: np.ndarray) -> np.ndarray:
        """A key for each unit: of the seed, its text and its number there."""
        data, ends = buffers(_large(texts))
        of = np.array([int.from_bytes(hashlib.blake2b(data[s:e], key=self.salt, digest_size=8).digest(), "little") for s, e in pairwise(ends.tolist())], _U)
        return mix(np.repeat(of, counts) + _ragged(np.ones(len(counts), np.int64), counts).astype(_U) * _U(0x9E3779B97F4A7C15))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Piece ids of each text."""
        ids, ends = self.encode_whole(texts)
        return [ids[s:e] for s, e in pairwise(ends.tolist())]

    def encode_whole(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, where each text's begin and the last one's end)."""
        if len(self.traces) > self.remembered:
            self.traces = _Traces(self.v)
        texts = _large(texts)
        units, counts = _units(texts)
        keys = self.keys(texts, counts)
        units = units.dictionary_encode()
        which, units = units.indices.to_numpy(zero_copy_only=False), units.dictionary
        # a mark of the text itself, and what is encoded one by one
        own = pa.compute.equal(units, MARK).to_numpy(zero_copy_only=False)
        alone = own | (pa.compute.utf8_length(units).to_numpy() > LONG)
        number = np.cumsum(~alone) - 1
        short = units.filter(pa.array(~alone)) if alone.any() else units
        mine = np.flatnonzero(~alone[which]) if alone.any() else np.arange(len(which))
        start, length = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        node = self.traces.walk(_marked(short), number[which[mine]], keys[mine], self.dropout)
        start[mine], length[mine] = self.traces.at[node], self.traces.length[node]
        ids = [self.traces.ids.held[:self.traces.ids.n]]
        at = len(ids[0])
        for i in np.flatnonzero(alone[which]).tolist() if alone.any() else ():
            k = int(which[i])
            ids.append(self.own if own[k] else spelled(self.v, _cut_one(self.v, units[k].as_py().replace(" ", MARK), int(keys[i]), self.dropout))[0])
            start[i], length[i] = at, len(ids[-1])
            at += len(ids[-1])
        whole = (np.concatenate(ids) if len(ids) > 1 else ids[0])[_ragged(start, length)]
        return whole, np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text that was encoded."""
    whole = b"".join(map(v.spelled.__getitem__, ids.tolist()))
    return whole[1:].decode()  # without the leading mark


def _lossless(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text's ids decode to it; ``pieces`` holds the bytes of all pieces."""
    back, place = buffers(pieces.take(pa.array(ids)))
    data, own = buffers(texts)
    place = place[ends]
    size = np.diff(place) - (np.diff(place) > 0)  # without the leading mark
    out = size == np.diff(own)
    for i in np.flatnonzero(out).tolist():
        out[i] = np.array_equal(back[place[i + 1] - size[i]: place[i + 1]], data[own[i]: own[i + 1]])
    return out


def _encode(v: Vocabulary, seed: int, dropout: float, variants: int, names: list[str], check: bool, remembered: int = REMEMBERED):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v, seed, dropout, variants, remembered)
        pieces = pa.array(v.spelled, pa.large_binary())
        for batch in batches:
            for at, end, texts in text_chunks(batch):  # tables of a megabyte's units, never of a whole batch's
                ids, ends = encoder.encode_whole(texts)
                columns = {n: batch.column(n).slice(at, end - at) for n in names}
                if check:
                    columns["n_chars"] = pa.compute.utf8_length(texts).cast(pa.int64())
                    columns["n_tokens"] = pa.array(np.diff(ends))
                    columns["tokens_sha256"] = pa.array([hashlib.sha256(ids[s:e]).hexdigest() for s, e in pairwise(ends.tolist())])
                    columns["lossless"] = pa.array(_lossless(pieces, ids, ends, texts))
                else:
                    columns["tokens"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def encoded(docs: DataFrame, model_file: str = MODEL, seed: int = 1, dropout: float = 0.1, variants: int = 4,
            column: str = "tokens", remembered: int = 250_000) -> DataFrame:
    """``docs`` with its text's piece ids in ``column`` (an input column of that name gives way). ``variants`` has no effect;
    ``remembered`` bounds a worker's memory (traces kept in a task) and costs time only."""
    rest = docs.drop(column)
    v = Vocabulary(model_file)
    schema = rest.select("*", F.lit(None).cast("array<int>").alias("tokens")).schema
    return rest.mapInArrow(released(_encode(v, seed, dropout, variants, rest.columns, False, remembered)), schema).withColumnRenamed("tokens", column)


def token_digests(docs: DataFrame, model_file: str = MODEL, seed: int = 1, dropout: float = 0.1, variants: int = 4) -> DataFrame:
    """(doc_id, n_chars, n_tokens, tokens_sha256, lossless) of every document; lossless: decoding gave the text back.
    The digest is over the ids as little-endian 32-bit integers."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(released(_encode(Vocabulary(model_file), seed, dropout, variants, ["doc_id"], True)),
                             "doc_id long, n_chars long, n_tokens long, tokens_sha256 string, lossless boolean")
