"""Pieces of text between white space, numbered by the batch in numpy.

A piece's bytes are read as 64-bit words and mixed word by word into a hash, all
pieces of a batch together.  An open-addressing table turns hashes to numbers,
and a hit counts only if the bytes agree: the words of every numbered piece are
kept.  A piece whose hash another piece has is learned anew each time, as are
pieces longer than LONGEST bytes, so numbers are exact for any text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import xxhash

LONGEST = 256
#: ASCII white space of the tokenizer, and first bytes of other white space in UTF-8 with what may follow.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LEAD = np.zeros(256, bool)
LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
WIDE = [bytes(chr(c), "utf-8") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
CODES = {n: np.array([int.from_bytes(w, "big") for w in WIDE if len(w) == n]) for n in (2, 3)}
#: The first k bytes of a word.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Batch(NamedTuple):
    """Pieces of a batch: its bytes (eight zeros behind them), and each piece's start, size, first word and hash."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    word: np.ndarray
    hashes: np.ndarray

    def load(self, k: int, at: np.ndarray) -> np.ndarray:
        """The k-th word of the pieces `at`, which have more than 8 k bytes."""
        rows = np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 7, 8), (1, 1))
        return rows[self.starts[at] + 8 * k].view("<u8").ravel() & MASK[np.minimum(self.sizes[at] - 8 * k, 8)]

    def raw(self, at: np.ndarray) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[s : s + n] for s, n in zip(self.starts[at].tolist(), self.sizes[at].tolist())]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b, at most LONGEST long, have the same bytes."""
        out = (self.sizes[a] == self.sizes[b]) & (self.word[a] == self.word[b])
        live, k = np.flatnonzero(out & (self.sizes[a] > 8)), 1
        while len(live):
            out[live] = self.load(k, a[live]) == self.load(k, b[live])
            k += 1
            live = live[out[live] & (self.sizes[a[live]] > 8 * k)]
        return out


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces in UTF-8 bytes that end with a blank."""
    blank = BLANK[data]
    at = np.flatnonzero(LEAD[data])
    if len(at):
        code = data[at].astype(np.int64) << 8 | data[np.minimum(at + 1, len(data) - 1)]
        for n in (2, 3):
            hit = at[np.isin(code, CODES[n])]
            for k in range(n):
                blank[hit + k] = True
            code = code << 8 | data[np.minimum(at + 2, len(data) - 1)]
    return edges(blank)


def edges(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches between blanks; the last byte is one."""
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
    return edge[::2], edge[1::2]


def batch(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> Batch:
    """The pieces with their 64-bit hashes, which are never 0."""
    return hashed(data, starts, ends, seed)[0]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *seeds: int) -> tuple[Batch, list[np.ndarray]]:
    """The pieces with their hashes for the first seed, and the hashes for every seed."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    sizes = ends - starts
    every = [sizes.astype(np.uint64) * MIX[0] ^ np.uint64(xxhash.xxh64_intdigest(b"", seed & (1 << 64) - 1)) for seed in seeds]
    out = Batch(data, starts, sizes, np.empty(0, np.uint64), every[0])
    live = np.arange(len(starts))
    first = out.load(0, live)
    out = out._replace(word=first)
    x, k = first, 0
    while len(live):
        for h in every:
            v = (h[live] if k else h) ^ x
            v *= MIX[1]
            v ^= v >> np.uint64(29)
            v *= MIX[2]
            v ^= v >> np.uint64(32)
            if k:
                h[live] = v
            else:
                h[:] = v
        k += 1
        live = live[(sizes[live] > 8 * k) & (sizes[live] <= LONGEST)]
        x = out.load(k, live) if len(live) else x
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        for h, seed in zip(every, seeds):
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed & (1 << 64) - 1)
    for h in every:
        h[h == 0] = 1
    return out, every


class Table:
    """Hash to number by linear probing; at most half full."""

    def __init__(self, most: int):
        self.bits = (2 * most - 1).bit_length()
        self.most, self.shift = most, np.uint64(64 - self.bits)
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers; -1 for hashes that aren't there."""
        mask = (1 << self.bits) - 1
        at = (h >> self.shift).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == h, self.values[at], -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.keys[at[open_]]
            hit = got == h[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that aren't there."""
        mask = (1 << self.bits) - 1
        at = (h >> self.shift).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[at[todo]] == 0
            self.keys[at[todo[free]]] = h[todo[free]]
            won = self.keys[at[todo]] == h[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & mask
        self.n += len(h)


def room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)])


class Pieces:
    """Exact numbers of at most `most` pieces: the table, and the words of each piece."""

    def __init__(self, most: int):
        self.table = Table(most)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.size, self.word, self.begin, self.number = (np.empty(1 << 12, t) for t in (np.int64, np.uint64, np.int64, np.int64))
        self.more, self.used = np.empty(1 << 12, np.uint64), 0

    def find(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's number (-1: not there), and which pieces may be added: no other has their hash."""
        at = self.table.find(b.hashes)
        hit = np.flatnonzero(at >= 0)
        own = at[hit]
        ok = (self.size[own] == b.sizes[hit]) & (self.word[own] == b.word[hit])
        live, k = np.flatnonzero(ok & (b.sizes[hit] > 8)), 1
        while len(live):
            ok[live] = self.more[self.begin[own[live]] + k - 1] == b.load(k, hit[live])
            k += 1
            live = live[ok[live] & (b.sizes[hit[live]] > 8 * k)]
        out = np.full(len(at), -1)
        out[hit[ok]] = self.number[own[ok]]
        free = (at < 0) & (b.sizes <= LONGEST)
        return out, free

    def add(self, b: Batch, at: np.ndarray, numbers: np.ndarray) -> None:
        """Keeps the pieces `at`, whose hashes differ and aren't there."""
        n, m = self.table.n, self.table.n + len(at)
        for name, x in (("size", b.sizes[at]), ("word", b.word[at]), ("number", numbers)):
            a = room(getattr(self, name), m)
            a[n:m] = x
            setattr(self, name, a)
        words = (b.sizes[at] - 1) // 8
        self.begin = room(self.begin, m)
        self.begin[n:m] = self.used + np.cumsum(words) - words
        self.used += int(words.sum())
        self.more = room(self.more, self.used)
        live, k = np.flatnonzero(words), 1
        while len(live):
            self.more[self.begin[n + live] + k - 1] = b.load(k, at[live])
            k += 1
            live = live[words[live] >= k]
        self.table.add(b.hashes[at], np.arange(n, m))


def numbered(texts: list[bytes], known: Pieces, learn: Callable[[list[str]], np.ndarray], clear: Callable[[], None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Number of each piece of a batch of UTF-8 texts end to end, and each text's number of pieces.

    `learn(pieces)` gives the numbers of new pieces; `clear()` forgets all, when
    the table is full.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = bounds(data)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    count = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)])))
    b = batch(data, starts, ends, seed)
    if known.table.n > known.table.most * 3 // 4:
        known.clear()
        clear()
    out, free = known.find(b)
    new = np.flatnonzero((out < 0) & free)
    if len(new):
        _, first, back = np.unique(b.hashes[new], return_index=True, return_inverse=True)
        first = new[first]
        numbers = np.asarray(learn([x.decode() for x in b.raw(first)]))
        alike = b.same(new, first[back])
        out[new[alike]] = numbers[back[alike]]
        # The rest of a batch that overfills the table is learned again later.
        fits = max(0, known.table.most - known.table.n)
        known.add(b, first[:fits], numbers[:fits])
    rest = np.flatnonzero(out < 0)
    if len(rest):
        out[rest] = learn([x.decode() for x in b.raw(rest)])
    return out, count
