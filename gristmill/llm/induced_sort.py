"""External induced sorting: a suffix array with common-prefix values, through disk-backed queues.

Suffixes that begin where a rise follows a fall (left-most S) are sorted by a recursion over the names of the
pieces between them. From these the falling suffixes are induced in ascending, then the rising ones in
descending order: an entry of the scanned order puts the suffix one place to its left into the queue of that
suffix's first symbol. Entries are tuples (position, common prefix with the entry before), and what is
induced shares one symbol more than the least common prefix in the order scanned in between. The queue
is keyed by symbols that are taken in order, so the tuples of a symbol are only appended and read once: they stay in
memory up to a bound, and then go to the folder that all machines share. Common prefixes are counted up to a limit.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow.fs

#: Bytes of queued tuples kept in memory where there is a folder for more; symbols of a text that is sorted by ranks
#: rather than by induction.
QUEUED, BASE = 4 << 20, 1 << 23
#: A text is sorted by induction from so many symbols on; its recursions, of large alphabets, from BASE on.
SHORT = 1 << 12


class Spill:
    """Files in a folder (a path or URI that every machine can open), one for each time a queue is full."""

    def __init__(self, folder: str):
        self.fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.path, recursive=True)
        self.open: list = []

    def write(self, arrays: Iterator[np.ndarray]) -> int:
        """The number of the file that now holds the arrays one after the other."""
        name = f"{self.path}/{len(self.open)}"
        with self.fs.open_output_stream(name) as out:
            for a in arrays:
                out.write(np.ascontiguousarray(a).data)
        self.open.append(self.fs.open_input_file(name))
        return len(self.open) - 1

    def read(self, number: int, at: int, n: int, kind: np.dtype) -> np.ndarray:
        return np.frombuffer(self.open[number].read_at(n * kind.itemsize, at), kind)

    def close(self) -> None:
        for f in self.open:
            f.close()
        self.fs.delete_dir(self.path)


class SymbolQueue:
    """Tuples (position, lcp) by symbol, in the order they came; beyond `bound` bytes they go to the spill, if any."""

    def __init__(self, spill: Spill | None, bound: int | None = None):
        self.spill, self.bound, self.held = spill, QUEUED if bound is None else bound, 0
        self.blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.written: dict[int, list[tuple]] = {}

    def push(self, symbol: int, position: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.setdefault(symbol, []).append((position, lcp))
        self.held += position.nbytes + lcp.nbytes
        if self.held > self.bound and self.spill is not None:
            self._write()

    def _write(self) -> None:
        joined = [(symbol, *_joined(blocks)) for symbol, blocks in self.blocks.items()]
        number, at = self.spill.write(a for _, position, lcp in joined for a in (position, lcp)), 0
        for symbol, position, lcp in joined:
            self.written.setdefault(symbol, []).append((number, at, len(position), position.dtype, lcp.dtype))
            at += position.nbytes + lcp.nbytes
        self.blocks, self.held = {}, 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of the symbol, or None: what one file has, or all that is in memory."""
        if self.written.get(symbol):
            number, at, n, one, two = self.written[symbol].pop(0)
            return self.spill.read(number, at, n, one), self.spill.read(number, at + n * one.itemsize, n, two)
        blocks = self.blocks.pop(symbol, None)
        if not blocks:
            return None
        position, lcp = _joined(blocks)
        self.held -= position.nbytes + lcp.nbytes
        return position, lcp

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while (b := self.pop(symbol)) is not None:
            yield b


def _joined(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return blocks[0] if len(blocks) == 1 else tuple(np.concatenate(x) for x in zip(*blocks, strict=True))


class _Least:
    """For each symbol the least common prefix scanned since a suffix was last put into its queue."""

    def __init__(self, limit: int):
        self.limit, self.since, self.time = limit, {}, 0
        # The least of the blocks from each of these times on, and only where it changes.
        self.times, self.mins = [], []

    def _so_far(self, d: int) -> int:
        time, least = self.since[d]
        at = bisect_right(self.times, time)
        return min(least, self.mins[at]) if at < len(self.times) else least

    def scan(self, lcp: np.ndarray, index: np.ndarray, symbol: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """lcp of a scanned block; index of its entries that induce a suffix, and the suffixes' symbols. Yields
        (symbol, index, lcp of the induced) by symbol."""
        self.time += 1
        if len(index):
            order = np.argsort(symbol, kind="stable")
            cuts = np.flatnonzero(np.diff(symbol[order])) + 1
            for part in np.split(order, cuts):
                d, at = int(symbol[part[0]]), index[part]
                starts = np.append(0, at + 1)
                tail = starts[-1] < len(lcp)
                least = np.minimum.reduceat(lcp, starts if tail else starts[:-1])
                own = least[: len(at)].copy()
                known = d in self.since
                if known:
                    own[0] = min(own[0], self._so_far(d))
                own = np.minimum(own + 1, self.limit).astype(lcp.dtype)
                if not known:
                    own[0] = 0
                self.since[d] = (self.time, int(least[-1]) if tail else self.limit)
                yield d, at, own
        whole = int(lcp.min())
        while self.mins and self.mins[-1] >= whole:
            self.mins.pop()
            self.times.pop()
        self.mins.append(whole)
        self.times.append(self.time)


def _kinds(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix rises, how often its first symbol repeats at its start, up to limit). The last symbol is the
    smallest of all and occurs once."""
    n, small = len(text), _small(limit)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1).astype(_index(n))
    size = np.diff(ends, prepend=ends.dtype.type(-1))
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
    repeat = np.repeat(ends + 1, size)
    repeat -= np.arange(n, dtype=repeat.dtype)
    return np.repeat(rises, size), np.minimum(repeat, limit).astype(small)


def _index(n: int) -> type:
    return np.int32 if n < 2**31 - 1 else np.int64


def _small(limit: int) -> type:
    return np.int16 if limit < 2**15 - 1 else np.int32


def _by_ranks(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes of a text in memory, by ranks of 1, 2, 4 ... symbols; ordered by the
    first `limit` symbols at least."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    levels, k = [rank.astype(_index(n))], 1
    while k < limit and levels[-1].max() < n - 1:
        key = levels[-1].astype(np.int64) * (n + 1)
        key[:-k] += levels[-1][k:] + 1
        _, rank = np.unique(key, return_inverse=True)
        levels.append(rank.astype(_index(n)))
        k *= 2
    sa = np.argsort(levels[-1], kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        for _ in range(2 if j == len(levels) - 1 else 1):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = levels[j][a[inside]] == levels[j][b[inside]]
            # A rank of 2^j symbols also says where a suffix ends; those that end differ.
            step = np.where(same, 1 << j, 0)
            got, a, b = got + step, a + step, b + step
    lcp[1:] = np.minimum(got, limit)
    return sa, lcp


def _induce(
    text: np.ndarray, rises: np.ndarray, repeat: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, limit: int, spill: Spill | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, lcp) of the suffix order, in descending order of symbols; within a block ascending.

    seeds: the left-most S suffixes in order (or pieces, where only pieces are to be sorted).
    """
    small = _small(limit)
    symbols = np.unique(text).tolist()
    bounds = np.searchsorted(text[seeds], [*symbols, symbols[-1] + 1]).tolist()
    queue, falling, least = SymbolQueue(spill), SymbolQueue(spill), _Least(limit)

    def induce(position: np.ndarray, lcp: np.ndarray, rising: bool, into: SymbolQueue, least: _Least) -> None:
        left = position - 1
        at = np.flatnonzero((position > 0) & (rises[left] == rising))
        left = left[at]
        for d, index, own in least.scan(lcp, at, text[left]):
            into.push(d, position[index] - 1, own)

    # Falling suffixes, ascending.
    for c, lo, hi in zip(symbols, bounds[:-1], bounds[1:], strict=True):
        last = None
        for position, lcp in queue.take(c):
            induce(position, lcp, False, queue, least)
            falling.push(c, position, lcp)
            last = position[-1]
        if hi > lo:
            position, lcp = seeds[lo:hi], seed_lcp[lo:hi].copy()
            lcp[0] = 0 if last is None else min(repeat[last], repeat[position[0]])
            induce(position, lcp, False, queue, least)
    # Rising suffixes, descending; a common prefix is with the entry scanned before, the larger one.
    queue, least = SymbolQueue(spill), _Least(limit)
    none = np.empty(0, seeds.dtype), np.empty(0, small)
    for c in reversed(symbols):
        rising = []
        for position, lcp in queue.take(c):
            induce(position, lcp, True, queue, least)
            rising.append((position, lcp))
        s, s_lcp = (x[::-1] for x in _joined(rising or [none]))
        f, f_lcp = _joined(list(falling.take(c)) or [none])
        if c == symbols[0] and not len(s):  # the end of the text, which nothing induces
            s, s_lcp = np.array([len(text) - 1], seeds.dtype), np.zeros(1, small)
            induce(s, s_lcp, True, queue, least)
        border = small(min(repeat[f[-1]], repeat[s[0]]) if len(f) and len(s) else 0)
        if len(f):
            induce(f[::-1], np.append(border, f_lcp[:0:-1]), True, queue, least)
        up = np.append(border, s_lcp[:-1]) if len(s) else s_lcp
        yield np.concatenate([f, s]), np.concatenate([f_lcp, up])


def suffix_order(
    text: np.ndarray, limit: int, folder: str | None = None, base: int = BASE, short: int = SHORT
) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before, up to `limit`) of a text of
    non-negative integers. Suffixes that agree in their first `limit` symbols may come in any order."""
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blocks = list(suffix_blocks(text, limit, folder, base, short))[::-1]
    return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])


def suffix_blocks(
    text: np.ndarray, limit: int, folder: str | None = None, base: int = BASE, short: int = SHORT
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, in blocks of one first symbol each, in descending order of symbols. folder: a path or URI for the
    queues' files; without one they stay in memory."""
    n = len(text)
    own = np.empty(n + 1, np.uint16 if n and int(text.max()) < 2**16 - 2 else np.uint32)
    own[:n] = text
    own[:n] += 1
    own[n] = 0
    del text
    spill = None if folder is None else Spill(folder)
    try:
        yield from _sorted_blocks(own, limit, spill, folder, base, short)
    finally:
        if spill is not None:
            spill.close()


def _sorted_blocks(
    text: np.ndarray, limit: int, spill: Spill | None, folder: str | None, base: int, short: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks as _induce() gives them, without the end of the text."""
    n, small = len(text), _small(limit)
    if n <= short:
        sa, lcp = _by_ranks(text, limit)
        sa, lcp = sa[1:], lcp[1:]
        cuts = np.flatnonzero(np.diff(text[sa].astype(np.int64))) + 1
        for p, v in list(zip(np.split(sa, cuts), np.split(lcp, cuts), strict=True))[::-1]:
            if len(p):
                yield p, v
        return
    rises, repeat = _kinds(text, limit)
    lms = (np.flatnonzero(rises[1:] & ~rises[:-1]) + 1).astype(_index(n))
    # Pieces from one to the next, ends included, are sorted by inducing from them in the order of their first symbols.
    seeds = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    number = np.empty(n, _index(n))
    number[lms] = np.arange(len(lms), dtype=_index(n))
    pieces = [number[p[is_lms[p]]] for p, _ in _induce(text, rises, repeat, seeds, np.zeros(len(seeds), small), 1, spill)]
    order = np.concatenate(pieces[::-1])
    del pieces, number, is_lms
    key = _keys(text, lms)[order]
    name = np.empty(len(lms), _index(n))
    name[order] = np.append(0, np.cumsum(key[1:] != key[:-1]))
    del key, order
    # The order of the suffixes that begin at them, from that of the names.
    sa, same = suffix_order(name, limit // 2 + 2, folder, base, base)
    seeds = lms[sa]
    # Equal names are equal symbols up to the next such place; then the pieces differ within their length.
    lcp = np.zeros(len(seeds), np.int64)
    i, j = sa[1:], sa[:-1]
    whole = same[1:]
    a, b = (lms[np.minimum(x + whole, len(lms) - 1)] for x in (i, j))
    lcp[1:] = a - lms[i]
    open_ = np.flatnonzero(lcp[1:] < limit)
    while len(open_):
        inside = (a[open_] < n) & (b[open_] < n)
        open_ = open_[inside]
        open_ = open_[text[a[open_]] == text[b[open_]]]
        lcp[open_ + 1] += 1
        a[open_] += 1
        b[open_] += 1
        open_ = open_[lcp[open_ + 1] < limit]
    lcp = np.minimum(lcp, limit).astype(small)
    del name, sa, same, i, j, whole, a, b
    for p, v in _induce(text, rises, repeat, seeds, lcp, limit, spill):
        if text[p[0]] != 0:
            yield p, v


def _keys(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64 bits of each piece of the text, from a start to the next, ends included."""
    size = np.append(np.diff(start) + 1, 1)
    x = (np.arange(1, int(size.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):  # in parts, as a part takes 30 bytes a symbol
        stop = max(at + 1, int(np.searchsorted(start, start[at] + (1 << 20))))
        part = size[at:stop]
        ends = np.cumsum(part)
        index = np.arange(ends[-1]) - np.repeat(ends - part, part)
        value = (text[np.repeat(start[at:stop], part) + index].astype(np.uint64) + np.uint64(1)) * x[index]
        out[at:stop] = np.add.reduceat(value, ends - part)
        at = stop
    return (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) ^ size.astype(np.uint64)
