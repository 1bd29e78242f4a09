"""Suffixes of many short strings in order, by induced sorting with queues on disk.

A suffix is of type S when it is smaller than the one after it, else of type L; an S suffix
after an L one is a star. Once the stars are in order, a scan upwards finds the order of the
L suffixes and a scan downwards that of the S suffixes: each suffix taken from the queue
induces the one before it, which enters the queue under its first symbol. Entries carry the
place of the suffix and the length of the prefix it shares with the entry before it under
that symbol, which follows from the shared prefixes of the suffixes that were taken in
between. The stars are ordered by naming the pieces between them (one more pair of scans)
and sorting the strings of names, by recursion while those are many.

Entries are taken and induced in blocks, as arrays. A queue holds a bounded number of
entries in memory and writes the others to a file in the order they came; the text and the
arrays that grow with it lie in files beyond the same bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from tempfile import TemporaryFile

import numpy as np

#: Entries taken from a queue at a time, entries a queue holds in memory, and symbols whose
#: order is found in memory instead of by recursion.
BLOCK, HELD, IN_MEMORY = 65_536, 4_000_000, 2_000_000
NONE = 255


class Store:
    """Numbers that are appended, in memory up to a bound and beyond it in a file."""

    def __init__(self, kind, held: int):
        self.kind, self.held, self.parts, self.size, self.file = np.dtype(kind), held, [], 0, None

    def add(self, some: np.ndarray) -> None:
        self.parts.append(np.ascontiguousarray(some, self.kind))
        self.size += len(some)
        if self.size > self.held:
            self.file = self.file or TemporaryFile()
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts = []

    def array(self) -> np.ndarray:
        if self.file is None:
            self.parts = [np.concatenate(self.parts)] if self.parts else [np.zeros(0, self.kind)]
            return self.parts[0]
        for part in self.parts:
            self.file.write(part.tobytes())
        self.parts = []
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=(self.size,))


class Queue:
    """A priority queue of (symbol, place, shared prefix): whole symbols are taken in order,
    entries of one symbol in the order they came."""

    def __init__(self, held: int):
        self.limit, self.size, self.file = held, 0, None
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.places: dict[int, list[tuple[int, int]]] = {}

    def push(self, symbols: np.ndarray, place: np.ndarray, shared: np.ndarray) -> None:
        """Entries sorted by symbol."""
        if not len(symbols):
            return
        cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(symbols)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            self.held.setdefault(int(symbols[a]), []).append((place[a:b], shared[a:b]))
        self.size += len(symbols)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or TemporaryFile()
        self.file.seek(0, 2)
        for symbol in sorted(self.held):
            place, shared = (np.concatenate(c) for c in zip(*self.held[symbol], strict=True))
            for i in range(0, len(place), BLOCK):
                self.places.setdefault(symbol, []).append((self.file.tell(), len(place[i : i + BLOCK])))
                self.file.write(place[i : i + BLOCK].astype(np.int64).tobytes() + shared[i : i + BLOCK].tobytes())
        self.held, self.size = {}, 0

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of the symbol's entries, those that come meanwhile included."""
        while True:
            if written := self.places.get(symbol):
                at, n = written.pop(0)
                self.file.seek(at)
                raw = self.file.read(9 * n)
                yield np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n)
            elif parts := self.held.pop(symbol, None):
                place, shared = (np.concatenate(c) for c in zip(*parts, strict=True))
                self.size -= len(place)
                for i in range(0, len(place), BLOCK):
                    yield place[i : i + BLOCK], shared[i : i + BLOCK]
            else:
                return


class _Carry:
    """The least shared prefix met since an entry was last pushed under each symbol."""

    def __init__(self, symbols: int, most: int):
        self.low, self.seen, self.most = np.full(symbols, NONE, np.uint8), np.zeros(symbols, bool), most

    def pushed(self, shared: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the entries `at` of a block, pushed under `symbol`: their order by symbol and
        what each shares with the entry pushed before it."""
        order = np.argsort(symbol, kind="stable")
        to, end = symbol[order], at[order]
        first = np.ones(len(to), bool)
        first[1:] = to[1:] != to[:-1]
        begin = np.zeros(len(to), np.int64)
        begin[1:] = end[:-1] + 1
        begin[first] = 0
        least = _range_min(shared, begin, end)
        least = np.where(first, np.minimum(least, self.low[to]), least)
        out = np.minimum(least.astype(np.int64) + 1, self.most).astype(np.uint8)
        out[first & ~self.seen[to]] = 0
        after = np.append(np.minimum.accumulate(shared[::-1])[::-1], NONE).astype(np.uint8)
        self.low = np.minimum(self.low, after[0])
        last = np.append(first[1:], True)[: len(to)]
        self.low[to[last]] = after[end[last] + 1]
        self.seen[to[last]] = True
        return order, out


def _range_min(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[begin : end + 1]."""
    if not len(begin):
        return np.zeros(0, np.uint8)
    size = end - begin + 1
    level = np.frexp(size)[1] - 1  # floor of the binary logarithm
    out = np.empty(len(begin), np.uint8)
    table = values
    for k in range(int(level.max()) + 1):
        some = np.flatnonzero(level == k)
        if len(some):
            out[some] = np.minimum(table[begin[some]], table[end[some] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols the suffixes at a and b share, `most` at most; an end is shared by none."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for d in range(most):
        x = text[a[open_] + d]
        open_ = open_[(x == text[b[open_] + d]) & (x != 0)]
        if not len(open_):
            break
        out[open_] = d + 1
    return out.astype(np.uint8)


def _scans(text: np.ndarray, stars: np.ndarray, symbols: np.ndarray, most: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the ends, largest first: blocks of (place, prefix shared with the one
    before it). `stars` in order; with `most` 0 no prefixes are carried."""
    n_symbols = int(symbols[-1]) + 1
    first_star = np.searchsorted(text[stars], np.append(symbols, n_symbols)) if len(stars) else np.zeros(len(symbols) + 1, np.int64)
    nothing = np.zeros(0, np.uint8)

    def induced(queue, carry, place, shared, symbol, wanted: Callable[[np.ndarray], np.ndarray]):
        before = text[place - 1]  # bytes stay 16 bits wide, which numpy sorts by radix
        at = np.flatnonzero(wanted(before))
        before = before[at]
        if carry is None:
            order, more = np.argsort(before, kind="stable"), np.zeros(len(at), np.uint8)
        else:
            order, more = carry.pushed(shared, at, before)
        queue.push(before[order], place[at[order]] - 1, more)

    def star_prefixes(some: np.ndarray, last: int | None) -> np.ndarray:
        if not most:
            return np.zeros(len(some), np.uint8)
        ahead = np.concatenate([[some[0] if last is None else last], some[:-1]])
        out = shared_prefix(text, ahead, some, most)
        if last is None:
            out[0] = 0
        return out

    upward, larger = Queue(held), Queue(held)  # to be taken; the L suffixes in order
    carry = _Carry(n_symbols, most) if most else None
    for k, symbol in enumerate(symbols.tolist()):
        last = None
        for place, shared in upward.take(symbol):
            larger.push(np.full(len(place), symbol), place, shared)
            induced(upward, carry, place, shared, symbol, lambda c, s=symbol: c >= s)
            last = int(place[-1])
        for i in range(first_star[k], first_star[k + 1], BLOCK):
            place = np.asarray(stars[i : min(i + BLOCK, first_star[k + 1])])
            shared = star_prefixes(place, last) if symbol else np.zeros(len(place), np.uint8)
            induced(upward, carry, place, shared, symbol, lambda c, s=symbol: c > s)
            last = int(place[-1])

    downward = Queue(held)
    carry = _Carry(n_symbols, most) if most else None
    for symbol in symbols[::-1].tolist():
        if not symbol:
            continue
        last = None
        for place, shared in downward.take(symbol):
            yield place, shared
            induced(downward, carry, place, shared, symbol, lambda c, s=symbol: (c > 0) & (c <= s))
            last = int(place[-1])
        # the L suffixes come back largest first; what each shares is noted with the one after it
        blocks = list(larger.take(symbol))
        after = nothing
        if blocks and last is not None and most:
            after = shared_prefix(text, np.array([blocks[-1][0][-1]]), np.array([last]), most)
        for place, shared in reversed(blocks):
            down = np.concatenate([shared[1:], after if len(after) else np.zeros(1, np.uint8)])[::-1]
            after = shared[:1]
            place = place[::-1]
            yield place, np.ascontiguousarray(down)
            induced(downward, carry, place, down, symbol, lambda c, s=symbol: (c > 0) & (c < s))


def _stars(text: np.ndarray, base: int = 0) -> np.ndarray:
    """Places of the stars, ends among them, of whole strings (a 0 ends each)."""
    if not len(text):
        return np.zeros(0, np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    run_end = np.append(change, len(text) - 1)
    rises = np.ones(len(run_end), bool)  # the last run is an end, which is of type S
    rises[:-1] = text[run_end[:-1] + 1] > text[run_end[:-1]]
    run_begin = np.concatenate([[0], run_end[:-1] + 1])
    star = rises.copy()
    star[1:] &= ~rises[:-1]
    star[0] = False
    return run_begin[star] + base


def _sorted_in_memory(text: np.ndarray) -> np.ndarray:
    """Places but 0 in the order of their suffixes, by doubling."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    to_end = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n)
    order = np.argsort(text, kind="stable")
    new = np.ones(n, bool)
    new[1:] = text[order][1:] != text[order][:-1]
    rank = np.empty(n, np.int64)  # of equal ones, the number of smaller ones
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    open_, h, longest = order[~alone], 1, int(to_end.max()) + 1
    while h < longest and len(open_):
        old = rank[open_]
        ahead = np.where(to_end[open_] >= h, rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        by = np.argsort(old * (n + 2) + ahead, kind="stable")
        open_, old, ahead = open_[by], old[by], ahead[by]
        at = np.arange(len(open_))
        group, part = np.ones(len(open_), bool), np.ones(len(open_), bool)
        group[1:] = old[1:] != old[:-1]
        part[1:] = group[1:] | (ahead[1:] != ahead[:-1])
        first = np.maximum.accumulate(np.where(part, at, 0))
        rank[open_] = old + first - np.maximum.accumulate(np.where(group, at, 0))
        open_ = open_[~(part & np.append(part[1:], True))]
        h *= 2
    order = np.argsort(rank, kind="stable")
    return order[order > 0]


def _same_pieces(text: np.ndarray, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the pieces (place, symbols) are equal."""
    same = size_a == size_b
    open_ = np.flatnonzero(same)
    d = 0
    while len(open_):
        x = text[a[open_] + d] == text[b[open_] + d]
        same[open_[~x]] = False
        open_ = open_[x]
        d += 1
        open_ = open_[size_a[open_] > d]
    return same


def _ordered_stars(text: np.ndarray, stars: np.ndarray, held: int, in_memory: int) -> np.ndarray:
    """The stars, given by place, in the order of their suffixes."""
    every = np.unique(np.concatenate([np.unique(text[i : i + (1 << 22)]) for i in range(0, len(text), 1 << 22)])).astype(np.int64)
    by_symbol = stars[np.argsort(text[stars], kind="stable")]
    ends = np.flatnonzero(text[stars] == 0)
    # sorting from stars in order of their first symbol alone puts the pieces in order
    size = np.append(np.diff(stars), 0) + 1
    size[ends] = 1
    number = np.zeros(len(stars), np.int64)
    kind = np.int32 if len(stars) < 1 << 31 else np.int64
    number_of = np.zeros(len(text), kind) if len(text) <= 8 * held else np.memmap(TemporaryFile(), kind, "w+", shape=(len(text),))
    number_of[stars] = np.arange(1, len(stars) + 1)
    name, before = 1, None  # ends are 0; names are given from the largest down
    for place, _ in _scans(text, by_symbol, every, 0, held):
        at = number_of[place]
        at = at[at > 0] - 1
        if not len(at):
            continue
        at = at if before is None else np.concatenate([[before], at])
        same = _same_pieces(text, stars[at[:-1]], size[at[:-1]], stars[at[1:]], size[at[1:]])
        names = name + np.cumsum(np.concatenate([[0], (~same).astype(np.int64)]))
        number[at] = names
        name, before = int(names[-1]), int(at[-1])
    number = np.where(number > 0, name + 1 - number, 0)
    del number_of, by_symbol
    if name == len(stars) - len(ends):
        order = np.argsort(number, kind="stable")
    else:
        reduced = np.concatenate([[0], number])
        if len(reduced) <= in_memory:
            order = _sorted_in_memory(reduced) - 1
        else:
            own = _stars(reduced)
            own = own[own > 0]
            inner = _ordered_stars(reduced, own, held, in_memory)
            down = Store(np.int64, held)
            for place, _ in _scans(reduced, inner, np.unique(reduced), 0, held):
                down.add(place)
            order = np.concatenate([ends + 1, down.array()[::-1]]) - 1
    return stars[order]


class Strings:
    """Strings of bytes that are appended and then sorted."""

    def __init__(self, held: int = HELD, in_memory: int = IN_MEMORY):
        self.held, self.in_memory = held, in_memory
        self.text, self.stars, self.starts = Store(np.uint16, 8 * held), Store(np.int64, held), Store(np.int64, held)
        self.text.add(np.zeros(1))

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Strings of the given sizes, none empty, one after another."""
        if not len(sizes):
            return
        stops = np.cumsum(sizes)
        text = np.insert(flat.astype(np.uint16) + 1, stops, 0)
        begin = stops - sizes + np.arange(len(sizes))
        self.stars.add(_stars(text, self.text.size))
        self.starts.add(begin + self.text.size)
        self.text.add(text)

    def found(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of places, and the places in them."""
        starts = self.starts.array()
        string = np.searchsorted(starts, place, "right") - 1
        return string, place - starts[string]

    def descending(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes, largest first, in blocks of (place, prefix shared with the suffix
        before it, `most` at most). Equal suffixes are in any order."""
        if not self.starts.size:
            return
        text, stars = self.text.array(), self.stars.array()
        order = _ordered_stars(text, stars, self.held, self.in_memory)
        symbols = np.flatnonzero(np.bincount(text, minlength=257)) if len(text) < 1 << 22 else np.arange(257)
        yield from _scans(text, order, symbols, most, self.held)
