"""External induced sorting of suffixes with their common prefixes.

The text is a string over bytes, separators and one last sentinel. Suffixes are of type L or S as they are larger or smaller than the next one;
an S after an L is an S*. The substrings between neighbouring S* get names by rank, and the S* suffixes are sorted by their names: by doubling,
as far as `cap` symbols. From these, one scan upwards induces all L suffixes, and one scan downwards all S suffixes. Every scan takes tuples (place,
common prefix with the last tuple) from queues, one for each first symbol, and pushes the tuple of the symbol before it. Together they
are a priority queue ordered by first symbol, then by time; tuples beyond a memory limit wait in a temporary file. A pushed tuple's common prefix is one
more than the least since the last push to that queue. Common prefixes are counted up to `cap`.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SENTINEL, SEPARATOR, SHIFT, TERMINATOR = 0, 1, 2, 511
SYMBOLS = 258
#: Tuples taken at once; bytes of tuples in memory before they go to a file.
STEP, RESIDENT = 1 << 16, 96 << 20


class Store:
    """Blocks of tuples: in memory up to a limit, then in a temporary file that goes with the store."""

    def __init__(self, limit: int = RESIDENT):
        self.limit, self.held, self.file = limit, 0, None

    def put(self, place: np.ndarray, common: np.ndarray):
        size = place.nbytes + common.nbytes
        if self.held + size <= self.limit:
            self.held += size
            return place, common
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        at = self.file.tell()
        self.file.write(place.tobytes())
        self.file.write(common.tobytes())
        return at, len(place)

    def get(self, ref) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(ref[0], np.ndarray):
            return ref
        at, n = ref
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.int16)

    def close(self) -> None:
        if self.file:
            self.file.close()


class Queue:
    """First in, first out; what was taken can be read again from the end."""

    def __init__(self, store: Store):
        self.store, self.waiting, self.taken = store, [], []

    def push(self, place: np.ndarray, common: np.ndarray) -> None:
        self.waiting.append(self.store.put(place, common))

    def pop(self) -> tuple[np.ndarray, np.ndarray] | None:
        n, got = 0, []
        while self.waiting and n < STEP:
            got.append(self.store.get(self.waiting[len(got)]))
            n += len(got[-1][0])
            if len(got) == len(self.waiting):
                break
        if not got:
            return None
        self.taken += self.waiting[: len(got)]
        del self.waiting[: len(got)]
        return (got[0] if len(got) == 1 else (np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])))

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        got: list = []
        n = 0
        for ref in reversed(self.taken):
            got.append(self.store.get(ref))
            n += len(got[-1][0])
            if n >= STEP:
                yield np.concatenate([x[0][::-1] for x in got]), np.concatenate([x[1][::-1] for x in got])
                got, n = [], 0
        if got:
            yield np.concatenate([x[0][::-1] for x in got]), np.concatenate([x[1][::-1] for x in got])


def _packed(text: np.ndarray) -> np.ndarray:
    """Seven symbols from each place on, nine bits each, the first highest."""
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(7):
        out = (out << np.uint64(9)) | padded[k : k + len(text)]
    return out


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S."""
    n = len(text)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    up[-1] = 1
    # equal symbols take the type of the next place where they differ
    at = np.where(up != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return up[following] > 0


def _refine(rank: np.ndarray, own: np.ndarray, key: np.ndarray) -> None:
    """Split groups of equal rank by a key, among the members listed in own. A rank is the number of smaller ones."""
    order = np.lexsort((key, rank[own]))
    r, k = rank[own][order], key[order]
    new_group = np.ones(len(order), bool)
    new_group[1:] = r[1:] != r[:-1]
    new = new_group.copy()
    new[1:] |= k[1:] != k[:-1]
    place = np.arange(len(order))
    start = np.maximum.accumulate(np.where(new_group, place, 0))
    rank[own[order]] = r + np.maximum.accumulate(np.where(new, place, 0)) - start


def _ties(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def sort_stars(text: np.ndarray, packed: np.ndarray, stars: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order, as far as cap symbols, and their common prefixes with the one before."""
    m, n = len(stars), len(text)
    size = np.append(np.diff(stars), 0) + 1  # symbols of each S* substring, both ends included
    rank = np.zeros(m, np.int64)
    own, done = np.arange(m), 0
    while len(own):
        w = packed[np.minimum(stars[own] + done, n - 1)]
        left = size[own] - done
        # after the last symbol a terminator above all others, then nothing
        short = left < 7
        k = np.maximum(left[short], 0)
        room = (9 * (7 - k)).astype(np.uint64)
        w[short] = (w[short] >> room << room) | np.where(k < 7, np.uint64(TERMINATOR) << (room - np.uint64(9)), np.uint64(0))
        _refine(rank, own, w)
        own = own[left >= 7]
        done += 7
    step = 1
    while True:
        own = _ties(rank)
        if not len(own) or step > cap:
            break
        nxt = np.where(own + step < m, rank[np.minimum(own + step, m - 1)], -1)
        _refine(rank, own, nxt)
        step *= 2
    sorted_stars = stars[np.argsort(rank, kind="stable")]
    return sorted_stars, common_prefixes(packed, sorted_stars, cap)


def common_prefixes(packed: np.ndarray, places: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of each place's suffix with that of the place before it in the list; 0 for the first."""
    out = np.zeros(len(places), np.int16)
    own = np.arange(1, len(places))
    n = len(packed)
    done = 0
    while len(own) and done < cap:
        a, b = places[own] + done, places[own - 1] + done
        inside = np.maximum(a, b) < n
        differ = packed[np.minimum(a, n - 1)] ^ packed[np.minimum(b, n - 1)]
        differ[~inside] = np.uint64(1) << np.uint64(62)
        # the highest bit that differs tells the first symbol that does
        high = differ.astype(np.float64)
        equal = np.where(differ == 0, 7, np.minimum(6, (62 - np.floor(np.log2(np.maximum(high, 1)))) // 9)).astype(np.int64)
        # rounding of large integers can only overshoot to the next power of two: check that symbol itself
        shift = (9 * (6 - np.minimum(equal, 6))).astype(np.uint64)
        wrong = (equal < 7) & ((differ >> shift) == 0)
        equal[wrong] += 1
        out[own] += equal.astype(np.int16)
        own = own[equal == 7]
        done += 7
    return np.minimum(out, cap).astype(np.int16)


class _Scan:
    """Pushes the tuples of the symbols before those scanned, to queues by symbol, with common prefixes."""

    def __init__(self, text: np.ndarray, chosen: np.ndarray, cap: int, store: Store):
        self.text, self.chosen, self.cap = text, chosen, cap
        self.queues = [Queue(store) for _ in range(SYMBOLS)]
        self.least = np.full(SYMBOLS, -1, np.int16)  # least common prefix since the last push; -1 before any

    def feed(self, place: np.ndarray, common: np.ndarray) -> None:
        if not len(place):
            return
        before = place - 1
        good = before >= 0
        good[good] = self.chosen[before[good]]
        at = np.flatnonzero(good)
        lowest = common.min()
        if len(at):
            symbol = self.text[before[at]]
            order = np.argsort(symbol, kind="stable")
            symbol, at = symbol[order], at[order]
            first = np.ones(len(at), bool)
            first[1:] = symbol[1:] != symbol[:-1]
            since = np.empty(len(at), np.int16)
            since[first] = np.minimum(self.least[symbol[first]], np.minimum.accumulate(common)[at[first]])
            rest = np.flatnonzero(~first)
            if len(rest):
                since[rest] = _range_min(common, at[rest - 1] + 1, at[rest])
            new = np.minimum(since + 1, self.cap).astype(np.int16)
            self.least = np.minimum(self.least, lowest)
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(at))
            after = np.minimum.accumulate(common[::-1])[::-1]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                c = int(symbol[a])
                self.queues[c].push(before[at[a:b]], new[a:b])
                last = at[b - 1] + 1
                self.least[c] = after[last] if last < len(common) else self.cap
        else:
            self.least = np.minimum(self.least, lowest)


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of x from low to high, both included."""
    table = [x]
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    for j in range(int(level.max())):
        table.append(np.minimum(table[-1][: -(1 << j)], table[-1][1 << j :]))
    out = np.empty(len(low), x.dtype)
    for j in np.unique(level):
        own = level == j
        out[own] = np.minimum(table[j][low[own]], table[j][high[own] - (1 << int(j)) + 1])
    return out


def _run(text: np.ndarray, at: int, cap: int) -> int:
    k = 1
    while k < cap and at + k < len(text) and text[at + k] == text[at]:
        k += 1
    return k


def induced(text: np.ndarray, cap: int, limit: int = RESIDENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the sentinel from the largest down, as blocks (places, common prefix of each with the one before it in this order).

    text: symbols 1 to 257 and at the end the sentinel 0. Suffixes that share cap symbols may come in any order.
    """
    small = types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(stars):
        return
    packed = _packed(text)
    stars, star_common = sort_stars(text, packed, stars, cap)
    del packed
    first_symbol = text[stars]
    star_from = np.searchsorted(first_symbol, np.arange(SYMBOLS + 1))
    store = Store(limit)
    try:
        up = _Scan(text, ~small, cap, store)
        for c in range(SYMBOLS):
            q, last, fresh = up.queues[c], -1, True
            while (got := q.pop()) is not None:
                place, common = got
                if fresh:
                    common = common.copy()
                    common[0], fresh = 0, False
                up.feed(place, common)
                last = int(place[-1])
            for a in range(star_from[c], star_from[c + 1], STEP):
                b = min(a + STEP, star_from[c + 1])
                common = star_common[a:b].copy()
                if a == star_from[c]:
                    common[0] = min(_run(text, last, cap), _run(text, int(stars[a]), cap)) if last >= 0 else 0
                up.feed(stars[a:b], common)
        down = _Scan(text, small, cap, store)
        for c in range(SYMBOLS - 1, 0, -1):
            q, last, fresh = down.queues[c], -1, True
            while (got := q.pop()) is not None:
                place, common = got
                if fresh:
                    common = common.copy()
                    common[0], fresh = 0, False
                yield place, common
                down.feed(place, common)
                last = int(place[-1])
            carry = None
            for place, common in up.queues[c].backwards():
                # upwards, each holds its common prefix with the smaller one: downwards that belongs to the next
                turned = np.empty(len(common), np.int16)
                turned[1:] = common[:-1]
                if carry is None:
                    turned[0] = min(_run(text, last, cap), _run(text, int(place[0]), cap)) if last >= 0 else 0
                else:
                    turned[0] = carry
                carry = common[-1]
                yield place, turned
                down.feed(place, turned)
    finally:
        store.close()


def repeated(text: np.ndarray, length: int, limit: int = RESIDENT) -> np.ndarray:
    """Whether the string of `length` symbols from each place on also starts elsewhere. text as for induced()."""
    out = np.zeros(len(text), bool)
    last = -1
    for place, common in induced(text, length, limit):
        same = common >= length
        out[place[same]] = True
        before = np.flatnonzero(same) - 1
        if len(before) and before[0] < 0:
            if last >= 0:
                out[last] = True
            before = before[1:]
        out[place[before]] = True
        last = int(place[-1])
    return out
