"""Hashes of words, shingles and byte strings over many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: The multipliers of the SplitMix64 finaliser and its increment; an odd base and its inverse modulo 2^64.
M1, M2, GOLDEN = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= M1
    x ^= x >> U(27)
    x *= M2
    x ^= x >> U(31)
    return x


def times(k: int, m: U) -> U:
    """k * m modulo 2^64, as a scalar."""
    return U(k * int(m) & (1 << 64) - 1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _powers.get(base, np.ones(1, U))
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums p of byte * BASE^place; (p[b] - p[a]) * INVERSE^a depends on the bytes from a to b alone."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts in order, and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))  # word starts and ends in turn
    a, b = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(a, ends), prepend=0)
    p = prefix(data)
    return mix((p[b] - p[a]) * powers(INVERSE, len(data))[a] + (b - a).astype(U)), counts


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words of all texts in order, and how many each text has. A text of fewer words, but one at least, has one
    shingle: all of its words. A text without words has none."""
    w, n = word_hashes(texts)
    if not len(w):
        return w, n
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    padded = np.concatenate([w, np.zeros(size, U)])
    h = np.zeros(len(w), U)
    start = np.cumsum(n) - n
    for j in range(size):
        part = padded[j : j + len(w)]
        h = mix(h + part * GOLDEN + U(j))
    # texts of fewer words: their own words alone, and their number
    for t in np.flatnonzero((n > 0) & (n < size)):
        x = np.array([n[t]], U)
        for j in range(n[t]):
            x = mix(x * GOLDEN + w[start[t] + j])
        h[start[t]] = x[0]
    first = np.cumsum(many) - many
    at = np.repeat(start - first, many) + np.arange(many.sum())
    return h[at], many


def multisets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count): the shingle multisets of all texts, sorted by text and hash."""
    h, n = shingles(texts, size)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))
