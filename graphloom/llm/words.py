"""Words of many texts at once in numpy: places, 64-bit hashes, grams.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so multi-byte characters stay whole.
Equal words have equal hashes. A word's bytes are a polynomial at a fixed point modulo the prime
2**61 - 1, so two different words of n bytes agree at n points at most: a chance of n / 2**61, whatever
pattern they follow. (Modulo 2**64 some patterns, Thue-Morse's among them, agree at every odd point.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
#: Remainders are taken of this prime; LOW masks the lower half of one.
PRIME = U((1 << 61) - 1)
LOW, HALF = U((1 << 31) - 1), U(31)
BASE = 0x1B873593CC9E2D51
UNBASE = pow(BASE, -1, int(PRIME))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on together; the arrays take about 60 times as much memory.
CHUNK_BYTES = 200_000
#: Bytes of one text that are hashed together: longer texts are hashed part by part.
SEGMENT = 300_000

_powers = [np.ones(1, U), np.ones(1, U)]


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo PRIME."""
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def raised(x: np.ndarray) -> np.ndarray:
    """Remainders times 2**31, below 2**62: what passes bit 61 comes back at bit 0."""
    return (x >> U(30)) + ((x & U((1 << 30) - 1)) << HALF)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of remainders modulo PRIME, from halves of 31 and 30 bits; no sum passes 64 bits."""
    a_high, a_low, b_high, b_low = a >> HALF, a & LOW, b >> HALF, b & LOW
    middle = a_high * b_low + a_low * b_high
    return reduced(((a_high * b_high) << U(1)) + raised(middle) + a_low * b_low)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least; up to SEGMENT they are kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made, size = [], max(n, SEGMENT + 1)
    for b in (BASE, UNBASE):
        own = np.ones(1, U)
        while len(own) < size:
            own = np.concatenate([own, product(own, power(b, len(own)))])
        made.append(own[:size].copy())
    if n <= SEGMENT + 1:
        _powers[:] = made
    return made[0], made[1]


def power(b: int, k: int) -> U:
    return U(pow(b, k, int(PRIME)))


class Sums:
    """Sums of the first 0, 1, ... values times powers, kept as sums of both halves: remainders are taken where asked for."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = (np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)]) for x in (low, high))

    def __getitem__(self, places) -> np.ndarray:
        return reduced(reduced(self.low[places]) + raised(reduced(self.high[places])))


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """Words of a list of texts (None counts as empty)."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        #: Text k has the bytes first[k] to last[k].
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if raw else np.zeros(0, np.int64)
        self.last = self.first + sizes
        self.table = (LOWER if lower else np.arange(256, dtype=np.uint8)).astype(U) + U(1)
        gap = SPACE[self.data]
        edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
        #: Word i has the bytes begin[i] to end[i].
        self.begin = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge[1:] == 1) + 1 if len(edge) else np.zeros(0, np.int64)
        #: Text k has the words at[k] to at[k + 1].
        self.at = np.append(np.searchsorted(self.begin, self.first), len(self.begin))

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run of bytes; ``begin`` and ``end`` ascend.

        Sums of byte * BASE**place up to each begin and end, and BASE**-begin, part by part.
        """
        up, down = powers(SEGMENT + 1)
        sums = [np.empty(len(begin), U), np.empty(len(end), U)]
        back, carry = np.empty(len(begin), U), U(0)
        for start in range(0, len(self.data) + 1, SEGMENT):
            values = self.table[self.data[start : start + SEGMENT]]
            own, shift = up[: len(values)], power(BASE, start)
            own = Sums(values * (own & LOW), values * (own >> HALF))
            for places, out in ((begin, sums[0]), (end, sums[1])):
                a, b = np.searchsorted(places, (start, start + SEGMENT))
                out[a:b] = reduced(product(own[places[a:b] - start], shift) + carry)
            carry = reduced(product(own[-1:], shift) + carry)[0]
            a, b = np.searchsorted(begin, (start, start + SEGMENT))
            back[a:b] = product(down[begin[a:b] - start], power(UNBASE, start))
        return mix(product(reduced(sums[1] + (PRIME - sums[0])), back) + (end - begin).astype(U) * U(0xD6E8FEB86659FD93))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.begin, self.end)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first)), np.diff(self.at))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row of one sequence."""
    if len(h) < n:
        return np.zeros(0, U)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * U(0x2545F4914F6CDD1D) + h[k : len(h) - n + 1 + k])
    return out


def chunks(texts: Iterable[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``most`` characters, with the number of the first."""
    part: list[str | None] = []
    size = start = 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield start, part
            part, size, start = [], 0, k + 1
    if part:
        yield start, part
