"""Glossary terms in a note: longest first, ASCII terms at word boundaries, code and links left out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np

from .markdown import Note, inside

Term = tuple[int, str, str]  # index, name, path of its note
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


class Matcher:
    """All terms in one automaton: a text is read once, however many terms there are.

    At one place the longest in UTF-8 bytes wins; of notes that define one term, the first found.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.automaton = None

    def build(self):
        """The automaton is made where it is used: it is larger than its terms, which are sent."""
        made, rank = ahocorasick.Automaton(), {}
        for t in sorted(self.terms, key=lambda t: t[0]):
            if t[1] and t[1] not in rank:
                rank[t[1]] = t
                made.add_word(t[1], (len(t[1].encode()), len(t[1]), t[1].isascii(), t))
        if rank:
            made.make_automaton()
        self.automaton = made if rank else False

    def __getstate__(self):
        return {"terms": self.terms, "automaton": None}

    def hits(self, text: str, body: int) -> list[tuple[int, int, int, Term]]:
        """Start, bytes, length and term of the longest term at each place of the body where there is one."""
        if self.automaton is None:
            self.build()
        if not self.automaton:
            return []
        best: dict[int, tuple[int, int, Term]] = {}
        for last, (size, length, ascii_, term) in self.automaton.iter(text, body):
            start = last + 1 - length
            if ascii_ and (start and text[start - 1] in WORD or last + 1 < len(text) and text[last + 1] in WORD):
                continue
            if start not in best or size > best[start][0]:
                best[start] = (size, length, term)
        return [(start, *best[start]) for start in sorted(best)]

    def find(self, text: str, note: Note, path: str) -> list[tuple[int, int, int]]:
        """Term index, start and end of each mention."""
        ranges = closed(note)
        found = reconciled(((start, start + length, own, index) for start, _, length, (index, _, own) in self.hits(text, note.body)), ranges, path)
        return [(index, a, b) for a, b, _, index in found]


def closed(note: Note) -> list[tuple[int, int]]:
    """Where no mention begins: code and brackets, as ranges apart from each other."""
    ranges: list[tuple[int, int]] = []
    for a, b in sorted(note.code + note.brackets):
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
        else:
            ranges.append((a, b))
    return ranges


def reconciled(hits: Iterable[tuple], ranges: list[tuple[int, int]], path: str) -> list[tuple]:
    """Of hits (start, end, path of the term's note, ...) in order, one for each start, those that are mentions.

    From left to right: a hit in a closed range is none, one that is taken uses its text up, and a
    note's own term does so unseen.
    """
    starts, out, at = [a for a, _ in ranges], [], 0
    for hit in hits:
        if hit[0] < at or inside(hit[0], ranges, starts):
            continue
        at = hit[1]
        if hit[2] != path:
            out.append(hit)
    return out


U = np.uint64
_BASE, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.array([chr(c) in WORD for c in range(128)] + [False])
#: Characters that are hashed together (under 20 MB).
PIECE = 1 << 18


def _powers(base: U, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, base)]), dtype=U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Hashed:
    """A text from which the hash of any part is had at once: prefix sums of a polynomial modulo 2^64."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(self.codes)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_mixed(self.codes.astype(U) + U(1)) * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = _powers(_INVERSE, n)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.back[start])


def marks(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash its word in a filter of so many, and five bits of it (or fewer)."""
    bits = np.zeros(len(hashes), U)
    for k in range(0, 30, 6):
        bits |= U(1) << ((hashes >> U(k)) & U(63))
    return ((hashes >> U(32)) % U(words)).astype(np.int64), bits


def name_hashes(names: list[str]) -> np.ndarray:
    sizes = np.array([len(n) for n in names], np.int64)
    return _Hashed("".join(names)).of(np.cumsum(sizes) - sizes, sizes)


class Sieve:
    """Where terms of a glossary may stand: a filter of fixed size, however many terms, that loses none and lets few others through.

    ``shapes`` are the terms' lengths with the place of the first character that is not ASCII, -1 if all are.
    """

    def __init__(self, table: np.ndarray, shapes: list[tuple[int, int]]):
        self.table, self.shapes = table, sorted(shapes)
        self.longest = max((n for _, n in shapes), default=0)

    def places(self, texts: list[str], bodies: list[int]) -> list[list[tuple[int, int]]]:
        """Start and length of each place in the body of each text, in order."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for pieces in self._gathered(texts, bodies) if self.shapes else ():
            ends = np.cumsum([len(p[-1]) + 1 for p in pieces])
            begins = ends - [len(p[-1]) + 1 for p in pieces]
            owner, offset, low, high = (np.array([p[k] for p in pieces], np.int64) for k in range(4))
            for start, length in self._found("\n".join(p[-1] for p in pieces) + "\n"):
                at = np.searchsorted(ends, start, "right")
                here = start - begins[at] + offset[at]
                good = (start + length < ends[at]) & (here >= low[at]) & (here < high[at])
                for k, a in zip(owner[at[good]].tolist(), here[good].tolist(), strict=True):
                    out[k].append((a, length))
        return [sorted(set(o)) for o in out]

    def _gathered(self, texts: list[str], bodies: list[int]) -> Iterator[list[tuple[int, int, int, int, str]]]:
        """Parts of texts, many short ones together, with what stands around: text, offset, first and last start."""
        own, size = [], 0
        for k, (text, body) in enumerate(zip(texts, bodies, strict=True)):
            for low in range(body, len(text), PIECE):
                a = max(0, low - 1)
                part = text[a : low + PIECE + self.longest + 1]
                own.append((k, a, low, low + PIECE, part))
                size += len(part)
                if size >= PIECE:
                    yield own
                    own, size = [], 0
        if own:
            yield own

    def _found(self, text: str) -> Iterator[tuple[np.ndarray, int]]:
        hashed = _Hashed(text)
        n, word = len(text), _IS_WORD[np.minimum(hashed.codes, 128)]
        shut = np.concatenate([~word, np.zeros(self.longest + 1, bool)])  # no ASCII term ends past the text
        opened, wide = np.flatnonzero(np.concatenate([[True], ~word[:-1]])), np.flatnonzero(hashed.codes > 127)
        for first, length in self.shapes:
            if first < 0:
                start = opened[shut[opened + length]]
            else:
                start = wide - first
                start = start[(start >= 0) & (start + length < n)]
            at, bits = marks(hashed.of(start, length), len(self.table))
            yield start[(self.table[at] & bits) == bits], length
