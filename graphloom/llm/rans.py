"""Static range asymmetric numeral system over one shared frequency table.

A block codes ``n`` symbols in ``LANES`` interleaved states. Symbol ``i`` belongs to lane
``i % LANES``; a step is one symbol of every lane. States are 64 bits wide and give off 32-bit
words, at most one for each symbol. Before every ``INTERVAL``-th step a checkpoint keeps all
states and the place in the words, so the segments between checkpoints decode independently, and
each segment has its own checksum.

Layout of a block (little-endian): header ``<4sIIQIII``: magic, lanes, scale bits, symbols, steps,
interval, checkpoints; one ``u64`` word place and one ``u32`` CRC-32 of the segment's symbols as
u32 for each checkpoint; states (``u64`` x lanes) of each checkpoint; words (``u32``).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"GRS1"
HEAD = struct.Struct("<4sIIQIII")
LANES = 1024
INTERVAL = 128
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class CorruptBlock(ValueError):
    """The bytes are not a block, or a checksum differs."""


def normalize(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits; every symbol that occurs keeps at least 1."""
    counts = np.asarray(counts, dtype=np.float64)
    total, size = counts.sum(), 1 << bits
    seen = counts > 0
    if not total:
        out = np.zeros(len(counts), np.int64)
        out[0] = size
        return out
    if seen.sum() > size:
        raise ValueError("more symbols than the scale can hold")
    out = np.where(seen, np.maximum(1, np.floor(counts / total * size)), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    spare = size - int(out.sum())
    if spare > 0:
        out[order[0]] += spare
    for s in order:  # the largest give back what rounding up to 1 took
        if spare >= 0:
            break
        give = min(int(out[s]) - 1, -spare)
        out[s] -= give
        spare += give
    return out


class Model:
    """Tables of one frequency table, for coding and decoding."""

    def __init__(self, freqs: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        self.freq = np.asarray(freqs, dtype=np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        if len(self.slot) != 1 << bits:
            raise ValueError("frequencies do not fill the scale")
        self.pad = int(np.argmax(self.freq))

    def encode(self, ids: np.ndarray, lanes: int = LANES, interval: int = INTERVAL) -> bytes:
        n = len(ids)
        steps = -(-n // lanes)
        grid = np.full(steps * lanes, self.pad, dtype=np.int64)
        grid[:n] = ids
        grid = grid.reshape(steps, lanes)
        freq, cum = self.freq[grid], self.cum[grid]
        if n and not freq.all():
            raise ValueError("a symbol has no frequency")
        bits = np.uint64(self.bits)
        limit = freq << np.uint64(63 - self.bits)
        x = np.full(lanes, LOW, dtype=np.uint64)
        chunks, marks, given = [], [], 0
        for t in range(steps - 1, -1, -1):
            f = freq[t]
            over = x >= limit[t]
            out = x[over].astype(np.uint32)
            chunks.append(out)
            given += len(out)
            x = np.where(over, x >> WORD, x)
            q = x // f
            x = (q << bits) + (x - q * f) + cum[t]
            if t % interval == 0:
                marks.append((given, x.copy()))
        marks.reverse()
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
        sums = [zlib.crc32(np.asarray(ids[k * interval * lanes : (k + 1) * interval * lanes], "<u4").tobytes()) for k in range(len(marks))]
        return b"".join(
            [
                HEAD.pack(MAGIC, lanes, self.bits, n, steps, interval, len(marks)),
                np.array([len(words) - g for g, _ in marks], "<u8").tobytes(),
                np.array(sums, "<u4").tobytes(),
                *(s.astype("<u8").tobytes() for _, s in marks),
                words.astype("<u4").tobytes(),
            ]
        )

    def decode(self, block: bytes) -> np.ndarray:
        head = Block(block, self.bits)
        parts = [self.segment(head, k) for k in range(head.count)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def segment(self, head: Block, k: int) -> np.ndarray:
        """The symbols between checkpoint k and the next, from that checkpoint alone."""
        first = k * head.interval
        steps = min(head.steps - first, head.interval)
        x, at = head.states[k].astype(np.uint64), int(head.places[k])
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = np.empty((steps, head.lanes), dtype=np.uint32)
        for t in range(steps):
            low = x & mask
            s = self.slot[low.astype(np.int64)]
            out[t] = s
            x = self.freq[s] * (x >> bits) + low - self.cum[s]
            short = x < LOW
            need = int(np.count_nonzero(short))
            if need:
                words = head.words[at : at + need]
                if len(words) < need:
                    raise CorruptBlock("the words end early")
                x[short] = (x[short] << WORD) | words
                at += need
        ids = out.reshape(-1)[: max(0, head.n - first * head.lanes)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != head.sums[k]:
            raise CorruptBlock(f"checksum of segment {k} differs")
        return ids


class Block:
    """A block's header and its views."""

    def __init__(self, data: bytes, bits: int):
        if len(data) < HEAD.size:
            raise CorruptBlock("too short")
        magic, self.lanes, scale, self.n, self.steps, self.interval, self.count = HEAD.unpack_from(data)
        if magic != MAGIC or scale != bits:
            raise CorruptBlock("not a block of this table")
        at = HEAD.size
        need = at + self.count * (12 + 8 * self.lanes)
        if len(data) < need:
            raise CorruptBlock("too short")
        self.places = np.frombuffer(data, "<u8", self.count, at)
        at += 8 * self.count
        self.sums = np.frombuffer(data, "<u4", self.count, at)
        at += 4 * self.count
        self.states = np.frombuffer(data, "<u8", self.count * self.lanes, at).reshape(self.count, self.lanes)
        self.words = np.frombuffer(data, "<u4", offset=need).astype(np.uint64)
