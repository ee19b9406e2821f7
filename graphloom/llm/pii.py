"""Personal data: patterns, and a character tagger (BiLSTM-CRF) trained from labelled spans.

The tagger reads windows of ``window`` characters, one every ``stride``. Where windows overlap, their
scores are averaged, each weighted by its distance from the window's edge, and one Viterbi pass
decodes the whole text: so a span across an edge is decided once, globally. All kinds hold a digit or an @,
so a character may belong to a span only if a window holds it together with one of these; elsewhere the tag is fixed: none.
Fixed tags cut the pass into stretches, which are decoded apart with the same result, and only windows that meet a
stretch need be read: what is found is what reading every window finds. Stretches of any length are read and
decoded part by part. A decoded span counts if it has the form of its kind (``plausible``) and meets no base span.

Training windows come from a bounded number of documents, drawn by id hash, whose base spans are
the labels; copies of them get spans of forms that the patterns miss. The driver trains the tagger.

A null or empty text has no spans. Rows are scanned one by one; other columns are passed on, except
those named like the new ones. Without any documents to learn from, generated windows alone serve.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .tagger import Path, Tagger

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
Span = tuple[int, int, int]  # kind, start, end

TRIGGER = re.compile("[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits matches from its first or not at all, so no other start is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


@dataclass(frozen=True)
class Settings:
    window: int = 96
    stride: int = 64
    hidden: int = 16
    steps: int = 500
    #: Bounds on the training rows, drawn by id hash, and on the characters of each.
    sample_rows: int = 1500
    sample_chars: int = 20_000
    training_windows: int = 6000
    seed: int = 11


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out = emails(text)
    if DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(small(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def plausible(kind: int, text: str) -> bool:
    digits = "".join(DIGITS.findall(text))
    if kind == 0:
        local, _, host = text.partition("@")
        return bool(local) and "." in host and not host.startswith(".") and not re.search(r"\s", text)
    if kind == 1:
        parts = re.split("[^0-9]+", text)
        return len(parts) == 4 and all(p and small(p) for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search(r"[^0-9\s().+/-]", text)


def codes(text: str) -> np.ndarray:
    """ASCII as it is; one code for other letters, one for all else. 0 pads."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(raw < 128, raw, 0).astype(np.int64)
    for k in np.flatnonzero(raw >= 128):
        out[k] = 128 if chr(int(raw[k])).isalpha() else 129
    return out


CODES, TAGS = 130, 1 + 2 * len(KINDS)


def tags(length: int, spans: list[Span]) -> np.ndarray:
    """0, or for kind k 1 + 2k at a span's first character and 2 + 2k after it."""
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] -= 1
    return out


def spans_of(found: np.ndarray) -> list[Span]:
    kind = (found.astype(np.int8) + 1) // 2  # 0: none
    fresh = np.append(True, (kind[1:] != kind[:-1]) | (found[1:] % 2 == 1))[: len(found)]
    starts = np.flatnonzero((kind > 0) & fresh)
    ends = np.flatnonzero((kind > 0) & np.append(fresh[1:], True)[: len(found)]) + 1
    return list(zip((kind[starts] - 1).tolist(), starts.tolist(), ends.tolist(), strict=True))


def card_number(r: np.random.Generator) -> str:
    body = "".join(map(str, r.integers(0, 10, int(r.integers(12, 16)))))
    return next(body + d for d in "0123456789" if luhn(body + d))


def made(r: np.random.Generator) -> tuple[int, str]:
    """A kind and a text of it, in forms of which the patterns know some; -1: what looks like one but is not."""
    n = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvw"), int(r.integers(3, 9))))
    pick = lambda *x: x[int(r.integers(0, len(x)))]
    kind = int(r.integers(-1, 4))
    if kind == 0:
        return 0, pick(f"{word()}.{word()}@{word()}.com", f"{word()}{n(2)}@{word()}{n(1)}.{word()}.org", f"{word()}+{word()}@{word()}.net", f"{word()}.{n(2)}@mail{n(1)}.example.com", f"{word()}'{word()}@{word()}.de", f"{word()}@{word()}.co.uk")
    if kind == 1:
        parts = [str(x) for x in r.integers(0, 256, 4)]
        return 1, pick(".", ".", ".", "-", " . ").join(parts)
    if kind == 2:
        digits = card_number(r)
        mark = pick("", " ", "-", ".", "  ", "/")
        return 2, mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == 3:
        a, b, c = n(3), n(3), n(4)
        return 3, pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+{n(2)} {a} {b} {c}", f"00{n(2)} {a} {b}{c}", f"({a}){b}-{c}")
    return -1, pick(n(4), f"{n(1)},{n(3)}.{n(2)}", f"{n(4)}-{n(2)}-{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"#{n(6)}", "".join(r.choice(list("0123456789abcdef"), 40)), f"@{word()}", f"{n(3)}%", f"${n(5)}", n(int(r.integers(5, 13))), f"{word()} @ {word()}")


def training_windows(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags (window, place) from labelled texts, half of them with a generated span let in."""
    r, w = np.random.default_rng(settings.seed), settings.window
    ids, gold = np.zeros((settings.training_windows, w), np.int64), np.zeros((settings.training_windows, w), np.int64)
    known = [(t, base_spans(t)) for t in texts if t] or [("", [])]
    with_spans = [k for k, (_, s) in enumerate(known) if s] or [0]
    for row in range(settings.training_windows):
        text, spans = known[int(r.choice(with_spans)) if row % 3 == 0 else int(r.integers(0, len(known)))]
        if row % 3 == 0 and spans:  # around a labelled span
            _, start, _ = spans[int(r.integers(0, len(spans)))]
            at = max(0, start - int(r.integers(0, w - 10)))
        else:
            at = int(r.integers(0, max(1, len(text) - w)))
        piece = text[at : at + w]
        marks = tags(len(text), spans)[at : at + w] if spans else np.zeros(len(piece), np.int64)
        if row % 3:
            kind, new = made(r)
            place = int(r.integers(0, len(piece) + 1))
            while 0 < place < len(piece) and not piece[place - 1].isspace():
                place += 1
            left, right = (" " if place else ""), " "
            marks = np.concatenate([marks[:place], np.zeros(len(left), np.int64), tags(len(new), [(kind, 0, len(new))] if kind >= 0 else []), [0], marks[place:]])
            piece = piece[:place] + left + new + right + piece[place:]
        c = codes(piece)[:w]
        ids[row, : len(c)], gold[row, : len(c)] = c, marks[: len(c)]
    return ids, gold


def train(docs: DataFrame, settings: Settings = Settings()) -> Tagger:
    """A tagger from the base spans of a bounded number of documents with a digit or an @.

    Of a text longer than ``sample_chars`` a piece of that many serves, at a place that its hash gives.
    """
    place = F.floor(common.uniform("text") * F.greatest(F.length("text") - settings.sample_chars + 1, F.lit(1))).cast("int") + 1
    usable = docs.select("doc_id", F.substr("text", place, F.lit(settings.sample_chars)).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    texts = [r.text for r in common.sample(usable, settings.sample_rows, "doc_id", "text").collect()]
    tagger = Tagger(CODES, TAGS, settings.hidden, settings.seed)
    tagger.train(*training_windows(texts, settings), settings.steps, seed=settings.seed)
    return tagger


def stretches(text: str, settings: Settings) -> list[tuple[int, int]]:
    """Where spans may be: the characters of windows with a digit or an @, start and end of each run of them."""
    out: list[tuple[int, int]] = []
    w, stride, have = settings.window, settings.stride, -1
    for m in TRIGGER.finditer(text):
        last = m.start() // stride
        if last == have and m.start() % stride:
            continue  # all windows that hold it hold one before it
        have = last
        start, end = max(0, (m.start() - w) // stride + 1) * stride, min(len(text), last * stride + w)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


#: Windows that are read together: under 100 MB.
TOGETHER = 512


class Stretch:
    """A stretch of a text, read from its first window to its last, in parts of any number of windows."""

    def __init__(self, number: int, text: str, start: int, end: int, tagger: Tagger, settings: Settings):
        self.number, self.text, self.start, self.end, self.settings = number, text, start, end, settings
        self.first = max(0, (start - settings.window) // settings.stride + 1)
        self.last = (end - 1) // settings.stride
        self.path = Path(tagger.p["a"], 0 if start else None)
        over = settings.window - settings.stride
        self.total, self.sums = np.zeros((over, TAGS), np.float32), np.zeros((over, 1), np.float32)

    def windows(self, first: int, last: int) -> np.ndarray:
        """Codes (window, place); past the text's end they are 0."""
        w, stride = self.settings.window, self.settings.stride
        padded = np.zeros((last - first) * stride + w, np.uint8)
        own = codes(self.text[first * stride : last * stride + w])
        padded[: len(own)] = own
        return np.lib.stride_tricks.sliding_window_view(padded, w)[::stride]

    def feed(self, first: int, last: int, scores: np.ndarray, weight: np.ndarray) -> list[Span]:
        """Takes scores (place, window, tag); the stretch's spans once its last window is there."""
        w, stride = self.settings.window, self.settings.stride
        over, size = w - stride, (last - first) * stride + w
        total, sums = np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)
        total[:over], sums[:over] = self.total, self.sums
        for k in range(last - first + 1):
            total[k * stride : k * stride + w] += scores[:, k] * weight
            sums[k * stride : k * stride + w] += weight
        whole = size if last == self.last else size - over
        self.total, self.sums = total[whole:].copy(), sums[whole:].copy()
        a, b = max(0, self.start - first * stride), min(whole, self.end - first * stride)
        if a < b:
            self.path.feed(total[a:b] / sums[a:b])
        if last < self.last:
            return []
        found = spans_of(self.path.tags(0 if self.end < len(self.text) else None))
        return [(kind, s + self.start, e + self.start) for kind, s, e in found]


def tagged(texts: list[str], tagger: Tagger, settings: Settings) -> list[list[Span]]:
    """The spans that the tagger sees in each text."""
    w = settings.window
    out: list[list[Span]] = [[] for _ in texts]
    weight = (np.minimum(np.arange(w), np.arange(w)[::-1]) + 1).astype(np.float32)[:, None]
    pending: list[tuple[Stretch, int, int]] = []  # with the first and last window that are next

    def read() -> None:
        scores, at = tagger.forward(np.concatenate([s.windows(a, b) for s, a, b in pending]).T), 0
        for s, a, b in pending:
            out[s.number] += s.feed(a, b, scores[:, at : at + b - a + 1], weight)
            at += b - a + 1
        pending.clear()

    size = 0
    for number, text in enumerate(texts):
        for start, end in stretches(text, settings):
            stretch = Stretch(number, text, start, end, tagger, settings)
            k = stretch.first
            while k <= stretch.last:
                to = min(stretch.last, k + TOGETHER - size - 1)
                pending.append((stretch, k, to))
                size, k = size + to - k + 1, to + 1
                if size == TOGETHER:
                    read()
                    size = 0
    if pending:
        read()
    return out


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those that meet no base span."""
    starts, ends = [], []
    for start, end in sorted((s, e) for _, s, e in base):
        if ends and start < ends[-1]:
            ends[-1] = max(end, ends[-1])
        else:
            starts.append(start)
            ends.append(end)
    before = lambda end: bisect_right(starts, end - 1)  # noqa: E731 - how many begin before it
    return [s for s in spans if not before(s[2]) or ends[before(s[2]) - 1] <= s[1]]


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def trimmed(text: str, span: Span) -> Span:
    kind, start, end = span
    while start < end and text[start].isspace():
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] in ".,"):
        end -= 1
    return kind, start, end


def find(docs: DataFrame, tagger: Tagger, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (text and others that are passed on) with the columns of SCHEMA in place of text."""
    mine = [c for c in docs.columns if c.lower() not in NAMES and c.lower() != "text"]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for text, seen in zip(texts, tagged(texts, tagger, settings), strict=True):
                base = base_spans(text)
                cut = [trimmed(text, s) for s in seen]
                added = apart([s for s in cut if s[1] < s[2] and plausible(s[0], text[s[1] : s[2]])], base)
                counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + added), len(added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in mine), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [*mine, *NAMES])

    kept = docs.select(*[F.col(f"`{c}`") for c in mine], "text")
    return common.to_python(kept).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"), SCHEMA]))
