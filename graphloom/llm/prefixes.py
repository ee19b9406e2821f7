"""Token counts at every prefix of a text, by dynamic programming over its bytes.

For a byte-pair vocabulary, each prefix of a piece has exactly one last token that its own coding can end
with: of the tokens that end there, the one whose pairing with the last token of what stands before it is
left alone by the merges. So one pass gives the last token, and with it the number of tokens, of every
prefix of a piece, and no prefix is coded again. ``steps`` of a text is what each code point adds to that
number (16 bits each; it may be negative, as tokens merge); how many tokens ``text[:k]`` has, and where a
budget of tokens ends, are sums of it.

Texts fall into units that are coded alone whatever stands around them: white space and what follows
it up to the next break of the tokenizer. Units are kept with their steps, so words are worked out once.

A null text is empty: no bytes, no tokens. Repeated rows are counted each; ids may be null. Other
columns are passed on by no function here, and do no harm whatever their names.
"""

from __future__ import annotations

import json
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .tokens import BYTE_SYMBOLS, tokenizer_file

TOKENIZER = "byte_bpe_50k.json"
#: Units of up to so many characters are kept, the last so many and as many before them (about 200 MB at most).
KEPT_CHARS, KEPT_UNITS = 48, 500_000
#: Pairs of tokens, and prefixes of one piece, that are kept at a time.
KEPT_PAIRS, KEPT_PREFIXES = 500_000, 1 << 16
SPACE = BYTE_SYMBOLS[32]
#: Characters of Unicode's White_Space, as the tokenizer knows it; Python adds four control characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What the tokenizer takes for one piece before a word, and how it splits texts.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
UNIT = rf"[{WHITE}]*(?:(?<! )(?:'s|'t|'re|'ve|'m|'ll|'d)|\p{{L}}+|\p{{N}}+|[^{WHITE}\p{{L}}\p{{N}}]+)|[{WHITE}]+"
COUNTED = "doc_id long, n_bytes long, n_tokens long, steps binary"


class After(dict):
    """Whether each token may follow this one: coding the symbols of both together gives just these two."""

    __slots__ = ("owner", "token")

    def __init__(self, token: str, owner: Counter):
        self.token, self.owner = token, owner

    def __missing__(self, token: str) -> bool:
        owner = self.owner
        owner.n_pairs += 1
        if owner.n_pairs > KEPT_PAIRS:
            owner.n_pairs = 0
            for _, _, after in owner.trie.values():
                after.clear()
        want = [self.token, token] if self.token else [token]
        found = self[token] = [t.value for t in owner.model.tokenize(self.token + token)] == want
        return found


class Counter(dict):
    """Steps of units, by the unit's text, for a byte-level tokenizers file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before, model = made["pre_tokenizer"] or {}, made["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or made["normalizer"] or model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("unk_token"):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        added = made["added_tokens"]
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) or any(a != b and a in b for a in self.special for b in self.special):
            raise ValueError(f"{path} has added tokens that reach beyond their text")
        self.unit = regex.compile(UNIT)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split_mine = regex.compile(SPLIT)
        self.known, self.odd = set(map(chr, range(128))), set()
        self.trie = ahocorasick.Automaton()
        for symbols in self.tokenizer.get_vocab(with_added_tokens=False):
            self.trie.add_word(symbols, (len(symbols), symbols, After(symbols, self)))
        self.trie.make_automaton()
        self.first = After("", self)
        self.longest = max(map(len, self.trie)) + 1
        self.n_pairs = 0
        self.older: dict[str, bytes] = {}

    def piece(self, text: str) -> array:
        """Steps of one piece. Only what one token can reach back to is kept of a long one."""
        plain = text.isascii()
        raw = b"" if plain else text.encode()
        if plain and text.isprintable():
            symbols = text.replace(" ", SPACE)
        else:
            symbols = (raw or text.encode()).decode("latin-1").translate(BYTE_SYMBOLS)
        n, gone, at, told = len(symbols), 0, -1, 0
        last, total, out = [self.first], [0], array("h")  # what may follow each prefix, and its tokens
        for end, (size, token, after) in self.trie.iter(symbols):
            if end == at:
                continue  # only one fits
            start = end + 1 - size - gone
            if last[start][token]:
                at, count = end, total[start] + 1
                last.append(after)
                total.append(count)
                if plain or end + 1 == n or raw[end + 1] & 0xC0 != 0x80:  # where a code point ends
                    out.append(count - told)
                    told = count
                if len(last) > KEPT_PREFIXES:
                    cut = len(last) - self.longest
                    del last[:cut], total[:cut]
                    gone += cut
        return out

    def contraction(self, body: str) -> array:
        """Its prefixes are a mark, and a mark and a letter apart."""
        counts = [0, sum(self.piece("'"))]
        if len(body) == 3:
            counts.append(counts[1] + sum(self.piece(body[1])))
        counts.append(sum(self.piece(body)))
        return array("h", [b - a for a, b in pairwise(counts)])

    def work_out(self, unit: str) -> array:
        """Steps of a unit, each prefix split as the tokenizer splits it."""
        body = unit.lstrip(WHITE)
        k = len(unit) - len(body)
        if not k:
            return self.contraction(body) if body in CONTRACTIONS else self.piece(body)
        if not body or k == 1 and unit[0] == " ":
            return self.piece(unit)
        run = self.piece(unit[:k])  # a run of white space is one piece, until something follows
        whole, base = sum(run), sum(run[:-1])
        if unit[k - 1] == " ":  # a space joins what follows
            own = self.piece(unit[k - 1 :])
            return run + array("h", [base + own[0] + own[1] - whole]) + own[2:]
        base += sum(self.piece(unit[k - 1]))
        own = self.contraction(body) if body in CONTRACTIONS else self.piece(body)
        return run + array("h", [base + own[0] - whole]) + own[1:]

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self.work_out(unit).tobytes()
        if len(unit) <= KEPT_CHARS:
            if len(self) >= KEPT_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found

    def differs(self, text: str) -> bool:
        """Whether the tokenizer and these regular expressions, of other versions of Unicode, class a character differently."""
        seen = set(text)
        for c in seen - self.known:
            probe = f"a{c}a1{c}1!{c}!"
            pieces = [a for _, (a, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            if pieces != [m.start() for m in self.split_mine.finditer(probe)]:
                self.odd.add(c)
            self.known.add(c)
        return not self.odd.isdisjoint(seen)

    def split(self, text: str) -> list[str]:
        """The units of a text without special tokens."""
        if text.isascii() or not self.differs(text):
            return self.unit.findall(text)
        units, space = [], ""
        for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            piece = space + text[a:b]
            space = "" if piece.strip(WHITE) else piece
            if not space:
                units.append(piece)
        return [*units, space] if space else units

    def steps(self, text: str) -> bytes:
        """What each code point of ``text`` adds to the number of tokens, 16 bits each."""
        if self.specials is None or not (found := list(self.specials.finditer(text))):
            return b"".join(map(self.__getitem__, self.split(text)))
        parts, at = [], 0
        for m in found:  # up to its last character a special token is text like any other
            own = b"".join(map(self.__getitem__, self.split(text[at : m.end() - 1])))
            begun = int(np.frombuffer(own, "<i2")[m.start() - at :].sum())
            parts += [own, np.array([1 - begun], "<i2").tobytes()]
            at = m.end()
        return b"".join([*parts, *map(self.__getitem__, self.split(text[at:]))])


_COUNTERS: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """The counter of this process; each machine finds the file for itself."""
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(tokenizer_file(name))
    return _COUNTERS[name]


def _count(name: str):
    def run(batches):
        own = counter(name)
        for batch in batches:
            n_bytes, n_tokens, steps = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = own.steps(text)
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(int(np.frombuffer(found, "<i2").sum(dtype=np.int64)))
                steps.append(found)
            arrays = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(steps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "steps"])

    return run


def prefixes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and steps of every row of ``docs`` (doc_id, text). No shuffle."""
    rows = common.to_python(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.mapInArrow(_count(tokenizer), COUNTED)


def _cuts(budget: int):
    def run(batches):
        for batch in batches:
            chars, used = [], []
            for steps in batch.column("steps"):
                counts = np.cumsum(np.frombuffer(steps.as_buffer(), "<i2"), dtype=np.int64)
                fit = np.flatnonzero(counts <= budget)
                k = int(fit[-1]) + 1 if len(fit) else 0
                chars.append(k)
                used.append(int(counts[k - 1]) if k else 0)
            kept = [batch.column(c) for c in ("doc_id", "n_bytes", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(chars, pa.int64()), pa.array(used, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "fit_chars", "fit_tokens"])

    return run


def cuts(counted: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of each text that has at most ``budget`` tokens: fit_chars and fit_tokens.

    It is the longest of all such prefixes, beyond ones that have more as well. ``counted`` is what
    :func:`prefixes` gives; texts are not read.
    """
    own = common.to_python(counted.select("doc_id", "n_bytes", "n_tokens", "steps"))
    return own.mapInArrow(_cuts(budget), "doc_id long, n_bytes long, n_tokens long, fit_chars long, fit_tokens long")


def _at(batches):
    for batch in batches:
        out = []
        for steps, chars in zip(batch.column("steps"), batch.column("chars").to_pylist(), strict=True):
            own = np.frombuffer(steps.as_buffer(), "<i2")
            out.append(None if chars is None else int(own[: max(0, chars)].sum(dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chars"), pa.array(out, pa.int64())], ["doc_id", "chars", "n_tokens"])


def counts_at(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, chars and the tokens of ``text[:chars]`` for each row of ``asked`` (doc_id, chars).

    Past a text's end it is that of the whole text, before its start 0, and null where chars is null.
    Ids of ``counted`` should be unique; questions of an unknown id are left out.
    """
    rows = asked.select("doc_id", F.col("chars").cast("long")).join(counted.select("doc_id", "steps"), "doc_id")
    return common.to_python(rows.select("doc_id", "chars", "steps")).mapInArrow(_at, "doc_id long, chars long, n_tokens long")


def truncated(docs: DataFrame, counted: DataFrame, budget: int) -> DataFrame:
    """``docs`` (doc_id, text; ids unique) with each text cut to its longest prefix of at most ``budget`` tokens."""
    ends = cuts(counted, budget).select(F.col("doc_id").alias("__doc"), "fit_chars")
    cut = F.substring(F.col("text"), F.lit(1), F.col("fit_chars").cast("int"))
    return docs.select("doc_id", "text").join(ends, F.col("doc_id") == F.col("__doc")).select("doc_id", cut.alias("text"))
