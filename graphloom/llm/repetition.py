"""Quality rules: repeated passages inside a document, found by a suffix array.

The suffixes of a text's words are sorted by prefix doubling; neighbours' longest common prefixes
give the intervals of maximal repeated substrings. Spans of repeats of ``min_words`` or more are
united. A document is rejected if they cover more than ``most_covered_percent`` of its words, if the longest
repeat has more than ``max_longest`` words, or if a base rule fails.

A text is sorted whole: memory is about 20 to 45 times a long text's size (see README). A null, empty or
blank text has no words and fails the base rule. Rows are judged one by one, so
repeated rows and null ids are kept apart; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .words import HALF, LOW, PRIME, SPACE, Sums, U, Words, chunks, grams, mix, powers, product, reduced

SYMBOLS = np.zeros(256, np.int8)
SYMBOLS[list(b"#*$%&|<>")] = 1
#: A code point's first byte.
LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int8)
SOLID_LEAD = LEAD * ~SPACE
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    most_repeat_percent: int = 50
    #: Words of the shortest repeat that counts.
    min_words: int = 10
    most_covered_percent: int = 30
    max_longest: int = 100


def _repeated(new: np.ndarray) -> np.ndarray:
    """Of sorted items, those that share their group; ``new`` marks each group's first."""
    return ~(new & np.append(new[1:], True))


def _group_starts(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_repeats(h: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with a repeat of ``least`` words or more, and the length in words of the longest there.

    ``h`` holds the hashes of the words of several texts, text k from at[k] to at[k + 1]; both
    occurrences of a repeat are in one text. Any order of the words serves to sort suffixes, so the
    hashes' is taken.
    """
    n, none = len(h), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    room = at[owner + 1] - np.arange(n)
    long = np.flatnonzero(room >= least)
    if not len(long):
        return none, none
    key = mix(grams(h, least)[long] + owner[long].astype(U) * U(0x9FB21C651E98DF25))
    by = np.argsort(key)
    order, key = long[by], key[by]
    new = np.append(True, key[1:] != key[:-1])
    found = np.sort(order[_repeated(new)])
    # Suffixes are sorted word by word, those that the doubling looks at: a repeat's, and what follows
    # its first words. A rank is the place of its group's first suffix; a text's end comes first.
    seen = np.unique(np.concatenate([found, (found + least)[room[found] > least]]))
    columns = [np.where(room[seen] > k, h[np.minimum(seen + k, n - 1)], U(0)) for k in range(least)]
    by = np.lexsort((*columns[::-1], owner[seen]))
    order = seen[by]
    new = np.append(True, np.diff(owner[order]) != 0)[: len(order)]
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    rank = np.full(n, -1)
    rank[order] = _group_starts(new)
    width, live = least, order[_repeated(new)] if len(order) else order
    while len(live):
        after = np.where(room[live] > width, rank[np.minimum(live + width, n - 1)], -1)
        by = np.lexsort((after, rank[live]))
        live, after = live[by], after[by]
        old = rank[live]
        group = np.append(True, old[1:] != old[:-1])
        new = group | np.append(True, after[1:] != after[:-1])
        rank = rank.copy()
        rank[live] = old + _group_starts(new) - _group_starts(group)
        live, width = live[_repeated(new)], width * 2
    if not len(found):
        return none, none
    suffixes = found[np.argsort(rank[found])]
    a, b = suffixes[:-1], suffixes[1:]
    lcp = common_prefixes(h, a, b, np.where(owner[a] == owner[b], np.minimum(room[a], room[b]), 0))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    starts = np.flatnonzero(longest >= least)
    return starts, longest[starts]


def common_prefixes(h: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from a and from b on, ``most`` at the most."""
    up, down = powers(len(h) + 1)
    terms = product(reduced(h), up[: len(h)])
    sums = Sums(terms & LOW, terms >> HALF)
    passage = lambda i, step: product(reduced(sums[i + step] + (PRIME - sums[i])), down[i])
    lcp = np.zeros(len(a), np.int64)
    step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
    while step:
        k = np.flatnonzero(lcp + step <= most)
        i, j = a[k] + lcp[k], b[k] + lcp[k]
        k = k[passage(i, step) == passage(j, step)]
        lcp[k] += step
        step >>= 1
    return lcp


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """For each of n words, whether a span holds it; the result sums up from 0, with n + 1 entries."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])


def measure(texts: list[str | None], rules: Rules) -> list[np.ndarray]:
    """The columns of SCHEMA for each text."""
    w = Words(texts)
    n = len(w.begin)
    # Each text ends at a space, which no flag marks, so the sums of a text may take it in.
    between = lambda flags: np.add.reduceat(flags, w.first, dtype=np.int64)
    of_text = lambda sums: sums[w.at[1:]] - sums[w.at[:-1]]
    n_words = np.diff(w.at)
    h = w.word_hashes()

    breaks = np.flatnonzero(w.data == 10)
    begin, end = np.sort(np.concatenate([w.first, breaks + 1])), np.sort(np.concatenate([breaks, w.last]))
    full = np.searchsorted(w.begin, end) > np.searchsorted(w.begin, begin)
    begin, end = begin[full], end[full]
    line_of = np.searchsorted(w.first, begin, side="right") - 1
    line = np.unique(mix(w.hashes(begin, end) + line_of.astype(U) * U(0x9FB21C651E98DF25)), return_index=True)[1]
    lines = lambda which: np.bincount(which, minlength=len(texts))
    dup_lines = lines(line_of) - lines(line_of[line])

    owner = w.owner()
    three = np.flatnonzero(w.at[owner + 1] - np.arange(n) >= 3)
    key = mix(grams(h, 3)[three] + owner[three].astype(U) * U(0x9FB21C651E98DF25))
    by = np.argsort(key)
    twice = three[by[_repeated(np.append(True, key[by][1:] != key[by][:-1]))]] if len(three) else three
    repeat_words = of_text(covered(twice, np.full(len(twice), 3), n))

    starts, lengths = suffix_repeats(h, w.at, rules.min_words)
    n_covered = of_text(covered(starts, lengths, n))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner[starts], lengths)

    failed = (n_words < rules.least_words) | (100 * repeat_words > rules.most_repeat_percent * n_words)
    kept = ~failed & (100 * n_covered <= rules.most_covered_percent * n_words) & (longest <= rules.max_longest)
    as_long = lambda x: x.astype(np.int64)
    return [n_words, between(SOLID_LEAD[w.data]), between(SYMBOLS[w.data]), dup_lines, repeat_words, n_covered, longest, failed, kept]


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, and others that are passed on) with the columns of SCHEMA.

    A column of the input that has the name of a new one gives way to it.
    """
    mine = [c for c in docs.columns if c.lower() not in NAMES]

    def run(batches):
        for batch in batches:
            for start, part in chunks(batch.column("text").to_pylist()):
                columns = measure(part, rules)
                row = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array(c) for c in columns)], [*mine, *NAMES])

    kept = docs.select(*[F.col(f"`{c}`") for c in mine])
    return common.to_python(kept).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), SCHEMA]))


#: The query's rows in DuckDB. Repeats of ten words or more cover what ten-word windows found twice
#: cover; the longest is the longest run of such windows at one distance, and nine words more.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g3 AS (SELECT r, k, array_to_string(w[k:k + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
w3 AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 3)) AS p FROM (SELECT r, k, count(*) OVER (PARTITION BY r, s) AS c FROM g3) WHERE c > 1) GROUP BY r),
g10 AS (SELECT r, k, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10)),
twice AS (SELECT r, k, s FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS c FROM g10) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 10)) AS p FROM twice) GROUP BY r),
pairs AS (SELECT a.r, b.k - a.k AS far, a.k FROM twice a JOIN twice b ON a.r = b.r AND a.s = b.s AND a.k < b.k),
runs AS (SELECT r, far, k - row_number() OVER (PARTITION BY r, far ORDER BY k) AS run FROM pairs),
longest AS (SELECT r, max(c) + 9 AS n FROM (SELECT r, far, run, count(*) AS c FROM runs GROUP BY r, far, run) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(w3.n, 0)::BIGINT AS n_repeat_words, coalesce(cov.n, 0)::BIGINT AS n_covered, coalesce(longest.n, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN lines ON lines.r = d.r LEFT JOIN w3 ON w3.r = d.r LEFT JOIN cov ON cov.r = d.r LEFT JOIN longest ON longest.r = d.r
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= 30 * n_words AND longest_repeat <= 100 AS kept
FROM m
"""
