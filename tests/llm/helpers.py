"""Brute-force versions and odd inputs for the training-data operators."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

ODD_TEXTS = [None, "", " ", "\n\t", "a", "A", "a b", "a b c", "the the the the", "x\n\nx\nx", "é 用 😀 🙂", "word " * 5000, "z" * 30_000, "0" * 3000, "@" * 50, "+" * 50, "<|endoftext|> x\x1cy z", "[[", "-----"]


def odd_documents(spark):
    """Nulls in every column, odd and long texts, repeated rows and ids, clashing extra columns."""
    rows = [(i, t, "en", "src0", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id here", None, None, 1), (None, "no id here", None, None, 1), (3, ODD_TEXTS[3], "en", "src0", None), (5, "same id, other text", "de", None, 2)]
    rows += [(100 + i, "one two three four five six seven eight nine ten eleven twelve", "fr", "src1", 3) for i in range(4)]
    rows = [(*r, 7, "clash", "x", "clash", 1.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, h string, region string, rate double")


def repetition(text, least=10):
    w = WORD.findall(text or "")
    n = len(w)
    threes = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    twice = {i + k for i in range(n - 2) if threes[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(n - least + 1):
        at[tuple(w[i : i + least])].append(i)
    covered, longest = set(), 0
    for places in at.values():
        for i, a in enumerate(places):
            for b in places[:i]:
                k = least
                while max(a, b) + k < n and w[a + k] == w[b + k]:
                    k += 1
                longest = max(longest, k)
                covered |= {*range(a, a + k), *range(b, b + k)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice), len(covered), longest


def shingle_set(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_classes(rows, percent=90, n=3):
    """(doc_id, n_shingles, component_id) for (doc_id, text) rows, null ids in classes of their own kind."""
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[root(i)].append(doc)
    return sorted(((d, len(s), (min(groups[root(i)]) if groups[root(i)] else None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(text, items, window=10):
    import hashlib

    w = bench_words(text)
    hit, found = set(), set()
    for item, t in items:
        b = bench_words(t)
        if item is None or not b:
            continue
        size = min(window, len(b))
        wins = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
