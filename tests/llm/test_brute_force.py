"""Operators that SQL cannot express, against plain loops that share no code with them; and large odd inputs."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from graphloom.llm import common, decontaminate, importance, jaccard, langid, mixing, pages, pii, registry, repetition, secrets, words
from graphloom.llm.tagger import Path

from tests.llm import helpers as H
from tests.llm.test_operators import plain_base, plain_secrets

M = (1 << 64) - 1


def documents(spark, sf):
    return common.table(spark, sf, "documents")


# 2: personal data ------------------------------------------------------------------------------

FORMS = ["(312) 555-0188", "312.555.0188", "1-312-555-0188", "o'neil@example.de", "10-20-30-40", "4111.1111.1111.1111"]


@pytest.fixture(scope="module")
def tagger(spark, sf):
    return pii.train(documents(spark, sf))


@pytest.fixture(scope="module")
def planted(spark, sf):
    """Texts of the table with forms let in that the base patterns miss."""
    r, out = random.Random(21), []
    for d in documents(spark, sf).orderBy("doc_id").collect():
        text = (d.text or "")[:4000].split(" ")
        for _ in range(2):
            text.insert(r.randrange(len(text) + 1), r.choice(FORMS))
        out.append(" ".join(text))
    return out


def plain_tagged(text, tagger, s):
    """Spans by reading every window, one at a time, and one pass over the text; a place that no window holds together with a digit or an @ has no tag."""
    total, weights, may = np.zeros((len(text), pii.TAGS)), np.zeros((len(text), 1)), np.zeros(len(text), bool)
    for a in range(0, len(text), s.stride):
        ids = np.zeros((s.window, 1), np.int64)
        piece = pii.codes(text[a : a + s.window])
        ids[: len(piece), 0] = piece
        scores = tagger.forward(ids)[:, 0]
        may[a : a + s.window] |= bool(re.search("[0-9@]", text[a : a + s.window]))
        for k in range(len(piece)):
            w = 1 + min(k, s.window - 1 - k)
            total[a + k] += scores[k] * w
            weights[a + k] += w
    scores = total / np.maximum(weights, 1)
    scores[~may, 1:] = -1e6
    return pii.spans_of(plain_viterbi(scores, tagger.p["a"].astype(float)))


def plain_viterbi(scores, a):
    best, came = scores[0] if len(scores) else None, []
    for row in scores[1:]:
        sums = best[:, None] + a
        came.append(sums.argmax(0))
        best = sums.max(0) + row
    out = [int(best.argmax())] if len(scores) else []
    for step in reversed(came):
        out.append(int(step[out[-1]]))
    return np.array(out[::-1], np.int64)


def added(text, seen):
    base = plain_base(text)
    spans = [pii.trimmed(text, s) for s in seen]
    return sorted(s for s in spans if s[1] < s[2] and pii.plausible(s[0], text[s[1] : s[2]]) and not any(a < s[2] and s[1] < b for _, a, b in base))


@pytest.mark.parametrize("together", [512, 3, 1])
def test_what_is_found_is_what_reading_every_window_finds(planted, tagger, monkeypatch, together):
    monkeypatch.setattr(pii, "TOGETHER", together)
    s, texts = pii.Settings(), [*(t[:3000] for t in planted[:60 if together > 99 else 12]), "", "no trigger at all " * 30, "7", "x" * 200 + "@", "5" * 400, ("a word or two " * 20 + "call 312-555-0188 ") * 5]
    for text, got in zip(texts, pii.tagged(texts, tagger, s), strict=True):
        assert got == plain_tagged(text, tagger, s)


def test_paths_in_parts_equal_whole_ones():
    r = np.random.default_rng(4)
    for case in range(60):
        n, tags = int(r.integers(1, 60)), int(r.integers(2, 6))
        scores, a = r.normal(0, 1, (n, tags)), r.normal(0, 2, (tags, tags))
        edge = np.full((1, tags), -1e9)
        edge[0, 0] = 0
        before, after = (0 if case % 2 else None), (0 if case % 3 else None)
        path, at = Path(a, before), 0
        while at < n:
            step = int(r.integers(1, 9))
            path.feed(scores[at : at + step])
            at += step
        want = plain_viterbi(np.concatenate([edge[: before is not None], scores, edge[: after is not None]]), a)[before is not None :][:n]
        assert path.tags(after).tolist() == want.tolist()


def test_added_spans_meet_no_base_span():
    r = random.Random(8)
    for _ in range(300):
        some = lambda: [(0, a, a + r.randint(1, 9)) for a in r.sample(range(60), r.randint(0, 6))]
        spans, base = some(), some()
        assert pii.apart(spans, base) == [s for s in spans if not any(a < s[2] and s[1] < b for _, a, b in base)]


def test_a_long_text_of_figures_takes_memory_in_parts(tagger):
    text = "4711 0815 " * 100_000
    s = pii.Settings()
    whole = pii.Stretch(0, text, *pii.stretches(text, s)[0], tagger, s)
    assert pii.stretches(text, s) == [(0, len(text))]
    weight, most, spans = np.ones((s.window, 1), np.float32), 0, []
    for k in range(whole.first, whole.last + 1, 512):
        to = min(whole.last, k + 511)
        spans += whole.feed(k, to, tagger.forward(whole.windows(k, to).T), weight)
        most = max(most, len(whole.path.came))
    assert most < 70_000 and len(whole.path.tags()) == len(text)


def test_the_method_finds_what_the_patterns_miss(spark, planted, tagger):
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs, tagger).collect()}
    found = there = 0
    for k, text in enumerate(planted):
        base = plain_base(text)
        for m in (m for f in FORMS for m in re.finditer(re.escape(f), text)):
            if not any(a < m.end() and m.start() < b for _, a, b in base):
                there += 1
                found += f":{m.start()}:{m.end()}" in rows[k].spans
    assert there > 200 and found > 0.85 * there
    for k, text in enumerate(planted):
        spans = [x.split(":") for x in rows[k].spans.split(",") if x]
        assert len(spans) == len(plain_base(text)) + rows[k].n_added
        for kind, a, b in spans:
            assert any(f in text[int(a) - 1 : int(b) + 1] for f in FORMS) or (pii.KINDS.index(kind), int(a), int(b)) in plain_base(text) or re.search("[0-9@]", text[int(a) : int(b)])


def test_spans_across_window_edges_are_found_once(tagger):
    s, seen = pii.Settings(), 0
    for shift in range(0, 130, 5):
        text = "ordinary words here " * 8
        text = text[: 60 + shift] + " call (312) 555-0188 soon " + text
        at = text.index("(312)")
        found = added(text, pii.tagged([text], tagger, s)[0])
        assert all(a >= at + 14 or b <= at or (a, b) == (at, at + 14) or b - a >= 12 for _, a, b in found)
        seen += any(abs(a - at) <= 1 and b == at + 14 for _, a, b in found)
    assert seen >= 22


# 4: language -----------------------------------------------------------------------------------


def plain_sizes(text, dictionaries, s):
    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace")
    out = []
    for lang, content in dictionaries.items():
        d, size = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), 0
        for k in range(0, len(data), s.piece_bytes):
            size += len(zstandard.ZstdCompressor(level=s.level, dict_data=d, write_content_size=False).compress(data[k : k + s.piece_bytes]))
        out.append((size, lang))
    return sorted(out)


def test_languages_equal_plain_sizes(spark, sf):
    docs, s = documents(spark, sf), langid.Settings()
    learned = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = registry.op4_zstd_language(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = plain_sizes(texts[r.doc_id], learned, s)
        margin = 1 - sizes[0][0] / sizes[1][0]
        assert r.lang_pred == sizes[0][1] and r.margin == margin and r.accepted == (margin >= s.least_margin)
        assert r.score == min(1.0, margin / s.sure_margin)


def test_dictionaries_hold_learned_texts_only(spark, sf):
    docs = documents(spark, sf).filter(~langid.held_out(F.col("doc_id")))
    own = defaultdict(str)
    for r in docs.collect():
        own[r.lang] += " " + langid.plain(r.text or "").decode()
    for lang, content in langid.train(docs).items():
        text = content.decode("utf-8", "ignore")
        for k in range(0, len(text) - 60, 997):
            piece = text[k : k + 12]
            assert piece in own[lang] or " " in piece


def test_numerals_are_no_letters(spark):
    rows = [(1, "½"), (2, "² ³ 12"), (3, "用"), (4, "_-_"), (5, "٣")]
    learned = {"a": b"some words of one language", "b": b"andere woerter einer sprache"}
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), learned).collect()}
    assert [got[k] for k in (1, 2, 4, 5)] == ["und"] * 4 and got[3] in learned


# 5: secrets ------------------------------------------------------------------------------------


def plain_model(labelled, smoothing):
    tally, seen = Counter(), set()
    for token, random_ in labelled:
        for a, b in zip(token, token[1:]):
            if ord(a) < 128 and ord(b) < 128:
                tally[random_, a, b] += 1
                seen |= {a, b}
    sums = Counter()
    for (kind, a, _), n in tally.items():
        sums[kind, a] += n
    p = lambda kind, a, b: (tally[kind, a, b] + smoothing) / (sums[kind, a] + smoothing * len(seen))
    return {(a, b): math.log(p(True, a, b)) - math.log(p(False, a, b)) for a in seen for b in seen}


def plain_added(text, model, s):
    text = text.replace("\0", "\1")
    base = [(int(x.split(":")[1]), int(x.split(":")[2])) for x in plain_secrets(text)[3].split(",") if x]
    score = lambda t: sum(model.get((a, b), 0.0) for a, b in zip(t, t[1:])) / len(t)
    good = lambda t: (len(t) >= s.sure_chars or re.search("[0-9]", t) and re.search("[A-Za-z]", t)) and score(t) >= s.least_ratio
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) < s.least_chars:
            continue
        if good(m[0]):
            out.append((m.start(), m.end()))
        elif re.search("[=/]", m[0]):
            out += [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[A-Za-z0-9+_-]+", m[0]) if len(p[0]) >= s.least_chars and good(p[0])]
    return [(a, b) for a, b in out if not any(x < b and a < y for x, y in base)]


def test_secrets_equal_a_plain_markov_loop(spark, sf):
    r, s = random.Random(31), secrets.Settings()
    labelled = secrets.samples(documents(spark, sf))
    table = secrets.train(labelled)
    model = plain_model([(x.token, x.random) for x in labelled.collect()], s.smoothing)
    for (a, b), ratio in model.items():
        assert table[ord(a) * 128 + ord(b)] == pytest.approx(ratio, abs=1e-12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = []
    for d in documents(spark, sf).orderBy("doc_id").collect():
        parts = (d.text or "")[:3000].split(" ")
        for _ in range(2):
            key = "".join(r.choices(alphabet + "+/_-", k=r.randint(15, 50)))
            parts.insert(r.randrange(len(parts) + 1), r.choice(["", "the_long_name_of_a_setting=", "/home/user/", "token=", "é\0"]) + key)
        texts.append(" ".join(parts))
    rows = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table).collect()}
    for k, text in enumerate(texts):
        want = plain_added(text, model, s)
        got = [tuple(map(int, x.split(":")[1:])) for x in rows[k].spans.split(",") if x.startswith("markov")]
        assert sorted(got) == sorted(want) and rows[k].n_markov == len(want)
    assert sum(x.n_markov for x in rows.values()) > len(texts)


def test_many_matches_take_time_in_proportion(spark, sf):
    table = secrets.train(secrets.samples(documents(spark, sf)))
    text = "deadbeefdeadbeefdeadbeef token=abcdefgh " * 50_000
    began = time.time()
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), table).first()
    assert (row.n_assign, row.n_hex, row.n_markov) == (50_000, 50_000, 0) and time.time() - began < 90
    assert row.spans.startswith("hex:0:24,assign:25:39,hex:40:64")


# 6: importance resampling ----------------------------------------------------------------------


def plain_mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return h ^ (h >> 31)


def plain_word(word):
    base, prime, h, data = 0x1B873593CC9E2D51, (1 << 61) - 1, 0, word.encode()
    for k, b in enumerate(data):
        h = (h + (b + 1) * pow(base, k, prime)) % prime
    return plain_mix((h + len(data) * 0xD6E8FEB86659FD93) & M)


def plain_buckets(text, buckets):
    h = [plain_word(w) for w in H.WORD.findall((text or "").translate(H.LOWER))]
    pairs = [plain_mix((a * 0x2545F4914F6CDD1D + b) & M) for a, b in zip(h, h[1:])]
    return [plain_mix(x) % buckets for x in h + pairs]


def test_importance_equals_plain_models(spark, sf):
    s = importance.Settings(buckets=512, keep_share=0.6)
    docs, labels = documents(spark, sf).filter("length(text) < 3000"), common.table(spark, sf, "labels")
    good = defaultdict(lambda: True)
    for r in labels.collect():
        good[r.doc_id] &= r.quality == 1 and not r.toxic
    rows = {r.doc_id: r.text for r in docs.collect()}
    each = {i: plain_buckets(t, s.buckets) for i, t in rows.items()}
    raw, target = Counter(), Counter()
    for i, b in each.items():
        raw.update(b)
        if i in good and good[i]:
            target.update(b)
    p = lambda c, k: (c[k] + s.smoothing) / (sum(c.values()) + s.smoothing * s.buckets)
    model = [math.log(p(target, k)) - math.log(p(raw, k)) for k in range(s.buckets)]
    weights = {i: sum(model[k] for k in b) for i, b in each.items()}
    noise = {i: -math.log(-math.log(((plain_mix((i * 2 + 1 + plain_mix(s.seed)) & M) >> 11) + 0.5) / (1 << 53))) for i in rows}
    keys = sorted((weights[i] + noise[i] for i in rows), reverse=True)
    least = keys[math.ceil(s.keep_share * len(keys)) - 1]
    got = importance.resample(docs, labels, s)
    for r in got.collect():
        assert r.log_weight == pytest.approx(weights[r.doc_id], abs=1e-6)
        assert r.key == pytest.approx(weights[r.doc_id] + noise[r.doc_id], abs=1e-6)
        assert r.kept == (weights[r.doc_id] + noise[r.doc_id] >= least - 1e-9)
    top = max(weights.values())
    w = [math.exp(x - top) for x in weights.values()]
    assert importance.effective_rows(got) == pytest.approx(sum(w) ** 2 / sum(x * x for x in w), rel=1e-6)


# Long texts, many parts and clashing names ------------------------------------------------------


def test_texts_are_hashed_alike_in_parts(monkeypatch):
    text = "Some wörds of 用 text\n\nand more " * 40
    whole = words.Words([text, None, "x"])
    want = whole.hashes(whole.begin, whole.end)
    assert [int(x) for x in want[:4]] == [plain_word(w) for w in text.split()[:4]]
    monkeypatch.setattr(words, "SEGMENT", 7)
    again = words.Words([text, None, "x"])
    assert np.array_equal(again.hashes(again.begin, again.end), want)


def test_a_passage_in_a_third_of_all_rows_is_found_without_broadcasts(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k if k % 5 else None, f"text {k % 50} says {passage} and more" if k % 3 == 0 else f"text {k} is of its own making and says nothing else") for k in range(300)]
    docs = spark.createDataFrame([*rows, (7, None), (8, "")], "doc_id long, text string")
    items = spark.createDataFrame([("a", passage), ("b", passage + " thirteen"), ("c", "seven eight"), ("d", "never seen here"), ("e", None)], "item_id string, text string")
    found = [sorted(decontaminate.inspect(docs, items, decontaminate.Settings(most_broadcast=b)).collect(), key=str) for b in (0, 32_000_000)]
    assert found[0] == found[1] and len(found[0]) == 302
    hit = Counter((r.n_hit, r.n_items) for r in found[0])
    assert hit == {(12, 3): 100, (0, 0): 202}


def test_rates_of_sources_are_joined_alike_with_and_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"t{k}", None if k % 7 == 0 else f"s{k % 7}") for k in range(200)], "doc_id long, text string, source string")
    once = sorted(mixing.mix(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(mixing.mix(docs).collect(), key=str) == once and once


def test_words_that_agree_modulo_powers_of_two_are_told_apart(spark):
    morse = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in morse[:1024]) for flip in (0, 1))
    assert len({int(x) for x in words.Words([f"{one} {other} {one}"]).word_hashes()}) == 2
    assert len({plain_word(one), plain_word(other)}) == 2
    # Two passages of 2,048 words that follow the same pattern share their first words at most.
    pair = words.Words(["x y"]).word_hashes()
    h = np.concatenate([pair[np.array(morse)], pair[1 - np.array(morse)]])
    assert repetition.common_prefixes(h, np.array([0, 0]), np.array([2048, 3]), np.array([2048, 2045])).tolist() == [0, next(k for k in range(9) if morse[k] != morse[k + 3])]
    docs = spark.createDataFrame([(1, f"{one} x y"), (2, f"{other} x y"), (3, f"{one} x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == {1: 1, 2: 2, 3: 1}
    lines = spark.createDataFrame([(1, "\n".join([one, other, one]))], "doc_id long, text string")
    row = repetition.judge(lines).first()
    assert (row.n_words, row.n_dup_lines, row.n_repeat_words) == (3, 1, 0)


def test_remainders_are_exact():
    r = random.Random(5)
    p = int(words.PRIME)
    some = [0, 1, p - 1, p - 2, 1 << 31, (1 << 31) - 1, *(r.randrange(p) for _ in range(200))]
    a, b = (np.array(x, np.uint64) for x in zip(*((x, y) for x in some for y in some)))
    assert [int(x) for x in words.product(a, b)] == [x * y % p for x in some for y in some]
    every = np.array([0, p, p + 1, 2 * p, (1 << 64) - 1], np.uint64)
    assert [int(x) for x in words.reduced(every)] == [int(x) % p for x in every]
    up, down = words.powers(1000)
    assert [int(x) for x in words.product(up[:1000], down[:1000])] == [1] * 1000


def test_a_text_of_20_mb(spark, sf):
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(5000)]
    long = " ".join(r.choices(vocabulary, k=3_000_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, "a short text", "en", "s")], "doc_id long, text string, lang string, source string")
    row = repetition.judge(docs).filter("doc_id = 1").first()
    assert row.n_words == 3_000_000 and row.kept
    assert {x.doc_id: x.n_shingles for x in jaccard.classes(docs).collect()}[1] > 2_900_000
    assert importance.resample(docs, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")).count() == 2
    assert langid.predict(docs, {"en": b"words of english " * 20, "xx": b"zzzz yyyy xxxx " * 20}).count() == 2


def test_broken_tags_take_time_in_proportion():
    for part in ('<a "', '<a "x" ', "<div>x", '<span class="share">', '<p class="ad">x', '<a b="c>d">e</a><', "</section>"):
        began = time.time()
        pages.article("<div>" * 50_000 + part * 100_000 + "'\"")
        assert time.time() - began < 20, part


NAMES = ["whole", "cdf", "hex", "base", "free", "assign", "access", "runs", "u", "v", "sid", "source_", "copy", "shuffle_key", "d", "th", "w", "at", "sh", "keys", "n", "h", "n_added", "spans", "lang_pred", "key"]


def test_columns_of_clashing_names(spark, sf):
    docs = H.odd_documents(spark).drop("h", "rate").withColumns({n: F.lit(f"own {n}") for n in NAMES})
    n = docs.count()
    model = secrets.train(secrets.samples(docs.limit(5)))
    out = secrets.scan(docs, model)
    assert out.count() == n and {"hex", "base", "free", "runs"} <= set(out.columns) and out.filter("hex <> 'own hex'").count() == 0
    mixed = mixing.mix(docs, size=2.0)
    assert {"whole", "cdf"} <= set(mixed.columns) and mixed.filter("whole <> 'own whole'").count() == 0
    assert repetition.judge(docs).count() == n
    assert langid.predict(docs, {"a": b"words words words"}).filter("lang_pred is null").count() == 0
    assert jaccard.classes(docs).count() == n
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_scratch_tables_are_deleted(spark):
    since = len(common.MADE)
    kept, gone = common.materialize(spark.range(3), "kept"), common.materialize(spark.range(3), "gone")
    common.clear(spark, since, but=(kept,))
    assert common.MADE[since:] == [kept.scratch] and kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone.scratch).count()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(session)


def test_words_and_marks_of_every_character():
    """The cache of words splits a text as the tokenizer does, for each character below U+3100 and some above."""
    from graphloom.llm import tokens

    coder = tokens.WordIds(tokens.tokenizer_file(tokens.TOKENIZER))
    assert coder.plain
    for k in [*range(0x3100), 0x4E2D, 0xAC00, 0xFEFF, 0xFF01, 0x1F600, 0x20000]:
        if 0xD800 <= k < 0xE000:
            continue
        c = chr(k)
        text = f"ab{c}Cd {c} {c}, x{c}."
        assert coder.of(text) == coder.whole(text), hex(k)
