"""Secret scan in DataFrame operations: fixed patterns, and Markov models of characters.

Base spans are the patterns' matches. The method looks at every other run of ``least_chars`` or more
identifier characters: two first-order Markov models of characters, one of random strings and one of
ordinary identifiers, give the log-likelihood ratio of each character after the one before; a run
whose mean ratio is ``least_ratio`` or more is a span of kind ``markov``, if it has ``sure_chars`` or
both letters and digits. Of another run its pieces of
``least_chars`` or more between '=' and '/' are judged likewise, so that names and paths do not hide
what stands behind them. A run or piece that meets a base span is left to it.

Both models are fitted by counting over labelled samples (token, random). ``samples`` makes them:
words of a bounded number of documents, alone and joined as in identifiers, against base64, base62
and hexadecimal renderings of hashes.

A null or empty text has no spans. Rows are scanned one by one, so repeated rows and null ids stay
apart. Other columns are passed on, except those named like the new ones; names that begin with __ are
the operator's own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Kinds in their order, pattern, group whose length counts, and its least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is matched whole or not at all, so its least length can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ADDED = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")
IDENTIFIER = "A-Za-z0-9+/_=-"
CODES = 128
SPAN = "array<struct<start:int,rank:int,end:int>>"


@dataclass(frozen=True)
class Settings:
    least_chars: int = 16
    #: Runs of fewer characters than this need a letter and a digit: long numbers are ordinary.
    sure_chars: int = 20
    #: Nats a character by which random must be likelier.
    least_ratio: float = 0.5
    smoothing: float = 0.5
    #: Bounds on the training sample: documents, and generated strings.
    sample_rows: int = 500
    random_strings: int = 4000


def samples(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Labelled tokens: (token, random)."""
    spark = docs.sparkSession
    drawn = common.sample(docs.select("doc_id", "text").filter("text is not null"), settings.sample_rows, "doc_id", "text").select("text").repartition(spark.sparkContext.defaultParallelism)
    clean = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    words = F.regexp_extract_all(clean, F.lit("[A-Za-z]{2,}"), F.lit(0))
    pairs = drawn.select(words.alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"), F.slice("w", 3, 1 << 30).alias("c"))).alias("p")).select("p.a", "p.b", "p.c").filter("c is not null")
    forms = F.array(F.col("a"), F.concat_ws("_", "a", "b", "c"), F.concat("a", F.initcap("b"), F.initcap("c")), F.concat_ws("-", F.lower("a"), F.lower("b")), F.upper(F.concat_ws("_", "a", "b")))
    ordinary = pairs.select(F.explode(forms).alias("token"), F.lit(False).alias("random"))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    sixty_four = F.base64(F.unhex(digest))
    rendered = F.array(sixty_four, F.regexp_replace(sixty_four, "[+/=]", ""), F.regexp_replace(sixty_four, "[^A-Z2-7]", ""), digest)
    generated = spark.range(settings.random_strings).select(F.explode(rendered).alias("token"), F.lit(True).alias("random"))
    return ordinary.unionByName(generated)


def train(labelled: DataFrame, settings: Settings = Settings()) -> list[float]:
    """Log-likelihood ratios random : ordinary of character b after a, at ``a * CODES + b``."""
    steps = labelled.select("random", F.explode(F.regexp_extract_all("token", F.lit(r"(?=([\x00-\x7F]{2}))"), F.lit(1))).alias("s"))
    # At most two rows for each pair of ASCII characters.
    tallied = steps.groupBy("random", "s").agg(F.count("*").alias("n")).collect()
    tally = {(r.random, ord(r.s[0]), ord(r.s[1])): r.n for r in tallied}
    seen = sorted({a for _, a, _ in tally} | {b for _, _, b in tally})
    table = [0.0] * (CODES * CODES)
    for a in seen:
        rows = {kind: [tally.get((kind, a, b), 0) + settings.smoothing for b in seen] for kind in (True, False)}
        sums = {kind: sum(row) for kind, row in rows.items()}
        for k, b in enumerate(seen):
            table[a * CODES + b] = math.log(rows[True][k] / sums[True]) - math.log(rows[False][k] / sums[False])
    return table


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Matches of a block. Spans are appended within blocks, so many matches cost no more each than few.
BLOCK = 256
MARK = "\x00"


def found(text: Column, pattern: str, rank: int, ok, inner=None) -> Column:
    """Leftmost non-overlapping matches that are ``ok`` (a test of the match), as spans in code points.

    Of a match that is not, the spans ``inner`` finds in it count. ``text`` must not hold MARK: it is
    put around each match, so that one pass gives gaps (even places) and matches (odd ones).
    """
    none = F.array().cast(SPAN)
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def step(acc, x):
        end = acc["at"] + F.length(x)
        span = F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        rest = acc["spans"]
        if inner:
            rest = F.concat(rest, F.transform(inner(x), lambda p: F.struct((acc["at"] + p["start"]).alias("start"), p["rank"].alias("rank"), (acc["at"] + p["end"]).alias("end"))))
        spans = F.when(~acc["odd"], acc["spans"]).when(ok(x), F.concat(acc["spans"], F.array(span))).otherwise(rest)
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), spans.alias("spans"))

    def spans(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), F.lit(False).alias("odd"), none.alias("spans")), step, lambda acc: acc["spans"])

    def of_blocks(p):
        size = 2 * BLOCK
        return F.transform(F.sequence(F.lit(1), F.size(p), F.lit(size)), lambda k: F.slice(p, k, F.lit(size)))

    def placed(blocks):
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x)))
        grow = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        starts = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), grow, lambda acc: acc["all"])
        return F.flatten(F.zip_with(blocks, starts, spans))

    return bound(parts, lambda p: F.when(F.size(p) < 2, none).otherwise(bound(of_blocks(p), placed)))


def apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that meet none of ``base`` (sorted): blocks of it first, then spans of the blocks."""
    meets = lambda r, b: (b["start"] < r["end"]) & (r["start"] < b["end"])

    def of_blocks(own):
        size = F.ceil(F.sqrt(F.size(own).cast("double"))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(own), F.greatest(size, F.lit(1))), lambda k: F.slice(own, k, F.greatest(size, F.lit(1))))
        return F.transform(cut, lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("own")))

    def kept(blocks):
        return F.filter(spans, lambda r: ~F.exists(blocks, lambda k: meets(r, k) & F.exists(k["own"], lambda b: meets(r, b))))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(bound(of_blocks(base), kept))


def ratio(token: Column, table: Column) -> Column:
    """The mean log-likelihood ratio of a token's characters."""
    step = lambda acc, c: F.struct(
        F.ascii(c).alias("last"), (acc["sum"] + F.when(acc["last"] > 0, F.get(table, acc["last"] * CODES + F.ascii(c))).otherwise(F.lit(0.0))).alias("sum")
    )
    return F.aggregate(F.split(token, ""), F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"]) / F.length(token)


def written(spans: Column) -> Column:
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, name), ",")


def scan(docs: DataFrame, table: list[float], settings: Settings = Settings()) -> DataFrame:
    """``docs`` (text and others that are passed on) with the columns of ADDED in place of text."""
    mine = [c for c in docs.columns if c.lower() not in ADDED and c.lower() != "text"]
    given = F.coalesce(F.col("text"), F.lit(""))
    text = F.when(given.contains(MARK), F.translate(given, MARK, "\x01")).otherwise(given)  # neither is in a pattern
    none = F.array().cast(SPAN)
    only = lambda when, spans: F.when(when, spans).otherwise(none)
    always = lambda m: F.lit(True)
    run = f"(?<![{IDENTIFIER}])[{IDENTIFIER}]{{{settings.least_chars},}}+"
    part = IDENTIFIER.replace("/", "").replace("=", "")
    piece = f"(?<![{part}])[{part}]{{{settings.least_chars},}}+"
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    mixed = lambda m: (F.length(m) >= settings.sure_chars) | (m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    random = lambda m: mixed(m) & (ratio(m, ratios) >= settings.least_ratio)
    pieces = lambda m: only(m.rlike("[=/]"), found(m, piece, 4, random))
    t = F.col("__text")
    kinds = {
        "assign": only(t.contains(":") | t.contains("="), found(t, ASSIGN, 1, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6)),
        "access": only(t.contains("AKIA"), found(t, ACCESS, 2, always)),
        "hex": found(t, HEX, 3, always),
        "runs": found(t, run, 4, random, pieces),
    }
    own = [F.col(f"`{c}`") for c in mine]
    rows = docs.select(*own, text.alias("__text")).select(*own, *(spans.alias(f"__{k}") for k, spans in kinds.items()))
    base = rows.select(*own, "__assign", "__access", "__hex", "__runs", F.array_sort(F.concat("__assign", "__access", "__hex")).alias("__base"))
    every = base.select("*", apart(F.col("__runs"), F.col("__base")).alias("__free"))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    spans = F.array_sort(F.concat("__base", "__free"))
    return every.select(*own, *counts, F.sha2(written(F.col("__base")).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"), F.size("__free").cast("long").alias("n_markov"))
