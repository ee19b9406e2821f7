"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A benchmark item's
windows are its ``window`` consecutive words; an item of fewer words is one window. Containment must
be whole, so a prefix of one shingle is necessary: the rarest, by occurrences in all documents, of
the window's shingles (``shingle`` words, fewer in a shorter window).

1. Occurrences of benchmark shingles in documents, with their places (one pass over all words).
2. Shingles are ordered by rarity; each window's prefix shingle joins the occurrences; candidates
   that would begin before the first word or end after the last are dropped.
3. A candidate is verified by all its shingles at their exact places, as texts, not hashes.
4. Each document's verified windows cover its hit words.

Shingles are joined by broadcast while they take ``most_broadcast`` bytes at most, else by a shuffle.
A null or wordless text or item has no words; null item_ids are ignored, items with the same text
all count, and rows that repeat a doc_id and text get the same result each. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    window: int = 10
    shingle: int = 3
    most_broadcast: int = 32_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, settings: Settings) -> DataFrame:
    """item_id, window (its words), size, shingle size for each window of each item."""
    own = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - settings.window, F.lit(0))
    placed = own.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    cut = placed.select("item_id", F.slice("w", F.col("k") + 1, settings.window).alias("window"))
    size = F.size("window")
    return cut.select("item_id", "window", size.alias("size"), F.least(size, F.lit(settings.shingle)).alias("s"), F.array_join("window", " ").alias("wid")).distinct()


def occurrences(docs: DataFrame, shingles: DataFrame, sizes: list[int], settings: Settings, rows: bool = False) -> tuple[DataFrame, bool]:
    """doc_id, th, n_words, at, sh: every place of a document that has a benchmark shingle.

    Words hold no space, so a shingle's words joined by one are a text of its own. If ``rows`` are asked
    for and shingles are few enough to be broadcast, each row of ``docs`` has the empty shingle at -1 too,
    so that words are found once; the second result says whether it is so.
    """
    out = None
    small = shingles.agg(F.coalesce(F.sum(F.octet_length("sh") + 16), F.lit(0))).first()[0] <= settings.most_broadcast
    for s in sizes:
        wanted = shingles.filter(F.col("s") == s).select("sh")
        mark = rows and small and s == sizes[0]
        if mark:
            wanted = wanted.unionByName(docs.sparkSession.createDataFrame([("",)], "sh string"))
        if small:
            wanted = F.broadcast(wanted)
        # No filter by size here: below the projection it would find the words a second time.
        own = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
        joined = F.transform("w", lambda x, i: F.concat_ws(" ", x, *(F.get("w", i + k) for k in range(1, s))))  # noqa: B023
        whole = F.slice(joined, 1, F.greatest(F.size("w") - s + 1, F.lit(0))) if s > 1 else F.col("w")
        every = F.posexplode(F.concat(F.array(F.lit("")), whole) if mark else whole)
        placed = own.select("doc_id", "th", F.size("w").alias("n_words"), every.alias("at", "sh"))
        if mark:
            placed = placed.withColumn("at", F.col("at") - 1)
        found = placed.join(wanted, "sh").select("doc_id", "th", "n_words", "at", "sh")
        out = found if out is None else out.unionByName(found)
    return out, rows and small


def dealt(rows: DataFrame, table: DataFrame, key: str, small: bool) -> DataFrame:
    """``rows`` (doc_id, th and others) joined with ``table``, so that a key which a third of all rows has is not one task's.

    A small table is broadcast. Of a larger one each row is copied to the salts that its key's rows have; ``rows``
    is written first, as it is read twice.
    """
    if small:
        return rows.join(F.broadcast(table), key)
    salted = common.materialize(rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(common.SALTS)).cast("int")), "salted")
    known = salted.select(key, "__salt").distinct().join(table, key)
    return salted.join(known, [key, "__salt"]).drop("__salt")


def verified(docs: DataFrame, items: DataFrame, settings: Settings, rows: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, th, start, size, item_ids of every window's occurrence in a document; and doc_id, th, n_words of
    every row, if ``rows`` are asked for and come with the occurrences."""
    own = common.materialize(windows(items, settings), "windows")
    unique = own.groupBy("wid", "window", "size", "s").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    offsets = F.explode(F.sequence(F.lit(0), F.col("size") - F.col("s"))).alias("offset")
    sizes = [r.s for r in own.select("s").distinct().orderBy("s").collect()]  # at most settings.shingle values
    if not sizes:
        return docs.select("doc_id", F.lit(0).cast("long").alias("th"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("items")).limit(0), None
    spread = unique.select("wid", "size", "s", "window", offsets)
    text = F.array_join(F.slice("window", F.col("offset") + 1, F.col("s")), " ")
    spread = common.materialize(spread.select("wid", "size", "s", "offset", text.alias("sh")), "window-shingles")
    shingles = spread.select("s", "sh").distinct()
    taken = lambda table, *names: table.agg(F.coalesce(F.sum(sum(F.octet_length(F.col(n).cast("string")) for n in names) + 48), F.lit(0))).first()[0]
    small = taken(spread, "wid", "sh") + taken(own, "wid", "item_id") <= settings.most_broadcast

    places, have_rows = occurrences(docs, shingles, sizes, settings, rows)
    places = common.materialize(places, "occurrences")
    found = places.filter("at >= 0")
    rarity = found.groupBy("sh").agg(F.count("*").alias("n"))
    # A shingle that no document has rules its window out: the inner join drops all its windows.
    ranked = spread.join(rarity, "sh", "left").groupBy("wid", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sh", "offset")).alias("first")).filter("first.n > 0")
    prefix = ranked.select("wid", "size", F.col("first.sh").alias("sh"), F.col("first.offset").alias("offset"))
    start = F.col("at") - F.col("offset")
    candidates = dealt(found, prefix, "sh", small).withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))).select("doc_id", "th", "start", "wid", "size").distinct()

    needed = dealt(candidates, spread.select("wid", "s", "offset", "sh"), "wid", small).select("doc_id", "th", "start", "wid", "size", "s", (F.col("start") + F.col("offset")).alias("at"), "sh")
    there = found.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("at").alias("a"), F.col("sh").alias("x")).distinct()
    matched = needed.join(there, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("at") == F.col("a")) & (F.col("sh") == F.col("x")))
    whole = matched.groupBy("doc_id", "th", "start", "wid", "size", "s").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("size") - F.col("s") + 1)
    hits = dealt(whole, unique.select("wid", "items"), "wid", small).select("doc_id", "th", "start", "size", "items")
    return hits, places.filter("at < 0").select("doc_id", "th", "n_words") if have_rows else None


def covered(spans: Column) -> Column:
    """How many places sorted [start, start + size) spans hold."""
    end = lambda s: s["start"] + s["size"]
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), end(s) - F.greatest(acc["to"], s["start"]))).alias("n"),
        F.greatest(acc["to"], end(s)).alias("to"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and th (the text's xxhash64), once each, of the rows that :func:`inspect` calls contaminated."""
    return verified(docs.select("doc_id", "text"), items, settings)[0].select("doc_id", "th").distinct()


def inspect(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``items`` has item_id and text. items_sha256 is the hash of the sorted, comma-joined item_ids.
    """
    docs = docs.select("doc_id", "text")
    spans, rows = verified(docs, items, settings, rows=True)
    hits = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), covered(F.col("spans")).alias("hit"), "items")
    if rows is None:
        rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).alias("n_words"))
    base = rows.withColumn("n_words", F.col("n_words").cast("long"))
    every = base.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    none = F.array().cast("array<string>")
    items_of = F.coalesce("items", none)
    hit = F.coalesce(F.col("hit").cast("long"), F.lit(0).cast("long"))
    return every.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
  FROM (SELECT d.r, d.w, sizes.size, unnest(range(1, len(d.w) - sizes.size + 2)) AS k FROM d JOIN sizes ON len(d.w) >= sizes.size)
),
m AS (SELECT DISTINCT dw.r, dw.k, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM m) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
