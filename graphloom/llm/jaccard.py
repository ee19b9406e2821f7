"""Exact n-gram Jaccard join: classes of documents linked at ``percent`` of similarity.

Words are lower-cased (A-Z); a document's set has its distinct ``n``-word shingles, as 64-bit hashes.
Jaccard distance is a metric, and the join uses it as such:

1. Pivots. Unrelated texts have distance 1 from every pivot, so pivots drawn at random would have all
   documents near each cell's edge (see README). Anchors choose them instead: the universe of shingles
   falls into more parts than two linked sets can differ in, so on some part they agree. Of all sets
   that agree on a part, the one with the least id is a pivot, and each of the others joins the region of
   each of its pivots, once, however many parts they agree on. Any two linked sets are in one region.
2. Regions. In a region distances to pivots, its own first, are measured exactly. Sets within r of a
   pivot are linked with it, and sets that are linked already need no look at each other. The others
   fall into Voronoi cells; by the triangle inequality, a set within 2r of a cell's edge, and whose
   distance to the cell's pivot differs by r at most from that of one of the others, is copied into it.
   Cells are joined likewise, recursively (:mod:`graphloom.llm.metric`).
3. A region of more than ``most_region`` sets is divided by the same rules over many tasks. If its cells
   do not shrink, blocks of the sets that are not linked yet meet blocks of all, each pair in a task.

Identical sets are one member. A null, empty or blank text has no shingles and is linked with nothing:
its component_id is its own doc_id. Repeated rows are identical sets; component_id is the least doc_id
that is not null, and null if a class has none. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .components import Union, connected
from .metric import EPS, link
from .words import U, Words, chunks, grams, mix

#: Keys that a task remembers while it looks for documents that meet in it already (under 30 MB).
TASK_KEYS = 150_000
#: Characters of text that are worked on together (under 20 MB).
CHUNK_CHARS = 200_000
BLOCK = 1024
#: A region weighs as many members as it has, or more if they take more than this on average.
MEMBER_BYTES = 8_192


@dataclass(frozen=True)
class Join:
    n: int = 3
    percent: int = 90
    most_region: int = 4096
    pivots: int = 16
    most_levels: int = 4


class Rings:
    """Size classes [low, next low), each with its number of parts."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(2 * self.lows[-1])
        #: More parts than two linked sets of a class can differ in, and some to choose from.
        most = [self.differ(high - 1, high - 1) for high in self.lows[1:]]
        self.parts = [d + 1 + (d + 1) // 5 for d in most]

    def differ(self, a: int, b: int) -> int:
        """In how many shingles linked sets of these sizes differ at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> list[tuple[int, int]]:
        """The classes in which a set of this size meets all its partners, and how many parts it must offer in each."""
        first = bisect_right(self.lows, size) - 1
        largest = 100 * size // self.percent
        last = bisect_right(self.lows, largest) - 1
        return [(c, self.differ(size, min(largest, self.lows[c + 1] - 1)) + 1) for c in range(first, last + 1)]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct shingles of a text's word hashes."""
    if not len(words):
        return words
    if len(words) < n:
        return mix(grams(words, len(words)) + U(len(words)))
    return np.unique(grams(words, n))


def text_sets(column: pa.Array, n: int):
    """The sets of a column of texts, some at a time, with the number of the first."""
    for start, part in chunks((t.as_py() for t in column), CHUNK_CHARS):
        w = Words(part, lower=True)
        h = w.word_hashes()
        yield start, [shingles(h[a:b], n) for a, b in zip(w.at[:-1], w.at[1:], strict=True)]


def set_id(own: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    sums = [mix(own ^ U(salt)).sum(dtype=U) for salt in (0x51ED270B7F4A7C15, 0x3C6EF372FE94F82B)]
    return np.array(sums, ">u8").tobytes()


def keys(own: np.ndarray, rings: Rings) -> np.ndarray:
    """Keys of parts of the set in each of its classes; equal for equal projections.

    A set that may differ from its partners in d parts offers the d + 1 that hold most shingles, ties by
    hash. Parts that linked sets agree on stand in one order for both, so those that one or the other
    leaves out are those that the one which leaves out more does: at least one part on which they agree is
    offered by both. The fullest parts are those that unrelated documents hardly agree on.
    """
    out, place, value = [], mix(own + U(0xA0761D6478BD642F)), mix(own ^ U(0xE7037ED1A0B428DB))
    low, high = (value & U(0xFFFFFFFF)).astype(np.float64), (value >> U(32)).astype(np.float64)
    for c, offered in rings.of(len(own)):
        parts = rings.parts[c]
        at = (place % U(parts)).astype(np.int64)
        sums = np.bincount(at, low, parts).astype(U) + (np.bincount(at, high, parts).astype(U) << U(32))
        found = mix(mix(sums) + np.arange(parts, dtype=U) * U(0x8EBC6AF09C88C6E3) + U((c + 1) * 0x589965CC75374CC3 % (1 << 64)))
        by = np.lexsort((found, np.bincount(at, minlength=parts)))
        out.append(found[by[parts - offered :]])
    return np.concatenate(out)


#: ``id`` is the first half of ``sid``: enough to propose pairs, which are verified as sets.
SIGNED = "doc_id long, th long, n long, sid binary, id long, keys array<long>, met array<long>"


def _sign(join: Join):
    def run(batches):
        rings, first, seen = Rings(join.percent), {}, set()

        def row(own: np.ndarray):
            if not len(own):
                return 0, None, None, [], []
            sid = set_id(own)
            number = int.from_bytes(sid[:8], "big", signed=True)
            if sid in seen:
                return len(own), sid, number, [], []
            if len(first) > TASK_KEYS:
                first.clear()
                seen.clear()
            seen.add(sid)
            new, met = [], set()
            for k in keys(own, rings).view(np.int64).tolist():
                other = first.setdefault(k, number)
                if other == number:
                    new.append(k)
                else:
                    met.add(other)
            return len(own), sid, number, np.array(new, np.int64), list(met)

        for batch in batches:
            for start, sets in text_sets(batch.column("text"), join.n):
                rows = [row(own) for own in sets]
                ids = [batch.column(c).slice(start, len(sets)) for c in ("doc_id", "th")]
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "th", "n", "sid", "id", "keys", "met"])

    return run


def _meet(batches):
    """Of rows sorted by key and id: each set of a key, and the first of it, which is its pivot."""
    last, lead = None, None
    for batch in batches:
        k, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if not len(k):
            continue
        same = np.append(last is not None and k[0] == last, k[1:] == k[:-1])
        heads = np.maximum.accumulate(np.where(same, -1, np.arange(len(k))))
        pivot = np.where(heads < 0, lead or 0, ids[heads])
        last, lead = k[-1], pivot[-1]
        at = np.flatnonzero(same & (pivot != ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(pivot[at])], ["u", "v"])


#: A set in a region. ``label`` names sets that are linked already; a set is open unless it has the label
#: that most of its region have, so of two sets that are not linked yet one is open.
MEMBER = "region string, sid binary, hashes binary, label binary, open boolean"


def _hash_members(n: int):
    def run(batches):
        for batch in batches:
            regions = batch.column("regions")
            for start, sets in text_sets(batch.column("text"), n):
                for k, own in enumerate(sets, start):
                    names = [str(r) for r in regions[k].as_py()]
                    columns = [names, [batch.column("sid")[k].as_py()] * len(names), [own.tobytes()] * len(names), [None] * len(names), [True] * len(names)]
                    kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["region", "sid", "hashes", "label", "open"])

    return run


def _link_regions(percent: int):
    """Of rows sorted by region, a link from each set (or its label's) to the least it is linked with in the region."""

    def linked(region, sids: list[bytes], sets: list[np.ndarray], labels: list):
        # The region's own pivot has the id that the region is named by, and comes first.
        own = int(re.split("[/+]", region)[0]).to_bytes(8, "big", signed=True) if region else b""
        by = sorted(range(len(sids)), key=lambda k: (sids[k][:8] != own, sids[k]))
        by = [k for j, k in enumerate(by) if not j or sids[k] != sids[by[j - 1]]]
        roots = link([sets[k] for k in by], percent, [labels[k] for k in by])
        name = lambda k: labels[k] or sids[k]
        return {(name(by[i]), name(by[r])) for i, r in enumerate(roots) if name(by[i]) != name(by[r])}

    def run(batches):
        region, sids, sets, labels = None, [], [], []
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], ["u", "v"])
        for batch in batches:
            out = []
            for r, sid, own, label in zip(*(batch.column(c).to_pylist() for c in ("region", "sid", "hashes", "label")), strict=True):
                if r != region:
                    out += linked(region, sids, sets, labels)
                    region, sids, sets, labels = r, [], [], []
                sids.append(sid)
                sets.append(np.frombuffer(own, U))
                labels.append(label)
            yield batch_of(out)
        yield batch_of(list(linked(region, sids, sets, labels)))

    return run


PLACED = "region string, sid binary, label binary, near array<binary>, d array<double>"


def _measure(percent: int):
    """Of each set its distances to its region's pivots, and those pivots that it is linked with.

    Rows come sorted by region and salt, pivots before members.
    """

    def run(batches):
        known, pivots = None, []
        for batch in batches:
            out = []
            for region, salt, member, sid, hashes, label in zip(*(batch.column(c).to_pylist() for c in ("region", "salt", "member", "sid", "hashes", "label")), strict=True):
                if (region, salt) != known:
                    known, pivots = (region, salt), []
                here = np.frombuffer(hashes, U)
                if not member:
                    pivots.append((sid, here))
                    continue
                d, near = [], []
                for other, p in pivots:
                    inter = int(np.count_nonzero(p[np.minimum(np.searchsorted(p, here), len(p) - 1)] == here))
                    union = len(p) + len(here) - inter
                    d.append(1 - inter / union)
                    if 100 * inter >= percent * union:
                        near.append(other)
                out.append((region, sid, label, near, d))
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["region", "sid", "label", "near", "d"])

    return run


def measured(rest: DataFrame, level: int, join: Join) -> DataFrame:
    """Distances of the members of large regions to pivots drawn from the open ones of each."""
    salts = F.ceil(F.col("size") / BLOCK).cast("int")
    share = F.xxhash64("sid", F.lit(level)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    # By hash about twice as many are drawn as there are pivots, however large the region.
    drawn = rest.filter(F.col("open") & (share < 2.0 * join.pivots / F.col("n_open"))).groupBy("region").agg(F.slice(F.array_sort(F.collect_set("sid")), 1, join.pivots).alias("p"))
    chosen = rest.join(drawn.select("region", F.explode("p").alias("sid")), ["region", "sid"]).dropDuplicates(["region", "sid"])
    pivots = chosen.select("region", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(False).alias("member"), "sid", "hashes", "label")
    members = rest.select("region", F.pmod(F.xxhash64("sid"), salts).cast("int").alias("salt"), F.lit(True).alias("member"), "sid", "hashes", "label")
    dealt = pivots.unionByName(members).repartition("region", "salt").sortWithinPartitions("region", "salt", "member", "sid")
    return common.materialize(dealt.mapInArrow(_measure(join.percent), PLACED), "measured")


def _roots(batches):
    """Of pairs sorted by region: each name and its root. A region has few: its pivots, and labels of earlier ones."""
    region, own = None, Union()

    def rows():
        return [(region, x, own.find(x)) for x in list(own.up)]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary()))], ["region", "name", "root"])

    for batch in batches:
        out = []
        for r, u, v in zip(*(batch.column(c).to_pylist() for c in ("region", "u", "v")), strict=True):
            if r != region:
                out += rows()
                region, own = r, Union()
            own.join(u, v)
        yield batch_of(out)
    yield batch_of(rows())


def contracted(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of members with pivots, and the members with the labels that follow."""
    first = F.get("near", F.lit(0))
    links = placed.filter("size(near) > 0").select(F.col("sid").alias("u"), first.alias("v")).filter("u <> v")
    steps = F.zip_with("near", F.slice("near", 2, 1 << 20), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    # Only pivots and labels, a few of each region: members themselves are in ``links``.
    pairs = placed.select("region", F.explode(F.filter(steps, lambda e: e["v"].isNotNull())).alias("e")).select("region", "e.u", "e.v")
    pairs = pairs.unionByName(placed.filter("label is not null and size(near) > 0").select("region", F.col("label").alias("u"), first.alias("v")).filter("u <> v"))
    pairs = common.materialize(pairs.distinct(), "pivot-pairs")
    roots = pairs.repartition("region").sortWithinPartitions("region").mapInArrow(_roots, "region string, name binary, root binary")
    roots = roots.select(named("region", "name").alias("name"), "root")
    known = placed.select("region", "sid", "d", F.coalesce(first, "label").alias("label"), named("region", F.coalesce(first, "label")).alias("name"))
    known = common.lookup(known, "name", roots, "sid").select("region", "sid", "d", F.coalesce("root", "label").alias("label"))
    return links.unionByName(pairs.select("u", "v")), common.materialize(known, "labelled")


def named(region: str, name: str | Column) -> Column:
    return F.concat_ws(" ", region, F.base64(name))


def in_cells(members: DataFrame, sizes: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """region, cell, sid, label, open of members by the cells they meet in, and the regions whose cells do not shrink.

    Of ``sizes`` (region, most: the label that most have, n_open, n_members) only regions with open sets.
    """
    radius = 1 - join.percent / 100
    known = common.lookup(members, "region", sizes, "sid").filter("n_open is not null").withColumn("open", ~F.col("label").eqNullSafe(F.col("most")))
    least = F.array_min("d")
    known = common.materialize(known.select("region", "sid", "label", "open", "d", least.alias("least"), (F.array_position("d", least) - 1).cast("int").alias("own")), "known")
    edge = known.filter("open").groupBy("region", "own").agg(F.min(F.get("d", F.col("own"))).alias("low"), F.max(F.get("d", F.col("own"))).alias("high"))
    edge = edge.select(F.concat_ws("/", "region", F.col("own").cast("string")).alias("cell"), "low", "high")
    near = F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda k: F.get("d", k) <= F.col("least") + 2 * radius + EPS)
    spread = known.select("region", "sid", "label", "open", "d", F.explode(near).alias("k"), "own").withColumn("cell", F.concat_ws("/", "region", F.col("k").cast("string")))
    at = F.get("d", F.col("k"))
    inside = common.lookup(spread, "cell", edge, "sid").filter((at >= F.col("low") - radius - EPS) & (at <= F.col("high") + radius + EPS))
    placed = common.materialize(inside.select(F.col("region").alias("parent"), "cell", F.col("sid").alias("member"), "label", (F.col("open") & (F.col("k") == F.col("own"))).alias("core")), "cells")
    work = placed.groupBy("parent", "cell").agg(F.count("*").alias("n"), F.count_if("core").alias("cores")).groupBy("parent").agg(F.sum(F.col("n") * F.col("cores")).alias("pairs"))
    stuck = work.join(sizes, F.col("parent") == F.col("region")).filter(F.col("pairs") > 0.7 * F.col("n_open") * F.col("n_members")).select("region", F.lit(True).alias("stuck"))
    return placed, stuck


def in_blocks(rest: DataFrame) -> DataFrame:
    """Regions cut to blocks by hash, each block of open sets with each of all a region: for any size, exact."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = rest.select("*", blocks("size").alias("all_blocks"), F.ceil(F.col("size") * F.col("n_open") / F.col("n_members") / BLOCK).cast("int").alias("open_blocks"))
    a, b = F.pmod(F.xxhash64("sid"), F.col("open_blocks")).cast("int"), F.pmod(F.xxhash64("sid", F.lit(1)), F.col("all_blocks")).cast("int")
    name = lambda i, j: F.concat_ws("+", "region", i.cast("string"), j.cast("string"))
    as_open = F.when(F.col("open"), F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda j: name(a, j))).otherwise(F.array().cast("array<string>"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("open_blocks") - 1), lambda i: name(i, b))
    return mine.select(F.explode(F.array_distinct(F.concat(as_open, as_any))).alias("region"), "sid", "hashes", "label", "open")


def links(members: DataFrame, join: Join) -> DataFrame:
    """Links (u, v) that connect what is linked in each region."""
    done, edges = [], []
    for level in range(join.most_levels + 1):
        weight = F.greatest(F.count("*"), F.ceil(F.sum(F.octet_length("hashes")) / MEMBER_BYTES))
        sizes = members.groupBy("region").agg(weight.alias("size"), F.count("*").alias("n_members"), F.count_if("open").alias("n_open"))
        large = common.materialize(sizes.filter(F.col("size") > join.most_region), "large")
        if large.isEmpty():
            break
        split = common.lookup(members, "region", large, "sid")
        done.append(split.filter("size is null").select("region", "sid", "hashes", "label", "open"))
        rest = common.materialize(split.filter("size is not null"), "rest")
        if level == join.most_levels:
            members = in_blocks(rest)
            break
        made, known = contracted(measured(rest, level, join))
        edges.append(made)
        most = known.filter("label is not null").groupBy("region", "label").agg(F.count("*").alias("n")).groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.max("n").alias("n_most"))
        left = large.join(most, "region", "left").select("region", "most", "n_members", "size", (F.col("n_members") - F.coalesce("n_most", F.lit(0))).alias("n_open")).filter("n_open > 0")
        left = common.materialize(left, "left")
        placed, stuck = in_cells(known, left.drop("size"), join)
        stuck = common.materialize(stuck, "stuck")
        again = common.lookup(placed, "parent", stuck.withColumnRenamed("region", "parent"), "member").filter("stuck is null")
        if not stuck.isEmpty():
            labels = known.select("region", "sid", F.col("label").alias("now"))
            whole = common.lookup(rest.select("region", "sid", "hashes"), "region", left.join(stuck, "region").drop("stuck"), "sid").filter("size is not null").join(labels, ["region", "sid"])
            done.append(in_blocks(whole.select("region", "sid", "hashes", F.col("now").alias("label"), "size", "n_members", "n_open", (~F.col("now").eqNullSafe(F.col("most"))).alias("open"))))
        sets = rest.select(F.col("region").alias("parent"), F.col("sid").alias("member"), "hashes")
        members = common.materialize(again.join(sets, ["parent", "member"]).select(F.col("cell").alias("region"), F.col("member").alias("sid"), "hashes", "label", F.col("core").alias("open")), "regions")
    done.append(members)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    found = every.repartition("region").sortWithinPartitions("region").mapInArrow(_link_regions(join.percent), "u binary, v binary")
    for more in edges:
        found = found.unionByName(more)
    return found


def regions(signed: DataFrame) -> DataFrame:
    """id and the ids of the pivots whose regions it is in, of every set that agrees with another on a part."""
    keyed = signed.select(F.explode("keys").alias("key"), "id")
    meeting = common.materialize(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_meet, "u long, v long").distinct(), "meeting")
    met = signed.select(F.col("id").alias("u"), F.explode("met").alias("v"))
    mine = meeting.groupBy("u").agg(F.collect_set("v").alias("to"))
    # A set that met another in its task has no key of its own there: it goes where the other goes, and to it.
    # One row for each pair that met, with all of the other's regions: they are not paired one by one.
    follow = met.join(mine.select(F.col("u").alias("v"), "to"), "v", "left").select("u", F.concat(F.array("v"), F.coalesce("to", F.array().cast("array<long>"))).alias("to"))
    pivots = meeting.select("v").unionByName(met.select("v")).distinct().select(F.col("v").alias("u"), F.array("v").alias("to"))
    every = mine.unionByName(follow).unionByName(pivots)
    # No more of a set than it has keys, or met in its task.
    found = common.materialize(every.groupBy("u").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("regions")), "regions-of-sets")
    common.discard(meeting)
    return found


def rooted_sets(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """doc_id, th, n and sid of the rows of ``docs``, and each set with the root of its class: sid, least, lead, root."""
    rows = common.to_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")))
    signed = common.materialize(rows.mapInArrow(_sign(join), SIGNED), "signed")
    with_sets = signed.filter("sid is not null")
    one = with_sets.groupBy("sid").agg(F.min("id").alias("id"), F.min(F.struct("doc_id", "th")).alias("own"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("lead"))
    one = common.materialize(one, "sets")
    anchored = regions(signed)
    slim = common.materialize(signed.drop("keys", "met", "id"), "signed")
    common.discard(signed)
    places = one.join(anchored, F.col("id") == F.col("u")).select("regions", "sid", F.col("own.doc_id").alias("d"), F.col("own.th").alias("h"))
    found = rows.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("regions", "sid", "text")
    if not slim.filter("sid is not null").groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        found = found.groupBy("sid").agg(F.first("regions").alias("regions"), F.first("text").alias("text"))  # repeated rows
    members = common.materialize(found.mapInArrow(_hash_members(join.n), MEMBER), "members")
    # In a table: chained, a task's links and its stars would each hold a Python worker, and idle ones stay.
    found = common.materialize(links(members, join), "pairs")
    common.discard(members)
    star = common.materialize(connected(found), "links")
    common.discard(found)
    rooted = one.join(star, F.col("sid") == F.col("node"), "left").select("sid", "least", "lead", F.coalesce("root", "sid").alias("root"))
    return slim, common.materialize(rooted, "rooted")


def classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    signed, rooted = rooted_sets(docs, join)
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = common.lookup(rooted, "root", least, "sid").select("sid", "component")
    joined = common.lookup(signed.select("doc_id", "th", "n", "sid"), "sid", named, "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def first_rows(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one, by least doc_id, then by hash of the text.

    Rows without an id come last in their class. A text without shingles is a class of its own; rows
    that repeat a doc_id and text, of such texts as well, count as one.
    """
    signed, rooted = rooted_sets(docs, join)
    leads = rooted.groupBy("root").agg(F.min("lead").alias("lead")).select(F.col("lead.doc_id").alias("__d"), F.col("lead.th").alias("__h"))
    blank = signed.filter("sid is null").select("doc_id", "th").distinct()
    hashed = docs.withColumn("__th", F.xxhash64("text"))
    first = hashed.join(leads.unionByName(blank.toDF("__d", "__h")), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__h")), "left_semi")
    if not signed.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        first = first.dropDuplicates(["doc_id", "__th"])
    return first.drop("__th")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT r, array_to_string(w[k:k + 2], ' ') AS sh FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)
),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM pairs JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.t),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id
FROM d JOIN least ON least.r = d.r LEFT JOIN n ON n.r = d.r
"""
