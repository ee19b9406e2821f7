"""Connected components of an edge table by alternating star contraction, without a driver's graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Nodes a task remembers before it lets go of what it has joined; the rounds finish the rest.
FOREST_NODES = 300_000


class Union:
    """Disjoint sets whose root is the least member."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, root = self.up, x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(batches):
    """The edges of a partition as stars: far fewer rows, with the same components."""

    def stars(own: Union):
        pairs = [(x, own.find(x)) for x in list(own.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["u", "v"])

    own = Union()
    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            own.join(a, b)
        if len(own.up) > FOREST_NODES:
            yield stars(own)
            own = Union()
    yield stars(own)


def connected(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) of every node of ``edges`` (u, v, binary) but roots.

    Each round gives every node's larger neighbours its least one, then every node's smaller ones;
    it ends when a round changes nothing, after about log(nodes) of them. A hub, whose edges may be a third
    of all, is dealt to many tasks by :func:`common.lookup`.
    """
    now = common.materialize(edges.mapInArrow(_forest, "u binary, v binary").distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = common.lookup(both.filter("v > u"), "u", least, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.lookup(large, "u", least, "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = common.materialize(small, "edges")
        common.discard(now, large)
        now = after
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
