"""``python -m graphloom.cli index [folder]``: the folder's graph as JSON, and counts on stderr."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from graphloom.operators import graph
from graphloom.sources import workspace


def main(args: list[str]) -> int:
    if not args or args[0] != "index" or len(args) > 2:
        print("usage: graphloom index [folder]", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    found = graph.index(workspace.read(spark, args[1] if len(args) > 1 else "."))
    for part in graph.json_parts(found.nodes, found.edges, True, found.scratch).orderBy("ordinal").toLocalIterator():
        sys.stdout.write(part.text)
    print()
    s = found.stats().first()
    found.close()
    print(f"{s.node_count} nodes, {s.edge_count} edges; code references: {s.code_refs_resolved} resolved, {s.code_refs_unresolved} not", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
