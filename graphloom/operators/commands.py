"""Commands by name, as a client sends them: each answers with a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.operators import graph, lookup

COMMANDS = ("symbolInfo", "graph", "graphParts")


class UnknownCommand(ValueError):
    pass


def run(w: graph.Workspace, command: str, arguments: list | None = None) -> DataFrame:
    """``symbolInfo`` of [symbol id]: no row for an unknown id; ``graph`` of [include sections], as one JSON row for a
    viewer, or ``graphParts``, the same in numbered parts, of any size (see graph.json_parts)."""
    given = arguments or []
    if command == "symbolInfo":
        if not given or isinstance(given[0], bool) or not isinstance(given[0], int):
            raise ValueError("symbolInfo takes a symbol id")
        return lookup.symbol_info(w, given[0])
    if command == "graph":
        return graph.to_json(w.nodes, w.edges, include_sections=bool(given and given[0]))
    if command == "graphParts":
        return graph.json_parts(w.nodes, w.edges, bool(given and given[0]), w.scratch)
    raise UnknownCommand(command)
