"""Small graphs in a short notation: nodes "id:TYPE", edges "src -TYPE-> dst"."""

from __future__ import annotations

import re

from quiver.graph import PropertyGraph


def node(text: str, **more) -> dict:
    node_id, _, kind = text.rpartition(":")
    return {"id": node_id, "type": kind, "name": node_id.rpartition(".")[2], **more}


def edge(text: str, *places: tuple, repo_id: str = "") -> dict:
    m = re.fullmatch(r"(\S+) -(\w+)-> (\S+)", text)
    return {"src": m[1], "type": m[2], "dst": m[3], "occurrences": list(places), "repo_id": repo_id}


def graph(spark, nodes: list, edges: list) -> PropertyGraph:
    return PropertyGraph.of(
        spark, [n if isinstance(n, dict) else node(n) for n in nodes], [e if isinstance(e, dict) else edge(e) for e in edges]
    )


def ids(df) -> list[str]:
    return [r.id for r in df.collect()]


def rows(df) -> set:
    return {tuple(r) for r in df.collect()}
