"""One-hop neighbourhoods and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions.predicates import contains_folded, is_dependency
from quiver.graph import PropertyGraph
from quiver.schema import GraphError

SEARCH_LIMIT = 50


def _ends(graph: PropertyGraph, edges: DataFrame, end: str) -> DataFrame:
    """The nodes at one end of edges, by id. The edges' other end is one node, so this semi-join's key set is its degree."""
    return graph.nodes.join(edges.select(F.col(end).alias("id")), "id", "left_semi").orderBy("id")


def dependencies(graph: PropertyGraph, node_id: str) -> DataFrame:
    """Nodes that a node depends on directly, itself included where it does."""
    graph.require(node_id)
    return _ends(graph, graph.live_edges.filter((F.col("src") == node_id) & is_dependency(F.col("type"))), "dst")


def blast_radius(graph: PropertyGraph, node_id: str) -> DataFrame:
    """Nodes that depend on a node directly."""
    graph.require(node_id)
    return _ends(graph, graph.live_edges.filter((F.col("dst") == node_id) & is_dependency(F.col("type"))), "src")


def implementations(graph: PropertyGraph, interface_id: str) -> DataFrame:
    """Types that implement an interface."""
    kind = graph.node(interface_id)["type"]
    if kind != "INTERFACE":
        raise GraphError(f"node {interface_id!r} is a {kind}, not an INTERFACE")
    return _ends(graph, graph.live_edges.filter((F.col("dst") == interface_id) & (F.col("type") == "IMPLEMENTS")), "src")


def search(graph: PropertyGraph, needle: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Nodes whose name or id contains the needle, whatever its case: those with the smallest ids."""
    hit = contains_folded(F.col("name"), needle) | contains_folded(F.col("id"), needle)
    return graph.nodes.filter(hit).orderBy("id").limit(limit)
