"""Goroutines and channels around a node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions.predicates import is_call, is_concurrency_edge, is_concurrency_node
from quiver.graph import PropertyGraph


def concurrency_graph(graph: PropertyGraph, node_id: str) -> DataFrame:
    """direction, src, dst, edge_type and id, type, name of the concurrency node, once for each direction and edge.

    outbound: the node's own edges to goroutines and channels. via_call: those of what it calls. via_goroutine: those
    of what it spawns, and of what that calls. inbound: goroutines and channels with edges to it, calls of goroutines
    included. Ordered by direction, id and edge type.
    """
    graph.require(node_id)
    types = graph.nodes.select(F.col("id").alias("node"), F.col("type").alias("node_type"))
    edges = graph.live_edges.select("src", "dst", F.col("type").alias("edge_type"))
    to = edges.join(types.withColumnsRenamed({"node": "dst", "node_type": "dst_type"}), "dst")
    towards_concurrency = to.filter(is_concurrency_edge(F.col("edge_type")) & is_concurrency_node(F.col("dst_type")))
    own = to.filter(F.col("src") == node_id)
    called = own.filter(is_call(F.col("edge_type")) & ~is_concurrency_node(F.col("dst_type"))).select("dst")
    spawned = own.filter((F.col("edge_type") == "SPAWNS") & (F.col("dst_type") != "CHANNEL")).select("dst")
    called_by_spawned = edges.filter(is_call(F.col("edge_type"))).join(
        spawned.select(F.col("dst").alias("src")), "src", "left_semi"
    ).select("dst")

    def leaving(nodes: DataFrame, direction: str) -> DataFrame:
        rows = towards_concurrency.join(nodes.select(F.col("dst").alias("src")), "src", "left_semi")
        return rows.select(F.lit(direction).alias("direction"), "src", "dst", "edge_type", F.col("dst").alias("id"))

    outbound = towards_concurrency.filter(F.col("src") == node_id).select(
        F.lit("outbound").alias("direction"), "src", "dst", "edge_type", F.col("dst").alias("id")
    )
    into = edges.filter(F.col("dst") == node_id).join(types.withColumnsRenamed({"node": "src", "node_type": "src_type"}), "src")
    from_concurrency = is_concurrency_node(F.col("src_type")) & (
        is_concurrency_edge(F.col("edge_type")) | (is_call(F.col("edge_type")) & (F.col("src_type") == "GOROUTINE"))
    )
    inbound = into.filter(from_concurrency).select(
        F.lit("inbound").alias("direction"), "src", "dst", "edge_type", F.col("src").alias("id")
    )
    parts = [
        outbound, leaving(called, "via_call"), leaving(spawned, "via_goroutine"),
        leaving(called_by_spawned, "via_goroutine"), inbound,
    ]
    rows = reduce(DataFrame.unionByName, parts).dropDuplicates(["direction", "src", "dst", "edge_type"])
    named = rows.join(graph.nodes.select("id", "type", "name"), "id")
    return named.select("direction", "src", "dst", "edge_type", "id", "type", "name").orderBy("direction", "id", "edge_type", "src")


def concurrency_flow(graph: PropertyGraph, node_id: str) -> DataFrame:
    """The distinct nodes of the concurrency graph."""
    ids = concurrency_graph(graph, node_id).select("id").distinct()
    return graph.nodes.join(ids, "id", "left_semi").orderBy("id")
