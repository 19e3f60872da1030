"""Fixed reports over a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.graph import PropertyGraph

TOP_PACKAGES = 10

# Assumed bytes of a node and an edge without their strings, for the estimate of memory.
NODE_BYTES, EDGE_BYTES = 160, 120


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")


def nodes_by_kind(graph: PropertyGraph) -> DataFrame:
    return _counted(graph.nodes, "type")


def edges_by_kind(graph: PropertyGraph) -> DataFrame:
    return _counted(graph.live_edges, "type")


def nodes_by_repo(graph: PropertyGraph) -> DataFrame:
    return _counted(graph.nodes.filter(F.col("repo_id") != ""), "repo_id")


def edges_by_repo(graph: PropertyGraph) -> DataFrame:
    return _counted(graph.live_edges.filter(F.col("repo_id") != ""), "repo_id")


def top_packages(graph: PropertyGraph, limit: int = TOP_PACKAGES) -> DataFrame:
    return _counted(graph.nodes.filter(F.col("pkg_path") != ""), "pkg_path").limit(limit)


def _strings(*columns: str) -> Column:
    return reduce(Column.__add__, [F.octet_length(c) for c in columns])


def totals(graph: PropertyGraph) -> DataFrame:
    """One row: node_count, edge_count, file_nodes, source_files (distinct paths of files), estimated_bytes."""
    is_file = F.col("type") == "FILE"
    nodes = graph.nodes.agg(
        F.count("*").alias("node_count"),
        F.count_if(is_file).alias("file_nodes"),
        F.count_distinct(F.when(is_file & (F.col("file_path") != ""), F.col("file_path"))).alias("source_files"),
        F.coalesce(F.sum(_strings("id", "type", "name", "pkg_path", "file_path", "repo_id") + NODE_BYTES), F.lit(0)).alias("nb"),
    )
    edges = graph.live_edges.agg(
        F.count("*").alias("edge_count"),
        F.coalesce(F.sum(_strings("src", "dst", "type", "repo_id") + 24 * F.size("occurrences") + EDGE_BYTES), F.lit(0)).alias("eb"),
    )
    # one row each
    return nodes.join(edges).select(
        "node_count", "edge_count", "file_nodes", "source_files", (F.col("nb") + F.col("eb")).alias("estimated_bytes")
    )


def statistics(graph: PropertyGraph) -> DataFrame:
    """All counts in long form: metric, key, count."""
    t = totals(graph)
    names = ("node_count", "edge_count", "file_nodes", "source_files", "estimated_bytes")
    flat = t.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).alias("count")) for n in names])).alias("x"))
    parts = [flat.select("x.*")]
    for metric, rows in (
        ("nodes_by_kind", nodes_by_kind(graph)), ("edges_by_kind", edges_by_kind(graph)),
        ("nodes_by_repo", nodes_by_repo(graph)), ("edges_by_repo", edges_by_repo(graph)),
        ("top_packages", top_packages(graph)),
    ):
        parts.append(rows.select(F.lit(metric).alias("metric"), "key", "count"))
    return reduce(DataFrame.unionByName, parts)


def in_neighbours(graph: PropertyGraph) -> DataFrame:
    """dst, src: who points at each node over dependency edges, by dst and src; a hub's rows are sorted by many tasks."""
    from quiver.functions.predicates import is_dependency

    edges = graph.live_edges.filter(is_dependency(F.col("type")))
    return edges.select("dst", "src").distinct().orderBy("dst", "src")


def workspace_totals(graph: PropertyGraph) -> DataFrame:
    """repo_id, nodes, edges of each repository and of all (repo_id null)."""
    rows = graph.nodes.select("repo_id", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        graph.live_edges.select("repo_id", F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return rows.rollup("repo_id").agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))
