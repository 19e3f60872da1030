"""Breadth-first traversals: bounded reverse reach, distances, shortest call path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions.predicates import is_call, is_dependency
from quiver.graph import PropertyGraph
from quiver.lineage import cut
from quiver.schema import GraphError, NotFound


#: Rows that a table made on the driver may have to be broadcast.
BROADCAST_ROWS = 10_000


def blast_radius_depth(
    graph: PropertyGraph, ids: list[str] | DataFrame, max_depth: int, max_nodes: int
) -> tuple[DataFrame, bool]:
    """Nodes that reach any of ``ids`` over dependency edges, with their least distance, and whether the cap cut some off.

    ``ids``: a list, ranked as it stands, or a table of the graph's nodes, ranked by id, which stays distributed.
    Under the cap, nodes are kept in the order of discovery: by distance, then by the rank of the first parent that
    finds them, then by id. It counts as cut only if one more node would have been added. ``max_nodes`` of 0 or less
    is no cap. Rows are ordered by distance and id.
    """
    spark = graph.nodes.sparkSession
    given = isinstance(ids, DataFrame)
    if max_depth <= 0 or not given and not ids:
        return graph.nodes.withColumn("distance", F.lit(1)).limit(0), False
    if given:
        start = cut(ids.select("id").distinct())
        ranked = start.select(F.col("id").alias("dst"), F.col("id").alias("parent_rank"))
    else:
        graph.require(*ids)
        sources = list(dict.fromkeys(ids))
        start = _local(spark, [(x,) for x in sources], "id string")
        ranked = _ranks(spark, sources)
    edges = graph.live_edges.filter(is_dependency(F.col("type"))).select("src", "dst")
    if max_nodes <= 0:
        reached = distances(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")), start, max_depth)
        found = graph.nodes.join(reached.filter("distance > 0").select("id", "distance"), "id")
        return found.orderBy("distance", "id"), False
    found: dict[str, int] = {}  # at most max_nodes
    truncated = False
    for depth in range(1, max_depth + 1):
        new = edges.join(ranked, "dst").join(start.withColumnRenamed("id", "src"), "src", "left_anti")
        if found:
            new = new.join(_local(spark, [(x,) for x in found], "src string"), "src", "left_anti")
        new = new.groupBy("src").agg(F.min("parent_rank").alias("parent_rank")).orderBy("parent_rank", "src")
        room = max_nodes - len(found)
        rows = [r.src for r in new.limit(room + 1).collect()]
        truncated = len(rows) > room
        frontier = rows[:room]
        found |= dict.fromkeys(frontier, depth)
        if truncated or not frontier:
            break
        ranked = _ranks(spark, frontier)
    reached = _local(spark, list(found.items()), "id string, distance int")
    return graph.nodes.join(reached, "id").orderBy("distance", "id"), truncated


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows, broadcast where they are few."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def _ranks(spark: SparkSession, ids: list[str]) -> DataFrame:
    return _local(spark, [(x, i) for i, x in enumerate(ids)], "dst string, parent_rank int")


def distances(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, distance, via of all that ``start`` (id) reaches over edges (a, b). via: the smallest predecessor; starts have none.

    Frontiers stay distributed; each level is a written table, so lineage doesn't grow.
    """
    frontier = cut(start.select("id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("via")).distinct())
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("via"))
        new = step.join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.select("id", F.lit(depth).alias("distance"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def call_distances(graph: PropertyGraph, source: str, max_depth: int | None = None) -> DataFrame:
    """Nodes that a node reaches over CALLS, with their distance (itself at 0)."""
    graph.require(source)
    edges = graph.live_edges.filter(is_call(F.col("type"))).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    start = graph.nodes.filter(F.col("id") == source).select("id")
    return graph.nodes.join(distances(edges, start, max_depth).select("id", "distance"), "id")


def find_path(graph: PropertyGraph, source: str, target: str) -> DataFrame:
    """The shortest call path: step, the node's columns, and next_edge (empty at the target).

    Of several shortest paths it is the one whose nodes, seen from the target back, have the smallest ids.
    """
    spark = graph.nodes.sparkSession
    graph.require(source, target)
    edges = graph.live_edges.filter(is_call(F.col("type")) & (F.col("src") != F.col("dst")))
    edges = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    levels = [cut(spark.createDataFrame([(source, None)], "id string, via string"))]
    seen = levels[0].select("id")
    while levels[-1].filter(F.col("id") == target).isEmpty():
        step = edges.join(levels[-1].select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id"))
        new = cut(step.agg(F.min("a").alias("via")).join(seen, "id", "left_anti"))
        if new.isEmpty():
            raise NotFound(f"no call path from {source!r} to {target!r}")
        levels.append(new)
        seen = seen.unionByName(new.select("id"))
    path = [target]
    for level in reversed(levels[1:]):
        path.append(level.filter(F.col("id") == path[-1]).select("via").first()[0])
    path.reverse()
    last = len(path) - 1
    rows = [(i, x, "" if i == last else "CALLS") for i, x in enumerate(path)]
    steps = F.broadcast(spark.createDataFrame(rows, "step int, id string, next_edge string"))
    return graph.nodes.join(steps, "id").select("step", *graph.nodes.columns, "next_edge").orderBy("step")


def check_range(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise GraphError(f"{name} must be between {low} and {high}")
