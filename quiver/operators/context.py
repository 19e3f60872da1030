"""All that stands around one node, in capped sections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.predicates import is_dependency, is_route_relation
from quiver.graph import PropertyGraph
from quiver.operators.concurrency import concurrency_graph
from quiver.operators.traversal import blast_radius_depth, check_range
from quiver.schema import GraphError
from quiver.sources.source_text import SourceUnavailable, bounded_source

RELATIONS = ("parents", "children", "routes", "interfaces")


@dataclass(frozen=True)
class ContextOptions:
    """Caps; 0 stands for the default. ``max_callers`` is the old name of ``max_dependents`` and must agree with it."""

    include_source: bool = True
    max_dependents: int = 0
    max_callers: int = 0
    max_dependencies: int = 0
    max_relations: int = 0
    max_depth: int = 0
    max_source_lines: int = 0
    max_source_bytes: int = 0

    def settled(self) -> ContextOptions:
        if self.max_dependents and self.max_callers and self.max_dependents != self.max_callers:
            raise GraphError("max_dependents and max_callers differ")
        dependents = self.max_dependents or self.max_callers or 20
        out = ContextOptions(
            self.include_source, dependents, dependents, self.max_dependencies or 20, self.max_relations or 20,
            self.max_depth or 1, self.max_source_lines or 200, self.max_source_bytes or 64 * 1024,
        )
        for name, high in (
            ("max_dependents", 100), ("max_dependencies", 100), ("max_relations", 100), ("max_depth", 3),
            ("max_source_lines", 1000), ("max_source_bytes", 512 * 1024),
        ):
            check_range(name, getattr(out, name), 1, high)
        return out


@dataclass
class NodeContext:
    node: dict
    sections: DataFrame
    truncated: dict[str, bool]
    source: str = ""
    warnings: list[str] = field(default_factory=list)


def context_relations(graph: PropertyGraph, node_id: str) -> DataFrame:
    """Uncapped relations: section, direction, edge_type and id, type, name of the other node."""
    edges = graph.live_edges.select("src", "dst", F.col("type").alias("edge_type"))
    others = graph.nodes.select("id", "type", "name")
    target = F.lit(graph.node(node_id)["type"])
    kind, edge = F.col("type"), F.col("edge_type")
    out = edges.filter(F.col("src") == node_id).withColumn("id", F.col("dst")).join(others, "id")
    outward = (
        F.when(is_dependency(edge), "dependencies").when(edge == "CONTAINS", "children")
        .when(is_route_relation(edge, target, kind), "routes").when(edge == "IMPLEMENTS", "interfaces")
    )
    into = edges.filter(F.col("dst") == node_id).withColumn("id", F.col("src")).join(others, "id")
    inward = (
        F.when(edge == "CONTAINS", "parents").when(is_route_relation(edge, target, kind), "routes")
        .when(edge == "IMPLEMENTS", "interfaces")
    )
    names = ("direction", "edge_type", "id", "type", "name")
    rows = out.select(outward.alias("section"), F.lit("outbound").alias("direction"), *names[1:]).unionByName(
        into.select(inward.alias("section"), F.lit("inbound").alias("direction"), *names[1:])
    )
    return rows.filter(F.col("section").isNotNull())


def context_sections(graph: PropertyGraph, node_id: str, options: ContextOptions = ContextOptions()) -> tuple[DataFrame, bool]:
    """Rows of all sections but the source, one more than the cap where there are more; and whether dependents were cut.

    section, position, direction, edge_type, id, type, name, distance. Within a section rows are ordered by id, edge
    type and direction; dependents by distance and id; concurrency by direction, id and edge type.
    """
    o = options.settled()
    none = F.lit(None).cast("int").alias("distance")
    relations = context_relations(graph, node_id).withColumn("distance", none)
    around = concurrency_graph(graph, node_id).select(
        F.lit("concurrency").alias("section"), "direction", "edge_type", "id", "type", "name", none
    )
    dependents, cut_off = blast_radius_depth(graph, [node_id], o.max_depth, o.max_dependents)
    dependents = dependents.select(
        F.lit("dependents").alias("section"), F.lit("inbound").alias("direction"), F.lit("").alias("edge_type"),
        "id", "type", "name", "distance",
    )
    rows = relations.unionByName(around).unionByName(dependents)
    by_direction = F.when(F.col("section") == "concurrency", F.col("direction")).otherwise("")
    order = Window.partitionBy("section").orderBy(
        F.coalesce("distance", F.lit(0)), by_direction, "id", "edge_type", "direction"
    )
    cap = F.when(F.col("section") == "dependencies", o.max_dependencies).when(
        F.col("section") == "dependents", o.max_dependents
    ).otherwise(o.max_relations)
    # the literal cap lets every task sort out a hub's edges before the shuffle
    most = max(o.max_dependencies, o.max_dependents, o.max_relations)
    ranked = rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most + 1)
    ranked = ranked.filter(F.col("position") <= cap + 1)
    return ranked.select("section", "position", "direction", "edge_type", "id", "type", "name", "distance"), cut_off


def node_context(graph: PropertyGraph, node_id: str, options: ContextOptions = ContextOptions()) -> NodeContext:
    """A node with its capped sections, source excerpt and warnings, one for each section that was cut."""
    o = options.settled()
    node = graph.node(node_id)
    rows, cut_off = context_sections(graph, node_id, options)
    caps = {"dependencies": o.max_dependencies, "dependents": o.max_dependents}
    kept, truncated, warnings = [], {"dependents": cut_off}, []
    for r in rows.collect():  # at most the caps
        cap = caps.get(r.section, o.max_relations)
        if r.position > cap:
            truncated[r.section] = True
        else:
            kept.append(tuple(r))
    for section, is_cut in truncated.items():
        if is_cut:
            name = {"dependents": "max_dependents", "dependencies": "max_dependencies"}.get(section, "max_relations")
            label = "concurrency context" if section == "concurrency" else section
            warnings.append(f"{label} truncated at {name}={caps.get(section, o.max_relations)}")
    source = ""
    if o.include_source:
        try:
            source, is_cut = bounded_source(node, o.max_source_lines, o.max_source_bytes)
            if is_cut:
                truncated["source"] = True
                warnings.append(
                    f"source truncated at max_source_lines={o.max_source_lines} or max_source_bytes={o.max_source_bytes}"
                )
        except SourceUnavailable as e:
            warnings.append(f"source unavailable: {e}")
    return NodeContext(node, graph.nodes.sparkSession.createDataFrame(kept, rows.schema), truncated, source, sorted(warnings))
