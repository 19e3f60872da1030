"""The operators behind one object, with the limits that remote callers get."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quiver.analysis.impact import ImpactOptions, Repo, Report, analyze
from quiver.graph import PropertyGraph
from quiver.operators import concurrency, context, neighbours, stats, structure, traversal
from quiver.plans.compiler import cypher
from quiver.sources.git import Runner, run_program
from quiver.sources.source_text import source_code


class GraphTools:
    """One method for each tool of the service."""

    def __init__(self, graph: PropertyGraph, repos: list[Repo] | None = None, run: Runner = run_program):
        self.graph, self.repos, self.run = graph, repos or [], run

    def get_dependencies(self, node_id: str) -> DataFrame:
        return neighbours.dependencies(self.graph, node_id)

    def get_blast_radius(self, node_id: str) -> DataFrame:
        return neighbours.blast_radius(self.graph, node_id)

    def get_concurrency_flow(self, node_id: str) -> DataFrame:
        return concurrency.concurrency_flow(self.graph, node_id)

    def get_concurrency_graph(self, node_id: str) -> DataFrame:
        return concurrency.concurrency_graph(self.graph, node_id)

    def get_implementations(self, interface_id: str) -> DataFrame:
        return neighbours.implementations(self.graph, interface_id)

    def get_source_code(self, node_id: str) -> str:
        return source_code(self.graph.node(node_id))

    def get_node_context(self, node_id: str, **options: int | bool) -> context.NodeContext:
        return context.node_context(self.graph, node_id, context.ContextOptions(**options))

    def get_repository_structure(self, **options: int | bool | str) -> DataFrame:
        return structure.structure_tree(self.graph, structure.StructureOptions(**options))

    def find_path(self, source: str, target: str) -> DataFrame:
        return traversal.find_path(self.graph, source, target)

    def search_nodes(self, needle: str) -> DataFrame:
        return neighbours.search(self.graph, needle)

    def execute_cypher(self, text: str) -> DataFrame:
        return cypher(self.graph, text, require_limit=True)

    def get_change_impact(self, **options: int | bool | str) -> Report:
        return analyze(self.graph, self.repos, ImpactOptions(**options), self.run)

    def stats(self) -> DataFrame:
        return stats.statistics(self.graph)
