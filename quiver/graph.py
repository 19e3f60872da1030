"""A property graph: a table of nodes and a table of edges, and how such tables are merged and maintained."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.functions.predicates import is_structure_endpoint, is_structure_owned
from quiver.functions.text import dirname
from quiver.schema import EDGES, NODES, GraphError, NotFound


class PropertyGraph:
    """Nodes and edges as DataFrames. Edges may lack endpoints; ``live_edges`` are those that don't.

    Node ids are unique and edges are unique by (src, dst, type): build with :meth:`build` where that isn't given.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, resolved: bool = False):
        self.nodes, self.edges, self.resolved = nodes, edges, resolved

    # -- making

    @classmethod
    def of(cls, spark: SparkSession, nodes: Iterable[dict], edges: Iterable[dict]) -> PropertyGraph:
        """From dictionaries; missing strings are empty, missing lines 0, missing occurrences none. Rows merge in order."""
        blank = {f.name: "" if f.dataType.simpleString() == "string" else 0 for f in NODES}
        rows = [(*(({**blank, **n})[f.name] for f in NODES), i) for i, n in enumerate(nodes)]
        links = [
            (e["src"], e["dst"], e["type"], e.get("repo_id", ""), [tuple(o) for o in e.get("occurrences", [])], i)
            for i, e in enumerate(edges)
        ]
        order = "load_order long"
        node_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODES)
        edge_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EDGES)
        return cls.build(
            spark.createDataFrame(rows, f"{node_schema}, {order}"), spark.createDataFrame(links, f"{edge_schema}, {order}")
        )

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """Merge rows that repeat a node or edge; ``load_order``, if there is such a column, says which came first."""
        return cls(merge_nodes(nodes), merge_edges(edges))

    @classmethod
    def merged(cls, graphs: list[PropertyGraph]) -> PropertyGraph:
        """Several stores as one graph: all nodes, then all edges; earlier stores write first."""
        if not graphs:
            raise GraphError("at least one graph is needed")
        union = lambda tables: reduce(
            DataFrame.unionByName, [t.withColumn("load_order", F.lit(i)) for i, t in enumerate(tables)]
        )
        return cls.build(union([g.nodes for g in graphs]), union([g.edges for g in graphs]))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PropertyGraph:
        return cls(
            with_defaults(spark.read.schema(NODES).parquet(f"{path}/nodes"), NODES),
            with_defaults(spark.read.schema(EDGES).parquet(f"{path}/edges"), EDGES),
        )

    def write(self, path: str, mode: str = "overwrite") -> None:
        """One Parquet table each, partitioned by the repository that owns the row."""
        for name, table in (("nodes", self.nodes), ("edges", self.edges)):
            table.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{path}/{name}")

    # -- views

    @property
    def live_edges(self) -> DataFrame:
        """Edges both of whose endpoints exist."""
        if self.resolved:
            return self.edges
        ids = self.nodes.select("id")
        found = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        return found.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*self.edges.columns)

    def resolve(self) -> PropertyGraph:
        """The graph with live edges alone."""
        return PropertyGraph(self.nodes, self.live_edges, True)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> PropertyGraph:
        """The resolved graph, kept for several queries."""
        return PropertyGraph(self.nodes.persist(level), self.live_edges.persist(level), True)

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def node(self, node_id: str) -> dict:
        """One node as a dictionary."""
        rows = self.nodes.filter(F.col("id") == node_id).limit(1).collect()
        if not rows:
            raise NotFound(f"node {node_id!r} isn't in the graph")
        return rows[0].asDict()

    def require(self, *ids: str) -> None:
        if not ids:
            return
        if len(ids) <= 100:
            found = {r.id for r in self.nodes.filter(F.col("id").isin(*ids)).select("id").collect()}
            lost = [x for x in ids if x not in found]
        else:
            asked = self.nodes.sparkSession.createDataFrame([(x,) for x in ids], "id string")
            lost = [r.id for r in asked.join(self.nodes.select("id"), "id", "left_anti").limit(1).collect()]
        if lost:
            raise NotFound(f"node {lost[0]!r} isn't in the graph")

    # -- maintenance

    def add_nodes(self, nodes: DataFrame) -> PropertyGraph:
        """Upsert: what is there stays, but a BOUNDARY gives way to the first node that is none."""
        return PropertyGraph(merge_nodes(_after(self.nodes, nodes)), self.edges)

    def add_edges(self, edges: DataFrame, strict: bool = True) -> PropertyGraph:
        """Add edges or merge their occurrences. strict: an unknown endpoint is an error; else the edge waits for it."""
        if strict:
            ids = self.nodes.select("id")
            for end in ("src", "dst"):
                lost = edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(end).limit(1).collect()
                if lost:
                    raise NotFound(f"edge endpoint {lost[0][0]!r} isn't in the graph")
        return PropertyGraph(self.nodes, merge_edges(_after(self.edges, edges)))

    def add(self, other: PropertyGraph) -> PropertyGraph:
        """Bulk build: nodes first, then edges, which may wait for endpoints."""
        return self.add_nodes(other.nodes).add_edges(other.edges, strict=False)

    def remove_package(self, pkg_path: str) -> PropertyGraph:
        """Without a package's nodes and the edges that leave them. Edges that enter stay, to be live again with their ends."""
        gone = self.nodes.filter(F.col("pkg_path") == pkg_path).select(F.col("id").alias("src"))
        return PropertyGraph(
            self.nodes.filter(F.col("pkg_path") != pkg_path), self.edges.join(gone, "src", "left_anti").select(*self.edges.columns)
        )

    def remove_packages(self, packages: DataFrame) -> PropertyGraph:
        """The same for all packages of a table (pkg_path), in one pass."""
        gone = self.nodes.join(packages.select("pkg_path").distinct(), "pkg_path", "left_semi").select(F.col("id").alias("src"))
        return PropertyGraph(
            self.nodes.join(packages.select("pkg_path").distinct(), "pkg_path", "left_anti").select(*self.nodes.columns),
            self.edges.join(gone, "src", "left_anti").select(*self.edges.columns),
        )

    def packages_below(self, folders: list[str]) -> DataFrame:
        """The packages (pkg_path) that have files in one of the folders or anywhere below it."""
        folder = dirname(F.col("file_path"))
        paths = F.array(*[F.lit(x.rstrip("/")) for x in folders])
        below = F.exists(paths, lambda x: (folder == x) | folder.startswith(F.concat(x, F.lit("/"))))
        rows = self.nodes.filter((F.col("file_path") != "") & (F.col("pkg_path") != ""))
        return rows.filter(below).select("pkg_path").distinct()

    def replace_package(self, pkg_path: str, fresh: PropertyGraph) -> PropertyGraph:
        return self.remove_package(pkg_path).add(fresh)

    def replace_structure(self, fresh: PropertyGraph, repo_id: str | None = None) -> PropertyGraph:
        """Forget folders, files of no package and the containment among them, then add a new walk's.

        Containment goes if it leaves a workspace, repository or folder, or enters a folder. ``repo_id`` limits both.
        """
        scope = lambda t: F.lit(True) if not repo_id else t["repo_id"] == repo_id
        owned = is_structure_owned(F.col("type"), F.col("pkg_path")) & scope(self.nodes)
        gone = self.nodes.filter(owned).select("id")
        ends = self.nodes.select("id", F.col("type").alias("end_type"))
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
            edges = edges.join(ends.select(F.col("id").alias(end), F.col("end_type").alias(f"{end}_type")), end, "left")
        from_structure = F.coalesce(is_structure_endpoint(F.col("src_type")), F.lit(False))
        into_folder = F.coalesce(F.col("dst_type") == "FOLDER", F.lit(False))
        old = (F.col("type") == "CONTAINS") & (from_structure | into_folder)
        if repo_id:
            old &= F.col("repo_id") == repo_id
        kept = edges.filter(~old).select(*self.edges.columns)
        return PropertyGraph(self.nodes.filter(~owned), kept).add(fresh)


def with_defaults(table: DataFrame, schema) -> DataFrame:  # noqa: ANN001
    """The schema's columns, with empty strings, zeros and empty arrays for nulls and missing columns."""
    out = []
    for f in schema:
        kind = f.dataType.simpleString()
        value = table[f.name].cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType)
        blank = F.lit("") if kind == "string" else F.lit(0) if kind == "int" else F.array().cast(f.dataType)
        out.append(F.coalesce(value, blank).alias(f.name))
    return table.select(*out)


def _order(table: DataFrame) -> Column:
    return F.col("load_order") if "load_order" in table.columns else F.lit(0)


def _after(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; those of the second come later."""
    names = [c for c in old.columns if c != "load_order"]
    later = F.struct(F.lit(1).alias("new"), _order(new).cast("long").alias("nth"))
    first = F.struct(F.lit(0).alias("new"), F.lit(0).cast("long").alias("nth"))
    return old.select(*names, first.alias("load_order")).unionByName(new.select(*names, later.alias("load_order")))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the first written, but a BOUNDARY only where nothing else is."""
    order = Window.partitionBy("id").orderBy(F.col("type") == "BOUNDARY", _order(nodes), *_ties(nodes, NODES))
    ranked = nodes.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == 1)
    return with_defaults(ranked.select(*[f.name for f in NODES]), NODES)


def _ties(table: DataFrame, schema) -> list[Column]:  # noqa: ANN001
    return [F.col(f.name) for f in schema if f.name not in ("id", "occurrences") and f.name in table.columns]


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, type): the first writer's repository, and occurrences in order.

    The first edge's occurrences stay as they are; later edges add those that aren't there yet.
    """
    each = F.struct(_order(edges).alias("nth"), F.col("repo_id").alias("repo_id"), F.col("occurrences").alias("occurrences"))
    grouped = edges.groupBy("src", "dst", "type").agg(F.array_sort(F.collect_list(each)).alias("all"))
    first = F.col("all")[0]
    rest = F.flatten(F.transform(F.slice("all", 2, F.size("all")), lambda e: e["occurrences"]))
    added = F.array_except(rest, first["occurrences"])  # distinct, in order
    return with_defaults(
        grouped.select("src", "dst", "type", first["repo_id"].alias("repo_id"), F.concat(first["occurrences"], added).alias("occurrences")),
        EDGES,
    )
