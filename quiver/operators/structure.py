"""The tree of workspaces, repositories, folders, packages and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions.predicates import inside, is_root_folder, structure_included, structure_rank
from quiver.functions.text import dirname
from quiver.graph import PropertyGraph
from quiver.schema import GraphError


@dataclass(frozen=True)
class StructureOptions:
    root: str = "."
    repo_id: str = ""
    max_depth: int = 0  # 0: default
    max_nodes: int = 0
    packages: bool = True
    files: bool = False

    def limits(self) -> tuple[int, int]:
        out = []
        for name, value, default, high in (
            ("max_depth", self.max_depth, 4, 32),
            ("max_nodes", self.max_nodes, 2000, 5000),
        ):
            if value < 0:
                raise GraphError(f"{name} must be at least 1")
            if value > high:
                raise GraphError(f"{name} must be at most {high}")
            out.append(value or default)
        return out[0], out[1]


def root_id(graph: PropertyGraph, options: StructureOptions) -> str:
    """The node that a root names: an id as it is, else a folder, alone in the graph or of a named repository."""
    root = options.root.strip() or "."
    if root.startswith(("folder:", "repo:", "workspace:")):
        return root
    folder = "folder:" + ("." if root == "." else root.strip("/").removeprefix("./"))
    if options.repo_id:
        return f"repo:{options.repo_id}:{folder}"
    ids = graph.nodes.filter((F.col("id") == folder) | ((F.col("type") == "FOLDER") & F.col("id").endswith(":" + folder)))
    rows = sorted(r.id for r in ids.select("id").orderBy(F.col("id") != folder, "id").limit(2).collect())
    if folder in rows or not rows:
        return folder
    if len(rows) == 1:
        return rows[0]
    if root == ".":
        workspace = graph.nodes.filter(F.col("type") == "WORKSPACE").orderBy("id").select("id").first()
        if workspace:
            return workspace.id
    raise GraphError(f"several repositories have a root {root!r}; name one by repo_id")


def structure_tree(graph: PropertyGraph, options: StructureOptions = StructureOptions()) -> DataFrame:
    """The tree in depth-first order: position, depth, parent_id, id, type, name, path (ids from the root, as an array).

    A node that already stands on its own path is a leaf. More nodes than ``max_nodes`` are an error; depth just ends.
    """
    spark = graph.nodes.sparkSession
    max_depth, max_nodes = options.limits()
    top = graph.node(root_id(graph, options))
    contains = graph.live_edges.filter(F.col("type") == "CONTAINS").select("src", "dst")
    kept = graph.nodes.filter(structure_included(F.col("type"), options.packages, options.files))
    kept = kept.select(F.col("id").alias("dst"), "type", "name", structure_rank(F.col("type")).alias("rank"))
    children: dict[str, list[tuple]] = {}
    total, level = 1, [(top["id"],)]
    for _ in range(max_depth):
        # a level holds at most max_nodes paths, and so do the children asked for
        asked = [x for x in dict.fromkeys(p[-1] for p in level if p[-1] not in p[:-1]) if x not in children]
        if asked:
            frontier = F.broadcast(spark.createDataFrame([(x,) for x in asked], "src string"))
            rows = contains.join(frontier, "src").join(kept, "dst").limit(max_nodes + 1).collect()
            for x in asked:
                children[x] = []
            for r in rows:
                children[r.src].append((r["rank"], r["name"], r["dst"], r["type"]))
        level = [(*p, c[2]) for p in level if p[-1] not in p[:-1] for c in sorted(children[p[-1]])]
        total += len(level)
        if total > max_nodes:
            raise GraphError(f"the structure exceeds max_nodes={max_nodes}; narrow the root, reduce max_depth or leave out files")
        if not level:
            break
    out: list[tuple] = []

    def walk(path: tuple[str, ...], kind: str, name: str) -> None:
        out.append((len(out), len(path) - 1, path[-2] if len(path) > 1 else None, path[-1], kind, name, list(path)))
        if len(path) <= max_depth and path[-1] not in path[:-1]:
            for _, child_name, child, child_kind in sorted(children.get(path[-1], [])):
                walk((*path, child), child_kind, child_name)

    walk((top["id"],), top["type"], top["name"])
    return spark.createDataFrame(
        out, "position int, depth int, parent_id string, id string, type string, name string, path array<string>"
    )


def repo_roots(graph: PropertyGraph) -> DataFrame:
    """repo_id, root: the smallest path of each repository's root folders that have one."""
    roots = graph.nodes.filter((F.col("type") == "FOLDER") & is_root_folder(F.col("id")) & (F.col("file_path") != ""))
    return roots.groupBy("repo_id").agg(F.min("file_path").alias("root")).orderBy("repo_id")


def packages_in(graph: PropertyGraph, folder: str, recursive: bool = False) -> DataFrame:
    """Packages of nodes directly in a folder, or anywhere below it."""
    place = dirname(F.col("file_path"))
    hit = inside(place, folder) if recursive else place == folder
    rows = graph.nodes.filter((F.col("file_path") != "") & (F.col("pkg_path") != "") & hit)
    return rows.select("pkg_path").distinct().orderBy("pkg_path")


def package_folders(nodes: DataFrame, root: str) -> DataFrame:
    """folder (relative to the root), packages: where the packages of files below a root lie."""
    below = nodes.filter((F.col("pkg_path") != "") & (F.col("file_path") != "") & inside(F.col("file_path"), root))
    relative = F.regexp_replace(dirname(F.col("file_path")), "^" + _quoted(root.rstrip("/")) + "/?", "")
    folder = F.when(relative == "", ".").otherwise(relative)
    return below.groupBy(folder.alias("folder")).agg(F.array_sort(F.collect_set("pkg_path")).alias("packages"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c in "/_") else c for c in text)
