"""A repository's folders and files as nodes and containment edges."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions.predicates import inside
from quiver.functions.text import basename, dirname
from quiver.graph import PropertyGraph
from quiver.schema import EDGES, NODES, GraphError

# Folders that a walk doesn't enter, and dot files that it keeps all the same.
SKIPPED_FOLDERS = ("vendor", "testdata", "node_modules")
KEPT_DOT_FILES = (".gitignore", ".dockerignore", ".env.example", ".golangci.yml")


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """path (absolute, clean), length of every file below a folder of any store, dot files included; nothing is read.

    The driver lists the folders, as a reader of files does when it plans a scan.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    rows = []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toUri().getPath(), f.getLen()))
    return spark.createDataFrame(rows, "path string, length long")


def walked(files: DataFrame, root: str) -> DataFrame:
    """relative, name of the files that a walk of ``root`` reaches."""
    root = root.rstrip("/") or "/"
    below = files.filter(inside(F.col("path"), root) & (F.col("path") != root))
    relative = F.expr(f"substring(path, {len(root) + (root != '/') + 1})")
    rows = below.select("path", relative.alias("relative"))
    folders = F.slice(F.split("relative", "/"), 1, F.size(F.split("relative", "/")) - 1)
    hidden = F.exists(folders, lambda f: f.startswith(".") | f.isin(*SKIPPED_FOLDERS))
    name = basename(F.col("relative"))
    return rows.filter(~hidden & (~name.startswith(".") | name.isin(*KEPT_DOT_FILES))).withColumn("name", name)


def prefix(repo_id: str) -> str:
    """What folder ids of a workspace's repository begin with; nothing outside workspaces."""
    return f"repo:{repo_id}:" if repo_id else ""


def structure(files: DataFrame, root: str, packages: DataFrame | None = None, repo_id: str = "", in_workspace: bool = False) -> PropertyGraph:
    """FOLDER nodes for every folder on the way to a walked file, FILE nodes for files that are no Go source, CONTAINS edges.

    ``packages`` (folder relative to the root, pkg_path) hangs packages below their folders.
    """
    start, root = prefix(repo_id if in_workspace else ""), root.rstrip("/") or "/"
    kept = walked(files, root)
    parts = F.split("relative", "/")
    ways = kept.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i - 1), "/"))).alias("folder"))
    folders = ways.distinct()
    if packages is not None:
        up = F.split(F.when(F.col("folder") == ".", "").otherwise(F.col("folder")), "/")
        extra = packages.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(up)), lambda i: F.array_join(F.slice(up, 1, i), "/"))).alias("folder"))
        folders = folders.unionByName(extra).distinct()
    folders = folders.unionByName(files.sparkSession.createDataFrame([("",)], "folder string")).distinct()
    text, zero, owner = F.lit(""), F.lit(0), F.lit(repo_id)

    def folder_id(folder: Column) -> Column:
        return F.concat(F.lit(start + "folder:"), F.when(folder == "", ".").otherwise(folder))

    def absolute(relative: Column) -> Column:
        return F.when(relative == "", root).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), relative))

    def node(table: DataFrame, kind: str, node_id: Column, name: Column, path: Column) -> DataFrame:
        values = (node_id, F.lit(kind), name, text, path, zero, zero, owner)
        return table.select(*[v.alias(f.name) for v, f in zip(values, NODES, strict=True)])

    def edge(table: DataFrame, src: Column, dst: Column) -> DataFrame:
        none = F.array().cast(EDGES["occurrences"].dataType)
        values = (src, dst, F.lit("CONTAINS"), owner, none)
        return table.select(*[v.alias(f.name) for v, f in zip(values, EDGES, strict=True)])

    f, r = F.col("folder"), F.col("relative")
    plain = kept.filter(~F.col("name").endswith(".go"))
    parent = F.when(f.contains("/"), F.regexp_replace(f, "/[^/]*$", "")).otherwise("")
    folder_name = F.when(f == "", os.path.basename(root) or "/").otherwise(basename(f))
    nodes = node(folders, "FOLDER", folder_id(f), folder_name, absolute(f)).unionByName(
        node(plain, "FILE", F.col("path"), F.col("name"), F.col("path"))
    )
    place = F.when(dirname(r) == ".", "").otherwise(dirname(r))
    parts_of = [edge(folders.filter(f != ""), folder_id(parent), folder_id(f)), edge(plain, folder_id(place), F.col("path"))]
    if packages is not None:
        of = F.when(F.col("folder") == ".", "").otherwise(F.col("folder"))
        parts_of.append(edge(packages, folder_id(of), F.col("pkg_path")))
    return PropertyGraph(nodes, reduce(DataFrame.unionByName, parts_of))


def hierarchy(spark: SparkSession, workspace: str, repos: list[str]) -> PropertyGraph:
    """The workspace above its repositories above their root folders."""
    if not workspace:
        raise GraphError("a workspace needs a name")
    top = f"workspace:{workspace}"
    nodes = [{"id": top, "type": "WORKSPACE", "name": workspace}]
    edges = []
    for r in sorted(repos):
        nodes.append({"id": f"repo:{r}", "type": "REPO", "name": r, "repo_id": r})
        edges.append({"src": top, "dst": f"repo:{r}", "type": "CONTAINS", "repo_id": r})
        edges.append({"src": f"repo:{r}", "dst": f"repo:{r}:folder:.", "type": "CONTAINS", "repo_id": r})
    return PropertyGraph.of(spark, nodes, edges)


def module_root(folder: str) -> str:
    """The nearest folder upwards with a go.mod, else the only one below; several are an error."""
    at = os.path.abspath(folder)
    while True:
        if os.path.isfile(os.path.join(at, "go.mod")):
            return at
        if os.path.dirname(at) == at:
            break
        at = os.path.dirname(at)
    found = []
    for place, folders, names in os.walk(os.path.abspath(folder)):
        folders[:] = [f for f in folders if not f.startswith(".") and f not in SKIPPED_FOLDERS]
        if "go.mod" in names:
            found.append(place)
            folders.clear()
    if len(found) == 1:
        return found[0]
    raise GraphError(f"{folder} has {'no module' if not found else 'several modules: ' + ', '.join(sorted(found))}")
