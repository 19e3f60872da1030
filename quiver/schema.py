"""Vocabularies and table schemas of property graphs."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed vocabularies of nodes, edges and queryable properties.
NODE_TYPES = (
    "PACKAGE", "FILE", "FOLDER", "STRUCT", "INTERFACE", "FUNC", "METHOD", "CONSTANT", "VARIABLE", "TYPE_ALIAS",
    "CHANNEL", "GOROUTINE", "ROUTE", "BOUNDARY", "REPO", "WORKSPACE",
)
EDGE_TYPES = (
    "CALLS", "IMPLEMENTS", "IMPORTS", "REFERENCES", "INSTANTIATES", "SPAWNS", "SENDS_TO", "RECEIVES_FROM", "CONTAINS",
    "REGISTERS_ROUTE",
)
DEPENDENCY_EDGES = ("CALLS", "IMPORTS", "REFERENCES", "INSTANTIATES")
CONCURRENCY_EDGES = ("SPAWNS", "SENDS_TO", "RECEIVES_FROM")
CONCURRENCY_NODES = ("GOROUTINE", "CHANNEL")
NODE_PROPERTIES = {
    "name": "name", "id": "id", "pkgpath": "pkg_path", "filepath": "file_path", "type": "type", "repoid": "repo_id",
}
EDGE_PROPERTIES = {"type": "type", "from": "src", "to": "dst", "repoid": "repo_id"}

OCCURRENCE = T.StructType(
    [
        T.StructField("filepath", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
    ]
)
NODES = T.StructType(
    [T.StructField(x, T.StringType(), False) for x in ("id", "type", "name", "pkg_path", "file_path")]
    + [T.StructField(x, T.IntegerType(), False) for x in ("line_start", "line_end")]
    + [T.StructField("repo_id", T.StringType(), False)]
)
EDGES = T.StructType(
    [T.StructField(x, T.StringType(), False) for x in ("src", "dst", "type", "repo_id")]
    + [T.StructField("occurrences", T.ArrayType(OCCURRENCE), False)]
)
METADATA = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("engine_version", T.StringType()),
        T.StructField("analyzed_at", T.TimestampType()),
        T.StructField("repo_id", T.StringType()),
        T.StructField("repo_root", T.StringType()),
        T.StructField("module_prefix", T.StringType()),
        T.StructField("workspace_name", T.StringType()),
        T.StructField("include_tests", T.BooleanType()),
        T.StructField("git_available", T.BooleanType()),
        T.StructField("git_error", T.StringType()),
        T.StructField("git_root", T.StringType()),
        T.StructField("git_head", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("git_dirty_at_analyze", T.BooleanType()),
        T.StructField("git_status_fingerprint", T.StringType()),
    ]
)
METADATA_VERSION = 1
FILE_RANGES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("whole_file", T.BooleanType()),
        T.StructField("repo_id", T.StringType()),
    ]
)
CHANGED_FILES = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("repo_id", "path", "absolute_path", "status")]
    + [
        T.StructField(
            "ranges",
            T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "end")])),
        ),
        T.StructField("whole_file", T.BooleanType()),
        T.StructField("untracked", T.BooleanType()),
    ]
)


class GraphError(ValueError):
    """A request that the graph can't answer."""


class NotFound(GraphError):
    """A node or path that doesn't exist."""
