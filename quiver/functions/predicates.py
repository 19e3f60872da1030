"""Predicates over node and edge columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.schema import CONCURRENCY_EDGES, CONCURRENCY_NODES, DEPENDENCY_EDGES


def is_type(column: Column, wanted: str | None) -> Column:
    """Type label equality ignoring case; an empty label matches any."""
    return F.lit(True) if not wanted else column == wanted.upper()


def is_dependency(edge_type: Column) -> Column:
    return edge_type.isin(*DEPENDENCY_EDGES)


def is_call(edge_type: Column) -> Column:
    return edge_type == "CALLS"


def is_concurrency_edge(edge_type: Column) -> Column:
    return edge_type.isin(*CONCURRENCY_EDGES)


def is_concurrency_node(node_type: Column) -> Column:
    return node_type.isin(*CONCURRENCY_NODES)


def is_route_relation(edge_type: Column, one: Column, other: Column) -> Column:
    """An edge that places a node in a route's context: registration, or a reference that touches a ROUTE."""
    return (edge_type == "REGISTERS_ROUTE") | ((edge_type == "REFERENCES") & ((one == "ROUTE") | (other == "ROUTE")))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether lines start..end of a node meet lines low..high, in either order. All bounds must be positive."""
    first, last = F.least(low, high), F.greatest(low, high)
    return (start > 0) & (end >= start) & (first > 0) & (start <= last) & (end >= first)


def same_repo(one: Column, other: Column) -> Column:
    """A blank repository matches any."""
    return (one == "") | (other == "") | (one == other)


def contains_folded(column: Column, needle: str) -> Column:
    """Substring test without regard to case: A-Z alone for an ASCII needle, by Unicode's rules for others."""
    if needle.isascii():
        folded = F.translate(column, string.ascii_uppercase, string.ascii_lowercase)
        return folded.contains(needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return F.lower(column).contains(needle.lower())


def is_root_folder(node_id: Column) -> Column:
    return (node_id == "folder:.") | node_id.endswith(":folder:.")


def is_structure_owned(node_type: Column, pkg_path: Column) -> Column:
    """Nodes that a walk of the file system makes: folders, and files of no package."""
    return (node_type == "FOLDER") | ((node_type == "FILE") & (pkg_path == ""))


def is_structure_endpoint(node_type: Column) -> Column:
    return node_type.isin("WORKSPACE", "REPO", "FOLDER")


def inside(path: Column, root: str) -> Column:
    """Whether a clean path is ``root`` or below it."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def is_internal_package(pkg_path: Column, module_prefix: str) -> Column:
    return F.lit(False) if not module_prefix else inside(pkg_path, module_prefix)


def structure_included(node_type: Column, packages: bool, files: bool) -> Column:
    kinds = ["WORKSPACE", "REPO", "FOLDER"] + ["PACKAGE"] * packages + ["FILE"] * files
    return node_type.isin(*kinds)


def structure_rank(node_type: Column) -> Column:
    """Order of siblings in a tree."""
    ranks = {"WORKSPACE": -2, "REPO": -1, "FOLDER": 0, "PACKAGE": 1, "FILE": 2}
    out = F.when(node_type == "WORKSPACE", ranks["WORKSPACE"])
    for kind in ("REPO", "FOLDER", "PACKAGE", "FILE"):
        out = out.when(node_type == kind, ranks[kind])
    return out.otherwise(3)
