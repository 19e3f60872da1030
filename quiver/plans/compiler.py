"""From a checked query to a DataFrame: scans, equi-joins, filters and a projection, left to Catalyst to arrange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.predicates import is_type
from quiver.graph import PropertyGraph
from quiver.plans.analyzer import CypherSemanticError, check
from quiver.plans.parser import Direction, EdgePattern, Item, Query, parse
from quiver.schema import EDGE_PROPERTIES, EDGES, NODE_PROPERTIES, NODES

# Names of the pattern's parts inside a plan; user aliases only appear in the result.
LEFT, EDGE, RIGHT = "l_", "e_", "r_"


def _renamed(table: DataFrame, prefix: str) -> DataFrame:
    return table.select(*[F.col(c).alias(prefix + c) for c in table.columns])


def _hops(graph: PropertyGraph, query: Query, nodes: dict[str, DataFrame]) -> DataFrame:
    pattern: EdgePattern = query.edge
    edges = _renamed(graph.live_edges.filter(is_type(F.col("type"), pattern.type)), EDGE)

    def one_way(rows: DataFrame, left_end: str, right_end: str) -> DataFrame:
        left, right = nodes[LEFT], nodes[RIGHT]
        return rows.join(left, F.col(EDGE + left_end) == F.col(LEFT + "id")).join(
            right, F.col(EDGE + right_end) == F.col(RIGHT + "id")
        )

    if pattern.direction is Direction.OUT:
        return one_way(edges, "src", "dst")
    if pattern.direction is Direction.IN:
        return one_way(edges, "dst", "src")
    # either way: a self-edge is one row, any other edge one for each orientation
    back = one_way(edges.filter(F.col(EDGE + "src") != F.col(EDGE + "dst")), "dst", "src")
    return one_way(edges, "src", "dst").unionByName(back)


def _column(kinds: dict[str, str], prefixes: dict[str, str], alias: str, name: str) -> Column:
    valid = NODE_PROPERTIES if kinds[alias] == "node" else EDGE_PROPERTIES
    return F.col(prefixes[alias] + valid[name.lower()])


def compile_query(graph: PropertyGraph, query: Query, ordered: bool = True, names: dict[str, str] | None = None) -> DataFrame:
    """The query's rows. One column for each distinct RETURN item, named as written (``a.Name``, or ``a`` for a struct).

    ``names`` gives items other column names. ``ordered`` makes LIMIT keep the smallest rows by left id, edge ends and
    type, and right id, so that it is deterministic; without it any rows may be kept, and the scan stops early.
    """
    kinds = check(query)
    prefixes = {query.left.alias: LEFT}
    nodes = {LEFT: _renamed(graph.nodes.filter(is_type(F.col("type"), query.left.type)), LEFT)}
    if query.edge:
        prefixes |= {query.edge.alias: EDGE, query.right.alias: RIGHT}
        nodes[RIGHT] = _renamed(graph.nodes.filter(is_type(F.col("type"), query.right.type)), RIGHT)
        rows = _hops(graph, query, nodes)
        order = [LEFT + "id", RIGHT + "id", EDGE + "src", EDGE + "dst", EDGE + "type"]
    else:
        rows, order = nodes[LEFT], [LEFT + "id"]

    def holds(alias: str, name: str, operator: str, value: str) -> Column:
        column = _column(kinds, prefixes, alias, name)
        return column.contains(value) if operator == "CONTAINS" else column == value if operator == "=" else column != value

    if query.where:
        tests = [holds(c.alias, c.prop, c.operator, c.value) for c in query.where]
        rows = rows.filter(reduce(Column.__and__, tests))
    if query.limit is not None:
        rows = (rows.orderBy(*order) if ordered else rows).limit(query.limit)

    def value(item: Item) -> Column:
        if item.prop:
            return _column(kinds, prefixes, item.alias, item.prop)
        schema = NODES if kinds[item.alias] == "node" else EDGES
        return F.struct(*[F.col(prefixes[item.alias] + f.name).alias(f.name) for f in schema])

    distinct = {item.key: item for item in query.items}  # a repeated item is one column
    return rows.select(*[value(i).alias((names or {}).get(k, k)) for k, i in distinct.items()])


def cypher(
    graph: PropertyGraph, text: str, ordered: bool = True, require_limit: bool = False, names: dict[str, str] | None = None
) -> DataFrame:
    """Run a query's text. ``require_limit``: a query without LIMIT is an error, as for remote callers."""
    query = parse(text)
    check(query)
    if require_limit and query.limit is None:
        raise CypherSemanticError("the query needs a LIMIT")
    return compile_query(graph, query, ordered, names)
