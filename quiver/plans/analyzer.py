"""Checks that a parsed query means something, in a fixed order: types, aliases, WHERE, RETURN."""

from __future__ import annotations

from quiver.plans.parser import Query
from quiver.schema import EDGE_PROPERTIES, EDGE_TYPES, NODE_PROPERTIES, NODE_TYPES, GraphError


class CypherSemanticError(GraphError):
    """A query that names what isn't there."""


def _known(kind: str, value: str, names: tuple[str, ...]) -> None:
    if value and value.upper() not in names:
        raise CypherSemanticError(f"unknown {kind} type {value!r}; there are {', '.join(sorted(names))}")


def aliases(query: Query) -> dict[str, str]:
    """What each alias stands for: node or edge."""
    out: dict[str, str] = {}
    for part, kind in ((query.left, "node"), (query.edge, "edge"), (query.right, "node")):
        if part is None or not part.alias:
            continue
        if part.alias in out:
            raise CypherSemanticError(f"alias {part.alias!r} stands for two parts of the pattern")
        out[part.alias] = kind
    return out


def check(query: Query) -> dict[str, str]:
    """The query's aliases, if all that it names is known."""
    for node in (query.left, query.right):
        if node:
            _known("node", node.type, NODE_TYPES)
    if query.edge:
        _known("edge", query.edge.type, EDGE_TYPES)
    bound = aliases(query)

    def name(alias: str, prop: str, clause: str) -> None:
        if alias not in bound:
            raise CypherSemanticError(f"unknown alias {alias!r} in {clause}; there are {', '.join(sorted(bound)) or 'none'}")
        if not prop and clause == "WHERE":
            raise CypherSemanticError(f"WHERE needs a property of {alias!r}, such as {alias}.Name")
        valid = NODE_PROPERTIES if bound[alias] == "node" else EDGE_PROPERTIES
        if prop and prop.lower() not in valid:
            raise CypherSemanticError(f"a {bound[alias]} has no property {prop!r}; it has {', '.join(sorted(valid))}")

    for c in query.where:
        name(c.alias, c.prop, "WHERE")
    for item in query.items:
        name(item.alias, item.prop, "RETURN")
    return bound
