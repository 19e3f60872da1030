"""The query's tree.

    MATCH (a:T) [ edge (b:T) ] [ WHERE cond { [AND] cond } ] RETURN item {, item} [ LIMIT n ]
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from quiver.plans.lexer import CypherSyntaxError, Token, tokens


class Direction(Enum):
    OUT = "->"
    IN = "<-"
    ANY = "--"


@dataclass(frozen=True)
class NodePattern:
    alias: str = ""
    type: str = ""


@dataclass(frozen=True)
class EdgePattern:
    direction: Direction
    alias: str = ""
    type: str = ""


@dataclass(frozen=True)
class Condition:
    alias: str
    prop: str
    operator: str
    value: str


@dataclass(frozen=True)
class Item:
    alias: str
    prop: str = ""

    @property
    def key(self) -> str:
        return f"{self.alias}.{self.prop}" if self.prop else self.alias


@dataclass(frozen=True)
class Query:
    left: NodePattern
    edge: EdgePattern | None = None
    right: NodePattern | None = None
    where: list[Condition] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    limit: int | None = None


class _Parser:
    def __init__(self, text: str):
        self.rest = tokens(text)[::-1]

    @property
    def next(self) -> Token:
        return self.rest[-1]

    def take(self, *kinds: str, what: str = "") -> Token:
        if self.next.kind not in kinds:
            said = self.next.text or "the end of the query"
            raise CypherSyntaxError(f"expected {what or ' or '.join(kinds)}, got {said!r} at {self.next.at}")
        return self.rest.pop() if self.next.kind != "END" else self.next

    def maybe(self, kind: str) -> bool:
        if self.next.kind != kind:
            return False
        self.rest.pop()
        return True

    def query(self) -> Query:
        self.take("MATCH")
        left, edge, right = self.node(), None, None
        if self.next.kind in ("-", "<-"):
            edge, right = self.edge(), self.node()
        where = self.conditions() if self.maybe("WHERE") else []
        self.take("RETURN")
        items = [self.item()]
        while self.maybe(","):
            items.append(self.item())
        limit = self.limit() if self.maybe("LIMIT") else None
        self.take("END", what="the end of the query")
        return Query(left, edge, right, where, items, limit)

    def label(self, *kinds: str) -> tuple[str, str]:
        """An optional alias and an optional type."""
        alias = self.rest.pop().text if self.next.kind == "IDENT" else ""
        return alias, self.take(*kinds, what="a type").text.upper() if self.maybe(":") else ""

    def node(self) -> NodePattern:
        self.take("(")
        alias, kind = self.label("IDENT")
        self.take(")")
        return NodePattern(alias, kind)

    def edge(self) -> EdgePattern:
        inward = self.take("-", "<-").kind == "<-"
        alias = kind = ""
        if self.maybe("["):
            alias, kind = self.label("IDENT", "CONTAINS")  # the one keyword that is an edge type
            self.take("]")
        end = self.take("-", what="- after an inbound edge") if inward else self.take("->", "-")
        direction = Direction.IN if inward else Direction.OUT if end.kind == "->" else Direction.ANY
        return EdgePattern(direction, alias, kind)

    def conditions(self) -> list[Condition]:
        out = [self.condition()]
        while self.maybe("AND") or self.next.kind == "IDENT":
            out.append(self.condition())
        return out

    def reference(self, where: str) -> tuple[str, str]:
        alias = self.take("IDENT", what=f"an alias in {where}").text
        return alias, self.take("IDENT", what="a property").text if self.maybe(".") else ""

    def condition(self) -> Condition:
        alias, name = self.reference("WHERE")
        operator = self.take("=", "!=", "CONTAINS").kind
        return Condition(alias, name, operator, self.take("STRING", what="a string").text)

    def item(self) -> Item:
        return Item(*self.reference("RETURN"))

    def limit(self) -> int:
        n = int(self.take("NUMBER", what="a number").text)
        if n <= 0:
            raise CypherSyntaxError("LIMIT must be greater than 0")
        return n


def parse(text: str) -> Query:
    return _Parser(text).query()
