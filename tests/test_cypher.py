from __future__ import annotations

import pytest

from quiver.plans.analyzer import CypherSemanticError, check
from quiver.plans.compiler import cypher
from quiver.plans.lexer import CypherSyntaxError, tokens
from quiver.plans.parser import Direction, parse
from tests.graphs import edge, graph, node


@pytest.fixture(scope="module")
def basic(spark):
    nodes = [
        {"id": "funcA", "type": "FUNC", "name": "A", "pkg_path": "example/parser", "repo_id": "repo-a"},
        {"id": "funcB", "type": "FUNC", "name": "B", "pkg_path": "example/graph", "repo_id": "repo-a"},
        {"id": "structX", "type": "STRUCT", "name": "X", "repo_id": "repo-a"},
    ]
    return graph(spark, nodes, ["funcA -CALLS-> funcB", "funcB -CONTAINS-> structX"]).persist()


def run(g, text, **more):
    return [tuple(r) for r in cypher(g, text, **more).collect()]


def test_tokens():
    kinds = [t.kind for t in tokens("Match (é:FUNC)-->() where a.b != 'x' LIMIT 10")]
    assert kinds == ["MATCH", "(", "IDENT", ":", "IDENT", ")", "-", "->", "(", ")", "WHERE", "IDENT", ".", "IDENT", "!=", "STRING", "LIMIT", "NUMBER", "END"]
    assert tokens("'a\\'")[0].text == "a\\"  # no escapes
    assert tokens('"two\nlines"')[0].text == "two\nlines"
    assert [t.kind for t in tokens("MATCH\0(")] == ["MATCH", "END"]
    with pytest.raises(CypherSyntaxError):
        tokens("'open")
    with pytest.raises(CypherSyntaxError):
        tokens("a % b")


def test_comment_lines():
    query = parse("-- first\nMATCH (a)\n  -- a comment inside the pattern\n-[r]->(b) RETURN a")
    assert query.edge.direction is Direction.OUT
    assert parse("MATCH (a)--(b) RETURN a").edge.direction is Direction.ANY


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a) RETURN a extra", "MATCH (a) RETURN a LIMIT 0", "MATCH (a) WHERE a.Name = 5 RETURN a", "MATCH (a)<-[r]->(b) RETURN a",
        "MATCH (a:CONTAINS) RETURN a", "MATCH (limit) RETURN limit", "MATCH (a)-[r:CALLS]->(b)-[s]->(c) RETURN a", "MATCH (a) WHERE RETURN a",
        "RETURN a", "MATCH (a) RETURN", "MATCH (a) RETURN a LIMIT 'x'", "MATCH (a) WHERE a.Name 'x' RETURN a", "MATCH (a RETURN a", "",
    ],
)
def test_syntax_errors(text):
    with pytest.raises(CypherSyntaxError):
        parse(text)


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a)-[]->(a) RETURN a", "MATCH (a) RETURN b", "MATCH (a) WHERE a = 'x' RETURN a", "MATCH (a:CLASS) RETURN a",
        "MATCH (a) RETURN a.Package", "MATCH (a)-[r:USES]->(b) RETURN a", "MATCH (a) WHERE b.Name = 'x' RETURN a",
        "MATCH ()-[r]->() RETURN r.Name", "MATCH (a) WHERE a.Lines = 'x' RETURN a", "MATCH () RETURN a",
    ],
)
def test_semantic_errors(text):
    with pytest.raises(CypherSemanticError):
        check(parse(text))


def test_contains_is_an_edge_type(basic):
    assert run(basic, "MATCH (a)-[:CONTAINS]->(b) RETURN a.ID, b.ID") == [("funcB", "structX")]


def test_nodes_and_hops(basic):
    assert sorted(run(basic, "MATCH (n:func) RETURN n.ID")) == [("funcA",), ("funcB",)]
    assert run(basic, "MATCH (a:FUNC)-[r:CALLS]->(b:FUNC) RETURN a.Name, b.Name, r.From, r.To") == [("A", "B", "funcA", "funcB")]
    assert run(basic, "MATCH (b)<-[r:CALLS]-(a) RETURN b.ID, a.ID") == [("funcB", "funcA")]
    assert len(run(basic, "MATCH (a)-[r]-(b) WHERE a.ID = 'funcB' RETURN b.ID")) == 2
    assert run(basic, "MATCH (a) WHERE a.PkgPath contains 'parser' RETURN a.Name") == [("A",)]
    assert run(basic, "MATCH (a)-->(b) WHERE a.Name = 'A' b.Name = 'B' RETURN a.ID") == [("funcA",)]


def test_empty_strings_take_part(basic):
    assert run(basic, "MATCH (a) WHERE a.PkgPath != 'x' RETURN a.ID LIMIT 9") == [("funcA",), ("funcB",), ("structX",)]
    assert len(run(basic, "MATCH (a) WHERE a.PkgPath CONTAINS '' RETURN a.ID")) == 3


def test_whole_entities_and_keys(basic):
    rows = cypher(basic, "MATCH (a)-[r]->(b) WHERE r.Type = 'CALLS' RETURN a, r, b.Name, b.name, b.Name")
    assert rows.columns == ["a", "r", "b.Name", "b.name"]
    row = rows.collect()[0]
    assert row["a"]["id"] == "funcA" and row["r"]["dst"] == "funcB" and row[2] == row[3] == "B"


def test_self_and_parallel_edges(spark):
    g = graph(spark, ["a:FUNC", "b:FUNC"], ["a -CALLS-> a", "a -CALLS-> b", "a -IMPORTS-> b"])
    assert sorted(run(g, "MATCH (x)-[r]->(y) WHERE x.ID = 'a' RETURN y.ID, r.Type")) == [("a", "CALLS"), ("b", "CALLS"), ("b", "IMPORTS")]
    assert run(g, "MATCH (x)-[r]->(y) WHERE r.Type = 'IMPORTS' RETURN y.ID") == [("b",)]
    assert sorted(run(g, "MATCH (x)-[r:CALLS]-(y) RETURN x.ID, y.ID")) == [("a", "a"), ("a", "b"), ("b", "a")]
    assert sorted(run(g, "MATCH (x)<-[r:CALLS]-(y) RETURN x.ID, y.ID")) == [("a", "a"), ("b", "a")]


def test_routes(spark):
    g = graph(
        spark, [node("reg:FUNC"), node("route:ROUTE", name="GET /healthz"), node("handle:FUNC")],
        [edge("reg -REGISTERS_ROUTE-> route"), edge("route -REFERENCES-> handle")],
    )
    assert run(g, "MATCH (f)-[:REGISTERS_ROUTE]->(r:ROUTE) RETURN f.ID, r.Name") == [("reg", "GET /healthz")]
    assert run(g, "MATCH (r:ROUTE)-[:REFERENCES]->(f:FUNC) RETURN f.ID") == [("handle",)]


def test_limit(spark, basic):
    assert len(run(basic, "MATCH (n) RETURN n.Name LIMIT 2")) == 2
    assert run(basic, "MATCH (n) RETURN n.ID LIMIT 2") == [("funcA",), ("funcB",)]
    assert len(run(basic, "MATCH (n) RETURN n.ID LIMIT 2", ordered=False)) == 2
    with pytest.raises(CypherSemanticError):
        cypher(basic, "MATCH (n) RETURN n", require_limit=True)


def test_pushdown(spark, tmp_path, basic):
    basic.write(str(tmp_path / "g"))
    from quiver.graph import PropertyGraph

    g = PropertyGraph.read(spark, str(tmp_path / "g"))
    plan = cypher(g, "MATCH (n:FUNC) WHERE n.Name CONTAINS 'A' RETURN n.ID")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "occurrences" not in plan
