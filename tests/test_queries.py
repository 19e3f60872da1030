"""Every query of the driver's entry against DuckDB over the same tables."""

from __future__ import annotations

import duckdb
import pytest

from quiver.api import GraphTools
from quiver.queries import ORACLES, QUERIES, graph_of

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    done = duck.execute(ORACLES[name])
    order = [d[0] for d in done.description]
    assert sorted(order) == names
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(row[order.index(n)] for n in names) for row in done.fetchall()), key=key)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == want


def test_sizes(spark, sf):
    g = graph_of(spark, sf)
    assert (g.nodes.count(), g.edges.count()) == (2066, 14543)
    assert g.nodes.select("id").distinct().count() == 2066 and g.edges.select("src", "dst", "type").distinct().count() == 14543


def test_tools(spark, sf):
    tools = GraphTools(graph_of(spark, sf))
    assert tools.get_dependencies("o/1").count() == 8
    assert tools.search_nodes("widget").count() == 27
    assert tools.execute_cypher("MATCH (n) RETURN n LIMIT 1").count() == 1
    with pytest.raises(ValueError, match="LIMIT"):
        tools.execute_cypher("MATCH (n) RETURN n")
    assert tools.get_repository_structure(max_depth=1).count() == 6


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
