"""Every graph operator as a query over the commerce graph, with the same result in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.analysis.freshness import freshness, overall
from quiver.analysis.impact import impact_rows
from quiver.graph import PropertyGraph, merge_edges, merge_nodes, with_defaults
from quiver.lineage import shared_folder, stored
from quiver.operators import concurrency, context, neighbours, ranges, stats, structure, traversal
from quiver.plans.compiler import cypher
from quiver.rules import extraction as rules
from quiver.rules.extraction import channel_flow, implements
from quiver.schema import CHANGED_FILES, EDGES, FILE_RANGES, METADATA, NODES
from quiver.sinks.export import dot_lines, json_rows, mermaid_lines
from quiver.sources import filesystem
from quiver.sources.commerce import SQL, Commerce, commerce_graph
from quiver.sources.packages import selected
from quiver.sources.storage import GraphStore
from quiver.streaming.updates import debounced, routed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_graphs: dict[tuple[str, str], PropertyGraph] = {}

DEP = "('CALLS', 'IMPORTS', 'REFERENCES', 'INSTANTIATES')"
CONC = "('SPAWNS', 'SENDS_TO', 'RECEIVES_FROM')"
CNODE = "('GOROUTINE', 'CHANNEL')"


def graph_of(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The commerce graph, stored once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        made = commerce_graph(spark, sf_dir)
        _graphs[key] = PropertyGraph(stored(made.nodes, "nodes"), stored(made.edges, "edges"), resolved=True)
    return _graphs[key]


def query(sql: str | None = None, prefix: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (SQL if prefix else "") + sql
        return f

    return add


def match(name: str, text: str, columns: dict[str, str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cypher(graph_of(spark, sf_dir), text, names=columns)

    run.__name__ = name
    query(sql)(run)


# -- the query language

match("match_nodes_by_type", "MATCH (n:STRUCT) RETURN n.ID, n.Name", {"n.ID": "n_id", "n.Name": "n_name"},
      "SELECT id AS n_id, name AS n_name FROM nodes WHERE type = 'STRUCT'")
match("match_where_eq", "MATCH (n) WHERE n.RepoID = 'ASIA' RETURN n.ID, n.Type", {"n.ID": "n_id", "n.Type": "n_type"},
      "SELECT id AS n_id, type AS n_type FROM nodes WHERE repo_id = 'ASIA'")
match("match_where_neq", "match (n:package) where n.name != 'NATION_7' return n.id, n.pkgpath",
      {"n.id": "n_id", "n.pkgpath": "n_pkg"},
      "SELECT id AS n_id, pkg_path AS n_pkg FROM nodes WHERE type = 'PACKAGE' AND name <> 'NATION_7'")
match("match_where_contains", "MATCH (n:INTERFACE) WHERE n.Name CONTAINS 'widget' RETURN n.ID", {"n.ID": "n_id"},
      "SELECT id AS n_id FROM nodes WHERE type = 'INTERFACE' AND contains(name, 'widget')")
match("match_and", "MATCH (n:FUNC) WHERE n.RepoID = 'ASIA' AND n.FilePath CONTAINS 'NATION_2' n.ID CONTAINS '1' RETURN n.ID, n.FilePath",
      {"n.ID": "n_id", "n.FilePath": "n_file"},
      "SELECT id AS n_id, file_path AS n_file FROM nodes WHERE type = 'FUNC' AND repo_id = 'ASIA' AND contains(file_path, 'NATION_2') AND contains(id, '1')")
match("match_outbound", "MATCH (c:FUNC)-[r:CALLS]->(o:METHOD) RETURN c.Name, o.ID, r.RepoID",
      {"c.Name": "c_name", "o.ID": "o_id", "r.RepoID": "r_repo"},
      "SELECT c.name AS c_name, o.id AS o_id, e.repo_id AS r_repo FROM edges e JOIN nodes c ON c.id = e.src JOIN nodes o ON o.id = e.dst WHERE e.type = 'CALLS' AND c.type = 'FUNC' AND o.type = 'METHOD'")
match("match_inbound", "MATCH (p:INTERFACE)<-[r:IMPLEMENTS]-(s:STRUCT) RETURN p.ID, s.ID", {"p.ID": "p_id", "s.ID": "s_id"},
      "SELECT dst AS p_id, src AS s_id FROM edges JOIN nodes ON id = dst WHERE edges.type = 'IMPLEMENTS' AND nodes.type = 'INTERFACE'")
match("match_any_direction", "MATCH (a)-[r]-(b) WHERE a.ID = 'c/0' RETURN a.ID, r.Type, b.ID",
      {"a.ID": "a_id", "r.Type": "r_type", "b.ID": "b_id"},
      "SELECT src AS a_id, type AS r_type, dst AS b_id FROM edges WHERE src = 'c/0' UNION ALL SELECT dst, type, src FROM edges WHERE dst = 'c/0' AND src <> dst")
match("match_any_direction_all", "MATCH (a:GOROUTINE)--(b) RETURN a.ID, b.ID, b.Type", {"a.ID": "a_id", "b.ID": "b_id", "b.Type": "b_type"},
      "SELECT a.id AS a_id, b.id AS b_id, b.type AS b_type FROM (SELECT src AS x, dst AS y FROM edges UNION ALL SELECT dst, src FROM edges WHERE src <> dst) JOIN nodes a ON a.id = x JOIN nodes b ON b.id = y WHERE a.type = 'GOROUTINE'")
match("match_untyped_edges", "MATCH (s:STRUCT)-[r]->(b) WHERE r.Type != 'IMPLEMENTS' RETURN s.ID, r.Type, b.ID",
      {"s.ID": "s_id", "r.Type": "r_type", "b.ID": "b_id"},
      "SELECT src AS s_id, edges.type AS r_type, dst AS b_id FROM edges JOIN nodes ON id = src WHERE nodes.type = 'STRUCT' AND edges.type <> 'IMPLEMENTS'")
match("match_edge_props", "MATCH (a)-[r:INSTANTIATES]->(b) RETURN r.From, r.To, r.Type, r.RepoID",
      {"r.From": "r_from", "r.To": "r_to", "r.Type": "r_type", "r.RepoID": "r_repo"},
      "SELECT src AS r_from, dst AS r_to, type AS r_type, repo_id AS r_repo FROM edges WHERE type = 'INSTANTIATES'")
match("match_contains_edges", "MATCH (f:FOLDER)-[:CONTAINS]->(p:PACKAGE) RETURN f.ID, p.ID", {"f.ID": "f_id", "p.ID": "p_id"},
      "SELECT src AS f_id, dst AS p_id FROM edges JOIN nodes f ON f.id = src JOIN nodes p ON p.id = dst WHERE edges.type = 'CONTAINS' AND f.type = 'FOLDER' AND p.type = 'PACKAGE'")
match("match_limit_ordered", "MATCH (p:INTERFACE)<-[r]-(o) RETURN p.ID, o.ID LIMIT 25", {"p.ID": "p_id", "o.ID": "o_id"},
      "SELECT p_id, o_id FROM (SELECT dst AS p_id, src AS o_id, edges.type AS t FROM edges JOIN nodes ON id = dst WHERE nodes.type = 'INTERFACE' ORDER BY dst, src, t LIMIT 25)")


# -- neighbourhoods and search


@query(f"SELECT DISTINCT dst AS id FROM edges WHERE src = 'o/1' AND type IN {DEP}")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.dependencies(graph_of(spark, sf_dir), "o/1").select("id")


@query(f"SELECT DISTINCT src AS id FROM edges WHERE dst = 'brand/Brand#1' AND type IN {DEP}")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.blast_radius(graph_of(spark, sf_dir), "brand/Brand#1").select("id")


@query("SELECT id, name FROM nodes WHERE id IN (SELECT src FROM edges WHERE dst = 'p/7' AND type = 'IMPLEMENTS')")
def implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.implementations(graph_of(spark, sf_dir), "p/7").select("id", "name")


@query("SELECT id, type, name FROM nodes WHERE contains(lower(name), 'widget') OR contains(lower(id), 'widget') ORDER BY id LIMIT 50")
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(graph_of(spark, sf_dir), "WIDGET").select("id", "type", "name")


@query("SELECT id FROM nodes WHERE contains(name, '00001') OR contains(id, '00001') ORDER BY id LIMIT 50")
def search_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(graph_of(spark, sf_dir), "00001").select("id")


@query(f"SELECT dst, count(DISTINCT src) AS n_sources, min(src) AS first_source FROM edges WHERE type IN {DEP} GROUP BY dst")
def in_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.in_neighbours(graph_of(spark, sf_dir))
    return rows.groupBy("dst").agg(F.count("*").alias("n_sources"), F.min("src").alias("first_source"))


# -- traversals


@query(
    f""", reach(id, d) AS (SELECT 'brand/Brand#1', 0
  UNION SELECT src, d + 1 FROM reach JOIN edges ON dst = id WHERE type IN {DEP} AND d < 4)
SELECT id, CAST(min(d) AS INTEGER) AS distance FROM reach GROUP BY id HAVING min(d) > 0"""
)
def blast_radius_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.blast_radius_depth(graph_of(spark, sf_dir), ["brand/Brand#1"], 4, 0)[0].select("id", "distance")


@query(
    f""", l1 AS (SELECT src AS id, row_number() OVER (ORDER BY src) AS rk FROM (SELECT DISTINCT src FROM edges WHERE dst = 'p/7' AND type IN {DEP})),
l2 AS (SELECT src AS id, min(rk) AS prk FROM edges JOIN l1 ON dst = l1.id
       WHERE type IN {DEP} AND src <> 'p/7' AND src NOT IN (SELECT id FROM l1) GROUP BY src),
r AS (SELECT id, 1 AS distance, rk, row_number() OVER (ORDER BY rk) AS nth FROM l1
      UNION ALL SELECT id, 2, prk, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY prk, id) FROM l2)
SELECT id, CAST(distance AS INTEGER) AS distance, (SELECT count(*) FROM r) > 40 AS truncated FROM r WHERE nth <= 40"""
)
def blast_radius_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut_off = traversal.blast_radius_depth(graph_of(spark, sf_dir), ["p/7"], 2, 40)
    return rows.select("id", "distance", F.lit(cut_off).alias("truncated"))


@query(
    """, reach(id, d) AS (SELECT 'u/0', 0 UNION SELECT dst, d + 1 FROM reach JOIN edges ON src = id WHERE type = 'CALLS' AND d < 12)
SELECT reach.id, CAST(min(d) AS INTEGER) AS distance FROM reach JOIN nodes ON nodes.id = reach.id WHERE nodes.type = 'STRUCT' GROUP BY reach.id"""
)
def find_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traversal.call_distances(graph_of(spark, sf_dir), "u/0")
    return rows.filter("type = 'STRUCT'").select("id", "distance")


@query(
    """, lv(id, d) AS (SELECT 'u/0', 0 UNION SELECT dst, d + 1 FROM lv JOIN edges ON src = id WHERE type = 'CALLS' AND d < 12),
best AS (SELECT id, min(d) AS d FROM lv GROUP BY id),
pred AS (SELECT dst AS id, min(src) AS via FROM edges JOIN best a ON a.id = src JOIN best b ON b.id = dst
         WHERE type = 'CALLS' AND a.d + 1 = b.d GROUP BY dst),
goal AS (SELECT id FROM best ORDER BY d DESC, id LIMIT 1),
path(id) AS (SELECT id FROM goal UNION SELECT via FROM path JOIN pred USING (id))
SELECT CAST(d AS INTEGER) AS step, id, CASE WHEN id = (SELECT id FROM goal) THEN '' ELSE 'CALLS' END AS next_edge FROM path JOIN best USING (id)"""
)
def find_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path from one goroutine to the node that it reaches last."""
    graph = graph_of(spark, sf_dir)
    goal = traversal.call_distances(graph, "u/0").orderBy(F.desc("distance"), "id").first()
    return traversal.find_path(graph, "u/0", goal.id).select("step", "id", "next_edge")


def _concurrency_sql(node: str) -> str:
    return f""", t AS (SELECT e.src, e.dst, e.type, s.type AS st, d.type AS dt FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst),
conc AS (SELECT * FROM t WHERE type IN {CONC} AND dt IN {CNODE}),
called AS (SELECT dst FROM t WHERE src = '{node}' AND type = 'CALLS' AND dt NOT IN {CNODE}),
spawned AS (SELECT dst FROM t WHERE src = '{node}' AND type = 'SPAWNS' AND dt <> 'CHANNEL'),
deep AS (SELECT dst FROM t WHERE type = 'CALLS' AND src IN (SELECT dst FROM spawned)),
found AS (
  SELECT 'outbound' AS direction, src, dst, type AS edge_type, dst AS id FROM conc WHERE src = '{node}'
  UNION SELECT 'via_call', src, dst, type, dst FROM conc WHERE src IN (SELECT dst FROM called)
  UNION SELECT 'via_goroutine', src, dst, type, dst FROM conc WHERE src IN (SELECT dst FROM spawned) OR src IN (SELECT dst FROM deep)
  UNION SELECT 'inbound', src, dst, type, src FROM t WHERE dst = '{node}' AND st IN {CNODE} AND (type IN {CONC} OR (type = 'CALLS' AND st = 'GOROUTINE')))
"""


def _concurrency(name: str, node: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return concurrency.concurrency_graph(graph_of(spark, sf_dir), node).select("direction", "src", "dst", "edge_type", "id")

    run.__name__ = name
    query(_concurrency_sql(node) + "SELECT direction, src, dst, edge_type, id FROM found")(run)


_concurrency("concurrency_graph", "c/3")
_concurrency("concurrency_graph_goroutine", "u/2")
_concurrency("concurrency_graph_channel", "channel:purchase")


@query(_concurrency_sql("c/0") + "SELECT DISTINCT nodes.id, nodes.type FROM found JOIN nodes USING (id)")
def concurrency_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concurrency.concurrency_flow(graph_of(spark, sf_dir), "c/0").select("id", "type")


# -- places in files


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 15 to 32 of every nation's customers, reversed for odd ones, and all suppliers of every fifth."""
    t = Commerce(spark, sf_dir)
    odd = F.col("n_nationkey") % 2 == 1
    path = lambda f: F.concat(t.folder, F.lit(f)).alias("file_path")
    lines = t.nation.select(
        path("/customers.go"), F.when(odd, 32).otherwise(15).alias("start_line"), F.when(odd, 15).otherwise(32).alias("end_line"),
        F.lit(False).alias("whole_file"), F.when(odd, "").otherwise(F.col("r")).alias("repo_id"),
    )
    whole = t.nation.filter(F.col("n_nationkey") % 5 == 0).select(
        path("/suppliers.go"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(True).alias("whole_file"), F.col("r").alias("repo_id")
    )
    return lines.unionByName(whole).select(*[f.name for f in FILE_RANGES])


TOUCHED_SQL = """, rng AS (
  SELECT '/data/' || r || '/' || n || '/customers.go' AS path, 15 AS lo, 32 AS hi, false AS whole FROM nat
  UNION ALL SELECT '/data/' || r || '/' || n || '/suppliers.go', 0, 0, true FROM nat WHERE n_nationkey % 5 = 0),
touched AS (SELECT DISTINCT id, type FROM nodes JOIN rng ON file_path = path
            WHERE whole OR (line_start > 0 AND line_end >= line_start AND line_start <= hi AND line_end >= lo))
"""


@query(TOUCHED_SQL + "SELECT id, type FROM touched")
def file_range_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.nodes_for_ranges(graph_of(spark, sf_dir), _ranges(spark, sf_dir)).select("id", "type")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same places as changed files, and one file for each nation that no node lies in."""
    rows = _ranges(spark, sf_dir).withColumn("path", F.element_at(F.split("file_path", "/"), -1))
    hunk = F.array(F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end")))
    known = rows.select(
        "repo_id", "path", F.col("file_path").alias("absolute_path"), F.lit("M").alias("status"),
        F.when(F.col("whole_file"), F.array().cast("array<struct<start:int,end:int>>")).otherwise(hunk).alias("ranges"),
        "whole_file", F.lit(False).alias("untracked"),
    )
    t = Commerce(spark, sf_dir)
    new = t.nation.select(
        F.col("r").alias("repo_id"), F.concat("n", F.lit(".md")).alias("path"), F.concat(t.folder, F.lit("/notes.md")).alias("absolute_path"),
        F.lit("??").alias("status"), F.array().cast("array<struct<start:int,end:int>>").alias("ranges"),
        F.lit(True).alias("whole_file"), F.lit(True).alias("untracked"),
    )
    return known.unionByName(new).select(*[f.name for f in CHANGED_FILES])


@query("SELECT r AS repo_id, n || '.md' AS path FROM nat")
def unmatched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _changed(spark, sf_dir)
    nodes = ranges.nodes_for_ranges(graph_of(spark, sf_dir), ranges.ranges_of_files(changed))
    return ranges.unmatched_files(changed, nodes).select("repo_id", "path")


@query(TOUCHED_SQL + "SELECT id, type FROM touched")
def impact_changed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _changed(spark, sf_dir)
    return ranges.nodes_for_ranges(graph_of(spark, sf_dir), ranges.ranges_of_files(changed)).select("id", "type")


@query(
    TOUCHED_SQL
    + f""", ranked AS (SELECT id, row_number() OVER (ORDER BY id) AS rk FROM touched),
step AS (SELECT src AS id, min(rk) AS prk FROM edges JOIN ranked ON dst = ranked.id WHERE type IN {DEP} AND src NOT IN (SELECT id FROM touched) GROUP BY src),
capped AS (SELECT id, row_number() OVER (ORDER BY prk, id) AS nth FROM step)
SELECT id, CAST(0 AS INTEGER) AS distance FROM touched UNION ALL SELECT id, 1 FROM capped WHERE nth <= 100"""
)
def impact_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_rows(graph_of(spark, sf_dir), _changed(spark, sf_dir), 1, 100)[0].select("id", "distance")


# -- reports


@query('SELECT type AS key, count(*) AS "count" FROM nodes GROUP BY type')
def nodes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nodes_by_kind(graph_of(spark, sf_dir))


@query('SELECT type AS key, count(*) AS "count" FROM edges GROUP BY type')
def edges_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edges_by_kind(graph_of(spark, sf_dir))


@query("SELECT repo_id AS key, count(*) AS \"count\" FROM nodes WHERE repo_id <> '' GROUP BY repo_id")
def nodes_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nodes_by_repo(graph_of(spark, sf_dir))


@query("SELECT repo_id AS key, count(*) AS \"count\" FROM edges WHERE repo_id <> '' GROUP BY repo_id")
def edges_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edges_by_repo(graph_of(spark, sf_dir))


@query("SELECT pkg_path AS key, count(*) AS \"count\" FROM nodes WHERE pkg_path <> '' GROUP BY pkg_path ORDER BY 2 DESC, 1 LIMIT 10")
def top_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_packages(graph_of(spark, sf_dir))


@query(
    """SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count,
  (SELECT count(*) FROM nodes WHERE type = 'FILE') AS file_nodes,
  (SELECT count(DISTINCT file_path) FROM nodes WHERE type = 'FILE' AND file_path <> '') AS source_files"""
)
def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(graph_of(spark, sf_dir)).drop("estimated_bytes")


@query(
    """SELECT repo_id, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(e) AS BIGINT) AS edges FROM (
  SELECT repo_id, 1 AS n, 0 AS e FROM nodes UNION ALL SELECT repo_id, 0, 1 FROM edges) GROUP BY ROLLUP (repo_id)"""
)
def workspace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.workspace_totals(graph_of(spark, sf_dir))


@query("SELECT repo_id, min(file_path) AS root FROM nodes WHERE type = 'FOLDER' AND suffix(id, ':folder:.') AND file_path <> '' GROUP BY repo_id")
def repo_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repo_roots(graph_of(spark, sf_dir))


@query("SELECT DISTINCT pkg_path FROM nodes WHERE starts_with(file_path, '/data/ASIA/') AND pkg_path <> ''")
def packages_under_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.packages_in(graph_of(spark, sf_dir), "/data/ASIA", recursive=True)


@query("SELECT DISTINCT pkg_path FROM nodes WHERE regexp_matches(file_path, '^/data/ASIA/NATION_2/[^/]*$') AND pkg_path <> ''")
def packages_in_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.packages_in(graph_of(spark, sf_dir), "/data/ASIA/NATION_2")


@query("SELECT r || '/' || n AS folder, 'tpch/' || r || '/' || n AS packages FROM nat")
def package_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.package_folders(graph_of(spark, sf_dir).nodes, "/data")
    return rows.select("folder", F.array_join("packages", ",").alias("packages"))


@query(
    """, kept AS (SELECT * FROM nodes WHERE type IN ('WORKSPACE', 'REPO', 'FOLDER', 'PACKAGE')),
tree(id, depth, path) AS (SELECT 'workspace:tpch', 0, 'workspace:tpch'
  UNION ALL SELECT kept.id, depth + 1, path || '>' || kept.id FROM tree JOIN edges ON src = tree.id JOIN kept ON kept.id = dst
  WHERE edges.type = 'CONTAINS' AND depth < 4)
SELECT tree.id, CAST(depth AS INTEGER) AS depth, path, name FROM tree JOIN nodes ON nodes.id = tree.id"""
)
def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.structure_tree(graph_of(spark, sf_dir), structure.StructureOptions(root="workspace:tpch"))
    return rows.select("id", "depth", F.array_join("path", ">").alias("path"), "name")


@query(
    f""", rel AS (
  SELECT CASE WHEN e.type IN {DEP} THEN 'dependencies' WHEN e.type = 'CONTAINS' THEN 'children'
              WHEN e.type = 'REGISTERS_ROUTE' THEN 'routes' WHEN e.type = 'IMPLEMENTS' THEN 'interfaces' END AS section,
         'outbound' AS direction, e.type AS edge_type, dst AS id FROM edges e WHERE src = 's/3'
  UNION ALL SELECT CASE WHEN e.type = 'CONTAINS' THEN 'parents'
              WHEN e.type = 'REGISTERS_ROUTE' OR (e.type = 'REFERENCES' AND n.type = 'ROUTE') THEN 'routes'
              WHEN e.type = 'IMPLEMENTS' THEN 'interfaces' END, 'inbound', e.type, src
  FROM edges e JOIN nodes n ON n.id = src WHERE dst = 's/3'),
dep AS (SELECT DISTINCT src AS id FROM edges WHERE dst = 's/3' AND type IN {DEP}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY id, edge_type, direction) AS position FROM rel WHERE section IS NOT NULL)
SELECT section, CAST(position AS INTEGER) AS position, direction, edge_type, id FROM ranked WHERE position <= 20
UNION ALL SELECT 'dependents', CAST(p AS INTEGER), 'inbound', '', id FROM (SELECT id, row_number() OVER (ORDER BY id) AS p FROM dep) WHERE p <= 20"""
)
def node_context_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.node_context(graph_of(spark, sf_dir), "s/3", context.ContextOptions(include_source=False))
    return found.sections.filter("section <> 'concurrency'").select("section", "position", "direction", "edge_type", "id")


# -- merging and maintenance


@query(
    "SELECT 'p/' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'INTERFACE' ELSE 'BOUNDARY' END AS type, "
    "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'placeholder' END AS name FROM part",
    prefix=False,
)
def merge_nodes_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of all parts come first; every second part follows for real, twice."""
    real = graph_of(spark, sf_dir).nodes.filter("type = 'INTERFACE'")
    early = real.withColumns({"type": F.lit("BOUNDARY"), "name": F.lit("placeholder"), "load_order": F.lit(0)})
    even = real.filter(F.substring_index("id", "/", -1).cast("long") % 2 == 0)
    later = even.withColumn("load_order", F.lit(1)).unionByName(even.withColumns({"name": F.lit("again"), "load_order": F.lit(2)}))
    return merge_nodes(early.unionByName(later)).select("id", "type", "name")


@query("SELECT src, dst, line, col AS at FROM occ WHERE type = 'REFERENCES'")
def merge_edge_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is an edge with one place; merged edges list each place once."""
    items = Commerce(spark, sf_dir).lineitem
    place = F.struct(F.lit("order").alias("filepath"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").cast("int").alias("column"))
    raw = items.select(
        F.concat(F.lit("o/"), "l_orderkey").alias("src"), F.concat(F.lit("p/"), "l_partkey").alias("dst"), F.lit("REFERENCES").alias("type"),
        F.lit("").alias("repo_id"), F.array(place).cast(EDGES["occurrences"].dataType).alias("occurrences"), F.col("l_linenumber").alias("load_order"),
    )
    return merge_edges(raw).select("src", "dst", F.explode("occurrences").alias("o")).select("src", "dst", "o.line", F.col("o.column").alias("at"))


@query("SELECT src, dst, type, CAST(line AS INTEGER) AS line, col AS at FROM occ")
def edge_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_of(spark, sf_dir).edges.select("src", "dst", "type", F.explode("occurrences").alias("o"))
    return rows.select("src", "dst", "type", "o.line", F.col("o.column").alias("at"))


@query("SELECT type, count(*) AS n FROM edges WHERE src IN (SELECT id FROM nodes WHERE type <> 'BOUNDARY') AND dst IN (SELECT id FROM nodes WHERE type <> 'BOUNDARY') GROUP BY type")
def drop_dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    live = PropertyGraph(g.nodes.filter("type <> 'BOUNDARY'"), g.edges).live_edges
    return live.groupBy("type").agg(F.count("*").alias("n"))


REMOVED = ", kept AS (SELECT * FROM nodes WHERE pkg_path <> 'tpch/ASIA/NATION_7') "


@query(REMOVED + "SELECT type, count(*) AS n FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) GROUP BY type")
def remove_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir).remove_package("tpch/ASIA/NATION_7")
    return PropertyGraph(g.nodes, g.edges).live_edges.groupBy("type").agg(F.count("*").alias("n"))


@query(REMOVED + "SELECT type, count(*) AS n FROM edges WHERE src IN (SELECT id FROM kept) GROUP BY type")
def readd_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that come back find the edges that enter them; those that left are gone."""
    g = graph_of(spark, sf_dir)
    again = g.remove_package("tpch/ASIA/NATION_7").add_nodes(g.nodes.filter("pkg_path = 'tpch/ASIA/NATION_7'"))
    return PropertyGraph(again.nodes, again.edges).live_edges.groupBy("type").agg(F.count("*").alias("n"))


@query(
    """, owned AS (SELECT id FROM nodes WHERE type = 'FOLDER'),
kept AS (SELECT e.src, e.dst FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst
         WHERE e.type = 'CONTAINS' AND s.type NOT IN ('WORKSPACE', 'REPO', 'FOLDER') AND d.type <> 'FOLDER')
SELECT src, dst FROM kept UNION ALL SELECT 'repo:' || r_name, 'repo:' || r_name || ':folder:new' FROM region"""
)
def replace_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, t = graph_of(spark, sf_dir), Commerce(spark, sf_dir)
    new = F.concat(F.lit("repo:"), "r_name", F.lit(":folder:new"))
    blank = g.nodes.limit(0)
    nodes = t.region.select(
        new.alias("id"), F.lit("FOLDER").alias("type"), F.lit("new").alias("name"), F.lit("").alias("pkg_path"), F.lit("").alias("file_path"),
        F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.col("r_name").alias("repo_id"),
    ).unionByName(blank)
    edges = t.region.select(
        F.concat(F.lit("repo:"), "r_name").alias("src"), new.alias("dst"), F.lit("CONTAINS").alias("type"), F.col("r_name").alias("repo_id"),
        F.array().cast(EDGES["occurrences"].dataType).alias("occurrences"),
    )
    done = PropertyGraph(g.nodes, g.edges).replace_structure(PropertyGraph(nodes, edges))
    return done.live_edges.filter("type = 'CONTAINS'").select("src", "dst")


@query(
    """, a AS (SELECT *, 0 AS o FROM nodes WHERE repo_id IN ('ASIA', '')), b AS (SELECT *, 1 AS o FROM nodes WHERE repo_id IN ('EUROPE', '')),
n AS (SELECT DISTINCT id FROM (SELECT id FROM a UNION ALL SELECT id FROM b))
SELECT type, count(*) AS n FROM edges WHERE repo_id IN ('ASIA', 'EUROPE', '') AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY type"""
)
def multi_repo_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two repositories' stores as one graph, with the edges between them."""
    g = graph_of(spark, sf_dir)
    part = lambda r: PropertyGraph(g.nodes.filter(F.col("repo_id").isin(r, "")), g.edges.filter(F.col("repo_id").isin(r, "")))
    return PropertyGraph.merged([part("ASIA"), part("EUROPE")]).live_edges.groupBy("type").agg(F.count("*").alias("n"))


# -- rules


@query(
    """, f AS (SELECT DISTINCT 'u/' || user_id AS callee, 'channel:' || event_type AS param, 'arg/' || (event_id % 10) AS arg FROM events),
e AS (SELECT src, dst, type FROM edges WHERE type IN ('SENDS_TO', 'RECEIVES_FROM'))
SELECT DISTINCT e.src, arg AS dst, e.type FROM f JOIN e ON callee = e.src AND param = e.dst"""
)
def channel_flow_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Commerce(spark, sf_dir).events
    flows = events.select(
        F.concat(F.lit("u/"), "user_id").alias("callee"), F.concat(F.lit("channel:"), "event_type").alias("param"),
        F.concat(F.lit("arg/"), F.col("event_id") % 10).alias("arg"),
    ).distinct()
    return channel_flow(flows, graph_of(spark, sf_dir).edges)


@query(
    """WITH m AS (SELECT DISTINCT l_suppkey AS t, l_partkey AS p FROM lineitem), i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
z AS (SELECT o, count(*) AS size FROM i GROUP BY o)
SELECT 's/' || t AS src, 'o/' || o AS dst FROM m JOIN i USING (p) JOIN z USING (o) GROUP BY t, o, size HAVING count(*) = size""",
    prefix=False,
)
def implements_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that supply every part of an order, as types and interfaces with parts for methods."""
    items = Commerce(spark, sf_dir).lineitem
    part, none = F.col("l_partkey").cast("string").alias("name"), F.lit("").alias("signature")
    return implements(
        items.select(F.concat(F.lit("s/"), "l_suppkey").alias("type"), part, none),
        items.select(F.concat(F.lit("o/"), "l_orderkey").alias("interface"), part, none),
    )


@query(
    """WITH p AS (SELECT 'pkg/' || o_custkey AS path, o_orderkey AS load_order, o_orderstatus = 'F' AS for_test, o_orderkey % 7 AS n_files FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY for_test DESC, n_files DESC, load_order) AS nth FROM p)
SELECT path, load_order FROM r WHERE nth = 1""",
    prefix=False,
)
def package_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Commerce(spark, sf_dir).orders
    test = F.col("o_orderstatus") == "F"
    base = F.concat(F.lit("pkg/"), "o_custkey")
    path = F.when(test, F.concat(base, F.lit(" ["), base, F.lit(".test]"))).otherwise(base)
    rows = orders.select(path.alias("pkg_path"), test.alias("for_test"), (F.col("o_orderkey") % 7).alias("n_files"), F.col("o_orderkey").alias("load_order"))
    return selected(rows).select("path", "load_order")


@query(
    """WITH f AS (SELECT DISTINCT r_name AS r, n_name AS n, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'folder:' || r AS src, 'folder:' || r || '/' || n AS dst FROM f UNION SELECT 'folder:.', 'folder:' || r FROM f
UNION SELECT 'folder:' || r || '/' || n, '/data/' || r || '/' || n || '/' || s || '.md' FROM f""",
    prefix=False,
)
def filesystem_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of a listing with a document for each segment, a Go file, and files that a walk skips."""
    t = Commerce(spark, sf_dir)
    base = t.customer.select(t.folder.alias("d"), "c_mktsegment").distinct()
    names = F.array(
        F.concat("d", F.lit("/"), "c_mktsegment", F.lit(".md")), F.concat("d", F.lit("/main.go")), F.concat("d", F.lit("/.hidden")),
        F.concat("d", F.lit("/vendor/x.md")), F.concat("d", F.lit("/.git/config")),
    )
    files = base.select(F.explode(names).alias("path"), F.lit(1).alias("length")).distinct()
    return filesystem.structure(files, "/data").edges.select("src", "dst")


# -- exports

ESC = "replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(13), '\\r'), chr(10), '\\n')"


def _esc(column: str) -> str:
    return ESC.format(column)


@query(
    f"""SELECT '  "' || {_esc("id")} || '" [label="' || {_esc("name")} || '\\n' || {_esc("type")} || '"];' AS line FROM nodes
UNION ALL SELECT '  "' || {_esc("e.src")} || '" -> "' || {_esc("e.dst")} || '" [label="' || e.type || '"' || coalesce(', occurrences="' || n || '", lines="' || places || '"', '') || '];'
FROM edges e LEFT JOIN (SELECT src, dst, type, count(*) AS n, string_agg(filepath || ':' || line || ':' || col, ',' ORDER BY filepath, line, col) AS places FROM occ GROUP BY ALL) o USING (src, dst, type)"""
)
def export_dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dot_lines(graph_of(spark, sf_dir)).select("line")


def _mid(column: str) -> str:
    safe = f"regexp_replace({column}, '[^A-Za-z0-9_]', '_', 'g')"
    return f"CASE WHEN regexp_matches({safe}, '^[0-9]') THEN '_' ELSE '' END || {safe}"


@query(
    f"""SELECT '    ' || {_mid("id")} || '["' || {_esc("name || ':' || type")} || '"]' AS line FROM nodes
UNION ALL SELECT '    ' || {_mid("src")} || ' -->|' || type || '| ' || {_mid("dst")} FROM edges"""
)
def export_mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mermaid_lines(graph_of(spark, sf_dir)).select("line")


@query("SELECT id, CAST(line_start AS BIGINT) AS first_line, repo_id FROM nodes")
def export_json_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported node objects, read again."""
    rows = json_rows(graph_of(spark, sf_dir))[0]
    return rows.select(
        F.get_json_object("json", "$.ID").alias("id"), F.get_json_object("json", "$.Lines[0]").cast("long").alias("first_line"),
        F.get_json_object("json", "$.RepoID").alias("repo_id"),
    )


# -- freshness and streams


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata row and a current state for each customer; what differs depends on its key."""
    k = F.col("c_custkey")
    values = {
        "schema_version": F.when(k % 17 == 0, F.lit(None)).otherwise(F.when(k % 13 == 0, 2).otherwise(1)).cast("int"),
        "analyzed_at": F.lit(None).cast("timestamp"), "repo_id": F.concat(F.lit("r"), k % 3), "repo_root": F.lit("/r"),
        "include_tests": F.lit(False), "git_available": k % 11 != 0, "git_root": F.lit("/r"),
        "git_head": F.when(k % 19 == 0, "").otherwise("abc"), "git_dirty_at_analyze": k % 5 == 0,
        "git_status_fingerprint": F.when(k % 5 == 0, "f").otherwise(""),
        "current_repo_id": F.concat(F.lit("r"), k % 3), "current_repo_root": F.lit("/r"), "current_root": F.lit("/r"),
        "current_head": F.when(k % 7 == 0, "def").otherwise("abc"), "current_branch": F.lit("main"), "current_dirty": k % 10 == 0,
        "current_fingerprint": F.when(k % 10 == 0, "f").otherwise(""), "current_error": F.when(k % 23 == 0, "no git"),
    }
    rest = {f.name: F.lit(None).cast(f.dataType) for f in METADATA if f.name not in values}
    return Commerce(spark, sf_dir).customer.select(k.alias("key"), *[c.alias(n) for n, c in (values | rest).items()])


FRESH_SQL = """WITH s AS (SELECT c_custkey AS k, c_custkey % 23 <> 0 AS known, c_custkey % 11 <> 0 AS avail FROM customer),
r AS (SELECT k,
  CASE WHEN known AND k % 19 <> 0 AND k % 7 = 0 THEN 1 ELSE 0 END
    + CASE WHEN known AND avail AND (k % 5 = 0) <> (k % 10 = 0) THEN 2 ELSE 0 END AS stale,
  CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN NOT avail THEN 1 ELSE 0 END + CASE WHEN NOT known THEN 1 ELSE 0 END
    + CASE WHEN known AND avail AND k % 19 = 0 THEN 1 ELSE 0 END AS unknown FROM s)
SELECT k AS key, CASE WHEN k % 17 = 0 THEN 'unknown' WHEN stale > 0 THEN 'stale' WHEN unknown > 0 THEN 'unknown' ELSE 'fresh' END AS status,
  CAST(CASE WHEN k % 17 = 0 THEN 1 ELSE stale + unknown END AS BIGINT) AS n_reasons FROM r"""


@query(FRESH_SQL, prefix=False)
def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness(_states(spark, sf_dir)).select("key", "status", F.size("reasons").cast("long").alias("n_reasons"))


@query(
    f"""SELECT coalesce(max_by(status, CASE status WHEN 'stale' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END), 'unknown') AS status
FROM ({FRESH_SQL}) AS each_repository""",
    prefix=False,
)
def freshness_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall(freshness(_states(spark, sf_dir)))


@query(
    """WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT event_type, ts, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT event_type, min(ts) AS burst_start, max(ts) + INTERVAL 10 MINUTE AS burst_end, count(*) AS n_events FROM b GROUP BY event_type, burst""",
    prefix=False,
)
def debounced_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounced(Commerce(spark, sf_dir).events, "10 minutes", ("event_type",))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'package' WHEN 2 THEN 'refresh' ELSE 'remove' END AS action,
  CASE event_id % 4 WHEN 1 THEN '/r/' || event_type WHEN 2 THEN '' ELSE '/r/' || event_type || '/a.md' END AS target FROM events WHERE event_id % 4 <> 0""",
    prefix=False,
)
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of other files (dropped), Go files, new and removed files, by event id."""
    k = F.col("event_id") % 4
    name = F.when(k == 1, "/a.go").otherwise("/a.md")
    op = F.when(k == 0, "write").when(k == 1, "write").when(k == 2, "create").otherwise("remove")
    events = Commerce(spark, sf_dir).events.select(
        "event_id", F.concat(F.lit("/r/"), "event_type", name).alias("path"), op.alias("op"), F.lit(False).alias("is_dir"), "ts"
    )
    return routed(events).select("event_id", "action", "target")


# -- rules over facts that the tables stand for: suppliers and parts as types, orders as methods, events as statements


def _text(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), *[F.col(c).cast("string") for c in columns])


PACKAGES_SQL = "WITH pk AS (SELECT 'lib/' || n_name AS pkg_path, n_name AS name, n_nationkey % 3 <> 0 AS internal FROM nation) "


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Commerce(spark, sf_dir).nation.select(
        _text("lib/", "n").alias("pkg_path"), F.col("n").alias("name"), (F.col("n_nationkey") % 3 != 0).alias("internal")
    )


def _internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packages(spark, sf_dir).filter("internal")


@query(PACKAGES_SQL + "SELECT pkg_path AS id, CASE WHEN internal THEN 'PACKAGE' ELSE 'BOUNDARY' END AS type, name, pkg_path FROM pk", prefix=False)
def rule_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.package_nodes(_packages(spark, sf_dir)).select("id", "type", "name", "pkg_path")


FILES_SQL = PACKAGES_SQL + """, f AS (SELECT DISTINCT 'lib/' || n_name AS pkg_path, '/src/' || n_name || '/' || c_mktsegment || '.go' AS path, c_mktsegment || '.go' AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey) """


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/src/"), "n", F.lit("/"), "c_mktsegment", F.lit(".go"))
    return Commerce(spark, sf_dir).customer.select(_text("lib/", "n").alias("pkg_path"), path.alias("path")).distinct()


@query(FILES_SQL + "SELECT path AS id, name, pkg_path, path AS file_path FROM f", prefix=False)
def rule_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.file_rules(_files(spark, sf_dir))[0].select("id", "name", "pkg_path", "file_path")


@query(FILES_SQL + "SELECT pkg_path AS src, path AS dst, 'CONTAINS' AS type FROM f", prefix=False)
def rule_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.file_rules(_files(spark, sf_dir))[1].select("src", "dst", "type")


IMPORTS_SQL = PACKAGES_SQL + """, i AS (SELECT DISTINCT 's/' || l_suppkey AS file, CASE WHEN l_partkey % 4 = 0 THEN 'ext/v' || (l_partkey % 50) ELSE 'lib/' || n_name END AS pkg_path
  FROM lineitem JOIN nation ON l_partkey % 25 = n_nationkey) """


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Commerce(spark, sf_dir)
    rows = t.lineitem.join(F.broadcast(t.nation), F.col("l_partkey") % 25 == F.col("n_nationkey"))
    outside = F.concat(F.lit("ext/v"), F.col("l_partkey") % 50)
    path = F.when(F.col("l_partkey") % 4 == 0, outside).otherwise(_text("lib/", "n"))
    return rows.select(_text("s/", "l_suppkey").alias("file"), path.alias("pkg_path"))


@query(IMPORTS_SQL + "SELECT file AS src, pkg_path AS dst, 'IMPORTS' AS type FROM i", prefix=False)
def rule_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.import_edges(_imports(spark, sf_dir)).select("src", "dst", "type")


@query(
    IMPORTS_SQL + "SELECT DISTINCT pkg_path AS id, 'BOUNDARY' AS type, split_part(pkg_path, '/', 2) AS name FROM i "
    "WHERE pkg_path NOT IN (SELECT pkg_path FROM pk WHERE internal)", prefix=False,
)
def rule_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.boundary_nodes(_imports(spark, sf_dir), _internal(spark, sf_dir)).select("id", "type", "name")


DECLS_SQL = """WITH d AS (
  SELECT 'p/' || p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'INTERFACE' WHEN 1 THEN 'TYPE_ALIAS' WHEN 2 THEN 'CONSTANT' WHEN 3 THEN 'VARIABLE' ELSE 'STRUCT' END AS kind,
         CASE WHEN p_partkey % 10 = 3 THEN '_' ELSE p_name END AS name, p_brand || '.go' AS file, p_size AS line, '' AS owner FROM part
  UNION ALL SELECT 'o/' || o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'FUNC' ELSE 'METHOD' END, o_orderpriority, 'o.go', o_orderkey % 100 + 1,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'p/' || (o_orderkey % (SELECT count(*) FROM part)) END FROM orders) """


def _decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Commerce(spark, sf_dir)
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("INTERFACE", "TYPE_ALIAS", "CONSTANT", "VARIABLE", "STRUCT")]), (k % 5 + 1).cast("int"))
    parts = t.part.select(
        _text("p/", "p_partkey").alias("id"), kind.alias("kind"), F.when(k % 10 == 3, "_").otherwise(F.col("p_name")).alias("name"),
        F.concat("p_brand", F.lit(".go")).alias("file"), F.col("p_size").cast("long").alias("line"), F.lit("").alias("owner"),
    )
    owner = F.concat(F.lit("p/"), (o % t.part.count()).cast("string"))
    orders = t.orders.select(
        _text("o/", "o_orderkey").alias("id"), F.when(o % 3 == 0, "FUNC").otherwise("METHOD").alias("kind"), F.col("o_orderpriority").alias("name"),
        F.lit("o.go").alias("file"), (o % 100 + 1).alias("line"), F.when(o % 3 == 0, "").otherwise(owner).alias("owner"),
    )
    return parts.unionByName(orders).withColumns({"pkg_path": F.lit("lib"), "end_line": F.col("line") + 2})


@query(DECLS_SQL + "SELECT id, kind AS type, name, file AS file_path, CAST(line AS BIGINT) AS first, CAST(line + 2 AS BIGINT) AS last FROM d WHERE name <> '_'", prefix=False)
def rule_declaration_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = rules.declaration_rules(_decls(spark, sf_dir))[0]
    return nodes.select("id", "type", "name", "file_path", F.col("line_start").cast("long").alias("first"), F.col("line_end").cast("long").alias("last"))


@query(
    DECLS_SQL + """, n AS (SELECT * FROM d WHERE name <> '_')
SELECT n.file AS src, n.id AS dst FROM n LEFT JOIN n o ON n.owner = o.id WHERE o.kind IS DISTINCT FROM 'INTERFACE'
UNION ALL SELECT owner, id FROM n WHERE owner <> ''""", prefix=False,
)
def rule_declaration_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files contain what they declare, but for an interface's methods; a method's type contains it."""
    return rules.declaration_rules(_decls(spark, sf_dir))[1].select("src", "dst")


USES_SQL = PACKAGES_SQL + """, u AS (SELECT 'k' || l_suppkey % 40 AS src, 'k' || l_partkey % 40 AS dst, 'lib/' || n_name AS pkg, l_linenumber AS line, l_suppkey AS col,
  CASE l_linenumber % 3 WHEN 0 THEN 'type' WHEN 1 THEN 'literal' ELSE 'init' END AS how FROM lineitem JOIN nation ON l_partkey % 25 = n_nationkey),
i AS (SELECT * FROM u WHERE src <> dst AND pkg IN (SELECT pkg_path FROM pk WHERE internal)) """


@query(
    USES_SQL + """SELECT src, dst, type, CAST(sum(places) AS BIGINT) AS places FROM (
  SELECT DISTINCT src, dst, 'REFERENCES' AS type, 0 AS places FROM i WHERE how <> 'literal'
  UNION ALL SELECT src, dst, t, 1 FROM i, (VALUES ('REFERENCES'), ('INSTANTIATES')) AS v(t) WHERE how = 'literal') GROUP BY ALL""", prefix=False,
)
def rule_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of types and initialisers once, literals with every place; none to oneself or outside."""
    t = Commerce(spark, sf_dir)
    rows = t.lineitem.join(F.broadcast(t.nation), F.col("l_partkey") % 25 == F.col("n_nationkey"))
    how = F.element_at(F.array(F.lit("type"), F.lit("literal"), F.lit("init")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    uses = rows.select(
        F.concat(F.lit("k"), F.col("l_suppkey") % 40).alias("src"), F.concat(F.lit("k"), F.col("l_partkey") % 40).alias("dst"),
        _text("lib/", "n").alias("dst_pkg"), how.alias("how"), F.lit("u.go").alias("file"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("column"),
    )
    edges = rules.use_edges(uses, _internal(spark, sf_dir))
    return edges.groupBy("src", "dst", "type").agg(F.sum(F.size("occurrences")).alias("places"))


CALLS_SQL = PACKAGES_SQL + """, c AS (SELECT 'o/' || l_orderkey AS src, 'p/' || l_partkey AS dst, 'lib/' || n_name AS pkg, 'P' || l_partkey AS name, l_linenumber AS line, l_suppkey AS col
  FROM lineitem JOIN nation ON l_partkey % 25 = n_nationkey) """


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = Commerce(spark, sf_dir)
    rows = t.lineitem.join(F.broadcast(t.nation), F.col("l_partkey") % 25 == F.col("n_nationkey"))
    calls = rows.select(
        _text("o/", "l_orderkey").alias("src"), _text("p/", "l_partkey").alias("dst"), _text("lib/", "n").alias("dst_pkg"),
        _text("P", "l_partkey").alias("dst_name"), F.lit("o.go").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("column"),
    )
    return rules.call_rules(calls, _internal(spark, sf_dir))


@query(CALLS_SQL + "SELECT src, dst, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS at FROM c", prefix=False)
def rule_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _calls(spark, sf_dir)[1].select("src", "dst", F.explode("occurrences").alias("o"))
    return rows.select("src", "dst", F.col("o.line").cast("long").alias("line"), F.col("o.column").cast("long").alias("at"))


@query(CALLS_SQL + "SELECT DISTINCT dst AS id, name, pkg AS pkg_path FROM c WHERE pkg NOT IN (SELECT pkg_path FROM pk WHERE internal)", prefix=False)
def rule_outside_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir)[0].select("id", "name", "pkg_path")


@query(
    """WITH s AS (SELECT event_id AS k, 'u/' || user_id AS src, 'lib.goroutine_L' || event_id || '_C' || (user_id % 80) AS id,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'f/' || event_type END AS callee FROM events)
SELECT src, id AS dst, 'SPAWNS' AS type FROM s UNION ALL SELECT id, callee, 'CALLS' FROM s WHERE callee <> ''""",
    prefix=False,
)
def rule_spawns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    spawns = Commerce(spark, sf_dir).events.select(
        _text("u/", "user_id").alias("src"), F.lit("lib").alias("pkg_path"), F.lit("g.go").alias("file"), k.alias("line"),
        (k + 3).alias("end_line"), (F.col("user_id") % 80).alias("column"),
        F.when(k % 3 == 0, "").otherwise(_text("f/", "event_type")).alias("callee"), F.lit("lib").alias("callee_pkg"),
    )
    return rules.spawn_rules(spawns)[1].select("src", "dst", "type")


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A channel for each user, by the place of its declaration; values above 100 are sent, others received."""
    events = Commerce(spark, sf_dir).events
    place = (F.lit("lib"), F.lit("c.go"), F.col("user_id").cast("string"), F.lit("7"), F.lit("ch"))
    channels = events.select("user_id").distinct().select(
        rules.channel_id(*place).alias("id"), F.lit("ch").alias("name"), F.lit("int").alias("elem"), F.lit("lib").alias("pkg_path"),
        F.lit("c.go").alias("file"), F.col("user_id").alias("line"),
    )
    ops = events.select(
        rules.function_id(F.lit("lib"), F.col("event_type")).alias("src"), rules.channel_id(*place).alias("channel"),
        F.when(F.col("value") > 100, "send").otherwise("receive").alias("op"),
    )
    return rules.channel_rules(channels, ops)


@query("SELECT DISTINCT 'channel:lib:c.go:' || user_id || ':7:ch' AS id, 'ch (chan int)' AS name, CAST(user_id AS BIGINT) AS line FROM events", prefix=False)
def rule_channel_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir)[0].select("id", "name", F.col("line_start").cast("long").alias("line"))


@query(
    """SELECT DISTINCT 'lib.' || event_type AS src, 'channel:lib:c.go:' || user_id || ':7:ch' AS dst,
  CASE WHEN value > 100 THEN 'SENDS_TO' ELSE 'RECEIVES_FROM' END AS type FROM events""",
    prefix=False,
)
def rule_channel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir)[1].select("src", "dst", "type")


ROUTES_SQL = """WITH r AS (SELECT page_id, page_id % 2 = 0 AS std, page_id % 4 < 2 AS said, page_id % 7 = 0 AS unknown FROM pages),
m AS (SELECT page_id, CASE WHEN std AND said THEN 'GET' WHEN std THEN 'ANY' WHEN said THEN 'POST' ELSE 'ANY' END AS method,
  CASE WHEN std THEN '/p/' ELSE '/api/p/' END || page_id AS path FROM r WHERE NOT unknown),
i AS (SELECT page_id, method, path, 'r.go::route:' || method || ':' || path AS id FROM m) """


def _routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even pages are patterns of the standard library, odd ones of groups below /api; every seventh is unresolved."""
    k = F.col("page_id")
    std, said, path = k % 2 == 0, k % 4 < 2, F.concat(F.lit("/p/"), k.cast("string"))
    handler = F.concat(F.lit("h/"), (k % 5).cast("string"))
    routes = Commerce(spark, sf_dir).pages.select(
        F.lit("r.go").alias("file"), _text("own/", "page_id").alias("owner"), F.when(std, "net/http").otherwise("gin").alias("framework"),
        F.when(~std & said, "post").alias("method"), F.when(std, "").otherwise("/api/").alias("prefix"),
        F.when(k % 7 == 0, None).when(std & said, F.concat(F.lit("GET "), path)).otherwise(path).alias("pattern"),
        F.array(handler, F.lit("auth"), handler).alias("handlers"), F.lit("lib").alias("pkg_path"), k.alias("line"),
    )
    return rules.route_rules(routes)


@query(ROUTES_SQL + "SELECT id, method || ' ' || path AS name FROM i", prefix=False)
def rule_route_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir)[0].select("id", "name")


@query(
    ROUTES_SQL + """SELECT 'r.go' AS src, id AS dst, 'CONTAINS' AS type FROM i UNION ALL SELECT 'own/' || page_id, id, 'REGISTERS_ROUTE' FROM i
UNION ALL SELECT id, 'h/' || (page_id % 5), 'REFERENCES' FROM i UNION ALL SELECT id, 'auth', 'REFERENCES' FROM i""", prefix=False,
)
def rule_route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir)[1].select("src", "dst", "type")


@query("SELECT 'lib.' || c_name AS func, 'lib.' || c_mktsegment || '.' || c_name AS method FROM customer", prefix=False)
def rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib, name = F.lit("lib"), F.col("c_name")
    return Commerce(spark, sf_dir).customer.select(
        rules.function_id(lib, name).alias("func"), rules.method_id(lib, F.col("c_mktsegment"), name).alias("method")
    )


# -- the store


def _store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The commerce graph as a store of its own."""
    store = GraphStore(spark, f"{shared_folder(spark)}/quiver/{uuid.uuid4().hex}/store")
    store.save(graph_of(spark, sf_dir))
    return store


@query("SELECT id, type, name, pkg_path, file_path, CAST(line_start AS BIGINT) AS line_start, repo_id FROM nodes")
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir).scan()
    return rows.select("id", "type", "name", "pkg_path", "file_path", F.col("line_start").cast("long").alias("line_start"), "repo_id")


@query("SELECT id, name FROM nodes WHERE starts_with(id, 'c/1')")
def store_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).scan_prefix("c/1").select("id", "name")


@query("SELECT id, type, name FROM nodes WHERE id = 's/3'")
def store_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = _store(spark, sf_dir).get("s/3")
    return spark.createDataFrame([(node["id"], node["type"], node["name"])], "id string, type string, name string")


@query(
    """SELECT id, name FROM nodes WHERE id NOT IN ('s/3', 's/4') UNION ALL SELECT 'new/' || r_name, 'new' FROM region"""
)
def store_put_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are put are there, also those already known; removed ones aren't, and a missing one is no error."""
    store = _store(spark, sf_dir)
    regions = Commerce(spark, sf_dir).region.select(_text("new/", "r_name").alias("id"), F.lit("new").alias("name"), F.lit("REPO").alias("type"))
    known = graph_of(spark, sf_dir).nodes.filter("id = 's/5'").select("id", F.lit("other").alias("name"), "type")
    store.put(nodes=with_defaults(regions.unionByName(known), NODES))
    store.remove("s/3", "s/4", "nobody")
    return store.scan().select("id", "name")
