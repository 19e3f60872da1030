"""Graph exports as text lines made by column expressions, and the writers that stream them."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions.text import escaped, identifier
from quiver.graph import PropertyGraph


def json_rows(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """One column ``json`` each for nodes and edges, with the exchange format's names; empty occurrences and zeros left out."""
    nodes = graph.nodes.select(
        F.to_json(
            F.struct(
                F.col("id").alias("ID"), F.col("type").alias("Type"), F.col("name").alias("Name"),
                F.col("pkg_path").alias("PkgPath"), F.col("file_path").alias("FilePath"),
                F.array("line_start", "line_end").alias("Lines"), F.col("repo_id").alias("RepoID"),
            )
        ).alias("json")
    )
    place = F.transform(
        "occurrences",
        lambda o: F.struct(
            F.nullif(o["filepath"], F.lit("")).alias("filepath"),
            F.nullif(o["line"], F.lit(0)).alias("line"),
            F.nullif(o["column"], F.lit(0)).alias("column"),
        ),
    )
    edges = graph.live_edges.select(
        F.to_json(
            F.struct(
                F.col("src").alias("From"), F.col("dst").alias("To"), F.col("type").alias("Type"),
                F.col("repo_id").alias("RepoID"), F.when(F.size("occurrences") > 0, place).alias("occurrences"),
            )
        ).alias("json")
    )
    return nodes, edges


def write_json(graph: PropertyGraph, out: TextIO) -> None:
    """{"nodes": [...], "edges": [...]}, indented; one partition in the driver's memory at a time."""
    nodes, edges = json_rows(graph)
    out.write("{\n")
    for name, rows, end in (("nodes", nodes, ",\n"), ("edges", edges, "\n")):
        out.write(f'  "{name}": [')
        empty = True
        for row in rows.toLocalIterator():
            body = json.dumps(json.loads(row.json), indent=2, ensure_ascii=False).replace("\n", "\n    ")
            out.write(("\n    " if empty else ",\n    ") + body)
            empty = False
        out.write(("]" if empty else "\n  ]") + end)
    out.write("}")


def read_json(spark, path: str) -> PropertyGraph:  # noqa: ANN001
    """A graph from the exchange format."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    nodes = [
        {
            "id": n["ID"], "type": n.get("Type", ""), "name": n.get("Name", ""), "pkg_path": n.get("PkgPath", ""),
            "file_path": n.get("FilePath", ""), "line_start": (n.get("Lines") or [0, 0])[0],
            "line_end": (n.get("Lines") or [0, 0])[1], "repo_id": n.get("RepoID", ""),
        }
        for n in data["nodes"]
    ]
    edges = [
        {
            "src": e["From"], "dst": e["To"], "type": e["Type"], "repo_id": e.get("RepoID", ""),
            "occurrences": [(o.get("filepath", ""), o.get("line", 0), o.get("column", 0)) for o in e.get("occurrences") or []],
        }
        for e in data["edges"]
    ]
    return PropertyGraph.of(spark, nodes, edges)


def mermaid_lines(graph: PropertyGraph) -> DataFrame:
    """part (0 nodes, 1 edges), key, line of a Mermaid flowchart; the header is the writer's."""
    label = F.when(F.col("type") == "", F.col("name")).otherwise(F.concat("name", F.lit(":"), "type"))
    nodes = graph.nodes.select(
        F.lit(0).alias("part"), F.col("id").alias("key"),
        F.concat(F.lit("    "), identifier(F.col("id")), F.lit('["'), escaped(label), F.lit('"]')).alias("line"),
    )
    edges = graph.live_edges.select(
        F.lit(1).alias("part"), F.concat_ws("\0", "src", "dst", "type").alias("key"),
        F.concat(
            F.lit("    "), identifier(F.col("src")), F.lit(" -->|"), escaped(F.col("type")), F.lit("| "), identifier(F.col("dst"))
        ).alias("line"),
    )
    return nodes.unionByName(edges)


def dot_lines(graph: PropertyGraph) -> DataFrame:
    """part, key, line of a DOT digraph; edges carry the number and places of their occurrences."""
    quoted = lambda c: F.concat(F.lit('"'), escaped(c), F.lit('"'))
    shown = F.concat(F.lit('"'), F.when(F.col("type") == "", escaped(F.col("name"))).otherwise(
        F.concat(escaped(F.col("name")), F.lit("\\n"), escaped(F.col("type")))), F.lit('"'))
    nodes = graph.nodes.select(
        F.lit(0).alias("part"), F.col("id").alias("key"),
        F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), shown, F.lit("];")).alias("line"),
    )
    places = F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["filepath"], o["line"], o["column"])), ",")
    more = F.when(
        F.size("occurrences") > 0,
        F.concat(F.lit(', occurrences="'), F.size("occurrences"), F.lit('", lines='), quoted(places)),
    ).otherwise("")
    edges = graph.live_edges.select(
        F.lit(1).alias("part"), F.concat_ws("\0", "src", "dst", "type").alias("key"),
        F.concat(
            F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(F.col("type")),
            more, F.lit("];"),
        ).alias("line"),
    )
    return nodes.unionByName(edges)


def _write(lines: DataFrame, out: TextIO, head: list[str], tail: list[str]) -> None:
    for x in head:
        out.write(x + "\n")
    for row in lines.orderBy("part", "key").select("line").toLocalIterator():
        out.write(row.line + "\n")
    for x in tail:
        out.write(x + "\n")


def write_mermaid(graph: PropertyGraph, out: TextIO) -> None:
    _write(mermaid_lines(graph), out, ["flowchart TD"], [])


def write_dot(graph: PropertyGraph, out: TextIO) -> None:
    _write(dot_lines(graph), out, ["digraph G {", "  node [shape=box];"], ["}"])


def result_json(rows: DataFrame) -> str:
    """A query's result as an indented JSON array; none is []."""
    return json.dumps([json.loads(x) for x in rows.toJSON().collect()], indent=2, ensure_ascii=False)
