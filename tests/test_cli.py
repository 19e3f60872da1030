from __future__ import annotations

import json
import subprocess

import pytest

from quiver.cli import main
from quiver.operators.context import node_context
from quiver.sinks import markdown
from tests.graphs import graph, node


@pytest.fixture
def facts(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.go").write_text("package p\n" * 30)
    (root / "README.md").write_text("x")
    path = str(root / "a.go")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-qm", "first")
    t = spark.createDataFrame
    tables = {
        "packages": t([("m/p", "p", True)], "pkg_path string, name string, internal boolean"),
        "files": t([("m/p", path)], "pkg_path string, path string"),
        "decls": t([("m/p.F", "FUNC", "F", "m/p", path, 10, 20, ""), ("m/p.G", "FUNC", "G", "m/p", path, 21, 25, "")], "id string, kind string, name string, pkg_path string, file string, line int, end_line int, owner string"),
        "calls": t([("m/p.G", "m/p.F", "m/p", "F", path, 22, 1)], "src string, dst string, dst_pkg string, dst_name string, file string, line int, column int"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/facts/{name}.parquet")
    return tmp_path


def run(capsys, *args):
    code = main(args)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_store_commands(spark, facts, capsys):
    store, root = f"file://{facts}/store", str(facts / "repo")
    code, out, _ = run(capsys, "analyze", "--facts", f"{facts}/facts", "--store", store, "--repo", "r", "--root", root)
    assert code == 0 and "nodes_by_kind FUNC: 2" in out
    code, out, _ = run(capsys, "query", "--store", store, "MATCH (a)-[:CALLS]->(b) RETURN a.Name, b.Name")
    assert code == 0 and json.loads(out) == [{"a.Name": "G", "b.Name": "F"}]
    code, out, err = run(capsys, "query", "--store", store, "MATCH (a:CLASS) RETURN a")
    assert code == 1 and out == "" and "CLASS" in err
    assert json.loads(run(capsys, "export", "--store", store)[1])["edges"]
    assert run(capsys, "export", "--store", store, "--format", "dot")[1].startswith("digraph G {")
    assert json.loads(run(capsys, "stats", "--store", store, "--json")[1])
    impact = ("impact", "--store", store, "--root", root, "--repo", "r")
    code, out, _ = run(capsys, *impact, "--strict")
    assert code == 0 and "No changes detected." in out
    lines = (facts / "repo" / "a.go").read_text().split("\n")
    lines[11] = "changed"
    (facts / "repo" / "a.go").write_text("\n".join(lines))
    code, out, err = run(capsys, *impact, "--strict", "--json")
    report = json.loads(out)
    assert code == 1 and "stale" in err and [n["id"] for n in report["impacted_nodes"]] == ["m/p.G"]


def test_workspace_commands(tmp_path, capsys):
    file = ("--file", str(tmp_path / "w.json"))
    assert run(capsys, "workspace", "init", "demo", *file)[0] == 0
    assert run(capsys, "workspace", "add", "a", str(tmp_path), *file)[0] == 0
    assert run(capsys, "workspace", "list", *file)[1].startswith("a\t")
    assert json.loads(run(capsys, "workspace", "show", *file)[1])["name"] == "demo"
    assert run(capsys, "workspace", "init", "demo", *file)[0] == 1
    assert run(capsys, "workspace", "remove", "b", *file)[0] == 1
    assert run(capsys, "version")[1].startswith("quiver ")


def test_markdown(spark):
    g = graph(spark, [node("A:FUNC"), node("B:FUNC"), node("c:CHANNEL")], ["A -CALLS-> B", "A -SENDS_TO-> c"])
    from quiver.operators.concurrency import concurrency_graph
    from quiver.operators.traversal import find_path

    assert "`B` (FUNC)" in markdown.node_list("Nodes", g.nodes) and "_None found._" in markdown.node_list("Nodes", g.nodes.limit(0))
    assert "SENDS_TO `c`" in markdown.concurrency("Around", concurrency_graph(g, "A"))
    assert "-CALLS->" in markdown.path(find_path(g, "A", "B"))
    text = markdown.context(node_context(g, "A"))
    assert "## Dependencies" in text and "## Warnings" in text
    assert markdown.source({"id": "x"}, "a ``` b").count("````") == 2
