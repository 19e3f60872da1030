from __future__ import annotations

import io
import json

import pytest

from quiver.graph import PropertyGraph
from quiver.operators import neighbours, stats, structure
from quiver.schema import GraphError, NotFound
from quiver.sinks.export import read_json, result_json, write_dot, write_json, write_mermaid
from quiver.sources.storage import GraphStore, load_all, metadata_table
from quiver.sources.workspace import Workspace
from tests.graphs import edge, graph, ids, node, rows


def edges_of(g):
    return rows(g.live_edges.select("src", "type", "dst"))


def test_merge_nodes(spark):
    g = graph(spark, [node("x:BOUNDARY", name="placeholder"), node("x:FUNC", name="real"), node("x:METHOD", name="late"), node("x:BOUNDARY")], [])
    assert rows(g.nodes.select("type", "name")) == {("FUNC", "real")}


def test_merge_occurrences(spark):
    a, b = ("main.go", 10, 2), ("main.go", 12, 2)
    g = graph(spark, ["f:FUNC", "g:FUNC"], [edge("f -CALLS-> g", a, repo_id="r1"), edge("f -CALLS-> g", b, repo_id="r2"), edge("f -CALLS-> g", b, a)])
    (row,) = g.edges.collect()
    assert [tuple(o) for o in row.occurrences] == [a, b] and row.repo_id == "r1"
    twice = graph(spark, ["f:FUNC", "g:FUNC"], [edge("f -CALLS-> g", a, a), edge("f -CALLS-> g", b, b)])
    assert [tuple(o) for o in twice.edges.collect()[0].occurrences] == [a, a, b]  # the first edge's stay as they are


def test_ids_with_colons(spark):
    g = graph(spark, [node("a:b:FUNC"), node("c:FUNC"), node("a:FUNC"), node("b:c:FUNC")], ["a:b -CALLS-> c", "a -CALLS-> b:c"])
    assert len(edges_of(g)) == 2


def test_dangling_edges_wait(spark):
    g = graph(spark, ["file:FILE"], ["file -IMPORTS-> pkg"])
    assert edges_of(g) == set()
    with pytest.raises(NotFound):
        graph(spark, ["a:FUNC"], []).add_edges(graph(spark, [], ["a -CALLS-> b"]).edges)
    both = PropertyGraph.merged([g, graph(spark, ["pkg:PACKAGE"], [])])
    assert edges_of(both) == {("file", "IMPORTS", "pkg")}


def test_remove_and_resurrect(spark):
    a, b = node("pkgA.FuncA:FUNC", pkg_path="pkgA"), node("pkgB.FuncB:FUNC", pkg_path="pkgB")
    g = graph(spark, [a, b], ["pkgA.FuncA -CALLS-> pkgB.FuncB", "pkgB.FuncB -CALLS-> pkgA.FuncA"])
    gone = g.remove_package("pkgB")
    assert edges_of(gone) == set()
    with pytest.raises(NotFound):
        neighbours.dependencies(gone, "pkgB.FuncB")
    back = gone.add_nodes(graph(spark, [b], []).nodes)
    assert edges_of(back) == {("pkgA.FuncA", "CALLS", "pkgB.FuncB")}


def test_replace_structure(spark):
    nodes = ["folder:.:FOLDER", "folder:old:FOLDER", node("p:PACKAGE", pkg_path="p"), node("p.F:FUNC", pkg_path="p"), node("old.txt:FILE"), node("p.go:FILE", pkg_path="p")]
    nodes[0], nodes[1] = node("folder:.:FOLDER"), node("folder:old:FOLDER")
    g = graph(spark, nodes, ["folder:. -CONTAINS-> folder:old", "folder:old -CONTAINS-> p", "folder:old -CONTAINS-> old.txt", "p -CONTAINS-> p.go"])
    fresh = graph(spark, [node("folder:.:FOLDER"), node("folder:new:FOLDER")], ["folder:. -CONTAINS-> folder:new", "folder:new -CONTAINS-> p"])
    done = g.replace_structure(fresh)
    assert set(ids(done.nodes)) == {"folder:.", "folder:new", "p", "p.F", "p.go"}
    assert edges_of(done) == {("folder:.", "CONTAINS", "folder:new"), ("folder:new", "CONTAINS", "p"), ("p", "CONTAINS", "p.go")}


def test_statistics(spark):
    nodes = [
        node("folder:.:FOLDER", repo_id="repo-a"), node("pkg:PACKAGE", pkg_path="pkg", repo_id="repo-a"),
        node("f.go:FILE", pkg_path="pkg", file_path="f.go", repo_id="repo-a"), node("pkg.F:FUNC", pkg_path="pkg", repo_id="repo-a"), node("fmt:BOUNDARY"),
    ]
    g = graph(spark, nodes, ["pkg -CONTAINS-> f.go", "pkg.F -CALLS-> fmt"])
    t = stats.totals(g).first()
    assert (t.node_count, t.edge_count, t.file_nodes, t.source_files) == (5, 2, 1, 1) and t.estimated_bytes > 0
    assert [tuple(r) for r in stats.top_packages(g).collect()] == [("pkg", 3)]
    assert rows(stats.nodes_by_repo(g)) == {("repo-a", 4)}
    long = {(r.metric, r.key): r[2] for r in stats.statistics(g).collect()}
    assert long["nodes_by_kind", "FUNC"] == 1 and long["edge_count", ""] == 2
    empty = graph(spark, [], [])
    assert stats.totals(empty).first().node_count == 0


def test_repo_roots_and_packages(spark):
    g = graph(
        spark,
        [
            node("repo:b:folder:.:FOLDER", repo_id="b", file_path="/b"), node("repo:a:folder:.:FOLDER", repo_id="a", file_path="/a"),
            node("repo:a:folder:internal:FOLDER", repo_id="a", file_path="/a/internal"), node("x:FUNC", pkg_path="m/x", file_path="/a/x/x.go"),
            node("y:FUNC", pkg_path="m", file_path="/a/y.go"),
        ],
        [],
    )
    assert [tuple(r) for r in structure.repo_roots(g).collect()] == [("a", "/a"), ("b", "/b")]
    assert rows(structure.packages_in(g, "/a")) == {("m",)}
    assert rows(structure.packages_in(g, "/a", recursive=True)) == {("m",), ("m/x",)}
    assert {r.folder: r.packages for r in structure.package_folders(g.nodes, "/a").collect()} == {".": ["m"], "x": ["m/x"]}


def test_json_round_trip(spark, tmp_path):
    g = graph(spark, [node("A:FUNC", line_start=3, line_end=4), node("B:FUNC")], [edge("A -CALLS-> B", ("m.go", 1, 0))])
    out = io.StringIO()
    write_json(g, out)
    data = json.loads(out.getvalue())
    assert len(data["nodes"]) == 2 and data["edges"][0]["occurrences"] == [{"filepath": "m.go", "line": 1}]
    (tmp_path / "g.json").write_text(out.getvalue())
    again = read_json(spark, str(tmp_path / "g.json"))
    assert rows(again.nodes) == rows(g.nodes)
    assert json.loads(result_json(g.nodes.filter("id = 'none'"))) == []


def test_mermaid_and_dot(spark):
    nodes = [
        {"id": "workspace:demo", "type": "WORKSPACE", "name": "demo"}, {"id": "repo:lvl2:folder:.", "type": "FOLDER", "name": 'a "b"\nc'},
        {"id": "A", "name": "A"}, {"id": "1B", "name": "B"},
    ]
    g = graph(spark, nodes, [edge("A -CALLS-> 1B", ("main.go", 10, 2), ("main.go", 12, 4)), "workspace:demo -CONTAINS-> repo:lvl2:folder:."])
    out = io.StringIO()
    write_mermaid(g, out)
    text = out.getvalue()
    assert text.startswith("flowchart TD\n") and '    workspace_demo["demo:WORKSPACE"]' in text
    assert '    repo_lvl2_folder__["a \\"b\\"\\nc:FOLDER"]' in text and "    A -->|CALLS| _1B" in text and '    A["A"]' in text
    out = io.StringIO()
    write_dot(g, out)
    text = out.getvalue()
    assert '"A" -> "1B" [label="CALLS", occurrences="2", lines="main.go:10:2,main.go:12:4"];' in text
    assert '"workspace:demo" -> "repo:lvl2:folder:." [label="CONTAINS"];' in text and text.rstrip().endswith("}")


def test_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(NotFound):
        store.load()
    store.save(graph(spark, [node("a:FUNC", repo_id="r1"), node("b:FUNC", repo_id="r2")], ["a -CALLS-> b"]), [{"repo_id": "r1"}])
    assert store.get("a")["repo_id"] == "r1" and edges_of(store.load()) == {("a", "CALLS", "b")}
    assert ids(store.scan_prefix("a")) == ["a"]
    store.put(nodes=graph(spark, ["c:FUNC"], []).nodes, edges=graph(spark, [], ["c -CALLS-> a"]).edges)
    assert ("c", "CALLS", "a") in edges_of(store.load())
    store.remove("b", "nobody")
    assert sorted(ids(store.scan())) == ["a", "c"]
    assert store.metadata().first().repo_id == "r1" and store.size() > 0
    assert store.compact() == 2 and sorted(ids(store.scan())) == ["a", "c"]
    with pytest.raises(GraphError):
        GraphStore(spark, store.path, read_only=True).save(store.load())
    (tmp_path / "store" / "notes.txt").write_text("mine")
    with pytest.raises(GraphError):
        store.delete()
    (tmp_path / "store" / "notes.txt").unlink()
    (tmp_path / "store" / ".notes.txt.crc").unlink(missing_ok=True)
    store.delete()
    with pytest.raises(NotFound):
        store.load()


def test_metadata_defaults(spark):
    row = metadata_table(spark, [{"repo_id": "x"}]).first()
    assert row.schema_version == 1 and row.analyzed_at is not None and row.git_available is False


def test_workspace(spark, tmp_path):
    w = Workspace("demo")
    w.add("service-b", str(tmp_path / "b"))
    w.add("service-a", str(tmp_path / "a"))
    for bad in ("a/b", "", ".."):
        with pytest.raises(GraphError):
            w.add(bad, str(tmp_path / "c"))
    with pytest.raises(GraphError):
        w.add("other", str(tmp_path / "a"))
    w.save(str(tmp_path / "w.json"))
    again = Workspace.load(str(tmp_path / "w.json"))
    assert again.repos == w.repos
    a, b = again.stores(spark, f"file://{tmp_path}/stores")
    a.save(graph(spark, [node("f:FILE", repo_id="service-a"), node("dup:BOUNDARY")], [edge("f -IMPORTS-> pkg", repo_id="service-a")]))
    b.save(graph(spark, [node("pkg:PACKAGE", repo_id="service-b"), node("dup:FUNC")], []))
    merged = load_all([a, b])
    assert edges_of(merged) == {("f", "IMPORTS", "pkg")} and merged.node("dup")["type"] == "FUNC"
    again.remove("service-a")
    with pytest.raises(NotFound):
        again.remove("service-a")
