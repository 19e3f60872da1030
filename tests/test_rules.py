from __future__ import annotations

from quiver import lineage
from quiver.rules import extraction
from quiver.rules.extraction import channel_flow, graph_of_facts, implements, route_rules
from quiver.sources import filesystem
from quiver.sources.packages import selected
from tests.graphs import graph, rows


def edges_of(g):
    return rows(g.live_edges.select("src", "type", "dst"))


def test_channel_flow(spark):
    edges = graph(spark, [], ["producer -SENDS_TO-> p.out", "consumer -RECEIVES_FROM-> c.in", "relay -SENDS_TO-> r.ch", "relay -RECEIVES_FROM-> r.ch", "producer -SENDS_TO-> out"]).edges
    flows = spark.createDataFrame([("producer", "p.out", "out"), ("producer", "p.out", "out2"), ("consumer", "c.in", "in"), ("idle", "i.in", "in"), ("relay", "r.ch", "in")], "callee string, param string, arg string")
    assert rows(channel_flow(flows, edges)) == {("producer", "out2", "SENDS_TO"), ("consumer", "in", "RECEIVES_FROM"), ("relay", "in", "SENDS_TO"), ("relay", "in", "RECEIVES_FROM")}


def test_implements(spark):
    methods = spark.createDataFrame([("T", "Read", "()"), ("T", "Write", "()"), ("U", "Read", "()"), ("V", "Read", "(int)")], "type string, name string, signature string")
    wanted = spark.createDataFrame([("RW", "Read", "()"), ("RW", "Write", "()"), ("R", "Read", "()")], "interface string, name string, signature string")
    assert rows(implements(methods, wanted)) == {("T", "RW"), ("T", "R"), ("U", "R")}


def test_routes(spark):
    facts = spark.createDataFrame(
        [
            ("f.go", "reg", "net/http", None, "GET /healthz", ["h", "h", "m"], "p", 3, None), ("f.go", "reg", "net/http", None, "/plain", ["h"], "p", 4, None),
            ("f.go", "reg", "gin", "post", "users/", ["h"], "p", 5, "/api"), ("f.go", "reg", "gin", "GET", None, ["h"], "p", 6, None),
        ],
        "file string, owner string, framework string, method string, pattern string, handlers array<string>, pkg_path string, line int, prefix string",
    )
    nodes, edges = route_rules(facts)
    assert rows(nodes.select("id", "name")) == {("f.go::route:GET:/healthz", "GET /healthz"), ("f.go::route:ANY:/plain", "ANY /plain"), ("f.go::route:POST:/api/users/", "POST /api/users/")}
    got = rows(edges.filter("src = 'f.go::route:GET:/healthz' or dst = 'f.go::route:GET:/healthz'").select("src", "type", "dst"))
    assert got == {("f.go", "CONTAINS", "f.go::route:GET:/healthz"), ("reg", "REGISTERS_ROUTE", "f.go::route:GET:/healthz"), ("f.go::route:GET:/healthz", "REFERENCES", "h"), ("f.go::route:GET:/healthz", "REFERENCES", "m")}


def test_all_rules(spark):
    t = spark.createDataFrame
    place = "file string, line int, column int"
    facts = {
        "packages": t([("m/p", "p", True), ("fmt", "fmt", False)], "pkg_path string, name string, internal boolean"),
        "files": t([("m/p", "/m/p/a.go")], "pkg_path string, path string"),
        "imports": t([("/m/p/a.go", "net/http")], "file string, pkg_path string"),
        "decls": t(
            [("m/p.T", "STRUCT", "T", "m/p", "/m/p/a.go", 1, 2, ""), ("m/p.I", "INTERFACE", "I", "m/p", "/m/p/a.go", 3, 5, ""), ("m/p.I.Do", "METHOD", "Do", "m/p", "/m/p/a.go", 4, 4, "m/p.I"),
             ("m/p.T.Do", "METHOD", "Do", "m/p", "/m/p/a.go", 6, 9, "m/p.T"), ("m/p.main", "FUNC", "main", "m/p", "/m/p/a.go", 10, 20, ""), ("m/p._", "VARIABLE", "_", "m/p", "/m/p/a.go", 21, 21, "")],
            "id string, kind string, name string, pkg_path string, file string, line int, end_line int, owner string",
        ),
        "uses": t([("m/p.main", "m/p.T", "m/p", "literal", "/m/p/a.go", 11, 2), ("m/p.T", "m/p.T", "m/p", "type", "/m/p/a.go", 1, 1), ("m/p.main", "fmt.X", "fmt", "type", "/m/p/a.go", 11, 2)], "src string, dst string, dst_pkg string, how string, " + place),
        "calls": t([("m/p.main", "fmt.Println", "fmt", "Println", "/m/p/a.go", 12, 3), ("m/p.main", "fmt.Println", "fmt", "Println", "/m/p/a.go", 13, 3)], "src string, dst string, dst_pkg string, dst_name string, " + place),
        "spawns": t([("m/p.main", "m/p", "/m/p/a.go", 14, 14, 2, "m/p.T.Do", "m/p")], "src string, pkg_path string, file string, line int, end_line int, column int, callee string, callee_pkg string"),
        "channels": t([("ch", "ch", "int", "m/p", "/m/p/a.go", 15)], "id string, name string, elem string, pkg_path string, file string, line int"),
        "chan_ops": t([("m/p.T.Do", "ch", "send")], "src string, channel string, op string"),
        "methods": t([("m/p.T", "Do", "()")], "type string, name string, signature string"),
        "interface_methods": t([("m/p.I", "Do", "()")], "interface string, name string, signature string"),
    }
    g = graph_of_facts(facts, "r")
    go = "m/p.goroutine_L14_C2"
    assert edges_of(g) >= {
        ("m/p", "CONTAINS", "/m/p/a.go"), ("/m/p/a.go", "IMPORTS", "net/http"), ("/m/p/a.go", "CONTAINS", "m/p.T"), ("m/p.I", "CONTAINS", "m/p.I.Do"), ("m/p.T", "CONTAINS", "m/p.T.Do"),
        ("m/p.main", "REFERENCES", "m/p.T"), ("m/p.main", "INSTANTIATES", "m/p.T"), ("m/p.main", "CALLS", "fmt.Println"), ("m/p.main", "SPAWNS", go), (go, "CALLS", "m/p.T.Do"),
        ("m/p.T.Do", "SENDS_TO", "ch"), ("m/p.T", "IMPLEMENTS", "m/p.I"),
    }
    assert ("/m/p/a.go", "CONTAINS", "m/p.I.Do") not in edges_of(g) and ("m/p.T", "REFERENCES", "m/p.T") not in edges_of(g)
    assert g.node("net/http") | {} == {**g.node("net/http"), "type": "BOUNDARY", "name": "http"}
    (call,) = g.edges.filter("dst = 'fmt.Println'").collect()
    assert [(o.line, o.column) for o in call.occurrences] == [(12, 3), (13, 3)]
    assert g.nodes.filter("name = '_'").isEmpty()
    assert ("m/p.T", "IMPLEMENTS", "m/p.I") not in edges_of(graph_of_facts(facts, implement=False))


def test_package_selection(spark):
    packages = spark.createDataFrame([("a", False, 3, 0), ("a [a.test]", True, 2, 1), ("b", False, 1, 2), ("b", False, 2, 3), ("a.test", False, 9, 4)], "pkg_path string, for_test boolean, n_files int, load_order int")
    assert rows(selected(packages).select("path", "load_order")) == {("a", 1), ("b", 3)}


def test_filesystem(spark, tmp_path):
    for p in ("a.go", "docs/x.md", ".gitignore", ".secret", "vendor/v.md", ".git/config", "pkg/sub/y.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    root = str(tmp_path)
    packages = spark.createDataFrame([("pkg/sub", "m/sub")], "folder string, pkg_path string")
    g = filesystem.structure(filesystem.listed_files(spark, root), root, packages)
    assert {r.id for r in g.nodes.filter("type = 'FOLDER'").collect()} == {"folder:.", "folder:docs", "folder:pkg", "folder:pkg/sub"}
    assert {r.name for r in g.nodes.filter("type = 'FILE'").collect()} == {"x.md", ".gitignore"}
    links = rows(g.edges.select("src", "dst"))
    assert ("folder:docs", f"{root}/docs/x.md") in links and ("folder:pkg/sub", "m/sub") in links and ("folder:.", "folder:pkg") in links
    (tmp_path / "pkg" / "go.mod").write_text("module m")
    assert filesystem.module_root(str(tmp_path / "pkg" / "sub")) == filesystem.module_root(root) == str(tmp_path / "pkg")
    top = filesystem.hierarchy(spark, "w", ["b", "a"])
    assert rows(top.edges.select("src", "dst")) >= {("workspace:w", "repo:a"), ("repo:a", "repo:a:folder:.")}


def test_implements_with_a_method_that_all_have(spark):
    """Against brute force: a popular method beside rare ones, interfaces of one method, and one that nobody fulfils."""
    sets = {f"T{i}": {"String"} | {f"m{k}" for k in range(2, 6) if i % k == 0} for i in range(60)}
    wants = {f"I{j}": {"String", f"m{2 + j % 4}", f"m{2 + j % 3}"} for j in range(12)} | {"S": {"String"}, "N": {"String", "none"}}
    methods = spark.createDataFrame([(t, m, "()") for t, ms in sets.items() for m in ms], "type string, name string, signature string")
    wanted = spark.createDataFrame([(i, m, "()") for i, ms in wants.items() for m in ms], "interface string, name string, signature string")
    assert rows(implements(methods, wanted)) == {(t, i) for t, ms in sets.items() for i, ws in wants.items() if ws <= ms}


def test_implements_sends_no_row_for_each_holder_of_a_method(spark, monkeypatch):
    """Candidates are arrays until all rarest methods were met; against brute force, for every bound of the arrays."""
    sets = {f"T{i}": {f"m{(i * i + 7 * k * i + k) % 40}" for k in range(9)} | {"String"} for i in range(150)}
    wants = {f"I{j}": {f"m{(j + 3 * k * k) % 40}" for k in range(1 + j % 6)} for j in range(80)} | {"S": {"String"}, "E": {"String", "m1"}}
    wants |= {"T3": {"m3"}, "T5": {"String", "m5"}}
    methods = spark.createDataFrame([(t, m, "()") for t, ms in sets.items() for m in ms] + [("T1", None, "()")], "type string, name string, signature string")
    wanted = [(i, m, "()") for i, ms in wants.items() for m in ms] + [("none", None, "()"), ("none", "m1", "()")]
    wanted = spark.createDataFrame(wanted, "interface string, name string, signature string")
    expected = {(t, i) for t, ms in sets.items() for i, ws in wants.items() if ws <= ms and t != i}
    for many, entries in ((1000, 10**6), (20, 50), (0, 10**6)):
        monkeypatch.setattr(extraction, "MANY_HOLDERS", many)
        monkeypatch.setattr(extraction, "PASS_ENTRIES", entries)
        found = implements(methods, wanted)
        assert rows(found) == expected and found.count() == len(expected)
    monkeypatch.undo()
    # most rows of a step: those of the tables given and of confirmed candidates, not each holder of the rarest method
    made: list[int] = []
    monkeypatch.setattr(lineage, "cut", lambda df, f=lineage.cut: made.append((out := f(df)).count()) or out)
    same = spark.range(3000).selectExpr("concat('t', id % 100) AS type", "concat('m', id div 100) AS name", "'()' AS signature")
    pairs = spark.range(400).selectExpr("concat('i', id) AS interface", "explode(array('a', 'b', 'c')) AS name", "'()' AS signature")
    each = spark.range(300).selectExpr("concat('t', id) AS type", "element_at(array('a', 'b', 'c'), cast(id % 3 + 1 as int)) AS name", "'()' AS signature")
    assert implements(same.unionByName(each), pairs).isEmpty()
    assert made and max(made) <= 1200
