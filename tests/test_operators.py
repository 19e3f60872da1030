from __future__ import annotations

import itertools
import random

import pytest

from quiver.operators import concurrency, context, neighbours, ranges, structure, traversal
from quiver.schema import DEPENDENCY_EDGES, EDGE_TYPES, NODE_TYPES, GraphError, NotFound
from quiver.sources.source_text import SourceUnavailable, bounded_source, excerpts, read_lines, source_code
from tests.graphs import edge, graph, ids, node, rows

RANGE = "file_path string, start_line int, end_line int, whole_file boolean, repo_id string"


def test_dependencies(spark):
    g = graph(
        spark, ["file.go:FILE", "Func:FUNC", "Called:FUNC", "fmt:BOUNDARY", "Type:STRUCT", "Channel:CHANNEL"],
        ["file.go -CONTAINS-> Func", "Func -CALLS-> Called", "Func -IMPORTS-> fmt", "Func -REFERENCES-> Type", "Func -INSTANTIATES-> Type", "Func -SENDS_TO-> Channel"],
    )
    assert ids(neighbours.dependencies(g, "Func")) == ["Called", "Type", "fmt"]
    assert ids(neighbours.blast_radius(g, "Channel")) == []
    assert ids(neighbours.blast_radius(g, "Type")) == ["Func"]
    with pytest.raises(NotFound):
        neighbours.dependencies(g, "nobody")


def test_self_edge(spark):
    g = graph(spark, ["a:FUNC"], ["a -CALLS-> a"])
    assert ids(neighbours.dependencies(g, "a")) == ids(neighbours.blast_radius(g, "a")) == ["a"]
    found, cut = traversal.blast_radius_depth(g, ["a"], 3, 10)
    assert ids(found) == [] and not cut


def test_implementations(spark):
    g = graph(spark, ["SQLStore:STRUCT", "Store:INTERFACE"], ["SQLStore -IMPLEMENTS-> Store"])
    assert ids(neighbours.implementations(g, "Store")) == ["SQLStore"]
    with pytest.raises(GraphError):
        neighbours.implementations(g, "SQLStore")


def test_search(spark):
    g = graph(spark, [node("x.ParseHTTP:FUNC"), node("x.Render:FUNC"), node("node-b:FUNC", name="Match"), node("node-a:FUNC", name="Match"), node("k:FUNC", name="Kelvin"), node("e:FUNC", name="ÉTÉ")], [])
    assert ids(neighbours.search(g, "http")) == ["x.ParseHTTP"]
    assert ids(neighbours.search(g, "match")) == ["node-a", "node-b"]
    assert ids(neighbours.search(g, "kelvin")) == []  # ASCII folds ASCII alone
    assert ids(neighbours.search(g, "été")) == ["e"]
    assert len(ids(neighbours.search(g, ""))) == 6
    assert ids(neighbours.search(g, "", limit=2)) == ["e", "k"]


def test_bfs(spark):
    g = graph(spark, ["Changed:FUNC", "Direct:FUNC", "Second:FUNC"], ["Direct -CALLS-> Changed", "Second -REFERENCES-> Direct"])
    at = lambda depth, cap: (lambda r: ([(x.id, x.distance) for x in r[0].collect()], r[1]))(traversal.blast_radius_depth(g, ["Changed"], depth, cap))
    assert at(1, 1) == ([("Direct", 1)], False)
    assert at(2, 1) == ([("Direct", 1)], True)
    assert at(2, 5) == at(2, 0) == ([("Direct", 1), ("Second", 2)], False)
    assert at(0, 5) == ([], False)
    with pytest.raises(NotFound):
        traversal.blast_radius_depth(g, ["nobody"], 1, 1)


def test_bfs_keeps_the_order_of_discovery(spark):
    g = graph(spark, ["z:FUNC", "a:FUNC", "m:FUNC", "b:FUNC"], ["m -CALLS-> z", "b -CALLS-> a"])
    found, cut = traversal.blast_radius_depth(g, ["z", "a"], 1, 1)
    assert ids(found) == ["m"] and cut


def test_path(spark):
    g = graph(spark, ["A:FUNC", "B:FUNC", "C:FUNC", "D:FUNC"], ["A -CONTAINS-> B", "B -CALLS-> C", "A -CALLS-> D", "D -CALLS-> C", "C -CALLS-> A"])
    assert [(r.id, r.next_edge) for r in traversal.find_path(g, "A", "C").collect()] == [("A", "CALLS"), ("D", "CALLS"), ("C", "")]
    assert [(r.id, r.next_edge) for r in traversal.find_path(g, "A", "A").collect()] == [("A", "")]
    with pytest.raises(NotFound):
        traversal.find_path(g, "A", "B")
    with pytest.raises(NotFound):
        traversal.find_path(g, "A", "nobody")


def test_concurrency(spark):
    g = graph(
        spark, ["A:FUNC", "B:FUNC", "g:GOROUTINE", "chA:CHANNEL", "chB:CHANNEL"],
        ["A -SPAWNS-> g", "g -CALLS-> B", "A -SENDS_TO-> chA", "A -RECEIVES_FROM-> chA", "B -RECEIVES_FROM-> chB"],
    )
    of = lambda x: rows(concurrency.concurrency_graph(g, x).select("direction", "edge_type", "id"))
    assert of("A") == {("outbound", "SPAWNS", "g"), ("outbound", "SENDS_TO", "chA"), ("outbound", "RECEIVES_FROM", "chA"), ("via_goroutine", "RECEIVES_FROM", "chB")}
    assert of("B") == {("inbound", "CALLS", "g"), ("outbound", "RECEIVES_FROM", "chB")}
    assert ids(concurrency.concurrency_flow(g, "A")) == ["chA", "chB", "g"]
    via = graph(spark, ["main:FUNC", "worker:FUNC", "ch:CHANNEL", "go:GOROUTINE", "c2:CHANNEL"], ["main -CALLS-> worker", "worker -RECEIVES_FROM-> ch", "main -SPAWNS-> go", "go -RECEIVES_FROM-> c2"])
    got = rows(concurrency.concurrency_graph(via, "main").select("direction", "id"))
    assert got == {("via_call", "ch"), ("outbound", "go"), ("via_goroutine", "c2")}


def test_ranges(spark):
    at = lambda x, a, b, **m: node(f"{x}:FUNC", file_path="/f.go", line_start=a, line_end=b, **m)
    g = graph(spark, [at("Changed", 10, 20, repo_id="repo-a"), at("Other", 30, 40, repo_id="repo-a"), at("legacy", 1, 5), at("skip", 1, 5, repo_id="repo-b"), node("f:FILE", file_path="/f.go")], [])
    find = lambda *r: ids(ranges.nodes_for_ranges(g, spark.createDataFrame(list(r), RANGE)))
    assert find(("/f.go", 12, 12, False, "repo-a")) == ["Changed"]
    assert find(("/f.go", 32, 15, False, "repo-a")) == ["Changed", "Other"]  # reversed
    assert find(("/f.go", 1, 3, False, "repo-a")) == ["legacy"]
    assert find(("/f.go", 0, 0, False, "")) == []
    assert find(("/f.go", 0, 0, True, "repo-a"), ("/f.go", 12, 12, False, "repo-a")) == ["Changed", "Other", "f", "legacy"]
    plan = ranges.nodes_for_ranges(g, spark.createDataFrame([("/f.go", 1, 2, False, "")], RANGE))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


TARGET = [
    "pkg.Target:FUNC", "fmt:BOUNDARY", "Dep:STRUCT", "Caller:FUNC", "Second:FUNC", "file:FILE", "child:FUNC", "route:ROUTE", "g:GOROUTINE", "ch:CHANNEL",
]
AROUND = [
    "pkg.Target -IMPORTS-> fmt", "pkg.Target -REFERENCES-> Dep", "Caller -CALLS-> pkg.Target", "Second -CALLS-> Caller", "file -CONTAINS-> pkg.Target",
    "pkg.Target -CONTAINS-> child", "route -REFERENCES-> pkg.Target", "pkg.Target -SPAWNS-> g", "g -SENDS_TO-> ch",
]


def sections(found):
    out = {}
    for r in sorted(found.sections.collect(), key=lambda r: (r.section, r.position)):
        out.setdefault(r.section, []).append(r.id)
    return out


def test_context(spark):
    g = graph(spark, TARGET, AROUND)
    found = context.node_context(g, "pkg.Target", context.ContextOptions(max_depth=2))
    assert sections(found) == {
        "dependencies": ["Dep", "fmt"], "dependents": ["Caller", "route", "Second"], "parents": ["file"], "children": ["child"],
        "routes": ["route"], "concurrency": ["g", "ch"],
    }
    assert found.warnings == ["source unavailable: the node has no file path"]
    out = sections(context.node_context(g, "route"))
    assert out == {"dependencies": ["pkg.Target"]}  # an outbound reference of a route is a dependency


def test_context_caps(spark):
    g = graph(spark, ["T:FUNC", "a:FUNC", "b:FUNC", "x:FUNC", "y:FUNC"], ["T -CALLS-> a", "T -CALLS-> b", "x -CALLS-> T", "y -CALLS-> T"])
    one = context.node_context(g, "T", context.ContextOptions(include_source=False, max_dependencies=1, max_callers=1))
    assert sections(one) == {"dependencies": ["a"], "dependents": ["x"]}
    assert one.warnings == ["dependencies truncated at max_dependencies=1", "dependents truncated at max_dependents=1"]
    two = context.node_context(g, "T", context.ContextOptions(include_source=False, max_dependencies=2, max_dependents=2))
    assert two.warnings == [] and not any(two.truncated.values())
    for bad in ({"max_depth": 4}, {"max_dependents": 101}, {"max_relations": -1}, {"max_dependents": 2, "max_callers": 3}):
        with pytest.raises(GraphError):
            context.node_context(g, "T", context.ContextOptions(**bad))


def test_structure(spark):
    g = graph(
        spark, [node("folder:.:FOLDER", name="root"), node("folder:internal:FOLDER", name="internal"), node("pkg:PACKAGE", name="pkg"), node("f.go:FILE", name="f.go"), node("z.md:FILE", name="z.md")],
        ["folder:. -CONTAINS-> folder:internal", "folder:internal -CONTAINS-> pkg", "pkg -CONTAINS-> f.go", "folder:. -CONTAINS-> z.md"],
    )
    tree = lambda **o: [(r.depth, r.id) for r in structure.structure_tree(g, structure.StructureOptions(**o)).collect()]
    assert tree() == [(0, "folder:."), (1, "folder:internal"), (2, "pkg")]
    assert tree(files=True) == [(0, "folder:."), (1, "folder:internal"), (2, "pkg"), (3, "f.go"), (1, "z.md")]
    assert tree(packages=False) == [(0, "folder:."), (1, "folder:internal")]
    assert tree(root="internal") == [(0, "folder:internal"), (1, "pkg")]
    assert tree(max_depth=1) == [(0, "folder:."), (1, "folder:internal")]
    assert len(tree(max_nodes=3)) == 3
    for bad in ({"max_depth": 33}, {"max_nodes": -1}, {"max_nodes": 2}, {"root": "nowhere"}):
        with pytest.raises(GraphError):
            tree(**bad)


def test_structure_cycles_and_roots(spark):
    g = graph(spark, [node("repo:a:folder:.:FOLDER"), node("repo:b:folder:.:FOLDER"), node("workspace:w:WORKSPACE")], ["repo:a:folder:. -CONTAINS-> repo:b:folder:.", "repo:b:folder:. -CONTAINS-> repo:a:folder:."])
    assert structure.root_id(g, structure.StructureOptions()) == "workspace:w"
    assert structure.root_id(g, structure.StructureOptions(repo_id="b")) == "repo:b:folder:."
    rows_of = structure.structure_tree(g, structure.StructureOptions(root="repo:a:folder:.")).collect()
    assert [(r.depth, r.id) for r in rows_of] == [(0, "repo:a:folder:."), (1, "repo:b:folder:."), (2, "repo:a:folder:.")]
    alone = graph(spark, [node("repo:a:folder:.:FOLDER"), node("repo:b:folder:.:FOLDER")], [])
    with pytest.raises(GraphError):
        structure.root_id(alone, structure.StructureOptions())


def test_source(spark, tmp_path):
    f = tmp_path / "a.go"
    f.write_bytes(b"one\r\ntwo\r\nthree")
    at = lambda a, b, p=str(f): {"id": "x", "file_path": p, "line_start": a, "line_end": b}
    assert source_code(at(2, 3)) == "two\nthree\n"
    assert bounded_source(at(1, 3), 2, 999) == ("one\r\ntwo\r\n", True)
    assert bounded_source(at(1, 3), 9, 7) == ("one\r\ntw", True)
    for bad in (at(0, 0), at(-1, 1), at(2, 1), at(1, 2, ""), at(1, 2, "/nowhere/x.go")):
        with pytest.raises(SourceUnavailable):
            source_code(bad)
    big = tmp_path / "b.go"
    big.write_text("é" * 100_000)
    text, cut = bounded_source(at(1, 1, str(big)), 5, 255)
    assert cut and len(text.encode()) <= 255
    g = graph(spark, [node("x:FUNC", file_path=str(f), line_start=2, line_end=3)], [])
    assert [tuple(r) for r in excerpts(g.nodes, read_lines(spark, str(tmp_path))).collect()] == [("x", 2, "two"), ("x", 3, "three")]


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    """Against plain Python over graphs with all types, self-edges, cycles and dangling edges."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    kinds = {n: rng.choice(NODE_TYPES) for n in names}
    kinds["n0"] = "FUNC"
    links = {(rng.choice(names), rng.choice(EDGE_TYPES + ("CALLS", "SPAWNS", "SENDS_TO")), rng.choice([*names, "ghost"])) for _ in range(40)}
    g = graph(spark, [node(f"{n}:{k}") for n, k in kinds.items()], [edge(f"{a} -{t}-> {b}") for a, t, b in links]).persist()
    live = {e for e in links if e[2] != "ghost"}
    dep = {(a, b) for a, t, b in live if t in DEPENDENCY_EDGES}
    for x in ("n0", "n3"):
        assert set(ids(neighbours.dependencies(g, x))) == {b for a, b in dep if a == x}
        # reverse breadth-first search in order of discovery
        for cap in (0, 2):
            seen, queue, cut = {x: 0}, [x], False
            for y in queue:
                if seen[y] >= 3 or cut:
                    continue
                for z in sorted({a for a, b in dep if b == y} - seen.keys()):
                    if cap and len(seen) - 1 >= cap:
                        cut = True
                        break
                    seen[z] = seen[y] + 1
                    queue.append(z)
            found, was_cut = traversal.blast_radius_depth(g, [x], 3, cap)
            assert {(r.id, r.distance) for r in found.collect()} == {(k, d) for k, d in seen.items() if d} and was_cut == cut
        calls = {(a, b) for a, t, b in live if t == "CALLS"}
        reach = {x: 0}
        for d in itertools.count(1):
            new = {b for a, b in calls if reach.get(a) == d - 1} - reach.keys()
            if not new:
                break
            reach |= dict.fromkeys(new, d)
        assert {(r.id, r.distance) for r in traversal.call_distances(g, x).collect()} == set(reach.items())
        conc = lambda y, live=live: {(y, b, t) for a, t, b in live if a == y and t in ("SPAWNS", "SENDS_TO", "RECEIVES_FROM") and kinds[b] in ("GOROUTINE", "CHANNEL")}
        want = {("outbound", *e) for e in conc(x)}
        for a, t, b in live:
            if a == x and t == "CALLS" and kinds[b] not in ("GOROUTINE", "CHANNEL"):
                want |= {("via_call", *e) for e in conc(b)}
            if a == x and t == "SPAWNS" and kinds[b] != "CHANNEL":
                for y in {b} | {d for c, u, d in live if c == b and u == "CALLS"}:
                    want |= {("via_goroutine", *e) for e in conc(y)}
            if b == x and kinds[a] in ("GOROUTINE", "CHANNEL") and (t in ("SPAWNS", "SENDS_TO", "RECEIVES_FROM") or (t == "CALLS" and kinds[a] == "GOROUTINE")):
                want.add(("inbound", a, b, t))
        assert rows(concurrency.concurrency_graph(g, x).select("direction", "src", "dst", "edge_type")) == want


def test_blast_radius_from_a_table_of_nodes(spark):
    """A table of starts gives what the list of its ids in order gives, for every cap."""
    rng = random.Random(5)
    names = [f"n{i:02}" for i in range(30)]
    g = graph(spark, [f"{x}:FUNC" for x in names], sorted({f"{rng.choice(names)} -CALLS-> {rng.choice(names)}" for _ in range(70)}))
    starts = g.nodes.filter("id in ('n03', 'n11', 'n20')")
    for cap in (0, 1, 5, 100):
        by_list = traversal.blast_radius_depth(g, ["n03", "n11", "n20"], 3, cap)
        by_table = traversal.blast_radius_depth(g, starts, 3, cap)
        assert [(x.id, x.distance) for x in by_table[0].collect()] == [(x.id, x.distance) for x in by_list[0].collect()]
        assert by_table[1] == by_list[1]
    nothing, was_cut = traversal.blast_radius_depth(g, starts.limit(0), 3, 5)
    assert nothing.count() == 0 and not was_cut
