from __future__ import annotations

import datetime as dt

from quiver.sources.storage import GraphStore
from quiver.streaming.updates import EVENTS, GraphUpdater, debounced, maintain, routed
from tests.graphs import graph, ids, node, rows

T0 = dt.datetime(2024, 1, 1)


def events(spark, *rows_of):
    return spark.createDataFrame([(p, op, d, T0 + dt.timedelta(milliseconds=ms)) for p, op, d, ms in rows_of], EVENTS)


def test_routing(spark):
    found = routed(
        events(
            spark, ("/r/p/a.go", "write", False, 0), ("/r/p/b.txt", "write", False, 0), ("/r/p/c.txt", "create", False, 0), ("/r/p/d.txt", "remove", False, 0),
            ("/r/new", "create", True, 0), ("/r/vendor/a.go", "write", False, 0), ("/r/p/.hidden", "create", False, 0), ("/r/.git/x", "create", False, 0), ("/r/p/e.go", "rename", False, 0),
        )
    )
    assert rows(found.select("path", "action", "target")) == {
        ("/r/p/a.go", "package", "/r/p"), ("/r/p/c.txt", "refresh", ""), ("/r/p/d.txt", "remove", "/r/p/d.txt"), ("/r/new", "tree", "/r/new"), ("/r/p/e.go", "package", "/r/p"),
    }


def test_debounce(spark):
    bursts = debounced(
        routed(events(spark, *[("/r/p/a.go", "write", False, ms) for ms in (0, 300, 700, 1500)], *[("/r/q/a.go", "write", False, ms) for ms in (100, 650)]))
    )
    assert sorted((r.target, r.n_events) for r in bursts.collect()) == [("/r/p", 1), ("/r/p", 3), ("/r/q", 1), ("/r/q", 1)]


def test_maintenance(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    old = [node("p.Old:FUNC", pkg_path="p"), node("q.F:FUNC", pkg_path="q"), node("bad.F:FUNC", pkg_path="bad"), node("gone.F:FUNC", pkg_path="gone")]
    store.save(graph(spark, old, ["q.F -CALLS-> p.New"]), [{"repo_id": "r"}])

    def parse(folder):
        if folder == "/r/bad":
            raise ValueError("syntax error")
        if folder == "/r/gone":
            return None
        return "p", graph(spark, [node("p.New:FUNC", pkg_path="p")], [])

    walk = lambda: graph(spark, [node("folder:.:FOLDER")], [])
    updater = GraphUpdater(store, parse, lambda folder: folder.rpartition("/")[2], walk, lambda: [{"repo_id": "again"}])
    source = tmp_path / "events"
    source.mkdir()
    rows_of = [("/r/p/a.go", "write", False, 0), ("/r/p/a.go", "write", False, 200), ("/r/bad/a.go", "write", False, 0), ("/r/gone/a.go", "remove", False, 0)]
    events(spark, *rows_of).coalesce(1).write.mode("append").json(str(source))
    events(spark, ("/r/p/late.go", "write", False, 3_600_000)).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
    started = maintain(stream, updater, f"file://{tmp_path}/checkpoint", availableNow=True)
    started.awaitTermination(120)
    assert started.exception() is None
    g = store.load()
    assert set(ids(g.nodes)) == {"p.New", "q.F", "bad.F", "folder:."}  # a failed parse keeps the old slice
    assert rows(g.live_edges.select("src", "dst")) == {("q.F", "p.New")}
    assert updater.failures[0][0] == "/r/bad" and store.metadata().first().repo_id == "again"


def test_trees_removed_paths_and_replays(spark, tmp_path):
    """A new tree brings every package below it, a removed path takes every package below it, a batch counts once."""
    store = GraphStore(spark, f"file://{tmp_path}/store")
    old = [node(f"{p}.F:FUNC", pkg_path=p, file_path=f"/r/{p}/a.go") for p in ("keep", "x", "x/deep", "xy")]
    store.save(graph(spark, old, []), [{"repo_id": "r"}])
    on_disk = {"/r/keep": "keep", "/r/new": "new", "/r/new/a/b": "new/a/b", "/r/new/bad": "new/bad", "/r/xy": "xy"}
    parsed = []

    def parse(folder):
        parsed.append(folder)
        if folder.endswith("bad"):
            raise ValueError("syntax error")
        p = on_disk[folder]
        return p, graph(spark, [node(f"{p}.G:FUNC", pkg_path=p, file_path=f"{folder}/a.go")], [])

    folders = lambda path: sorted(f for f in on_disk if f == path or f.startswith(path + "/"))
    updater = GraphUpdater(store, parse, lambda f: f.removeprefix("/r/"), folders=folders, root="/r")
    batch = lambda *rows_of: spark.createDataFrame(rows_of, "action string, target string")
    updater.apply(batch(("tree", "/r/new")), 0, "one")
    assert set(ids(store.load().nodes)) == {"keep.F", "x.F", "x/deep.F", "xy.F", "new.G", "new/a/b.G"}
    assert [f for f, _ in updater.failures] == ["/r/new/bad"]
    parsed.clear()
    updater.apply(batch(("tree", "/r/new")), 0, "one")  # the stream gives the batch again
    assert not parsed
    updater.apply(batch(("remove", "/r/x")), 1, "one")  # nested packages go, others are parsed again
    assert set(ids(store.load().nodes)) == {"keep.G", "xy.G", "new.G", "new/a/b.G"}
    before = store.current()
    updater.apply(batch(("remove", "/r/nothing")), 2, "one")
    assert store.current() == before


def test_generations_of_two_writers(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    store.save(graph(spark, [node("a:FUNC")], []))
    claimed = store._claim()  # another writer has begun
    store.save(graph(spark, [node("b:FUNC")], []), mark="m")
    assert claimed != store.current() and ids(store.load().nodes) == ["b"] and store.marked("m") and not store.marked("n")
    store.remove("b", "not there")
    assert ids(store.load().nodes) == []
