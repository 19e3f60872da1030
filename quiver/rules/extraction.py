"""Relational rules from facts to nodes and edges.

An extractor outside states what it sees in source files as tables; every rule here is a projection, join or grouping.
Tables and columns (strings unless noted; ``line``, ``end_line``, ``column`` are ints):

packages   pkg_path, name, internal (boolean)
files      pkg_path, path
imports    file, pkg_path
decls      id, kind (a node type), name, pkg_path, file, line, end_line, owner (id of the type of a method, else "")
uses       src, dst, dst_pkg, how (type, init, literal), file, line, column
calls      src, dst, dst_pkg, dst_name, file, line, column
spawns     src, pkg_path, file, line, end_line, column, callee, callee_pkg
channels   id, name, elem, pkg_path, file, line
chan_ops   src, channel, op (send, receive)
flows      callee, param, arg (channels)
methods    type, name, signature
interface_methods  interface, name, signature
routes     file, owner, framework, method, pattern, handlers (array of ids), pkg_path, line
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.text import basename, join_route_column, last_segment, route_parts
from quiver.graph import PropertyGraph
from quiver.lineage import passing, step
from quiver.schema import EDGES, NODES

GIN_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "ANY")

#: Holders of a method that are listed beside it; methods that more types hold are looked up for candidates alone.
MANY_HOLDERS = 1000

#: Counters of holders by a hash of the method, which every task gets.
BUCKETS = 1 << 19

#: Entries of holders' lists that are shuffled beside interfaces at once.
PASS_ENTRIES = 150_000_000


def _nodes(table: DataFrame, **values: Column) -> DataFrame:
    blank = {f.name: F.lit("" if f.dataType.simpleString() == "string" else 0) for f in NODES}
    return table.select(*[(blank | values)[f.name].alias(f.name) for f in NODES])


def _edges(table: DataFrame, kind: str | Column, src: Column, dst: Column, repo_id: str = "", placed: bool = False) -> DataFrame:
    place = F.array(F.struct(F.col("file").alias("filepath"), F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column")))
    none = F.array().cast(EDGES["occurrences"].dataType)
    label = F.lit(kind) if isinstance(kind, str) else kind
    return table.select(
        src.alias("src"), dst.alias("dst"), label.alias("type"), F.lit(repo_id).alias("repo_id"),
        (place if placed else none).alias("occurrences"),
    )


def goroutine_id(pkg_path: Column, line: Column, column: Column) -> Column:
    return F.concat(pkg_path, F.lit(".goroutine_L"), line, F.lit("_C"), column)


def route_id(file: Column, method: Column, pattern: Column) -> Column:
    return F.concat(file, F.lit("::route:"), method, F.lit(":"), pattern)


def method_id(pkg_path: Column, receiver: Column, name: Column) -> Column:
    return F.concat_ws(".", pkg_path, receiver, name)


def function_id(pkg_path: Column, name: Column) -> Column:
    return F.concat_ws(".", pkg_path, name)


def channel_id(pkg_path: Column, file: Column, line: Column, column: Column, name: Column) -> Column:
    """A channel's identity is where it is declared; without a place it belongs to its function: ``function.name``."""
    return F.concat_ws(":", F.lit("channel"), pkg_path, file, line, column, name)


# -- the rules, one function each


def package_nodes(packages: DataFrame) -> DataFrame:
    kind = F.when(F.col("internal"), "PACKAGE").otherwise("BOUNDARY")
    return _nodes(packages, id=F.col("pkg_path"), type=kind, name=F.col("name"), pkg_path=F.col("pkg_path"))


def file_rules(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    path = F.col("path")
    nodes = _nodes(files, id=path, type=F.lit("FILE"), name=basename(path), pkg_path=F.col("pkg_path"), file_path=path)
    return nodes, _edges(files, "CONTAINS", F.col("pkg_path"), path)


def boundary_nodes(paths: DataFrame, internal: DataFrame) -> DataFrame:
    """BOUNDARY nodes of imported packages that aren't internal, named by their last segment."""
    outside = paths.select("pkg_path").distinct().join(internal.select("pkg_path"), "pkg_path", "left_anti")
    p = F.col("pkg_path")
    return _nodes(outside, id=p, type=F.lit("BOUNDARY"), name=last_segment(p), pkg_path=p)


def import_edges(imports: DataFrame) -> DataFrame:
    return _edges(imports, "IMPORTS", F.col("file"), F.col("pkg_path")).distinct()


def declaration_rules(decls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types, functions, methods, constants and variables; their file contains them, and so does a method's type. ``_`` names nothing."""
    named = decls.filter(F.col("name") != "_")
    nodes = _nodes(
        named, id=F.col("id"), type=F.col("kind"), name=F.col("name"), pkg_path=F.col("pkg_path"), file_path=F.col("file"),
        line_start=F.col("line").cast("int"), line_end=F.col("end_line").cast("int"),
    )
    # methods of interfaces hang below their interface alone
    owners = named.select(F.col("id").alias("owner"), F.col("kind").alias("owner_kind"))
    placed = named.join(owners, "owner", "left")
    by_interface = F.coalesce(F.col("owner_kind") == "INTERFACE", F.lit(False))
    in_file = _edges(placed.filter(~by_interface), "CONTAINS", F.col("file"), F.col("id"))
    return nodes, in_file.unionByName(_edges(named.filter(F.col("owner") != ""), "CONTAINS", F.col("owner"), F.col("id")))


def use_edges(uses: DataFrame, internal: DataFrame) -> DataFrame:
    """REFERENCES to internal types and objects, INSTANTIATES beside it for literals; none to oneself or outside."""
    inside = uses.filter(F.col("src") != F.col("dst")).join(
        internal.select(F.col("pkg_path").alias("dst_pkg")), "dst_pkg", "left_semi"
    )
    literal = inside.filter(F.col("how") == "literal")
    plain = _edges(inside.filter(F.col("how") != "literal"), "REFERENCES", F.col("src"), F.col("dst")).distinct()
    return plain.unionByName(_edges(literal, "REFERENCES", F.col("src"), F.col("dst"), placed=True)).unionByName(
        _edges(literal, "INSTANTIATES", F.col("src"), F.col("dst"), placed=True)
    )


def call_rules(calls: DataFrame, internal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CALLS with the place of each call; callees outside get BOUNDARY nodes."""
    outside = calls.join(internal.select(F.col("pkg_path").alias("dst_pkg")), "dst_pkg", "left_anti")
    callees = outside.select("dst", "dst_pkg", "dst_name").distinct()
    nodes = _nodes(callees, id=F.col("dst"), type=F.lit("BOUNDARY"), name=F.col("dst_name"), pkg_path=F.col("dst_pkg"))
    return nodes, _edges(calls, "CALLS", F.col("src"), F.col("dst"), placed=True)


def spawn_rules(spawns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A GOROUTINE for each go statement; who runs it spawns it, and it calls its callee."""
    made = spawns.withColumn("id", goroutine_id(F.col("pkg_path"), F.col("line"), F.col("column")))
    nodes = _nodes(
        made, id=F.col("id"), type=F.lit("GOROUTINE"), name=F.concat(F.lit("goroutine_L"), "line"), pkg_path=F.col("pkg_path"),
        file_path=F.col("file"), line_start=F.col("line").cast("int"), line_end=F.col("end_line").cast("int"),
    )
    called = made.filter(F.coalesce("callee", F.lit("")) != "")
    return nodes, _edges(made, "SPAWNS", F.col("src"), F.col("id")).unionByName(
        _edges(called, "CALLS", F.col("id"), F.col("callee"), placed=True)
    )


def channel_rules(channels: DataFrame, chan_ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = _nodes(
        channels, id=F.col("id"), type=F.lit("CHANNEL"), name=F.concat("name", F.lit(" (chan "), "elem", F.lit(")")),
        pkg_path=F.col("pkg_path"), file_path=F.col("file"), line_start=F.col("line").cast("int"), line_end=F.col("line").cast("int"),
    )
    kind = F.when(F.col("op") == "send", "SENDS_TO").otherwise("RECEIVES_FROM")
    return nodes, _edges(chan_ops, kind, F.col("src"), F.col("channel")).distinct()


def channel_flow(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, type: a callee that sends to or receives from a parameter does so with the argument; one pass, new edges only."""
    ends = edges.filter(F.col("type").isin("SENDS_TO", "RECEIVES_FROM")).select("src", "dst", "type")
    moved = flows.join(ends, (F.col("callee") == F.col("src")) & (F.col("param") == F.col("dst")))
    return moved.select("src", F.col("arg").alias("dst"), "type").distinct().join(ends, ["src", "dst", "type"], "left_anti")


def implements(methods: DataFrame, interface_methods: DataFrame) -> DataFrame:
    """src, dst: types whose method sets hold every method of a non-empty interface; relational division.

    Of an interface of several methods only types that hold its three rarest are candidates: the holders of a method
    travel as one array of 32-bit hashes of types, and arrays are intersected, so a candidate is never a row of its own
    before that. A method with more than MANY_HOLDERS has no array and rules nothing out; where all three are such, the
    holders of the rarest are candidates. Hashes can only let more through: each candidate's methods are all looked up
    by name and signature. What is rare is told from BUCKETS counts, which rule nothing out either. Steps are written
    one by one, so that a disk holds the shuffle of one step at a time.
    """
    method, m = ["name", "signature"], F.xxhash64("name", "signature").alias("m")
    has, wanted = methods.select("type", *method), interface_methods.select("interface", *method)
    bucket = F.pmod("m", F.lit(BUCKETS)).alias("bucket")
    with passing() as written:
        held = has.select(m, F.hash("type").alias("t")).repartition("m").groupBy("m").agg(F.collect_set("t").alias("types"))
        few = F.when(F.size("types") <= MANY_HOLDERS, F.col("types"))
        held = written(held.select("m", F.size("types").alias("n"), few.alias("types")))
        load = held.groupBy(bucket).agg(F.sum("n").alias("load"))
        counted = wanted.select("*", m).select("interface", *method, bucket).join(F.broadcast(load), "bucket", "left")
        one = F.struct(F.coalesce("load", F.lit(0)).alias("load"), *method).alias("one")
        listed = counted.select("interface", one).repartition("interface").groupBy("interface")
        listed = listed.agg(F.sort_array(F.collect_set("one")).alias("methods"))
        listed = written(listed.select(F.monotonically_increasing_id().alias("id"), "*", F.size("methods").alias("size")))
        single = listed.filter("size = 1").select("interface", F.col("methods")[0].alias("one")).select("interface", "one.*")
        single = step(single.drop("load"))

        # an interface of two methods meets its first one twice, which changes nothing
        nth = lambda k: F.col("methods")[F.when(F.col("size") > k, k).otherwise(0)]
        several = listed.filter("size > 1")
        rows = several.agg(F.sum(F.least(F.col("methods")[0]["load"], F.lit(MANY_HOLDERS)))).first()[0] or 0
        n_passes = 1 + rows // PASS_ENTRIES
        left: list[DataFrame] = []
        for nth_pass in range(n_passes):
            now = several.filter(F.pmod(F.xxhash64("id"), F.lit(n_passes)) == nth_pass)
            now = now.select("id", *[F.xxhash64(nth(k)["name"], nth(k)["signature"]).alias(f"m{k}") for k in range(3)])
            now = now.withColumn("both", F.lit(None).cast("array<int>"))
            for k in range(3):
                now = now.join(held.select(F.col("m").alias(f"m{k}"), "types"), f"m{k}")
                both = F.coalesce(F.array_intersect("both", "types"), "both", "types")
                now = now.withColumn("both", both).drop(f"m{k}", "types").filter(F.col("both").isNull() | (F.size("both") > 0))
            left.append(written(now))
        left_over = reduce(DataFrame.unionByName, left)
        names = has.select("type").distinct().select(F.hash("type").alias("t"), "type")
        candidates = left_over.select("id", F.explode("both").alias("t")).join(names, "t").select("id", "type")
        wide = left_over.filter(F.col("both").isNull()).select("id")
        if not wide.isEmpty():
            rarest = several.join(wide, "id").select("id", F.col("methods")[0].alias("one")).select("id", "one.*")
            candidates = candidates.unionByName(rarest.join(has.distinct(), method).select("id", "type"))
        asked = several.join(candidates, "id").filter(F.col("type") != F.col("interface"))
        asked = asked.select("type", "interface", "size", F.explode("methods").alias("one"))
        asked = written(asked.select("type", "interface", "size", "one.name", "one.signature"))
        full = asked.join(has, ["type", *method], "left_semi").groupBy("type", "interface", "size").agg(F.count("*").alias("n"))
        full = step(full.filter("n = size").select("type", "interface"))
    alone = single.join(has.repartition(*method).distinct(), method).filter(F.col("type") != F.col("interface"))
    found = alone.select("type", "interface").unionByName(full)
    return found.select(F.col("type").alias("src"), F.col("interface").alias("dst"))


def route_rules(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ROUTE nodes of both frameworks; file contains, owner registers, route references each handler once.

    A pattern that the extractor couldn't resolve (null), as after a reassignment in a branch, makes no route.
    """
    known = routes.filter(F.col("pattern").isNotNull())
    said_method, said_path = route_parts(F.col("pattern"))
    prefix = F.coalesce("prefix", F.lit("")) if "prefix" in routes.columns else F.lit("")
    given = F.coalesce("method", F.lit(""))
    std = F.col("framework") == "net/http"
    method = F.when(std, said_method).otherwise(F.when(given == "", "ANY").otherwise(F.upper(given)))
    path = F.when(std, said_path).otherwise(join_route_column(prefix, F.col("pattern")))
    made = known.withColumns({"_method": method, "_path": path}).withColumn(
        "id", route_id(F.col("file"), F.col("_method"), F.col("_path"))
    )
    nodes = _nodes(
        made, id=F.col("id"), type=F.lit("ROUTE"), name=F.concat_ws(" ", "_method", "_path"), pkg_path=F.col("pkg_path"),
        file_path=F.col("file"), line_start=F.col("line").cast("int"), line_end=F.col("line").cast("int"),
    )
    handled = made.select("id", F.explode(F.array_distinct("handlers")).alias("handler"))
    edges = [
        _edges(made, "CONTAINS", F.col("file"), F.col("id")), _edges(made, "REGISTERS_ROUTE", F.col("owner"), F.col("id")),
        _edges(handled, "REFERENCES", F.col("id"), F.col("handler")),
    ]
    return nodes, reduce(DataFrame.unionByName, edges).distinct()


def graph_of_facts(facts: dict[str, DataFrame], repo_id: str = "", implement: bool = True) -> PropertyGraph:
    """All rules over the tables that are there, merged. ``implement``: whether to find IMPLEMENTS (not done per package)."""
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []
    packages = facts["packages"]
    internal = packages.filter("internal")
    nodes.append(package_nodes(packages))
    for name, rule in (
        ("files", file_rules), ("decls", declaration_rules), ("spawns", spawn_rules), ("routes", route_rules),
    ):
        if name in facts:
            made = rule(facts[name])
            nodes.append(made[0])
            edges.append(made[1])
    if "imports" in facts:
        nodes.append(boundary_nodes(facts["imports"], internal))
        edges.append(import_edges(facts["imports"]))
    if "uses" in facts:
        edges.append(use_edges(facts["uses"], internal))
    if "calls" in facts:
        made = call_rules(facts["calls"], internal)
        nodes.append(made[0])
        edges.append(made[1])
    if "channels" in facts:
        made = channel_rules(facts["channels"], facts["chan_ops"])
        nodes.append(made[0])
        edges.append(made[1])
        if "flows" in facts:
            moved = channel_flow(facts["flows"], made[1])
            edges.append(_edges(moved, F.col("type"), F.col("src"), F.col("dst")))
    if implement and "interface_methods" in facts:
        found = implements(facts["methods"], facts["interface_methods"])
        edges.append(_edges(found, "IMPLEMENTS", F.col("src"), F.col("dst")))
    all_nodes, all_edges = reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
    owner = F.lit(repo_id)
    return PropertyGraph.build(all_nodes.withColumn("repo_id", owner), all_edges.withColumn("repo_id", owner))
