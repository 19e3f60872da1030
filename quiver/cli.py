"""Command line: graphs in stores, queried, counted, exported and compared with Git; workspaces of several of them.

    python -m quiver.cli analyze --facts FOLDER --store FOLDER [--repo ID] [--root FOLDER]
    python -m quiver.cli query --store FOLDER "MATCH ..."
    python -m quiver.cli stats | export | impact --store FOLDER ...
    python -m quiver.cli workspace init | add | list | show | remove ...
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from quiver.analysis.impact import ImpactOptions, Repo, analyze
from quiver.graph import PropertyGraph
from quiver.operators.structure import package_folders, repo_roots
from quiver.plans.compiler import cypher
from quiver.plans.parser import parse
from quiver.rules.extraction import graph_of_facts
from quiver.schema import GraphError
from quiver.sinks import markdown
from quiver.sinks.export import result_json, write_dot, write_json, write_mermaid
from quiver.sources import filesystem, git
from quiver.sources.storage import ENGINE_VERSION, GraphStore, load_all
from quiver.sources.workspace import Workspace

FACTS = (
    "packages", "files", "imports", "decls", "uses", "calls", "spawns", "channels", "chan_ops", "flows", "methods",
    "interface_methods", "routes",
)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quiver")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, store: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if store:
            p.add_argument("--store", action="append", required=True, help="folder of a graph store; several make one graph")
        for f in flags:
            p.add_argument(f)
        return p

    command("version", store=False)
    command("init", "path", store=False)
    made = command("analyze", "--facts", "--repo", "--root", "--module")
    made.add_argument("--tests", action="store_true")
    command("query", "text")
    command("stats").add_argument("--json", action="store_true")
    out = command("export", "--output")
    out.add_argument("--format", choices=("json", "mermaid", "dot"), default="json")
    change = command("impact", "--root", "--repo")
    change.add_argument("--base", default="HEAD")
    for name in ("depth", "nodes", "files"):
        change.add_argument(f"--max-{name}", type=int, default=0)
    change.add_argument("--no-untracked", action="store_true")
    change.add_argument("--json", action="store_true")
    change.add_argument("--strict", action="store_true")
    space = command("workspace", "action", "args", store=False)
    space._actions[-2].choices = ("init", "add", "list", "show", "remove")
    space._actions[-1].nargs = "*"
    space.add_argument("--file", default="workspace.json")
    return top


def load(spark: SparkSession, stores: list[str]) -> PropertyGraph:
    return load_all([GraphStore(spark, s, read_only=True) for s in stores]) if len(stores) > 1 else GraphStore(spark, stores[0], True).load()


def workspace(args: argparse.Namespace) -> str:
    if args.action == "init":
        if os.path.exists(args.file):
            raise GraphError(f"{args.file} is there already")
        Workspace(*args.args).save(args.file)
        return f"made {args.file}"
    w = Workspace.load(args.file)
    if args.action == "add":
        w.add(*args.args)
        w.save(args.file)
    elif args.action == "remove":
        w.remove(*args.args)
        w.save(args.file)
    elif args.action == "show":
        return json.dumps({"name": w.name, "repos": w.repos}, indent=2)
    return "\n".join(f"{r}\t{p}" for r, p in sorted(w.repos.items()))


def analyzed(spark: SparkSession, args: argparse.Namespace) -> str:
    """Build a graph from tables of facts and, with a root, the walk of its files; save it with the repository's state."""
    tables = {n: spark.read.parquet(f"{args.facts}/{n}.parquet") for n in FACTS if os.path.exists(f"{args.facts}/{n}.parquet")}
    graph = graph_of_facts(tables, args.repo or "")
    meta = {"repo_id": args.repo or "", "include_tests": args.tests, "module_prefix": args.module or ""}
    if args.root:
        root = os.path.abspath(args.root)
        meta["repo_root"] = root
        folders = package_folders(graph.nodes, root).selectExpr("folder", "explode(packages) as pkg_path")
        walk = filesystem.structure(filesystem.listed_files(spark, root), root, folders, args.repo or "")
        graph = graph.add(walk)
        try:
            now = git.capture(root)
            meta |= {
                "git_available": True, "git_root": now.root, "git_head": now.head, "git_branch": now.branch,
                "git_dirty_at_analyze": now.dirty, "git_status_fingerprint": now.status_fingerprint,
            }
        except GraphError as e:
            meta |= {"git_available": False, "git_error": str(e)}
    store = GraphStore(spark, args.store[0])
    store.save(graph, [meta])
    store.compact()
    return markdown.stats(store.load())


def changed(spark: SparkSession, args: argparse.Namespace) -> str:
    graph = load(spark, args.store)
    known = {r.repo_id: r.asDict() for s in args.store for r in GraphStore(spark, s, True).metadata().collect()}
    roots = {args.repo or "": args.root} if args.root else {r.repo_id: r.root for r in repo_roots(graph).collect()}
    if len(roots) > 1 and len(args.store) == 1:
        raise GraphError("the graph has several roots; name one, or use a workspace of stores")
    options = ImpactOptions(args.base, args.max_depth, args.max_nodes, args.max_files, not args.no_untracked)
    report = analyze(graph, [Repo(root, r, known.get(r)) for r, root in roots.items()], options)
    shown = json.dumps(report, default=lambda x: x.__dict__, indent=2) if args.json else markdown.impact(report)
    print(shown)
    if args.strict:
        report.require_fresh()
    return ""


def main(argv: Sequence[str] | None = None) -> int:
    """Results go to stdout, everything else to stderr; 1 if the request can't be answered."""
    args = parser().parse_args(argv)
    try:
        if args.command == "version":
            print(f"quiver {ENGINE_VERSION}")
            return 0
        if args.command == "workspace":
            print(workspace(args))
            return 0
        if args.command == "query":
            parse(args.text)  # before anything is opened
        if args.command == "init":
            os.makedirs(args.path, exist_ok=True)
            print(f"made {args.path}")
            return 0
        spark = SparkSession.builder.appName("quiver").getOrCreate()
        if args.command == "analyze":
            print(analyzed(spark, args), end="")
        elif args.command == "impact":
            changed(spark, args)
        else:
            graph = load(spark, args.store)
            if args.command == "query":
                print(result_json(cypher(graph, args.text)))
            elif args.command == "stats":
                from quiver.operators.stats import statistics

                print(result_json(statistics(graph)) if args.json else markdown.stats(graph), end="")
            else:
                write = {"json": write_json, "mermaid": write_mermaid, "dot": write_dot}[args.format]
                if args.output:
                    with open(args.output, "w", encoding="utf-8") as f:
                        write(graph, f)
                else:
                    write(graph, sys.stdout)
    except GraphError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
