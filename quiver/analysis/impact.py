"""Change impact: from changed files through the nodes they touch to all that depends on those."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.analysis.diff import ChangedFile
from quiver.analysis.freshness import FRESH, RANK, UNKNOWN, freshness, overall, untested_changes
from quiver.functions.text import canonical_path
from quiver.graph import PropertyGraph
from quiver.lineage import cut
from quiver.operators.ranges import nodes_for_ranges, ranges_of_files, unmatched_files
from quiver.operators.traversal import blast_radius_depth, check_range
from quiver.schema import CHANGED_FILES, METADATA, GraphError
from quiver.sources.git import Runner, capture, changed_files, check_base_ref, run_program

REPO_WORKERS = 8
SUMMARY = ("id", "type", "name", "pkg_path", "file_path", "line_start", "line_end", "repo_id")


@dataclass(frozen=True)
class ImpactOptions:
    base_ref: str = "HEAD"
    max_depth: int = 1
    max_nodes: int = 100
    max_files: int = 1000
    untracked: bool = True

    def settled(self) -> ImpactOptions:
        out = ImpactOptions(
            self.base_ref or "HEAD", self.max_depth or 1, self.max_nodes or 100, self.max_files or 1000, self.untracked
        )
        check_base_ref(out.base_ref)
        check_range("max_depth", out.max_depth, 1, 5)
        check_range("max_nodes", out.max_nodes, 1, 500)
        check_range("max_files", out.max_files, 1, 10_000)
        return out


@dataclass(frozen=True)
class Repo:
    root: str
    id: str = ""
    metadata: dict | None = None


@dataclass
class Freshness:
    status: str = UNKNOWN
    reasons: list[str] = field(default_factory=list)


@dataclass
class RepoReport:
    id: str
    root: str
    scanned: bool = False
    error: str = ""
    freshness: Freshness = field(default_factory=Freshness)


@dataclass
class Report:
    base_ref: str
    repos: list[RepoReport] = field(default_factory=list)
    changed_files: list[dict] = field(default_factory=list)
    changed_nodes: list[dict] = field(default_factory=list)
    impacted_nodes: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def freshness_status(self) -> str:
        ranks = [RANK[r.freshness.status] for r in self.repos]
        return {v: k for k, v in RANK.items()}[max(ranks)] if ranks else UNKNOWN

    def require_fresh(self) -> Report:
        """Strict mode: an error after the report was made."""
        if self.freshness_status != FRESH:
            raise GraphError(f"the graph is {self.freshness_status}")
        return self


class AllReposFailed(GraphError):
    """No repository could be scanned."""


def normalized(repos: list[Repo]) -> list[Repo]:
    """Trimmed, rooted, absolute, by id; the id defaults to the root."""
    out = []
    for r in repos:
        if r.root.strip():
            root = os.path.abspath(r.root.strip())
            out.append(Repo(root, r.id.strip() or root, r.metadata))
    return sorted(out, key=lambda r: r.id)


def changed_table(spark: SparkSession, files: list[ChangedFile]) -> DataFrame:
    rows = [{**asdict(f), "absolute_path": canonical_path(f.absolute_path), "ranges": [tuple(r) for r in f.ranges]} for f in files]
    return spark.createDataFrame([tuple(r[c.name] for c in CHANGED_FILES) for r in rows], CHANGED_FILES)


def changed_nodes(graph: PropertyGraph, changed: DataFrame) -> DataFrame:
    return nodes_for_ranges(graph, ranges_of_files(changed))


def impact_rows(graph: PropertyGraph, changed: DataFrame, max_depth: int = 1, max_nodes: int = 100) -> tuple[DataFrame, bool]:
    """Changed nodes at distance 0 and the nodes they impact, by distance and id; and whether the cap cut any off."""
    touched = cut(changed_nodes(graph, changed))
    reached, cut_off = blast_radius_depth(graph, touched, max_depth, max_nodes)
    rows = touched.withColumn("distance", F.lit(0)).unionByName(reached.select(*touched.columns, "distance"))
    return rows.select(*SUMMARY, "distance").orderBy("distance", "id"), cut_off


def analyze(graph: PropertyGraph, repos: list[Repo], options: ImpactOptions = ImpactOptions(), run: Runner = run_program) -> Report:
    """Scan repositories, map their changes to nodes and follow dependents. Failed repositories become warnings."""
    o = options.settled()
    spark = graph.nodes.sparkSession
    repos = normalized(repos)
    if not repos:
        raise GraphError("at least one repository root is needed")

    def scan(repo: Repo) -> tuple[list[ChangedFile], str, dict]:
        state = dict.fromkeys(("current_root", "current_head", "current_branch", "current_fingerprint", "current_error"))
        state |= {"current_repo_id": repo.id, "current_repo_root": canonical_path(repo.root), "current_dirty": False}
        try:
            now = capture(repo.root, run)
            state |= {
                "current_root": canonical_path(now.root), "current_head": now.head, "current_branch": now.branch,
                "current_dirty": now.dirty, "current_fingerprint": now.status_fingerprint,
            }
        except GraphError as e:
            state["current_error"] = str(e)
        try:
            return changed_files(repo.id, repo.root, o.base_ref, o.untracked, run), "", state
        except GraphError as e:
            return [], str(e), state

    with ThreadPoolExecutor(REPO_WORKERS) as pool:
        scans = list(pool.map(scan, repos))
    report = Report(o.base_ref)
    files: list[ChangedFile] = []
    for repo, (found, error, _) in zip(repos, scans, strict=True):
        report.repos.append(RepoReport(repo.id, repo.root, not error, error))
        if error:
            report.warnings.append(f'repo "{repo.id}": {error}')
        files += found
    if all(r.error for r in report.repos):
        raise AllReposFailed("no repository could be scanned: " + "; ".join(report.warnings))
    files.sort(key=lambda f: (f.repo_id, f.path))
    everything = changed_table(spark, files)
    _add_freshness(spark, report, repos, [s for _, _, s in scans], everything)
    if len(files) > o.max_files:
        report.warnings.append(f"changed files truncated at max_files={o.max_files}")
        files = files[: o.max_files]
    changed = changed_table(spark, files)
    report.changed_files = [asdict(f) for f in files]
    touched = cut(changed_nodes(graph, changed).select(*SUMMARY))
    report.changed_nodes = [r.asDict() for r in touched.orderBy("id").collect()]
    for r in unmatched_files(changed, touched).collect():
        report.warnings.append(f"no graph nodes matched changed file {r.path}" + (f" in repo {r.repo_id}" if r.repo_id else ""))
    reached, cut_off = blast_radius_depth(graph, touched, o.max_depth, o.max_nodes)
    report.impacted_nodes = [r.asDict() for r in reached.select(*SUMMARY, "distance").collect()]
    if cut_off:
        report.warnings.append(f"impacted nodes truncated at max_nodes={o.max_nodes}")
    report.warnings.sort()
    return report


def _add_freshness(spark: SparkSession, report: Report, repos: list[Repo], states: list[dict], changed: DataFrame) -> None:
    names = [f.name for f in METADATA]
    meta = []
    for repo in repos:
        m = dict(repo.metadata or {})
        for path in ("repo_root", "git_root"):
            if m.get(path):
                m[path] = canonical_path(m[path])
        meta.append(m)
    columns = sorted(states[0])
    kinds = ", ".join(f"{c} {'boolean' if c == 'current_dirty' else 'string'}" for c in columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in METADATA) + ", " + kinds
    rows = [tuple(m.get(n) for n in names) + tuple(s[c] for c in columns) for m, s in zip(meta, states, strict=True)]
    scanned = changed.join(
        spark.createDataFrame([(r.id,) for r in report.repos if r.scanned], "repo_id string"), "repo_id", "left_semi"
    )
    judged = untested_changes(freshness(spark.createDataFrame(rows, schema)), scanned)
    by_id = {r.current_repo_id: r for r in judged.select("current_repo_id", "status", "reasons").collect()}
    for repo in report.repos:
        repo.freshness = Freshness(by_id[repo.id].status, list(by_id[repo.id].reasons))


def overall_status(reports: DataFrame) -> str:
    return overall(reports).first().status
