"""Reports as Markdown, formatted on the driver from bounded results."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame

from quiver.analysis.impact import Report
from quiver.functions.text import human_bytes, markdown_code as code
from quiver.operators.context import NodeContext
from quiver.operators.stats import statistics


def node_list(title: str, nodes: DataFrame) -> str:
    rows = nodes.collect()
    if not rows:
        return f"## {title}\n\n_None found._\n"
    lines = [f"- {code(r.name)} ({r.type}) {code(r.id)}" + (f" in {code(r.file_path)}" if r.file_path else "") for r in map(_row, rows)]
    return f"## {title}\n\n" + "\n".join(lines) + "\n"


class _row:  # noqa: N801 - attribute access over a row with a column "count" or "index"
    def __init__(self, row):  # noqa: ANN001
        self.__dict__.update(row.asDict())


def concurrency(title: str, rows: DataFrame) -> str:
    out = [f"## {title}", ""]
    for direction, group in groupby(rows.collect(), key=lambda r: r.direction):
        out += [f"### {direction}", ""]
        out += [f"- {r.edge_type} {code(r.name)} ({r.type}) {code(r.id)}" for r in map(_row, group)]
        out.append("")
    return "\n".join(out) if len(out) > 2 else f"## {title}\n\n_None found._\n"


def path(rows: DataFrame) -> str:
    out = ["## Call path", ""]
    for r in map(_row, rows.collect()):
        out.append(f"{r.step + 1}. {code(r.name)} ({r.type}) {code(r.id)}" + (f" -{r.next_edge}->" if r.next_edge else ""))
    return "\n".join(out) + "\n"


def tree(rows: DataFrame) -> str:
    out = ["## Structure", ""]
    for r in sorted(rows.collect(), key=lambda r: r.position):
        out.append("  " * r.depth + f"- {code(r['name'])} ({r.type})")
    return "\n".join(out) + "\n"


def source(node: dict, text: str) -> str:
    longest = max((len(run) for run in _runs(text)), default=0)
    fence = "`" * max(3, longest + 1)
    return f"## {code(node['id'])}\n\n{fence}go\n{text}{'' if text.endswith(chr(10)) else chr(10)}{fence}\n"


def _runs(text: str) -> list[str]:
    return ["".join(g) for c, g in groupby(text) if c == "`"]


def context(found: NodeContext) -> str:
    node = found.node
    out = [f"# {code(node['name'])} ({node['type']})", "", f"- ID: {code(node['id'])}"]
    if node["file_path"]:
        out.append(f"- File: {code(node['file_path'])} lines {node['line_start']}-{node['line_end']}")
    rows = sorted(found.sections.collect(), key=lambda r: (r.section, r.position))
    for section, group in groupby(rows, key=lambda r: r.section):
        more = " (truncated)" if found.truncated.get(section) else ""
        out += ["", f"## {section.capitalize()}{more}", ""]
        for r in map(_row, group):
            detail = f" distance {r.distance}" if r.distance is not None else f" {r.direction} {r.edge_type}"
            out.append(f"- {code(r.name)} ({r.type}) {code(r.id)}{detail}")
    if found.source:
        out += ["", source(node, found.source)]
    if found.warnings:
        out += ["", "## Warnings", "", *(f"- {w}" for w in found.warnings)]
    return "\n".join(out) + "\n"


def stats(graph) -> str:  # noqa: ANN001
    """Count tables, largest first, and names in order among equals."""
    rows = sorted((_row(r) for r in statistics(graph).collect()), key=lambda r: (r.metric, -r.__dict__["count"], r.key))
    out = []
    for metric, group in groupby(rows, key=lambda r: r.metric):
        for r in group:
            value = r.__dict__["count"]
            shown = human_bytes(value) if metric == "estimated_bytes" else str(value)
            out.append(f"{metric}{' ' + r.key if r.key else ''}: {shown}")
    return "\n".join(out) + "\n"


def impact(report: Report) -> str:
    """The change report: what changed, what that touches, grouped by distance, repository, package and file."""
    out = ["## Change Impact", ""]
    out += [
        f"- Base ref: {code(report.base_ref)}", f"- Graph freshness: **{report.freshness_status}**",
        f"- Repositories scanned: **{sum(r.scanned for r in report.repos)}**", f"- Changed files: **{len(report.changed_files)}**",
        f"- Changed nodes: **{len(report.changed_nodes)}**", f"- Impacted nodes: **{len(report.impacted_nodes)}**",
        f"- Warnings: **{len(report.warnings)}**", "", "### Graph Freshness", "",
    ]
    for repo in report.repos:
        out.append(f"- Repo {code(repo.id or repo.root)}: **{repo.freshness.status}**")
        out += [f"  - {reason}" for reason in repo.freshness.reasons]
    if not report.changed_files:
        out += ["", "No changes detected."]
    else:
        out += ["", "### Changed Files", ""]
        for f in report.changed_files:
            where = " whole file" if f["whole_file"] else ""
            if not where and f["ranges"]:
                where = " lines " + ", ".join(f"{a}-{b}" for a, b in f["ranges"])
            out.append(f"- {code(f['path'])}" + (f" repo {code(f['repo_id'])}" if f["repo_id"] else "") + f" status {code(f['status'])}{where}")
        out += ["", "### Changed Nodes", "", *_summaries(report.changed_nodes), "", "### Impacted Dependents"]
        if not report.impacted_nodes:
            out += ["", "_No impacted dependency nodes found._"]
        for distance, group in groupby(report.impacted_nodes, key=lambda n: n["distance"]):
            out += ["", f"Distance {distance}:", "", *_summaries(list(group))]
    if report.warnings:
        out += ["", "### Warnings", "", *(f"- {w}" for w in report.warnings)]
    return "\n".join(out) + "\n"


def _summaries(nodes: list[dict]) -> list[str]:
    out = []
    place = lambda n: (n["repo_id"], n["pkg_path"], n["file_path"])
    for (repo, package, file), group in groupby(sorted(nodes, key=lambda n: (*place(n), n["id"])), key=place):
        out.append("- " + ", ".join(code(x) for x in (repo, package, file) if x) if repo or package or file else "- elsewhere")
        out += [f"  - {code(n['name'])} ({n['type']}) {code(n['id'])}" for n in group]
    return out or ["_None._"]
