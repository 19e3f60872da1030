from __future__ import annotations

import hashlib
import subprocess

import pytest

from quiver.analysis import impact
from quiver.analysis.diff import parse_diff, parse_untracked, unquoted
from quiver.analysis.freshness import freshness, overall
from quiver.functions.text import canonical_path, join_route, markdown_code
from quiver.schema import METADATA, GraphError
from quiver.sinks import markdown
from quiver.sources.git import capture, check_base_ref, run_program
from tests.graphs import graph, node


def diff(*lines):
    return "\n".join(lines) + "\n"


def test_hunks():
    text = diff(
        "diff --git a/a.go b/a.go", "index 1..2 100644", "--- a/a.go", "+++ b/a.go", "@@ -10 +11,2 @@ func x", "-old", "+new", "+--- not a header",
        "@@ -20,2 +21,0 @@", "-x", "--- b/looks.go", "@@ -1 +0,0 @@", "-y",
    )
    (f,) = parse_diff(text, "r", "/root")
    assert (f.path, f.status, f.ranges, f.whole_file, f.absolute_path) == ("a.go", "M", [(11, 12), (21, 21), (0, 0)], False, "/root/a.go")


def test_statuses():
    text = diff(
        "diff --git a/gone.go b/gone.go", "deleted file mode 100644", "--- a/gone.go", "+++ /dev/null", "@@ -1,5 +0,0 @@", *["-x"] * 5,
        "diff --git a/mode.go b/mode.go", "old mode 100644", "new mode 100755",
        "diff --git a/old.go b/new.go", "similarity index 90%", "rename from old.go", "rename to new.go",
        "diff --git a/new2.go b/new2.go", "new file mode 100644", "--- /dev/null", "+++ b/new2.go", "@@ -0,0 +1,3 @@", *["+x"] * 3,
    )
    found = {f.path: (f.status, f.whole_file, f.ranges) for f in parse_diff(text, "", "/r")}
    assert found == {"gone.go": ("D", True, []), "mode.go": ("M", True, []), "new.go": ("R", True, []), "new2.go": ("A", False, [(1, 3)])}


def test_odd_paths():
    assert unquoted('"a/\\303\\251\\t\\"x\\".go"') == 'a/é\t"x".go'
    (f,) = parse_diff(diff('diff --git "a/\\303\\251.go" "b/\\303\\251.go"', "old mode 100644", "new mode 100755"), "", "/r")
    assert f.path == "é.go"
    (f,) = parse_diff(diff("diff --git a/x b/y.go b/x b/y.go", "old mode 1", "new mode 2"), "", "/r")
    assert f.path == "x b/y.go"
    (f,) = parse_diff(diff("diff --git a/l.go b/l.go", "--- a/l.go", "+++ b/l.go", "@@ -1 +1 @@", "-x", "+" + "y" * 70_000), "", "/r")
    assert f.ranges == [(1, 1)]


def test_untracked():
    assert [f.path for f in parse_untracked("a.go\0b c.go\0", "", "/r")] == ["a.go", "b c.go"]
    (f,) = parse_untracked("a.go\n", "r", "/r")
    assert (f.status, f.whole_file, f.untracked) == ("??", True, True)


@pytest.mark.parametrize("ref", ["--cached", "-HEAD", "^HEAD", "main..next", "a\nb", "a\x7f", ""])
def test_bad_refs(ref):
    with pytest.raises(GraphError):
        check_base_ref(ref)


def test_good_refs():
    check_base_ref("origin/main")
    check_base_ref("HEAD~2")


class Fake:
    """Answers of a program by its arguments."""

    def __init__(self, root, diff="", untracked="", head="abc", status=""):
        self.answers = {
            ("rev-parse", "--show-toplevel"): root, ("rev-parse", "HEAD"): head, ("branch", "--show-current"): "main", ("status",): status,
            ("rev-parse", "--verify"): "abc", ("diff",): diff, ("ls-files",): untracked,
        }

    def __call__(self, folder, args):
        for k, v in self.answers.items():
            if tuple(args[1 : 1 + len(k)]) == k:
                if isinstance(v, Exception):
                    raise v
                return v.encode()
        raise GraphError(f"unexpected {args}")


def place(name, a, b):
    return node(f"{name}:FUNC", file_path="/repo/a.go", line_start=a, line_end=b, repo_id="r")


CHANGE = diff("diff --git a/a.go b/a.go", "--- a/a.go", "+++ b/a.go", "@@ -12 +12 @@", "-x", "+y")
META = {"schema_version": 1, "repo_id": "r", "repo_root": "/repo", "include_tests": False, "git_available": True, "git_root": "/repo", "git_head": "abc", "git_dirty_at_analyze": False, "git_status_fingerprint": ""}


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, [place("Changed", 10, 20), place("Direct", 30, 40), place("Second", 50, 60)], ["Direct -CALLS-> Changed", "Second -REFERENCES-> Direct"]).persist()


def test_report(small):
    report = impact.analyze(small, [impact.Repo("/repo", "r", META)], impact.ImpactOptions(max_depth=2), Fake("/repo", CHANGE))
    assert [n["id"] for n in report.changed_nodes] == ["Changed"]
    assert [(n["id"], n["distance"]) for n in report.impacted_nodes] == [("Direct", 1), ("Second", 2)]
    assert report.warnings == [] and report.freshness_status == "fresh"
    text = markdown.impact(report.require_fresh())
    assert "Distance 1:" in text and "`a.go` repo `r` status `M` lines 12-12" in text
    cut = impact.analyze(small, [impact.Repo("/repo", "r", META)], impact.ImpactOptions(max_depth=2, max_nodes=1), Fake("/repo", CHANGE))
    assert cut.warnings == ["impacted nodes truncated at max_nodes=1"]


def test_caps_and_warnings(small):
    gone = diff("diff --git a/a.go b/a.go", "deleted file mode 100644", "--- a/a.go", "+++ /dev/null", "@@ -1 +0,0 @@", "-x")
    report = impact.analyze(small, [impact.Repo("/repo", "r", META)], run=Fake("/repo", gone, "new.go\0", status="?? new.go\0"))
    assert len(report.changed_files) == 2 and len(report.changed_nodes) == 3
    assert report.warnings == ["no graph nodes matched changed file new.go in repo r"] and report.freshness_status == "stale"
    with pytest.raises(GraphError):
        report.require_fresh()
    one = impact.analyze(small, [impact.Repo("/repo", "r", META)], impact.ImpactOptions(max_files=1), Fake("/repo", gone, "b.go\0"))
    assert [f["path"] for f in one.changed_files] == ["a.go"] and "changed files truncated at max_files=1" in one.warnings


def test_failures(small):
    broken = Fake("/repo")
    broken.answers[("diff",)] = GraphError("no diff")
    with pytest.raises(impact.AllReposFailed):
        impact.analyze(small, [impact.Repo("/repo", "r")], run=broken)
    for bad in ({"max_depth": 6}, {"max_nodes": 501}, {"max_files": -1}, {"base_ref": "--x"}):
        with pytest.raises(GraphError):
            impact.analyze(small, [impact.Repo("/repo", "r")], impact.ImpactOptions(**bad), Fake("/repo"))
    with pytest.raises(GraphError):
        impact.analyze(small, [impact.Repo("  ")], run=Fake("/repo"))


def test_test_files_are_stale(small):
    change = CHANGE.replace("a.go", "a_test.go")
    report = impact.analyze(small, [impact.Repo("/repo", "r", META)], run=Fake("/repo", change))
    (reason,) = report.repos[0].freshness.reasons
    assert report.freshness_status == "stale" and "a_test.go" in reason
    tested = impact.analyze(small, [impact.Repo("/repo", "r", META | {"include_tests": True})], run=Fake("/repo", change))
    assert tested.freshness_status == "fresh"
    unknown = impact.analyze(small, [impact.Repo("/repo", "r")], run=Fake("/repo", CHANGE))
    assert unknown.freshness_status == "unknown" and not unknown.repos[0].freshness.reasons[0].startswith("[")


def test_freshness_reasons(spark):
    names = ["current_repo_id", "current_repo_root", "current_root", "current_head", "current_branch", "current_fingerprint", "current_error"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in METADATA) + ", " + ", ".join(f"{n} string" for n in names) + ", current_dirty boolean"
    base = dict.fromkeys([f.name for f in METADATA] + names) | META | {"current_repo_id": "r", "current_repo_root": "/repo", "current_root": "/repo", "current_head": "abc", "current_fingerprint": "", "current_dirty": False}

    def judge(**change):
        row = base | change
        order = [f.name for f in METADATA] + names + ["current_dirty"]
        (r,) = freshness(spark.createDataFrame([tuple(row[c] for c in order)], schema)).collect()
        return r.status, list(r.reasons)

    assert judge() == ("fresh", [])
    assert judge(current_head="def")[1] == ["[stale] graph HEAD abc differs from current HEAD def"]
    status, reasons = judge(current_dirty=True, current_fingerprint="f", schema_version=2)
    assert status == "stale" and len(reasons) == 3 and reasons[-1].startswith("[unknown]")
    assert judge(git_available=False, git_error="/secret")[1] == ["[unknown] git state was unavailable during analyze (error recorded in metadata)"]
    assert judge(current_error="no git")[0] == judge(schema_version=None)[0] == "unknown"
    assert judge(current_repo_id="other")[0] == judge(current_repo_root="/x")[0] == "stale"
    order = spark.createDataFrame([("fresh",), ("unknown",)], "status string")
    assert overall(order).first().status == "unknown" and overall(order.limit(0)).first().status == "unknown"


def test_real_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.go").write_text("".join(f"line {i}\n" for i in range(1, 31)))
    git("add", ".")
    git("commit", "-qm", "first")
    assert not capture(str(tmp_path)).dirty
    lines = (tmp_path / "a.go").read_text().split("\n")
    lines[11] = "changed"
    (tmp_path / "a.go").write_text("\n".join(lines))
    (tmp_path / "new.go").write_text("x")
    state = capture(str(tmp_path))
    assert state.dirty and len(state.status_fingerprint) == 64 and state.branch == "main"
    status = subprocess.run(["git", "status", "--porcelain=v1", "-z"], cwd=tmp_path, check=True, capture_output=True).stdout
    assert state.status_fingerprint == hashlib.sha256(status).hexdigest()
    path = canonical_path(str(tmp_path / "a.go"))
    g = graph(spark, [node("F:FUNC", file_path=path, line_start=10, line_end=20, repo_id="r")], [])
    report = impact.analyze(g, [impact.Repo(str(tmp_path), "r")])
    assert [n["id"] for n in report.changed_nodes] == ["F"] and [f["path"] for f in report.changed_files] == ["a.go", "new.go"]


def test_state_of_odd_repositories(tmp_path):
    """A branch that Git can't tell is empty, a HEAD without a commit is an error, folders without tracked files are one entry."""

    def run(folder, args):
        if "branch" in args:
            raise GraphError("no branch")
        return run_program(folder, args)

    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    with pytest.raises(GraphError):
        capture(str(tmp_path))
    (tmp_path / "a.go").write_text("a")
    git("add", ".")
    git("commit", "-qm", "first")
    assert capture(str(tmp_path), run).branch == "" and not capture(str(tmp_path), run).dirty
    (tmp_path / "more").mkdir()
    for name in ("x.go", "y.go"):
        (tmp_path / "more" / name).write_text(name)
    assert capture(str(tmp_path)).status_fingerprint == hashlib.sha256(b"?? more/\0").hexdigest()


def test_small_functions():
    assert markdown_code("a`b``c") == "```a`b``c```" and markdown_code("`x`") == "`` `x` ``"
    assert join_route("/api", "users/") == "/api/users/" and join_route("", "/") == "/" and join_route("api/", "/v1") == "/api/v1"
