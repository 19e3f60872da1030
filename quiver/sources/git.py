"""State and changes of Git repositories, by its command line on the driver."""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Callable
from dataclasses import dataclass

from quiver.analysis.diff import ChangedFile, parse_diff, parse_untracked
from quiver.schema import GraphError

#: Runs a program in a folder and returns its output; raises GraphError if it fails.
Runner = Callable[[str, list[str]], bytes]


def run_program(folder: str, args: list[str]) -> bytes:
    try:
        done = subprocess.run(args, cwd=folder, capture_output=True, check=False)
    except OSError as e:
        raise GraphError(f"{' '.join(args)}: {e}") from e
    if done.returncode:
        raise GraphError(f"{' '.join(args)}: {done.stderr.decode('utf-8', 'replace').strip() or done.returncode}")
    return done.stdout


@dataclass(frozen=True)
class GitState:
    root: str
    head: str
    branch: str
    dirty: bool
    status_fingerprint: str


def capture(root: str, run: Runner = run_program) -> GitState:
    """Top folder, commit, branch, whether anything is changed, and SHA-256 of the porcelain status if so.

    A HEAD that is no commit is an error; a branch that Git can't tell, as where HEAD is detached, is empty.
    """
    line = lambda *args: run(root, ["git", *args]).decode("utf-8", "replace").strip()
    top, head = line("rev-parse", "--show-toplevel"), line("rev-parse", "--verify", "HEAD^{commit}")
    try:
        branch = line("branch", "--show-current")
    except GraphError:
        branch = ""
    # as Git's own default has it, a folder without tracked files is one entry
    status = run(root, ["git", "status", "--porcelain=v1", "-z"])
    return GitState(top, head, branch, bool(status), hashlib.sha256(status).hexdigest() if status else "")


def check_base_ref(ref: str) -> None:
    """A base that can't be taken for an option, a negation, a range or several words."""
    if not ref or ref[0] in "-^" or ".." in ref or not re.fullmatch(r"[A-Za-z0-9_./@{}~^+-]+", ref):
        raise GraphError(f"invalid base ref {ref!r}")


def changed_files(repo_id: str, root: str, base_ref: str = "HEAD", untracked: bool = True, run: Runner = run_program) -> list[ChangedFile]:
    check_base_ref(base_ref)
    commit = run(root, ["git", "rev-parse", "--verify", f"{base_ref}^{{commit}}"]).decode().strip()
    diff = run(root, ["git", "diff", "--no-ext-diff", "--unified=0", commit, "--"])
    files = parse_diff(diff.decode("utf-8", "replace"), repo_id, root)
    if untracked:
        listed = run(root, ["git", "ls-files", "-z", "--others", "--exclude-standard"])
        files += parse_untracked(listed.decode("utf-8", "replace"), repo_id, root)
    return files
