"""A workspace: a name and the repositories it holds, kept as JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from quiver.graph import PropertyGraph
from quiver.schema import GraphError, NotFound
from quiver.sources.storage import GraphStore, load_all


def check_name(kind: str, name: str) -> str:
    name = name.strip()
    if not name or name in (".", "..") or any(c in name for c in "/\\:\0"):
        raise GraphError(f"invalid {kind} {name!r}")
    return name


@dataclass
class Workspace:
    name: str
    repos: dict[str, str] = field(default_factory=dict)  # id to root

    def __post_init__(self) -> None:
        self.name = check_name("workspace name", self.name)

    @classmethod
    def load(cls, path: str) -> Workspace:
        if not os.path.exists(path):
            raise NotFound(f"no workspace file {path}")
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        out = cls(data.get("name", ""))
        for repo, root in (data.get("repos") or {}).items():
            out.add(repo, root)
        return out

    def save(self, path: str) -> None:
        """Replace the file at once, so that a reader never meets half of it."""
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump({"name": self.name, "repos": dict(sorted(self.repos.items()))}, f, indent=2)
        os.replace(path + ".new", path)

    def add(self, repo_id: str, root: str) -> None:
        repo_id = check_name("repository id", repo_id)
        root = os.path.abspath(root)
        if repo_id in self.repos:
            raise GraphError(f"repository {repo_id!r} is in the workspace already")
        if root in self.repos.values():
            raise GraphError(f"{root} is in the workspace already")
        self.repos[repo_id] = root

    def remove(self, repo_id: str) -> None:
        if repo_id not in self.repos:
            raise NotFound(f"repository {repo_id!r} isn't in the workspace")
        del self.repos[repo_id]

    def stores(self, spark: SparkSession, folder: str) -> list[GraphStore]:
        """A store for each repository, by id."""
        return [GraphStore(spark, f"{folder.rstrip('/')}/{r}") for r in sorted(self.repos)]

    def graph(self, spark: SparkSession, folder: str) -> PropertyGraph:
        return load_all(self.stores(spark, folder))
