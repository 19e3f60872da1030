"""From changed places in files to nodes: an interval join behind an equality of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.predicates import overlaps, same_repo
from quiver.graph import PropertyGraph


def _meets(whole: Column, start: Column, end: Column, repo: Column) -> Column:
    """Whether a range touches a node, given the equality of their paths."""
    lines = overlaps(F.col("line_start"), F.col("line_end"), start, end)
    return same_repo(repo, F.col("repo_id")) & (F.coalesce(whole, F.lit(False)) | lines)


def nodes_for_ranges(graph: PropertyGraph, ranges: DataFrame) -> DataFrame:
    """Nodes whose file and lines a range meets; a whole-file range meets all of its file. Ordered by id.

    Both sides' paths must be canonical. The equality of paths is the join's key, so that the intervals are a residual
    condition of a hash or merge join.
    """
    wanted = ranges.select(
        F.col("file_path").alias("r_path"), F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"),
        F.col("whole_file").alias("r_whole"), F.coalesce("repo_id", F.lit("")).alias("r_repo"),
    ).filter(F.col("r_path") != "")
    meets = _meets(F.col("r_whole"), F.col("r_start"), F.col("r_end"), F.col("r_repo"))
    return graph.nodes.join(wanted, (F.col("file_path") == F.col("r_path")) & meets, "left_semi").orderBy("id")


def ranges_of_files(changed: DataFrame) -> DataFrame:
    """A row for each hunk of the changed files, one flagged row for a whole file, none for a file without either."""
    path = F.col("absolute_path").alias("file_path")
    whole = changed.filter("whole_file").select(
        path, F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(True).alias("whole_file"), "repo_id"
    )
    hunks = changed.filter("not whole_file").select(path, F.explode("ranges").alias("r"), "repo_id")
    return whole.unionByName(
        hunks.select(
            "file_path", F.col("r.start").alias("start_line"), F.col("r.end").alias("end_line"),
            F.lit(False).alias("whole_file"), "repo_id",
        )
    )


def unmatched_files(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changed files that none of the given nodes lies in, by repository and path."""
    places = nodes.select(F.col("file_path").alias("n_path"), F.col("repo_id").alias("n_repo")).distinct()
    match = (F.col("absolute_path") == F.col("n_path")) & same_repo(F.col("repo_id"), F.col("n_repo"))
    return changed.join(places, match, "left_anti").orderBy("repo_id", "path")
