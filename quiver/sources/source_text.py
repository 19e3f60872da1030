"""Source text of nodes: on the driver for one node, or from a table of lines for many."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.schema import GraphError


class SourceUnavailable(GraphError):
    """A node without a place in a file, or a file that can't be read."""


def _place(node: dict) -> tuple[str, int, int]:
    path, start, end = node["file_path"], node["line_start"], node["line_end"]
    if not path:
        raise SourceUnavailable("the node has no file path")
    if not start and not end:
        raise SourceUnavailable("the node has no line range")
    if start < 1 or end < start:
        raise SourceUnavailable(f"invalid line range {start}-{end}")
    return path, start, end


def source_code(node: dict) -> str:
    """A node's lines, each ended by a newline whatever ended it in the file."""
    path, start, end = _place(node)
    out = []
    try:
        with open(path, encoding="utf-8", errors="replace", newline="\n") as f:
            for number, line in enumerate(f, 1):
                if number > end:
                    break
                if number >= start:
                    out.append(line.rstrip("\n").removesuffix("\r") + "\n")
    except OSError as e:
        raise SourceUnavailable(f"cannot read {os.path.basename(path)}: {e.strerror}") from e
    return "".join(out)


def bounded_source(node: dict, max_lines: int, max_bytes: int) -> tuple[str, bool]:
    """A node's lines as they are in the file, up to both caps, and whether a cap cut them. A cut never splits a character."""
    path, start, end = _place(node)
    out, size, truncated = [], 0, False
    try:
        with open(path, "rb") as f:
            for number, line in enumerate(f, 1):
                if number > end:
                    break
                if number < start:
                    continue
                if number - start >= max_lines:
                    truncated = True
                    break
                if size + len(line) > max_bytes:
                    out.append(line[: max_bytes - size].decode("utf-8", "ignore"))
                    truncated = True
                    break
                out.append(line.decode("utf-8", "replace"))
                size += len(line)
    except OSError as e:
        raise SourceUnavailable(f"cannot read {os.path.basename(path)}: {e.strerror}") from e
    return "".join(out), truncated


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file_path, line_no (from 1), text of text files in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    text = F.split(F.decode("content", "UTF-8"), "\r?\n")
    rows = files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), F.posexplode(text).alias("at", "text"))
    return rows.select("file_path", (F.col("at") + 1).alias("line_no"), "text")


def excerpts(nodes: DataFrame, lines: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Lines of many nodes: id, line_no, text; an equality of paths with the line range as residual condition."""
    placed = nodes.filter((F.col("file_path") != "") & (F.col("line_start") > 0) & (F.col("line_end") >= F.col("line_start")))
    last = F.col("line_end") if max_lines is None else F.least("line_end", F.col("line_start") + (max_lines - 1))
    placed = placed.select("id", F.col("file_path").alias("n_path"), "line_start", last.alias("last"))
    match = (F.col("n_path") == F.col("file_path")) & F.col("line_no").between(F.col("line_start"), F.col("last"))
    return placed.join(lines, match).select("id", "line_no", "text").orderBy("id", "line_no")
