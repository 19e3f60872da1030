"""String and path expressions."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """The folder of a clean slash path; "." for a bare name, "/" for one in the root."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(~path.contains("/"), ".").when(folder == "", "/").otherwise(folder)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def last_segment(path: Column) -> Column:
    """What follows the last slash, the whole if nothing does."""
    tail = F.substring_index(path, "/", -1)
    return F.when(tail == "", path).otherwise(tail)


def identifier(column: Column) -> Column:
    """Letters, digits and underscores alone, with an underscore before a leading digit."""
    safe = F.regexp_replace(column, "[^A-Za-z0-9_]", "_")
    return F.when(safe == "", "_").when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe)


def escaped(column: Column) -> Column:
    """Backslash, quote and line ends with a backslash before."""
    out = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(out, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def route_parts(pattern: Column) -> tuple[Column, Column]:
    """Method and path of an HTTP pattern such as "GET /x"; without a method it is ANY."""
    trimmed = F.regexp_replace(pattern, r"^\s+|\s+$", "")
    method = F.regexp_extract(trimmed, r"^(\S+)\s+(\S.*)$", 1)
    path = F.regexp_extract(trimmed, r"^(\S+)\s+(\S.*)$", 2)
    return F.when(method == "", "ANY").otherwise(F.upper(method)), F.when(method == "", trimmed).otherwise(path)


def join_route(prefix: str, path: str) -> str:
    """A route below a group's prefix: one leading slash, a trailing slash kept."""
    if not path:
        return "/" + prefix.lstrip("/") if prefix else "/"
    joined = posixpath.normpath("/" + prefix.strip("/") + "/" + path.lstrip("/"))
    joined = "/" + joined.lstrip("/")
    return joined + "/" if path.endswith("/") and not joined.endswith("/") else joined


def join_route_column(prefix: Column, path: Column) -> Column:
    """The same for columns."""
    joined = F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), path), "/+", "/")
    bare = F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))
    return F.when(path.endswith("/") & ~bare.endswith("/"), F.concat(bare, F.lit("/"))).otherwise(bare)


def short_commit(commit: Column) -> Column:
    return F.substring(F.trim(commit), 1, 12)


def human_bytes(n: int) -> str:
    size = float(n)
    for unit in ("B", "KiB", "MiB", "GiB"):
        if size < 1024 or unit == "GiB":
            return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{n} B"


_paths: dict[str, str] = {}


def canonical_path(path: str) -> str:
    """Absolute, clean, with symbolic links resolved; of a missing file, those of its folder. Driver only."""
    if not path:
        return ""
    if path not in _paths:
        full = os.path.abspath(path)
        if os.path.exists(full):
            full = os.path.realpath(full)
        else:
            full = os.path.join(os.path.realpath(os.path.dirname(full)), os.path.basename(full))
        _paths[path] = full
    return _paths[path]


def clean_path(column: Column) -> Column:
    """Lexical cleaning of absolute paths: no double slashes, no "." parts, no trailing slash."""
    out = F.regexp_replace(column, "/(\\./)+", "/")
    out = F.regexp_replace(F.regexp_replace(out, "/+", "/"), "/\\.$", "")
    return F.when(out == "/", out).otherwise(F.regexp_replace(out, "/$", ""))


def markdown_code(text: str) -> str:
    """Inline code whose fence is longer than any run of backticks inside."""
    text = text.replace("\r", " ").replace("\n", " ")
    longest = run = 0
    for c in text:
        run = run + 1 if c == "`" else 0
        longest = max(longest, run)
    fence = "`" * (longest + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"
