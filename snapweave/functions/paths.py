"""Functions of slash-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components of a path; empty ones are left out."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def join(*columns: Column) -> Column:
    """Parts joined by one slash each, doubled slashes folded."""
    return F.regexp_replace(F.concat_ws("/", *columns), "/+", "/")


def base(path: Column) -> Column:
    """Last component; a dot for an empty path."""
    own = parts(path)
    return F.when(F.size(own) == 0, ".").otherwise(F.element_at(own, -1))


def parent(path: Column) -> Column:
    """All components but the last; empty for a top-level path."""
    own = parts(path)
    return F.when(F.size(own) <= 1, "").otherwise(F.array_join(F.slice(own, 1, F.size(own) - 1), "/"))


def relative(path: Column, root: Column) -> Column:
    """A path below ``root`` without it; null if it is not below."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2))


def ancestors(path: Column, own: bool = True) -> Column:
    """All prefixes of a path by whole components, the shortest first; with the path itself or not."""
    names = parts(path)
    n = F.size(names) if own else F.size(names) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(names, 1, i), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def under(path: Column, mount: Column) -> Column:
    """Whether a path is a mount or lies below it, by whole components."""
    return (path == mount) | F.startswith(path, F.concat(mount, F.lit("/")))
