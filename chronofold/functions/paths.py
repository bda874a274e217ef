"""Path functions: ``/``-separated, the root is the empty path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda p: F.col(p) if isinstance(p, str) else p


def full_path(parent: Column | str, name: Column | str) -> Column:
    """``parent/name``, or the name alone below the root."""
    parent, name = _c(parent), _c(name)
    return F.when(F.coalesce(parent, F.lit("")) == "", name).otherwise(F.concat_ws("/", parent, name))


def parent_of(path: Column | str) -> Column:
    """The path without its last part; the root has none (null)."""
    path = _c(path)
    return F.when(path != "", F.regexp_replace(path, "/?[^/]*$", ""))


def name_of(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def depth_of(path: Column | str) -> Column:
    """Number of parts; 0 for the root."""
    path = _c(path)
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def is_below(path: Column | str, ancestor: str) -> Column:
    """Whether the path lies below ``ancestor``, at any depth; everything but the root lies below the root."""
    path = _c(path)
    return path != "" if ancestor == "" else path.startswith(ancestor + "/")


def is_direct_child(path: Column | str, parent: str) -> Column:
    return is_below(path, parent) & (parent_of(path) == parent)


def applies(path: Column | str, is_tree: Column, wanted: str) -> Column:
    """Path filter: a tree applies if it is the wanted path, above or below it; a feature if it is it or below."""
    path = _c(path)
    below = (path == wanted) | is_below(path, wanted)
    return F.when(is_tree, below | (path == "") | F.lit(wanted).startswith(F.concat(path, F.lit("/")))).otherwise(below)


def ancestor_paths(path: Column | str) -> Column:
    """All paths from the first part to the path itself."""
    parts = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
