"""History of lines: log with its filters, statistics, and the commit before a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from .graph import Graph

PERSON = ["name", "email", "ts", "tz"]


def clean_commits(commits: DataFrame) -> DataFrame:
    """Commits with normalised ids, each once per line: the first receipt's content. Commits without id or line are left out."""
    rest = [c for c in commits.columns if c not in ("commit_id", "line", "tree", "parents", "received_at")]
    c = commits.select(norm_id("commit_id").alias("commit_id"), "line", norm_id("tree").alias("tree"), F.transform("parents", norm_id).alias("parents"), *rest, "received_at")
    content = ["tree", "parents", *rest]
    first = F.min(F.struct("received_at", *content)).alias("x")
    return c.filter("commit_id is not null and line is not null").groupBy("commit_id", "line").agg(first).select("commit_id", "line", *[f"x.{k}" for k in content], "x.received_at")


def heads(commits: DataFrame) -> DataFrame:
    """``line commit_id``: each line's newest commit by committer time, then id."""
    return commits.groupBy("line").agg(F.max(F.struct("committer_ts", "commit_id")).alias("x")).select("line", "x.commit_id")


def log(
    commits: DataFrame, graph: Graph, tips: DataFrame | None = None, since: DataFrame | None = None, first_parent: bool = False,
    author: str | None = None, committer: str | None = None, after: int | None = None, before: int | None = None,
) -> DataFrame:
    """``start`` and the commits of its history.

    ``tips`` (``start id``; by default the lines' heads) begin, ``since`` (``start id``) excludes what it
    reaches. Whole-string patterns for author and committer pass absent names; ``after`` and ``before``
    bound the committer time, both included. Orders are columns: ``committer_ts``, ``commit_id`` for the
    chronological one, ``back`` (with ``first_parent``) for the linear one, and :meth:`Graph.topological`.
    """
    tips = heads(commits).select(F.col("line").alias("start"), F.col("commit_id").alias("id")) if tips is None else tips
    reached = graph.first_parents(tips) if first_parent else graph.reach(tips)
    if since is not None:
        reached = reached.join(graph.reach(since), ["start", "id"], "left_anti")
    one = commits.dropDuplicates(["commit_id"])
    out = reached.withColumnRenamed("id", "commit_id").join(one, "commit_id")
    for name, pattern in (("author_name", author), ("committer_name", committer)):
        if pattern is not None:
            out = out.filter(F.col(name).isNull() | F.col(name).rlike(f"^(?:{pattern})$"))
    if after is not None:
        out = out.filter(F.col("committer_ts") >= after)
    if before is not None:
        out = out.filter(F.col("committer_ts") <= before)
    return out


def page(rows: DataFrame, order: list, skip: int = 0, limit: int | None = None) -> DataFrame:
    """A page of an ordered result; the order must tell all rows apart."""
    out = rows.orderBy(*order).offset(skip)
    return out if limit is None else out.limit(limit)


def commit_before(commits: DataFrame, graph: Graph, when: int) -> DataFrame:
    """``line commit_id``: the nearest commit on each head's first-parent way whose committer time is before ``when``."""
    tips = heads(commits).select(F.col("line").alias("start"), F.col("commit_id").alias("id"))
    one = commits.select("commit_id", "committer_ts").dropDuplicates(["commit_id"])
    way = graph.first_parents(tips).join(one, F.col("id") == F.col("commit_id")).filter(F.col("committer_ts") < when)
    return way.groupBy(F.col("start").alias("line")).agg(F.min_by("id", "back").alias("commit_id"))


def statistics(commits: DataFrame) -> DataFrame:
    """For each line: commits, distinct authors (the committer where the author is unnamed), first and last commit."""
    who = F.coalesce("author_name", "committer_name")
    return commits.groupBy("line").agg(
        F.count("*").alias("n_commits"), F.count_distinct(who).alias("n_authors"),
        F.min(F.struct("committer_ts", "commit_id"))["commit_id"].alias("first_commit"),
        F.max(F.struct("committer_ts", "commit_id"))["commit_id"].alias("last_commit"),
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """``commit_id added modified removed`` from ``commit_id change_kind``."""
    n = lambda k: F.count(F.when(F.col("change_kind") == k, 1)).alias(k.lower())
    return changes.groupBy("commit_id").agg(n("ADDED"), n("MODIFIED"), n("REMOVED"))


def commits_touching(changes: DataFrame, path: str) -> DataFrame:
    """Commits with a change at or below a path."""
    from ..functions.paths import full_path, is_below

    p = full_path("parent_path", "ref_name")
    return changes.filter((p == path) | is_below(p, path)).select("commit_id").distinct()
