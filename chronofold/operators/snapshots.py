"""Listings of root trees seen as snapshots of lines, and what changed between consecutive ones.

A *snapshot* of a line is a commit whose tree has a listing; snapshots are ordered by committer time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import id_hash, norm_id
from ..workspace import materialize, number_rows, sized_broadcast

PATH = ["parent_path", "ref_name"]


def _listed_commits(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """``tree line commit_id ts`` of every commit of a line whose tree has a listing; of the listings only the trees' ids are read."""
    c = (
        commits.select(
            "line", norm_id("commit_id").alias("commit_id"), norm_id("tree").alias("tree"), F.col("committer_ts").alias("ts")
        )
        .dropna()
        .groupBy("line", "commit_id")
        .agg(F.min("ts").alias("ts"), F.max("tree").alias("tree"))
    )
    listed = refs.select(norm_id("tree").alias("tree")).dropna().distinct()
    return c.join(listed, "tree", "left_semi")


def line_ends(commits: DataFrame, refs: DataFrame) -> tuple[DataFrame, int]:
    """``line first last``: the trees of each line's first and last snapshot, by plain aggregates; and the number of lines."""
    at = F.struct("ts", "commit_id", "tree")
    ends = materialize(_listed_commits(commits, refs).groupBy("line").agg(F.min(at)["tree"].alias("first"), F.max(at)["tree"].alias("last")))
    return ends, ends.count()


def snapshots(commits: DataFrame, refs: DataFrame) -> tuple[DataFrame, int]:
    """Number the snapshots of all lines: ``num line commit_id tree ts next_ts first_num``, and their count.

    ``num`` is consecutive within a line, ``first_num`` that of the line's first snapshot, ``next_ts`` the
    time of the line's next snapshot or -1. Commits delivered again count once, with the smallest time.
    Commits without line, id, tree or time make no snapshot. Equal times are ordered by commit id.
    """
    numbered, n = number_rows(_listed_commits(commits, refs), ["line", "ts", "commit_id"], "num")
    ends = numbered.groupBy("line").agg(F.min("num").alias("first_num"))
    after = numbered.select(F.col("line").alias("l2"), (F.col("num") - 1).alias("num"), F.col("ts").alias("next_ts"))
    out = (
        numbered.join(after, (numbered["num"] == after["num"]) & (numbered["line"] == after["l2"]), "left")
        .drop("l2", after["num"])
        .join(ends, "line")
        .withColumn("next_ts", F.coalesce("next_ts", F.lit(-1).cast("long")))
    )
    return materialize(out), n


def placed(refs: DataFrame, snaps: DataFrame, n_snaps: int, attr: Column) -> DataFrame:
    """Features by snapshot: ``first_num parent_path ref_name num ts next_ts h``, clustered and sorted by path.

    One shuffle, by (line, path), serves everything that follows: the rows of a line's path come together
    sorted by snapshot, and of several rows for a path of one tree the one listed last counts; one that
    is a TREE by then is no feature. ``attr`` is hashed into ``h``. Keys are as fine as a path of a line,
    so no key has more rows than its line has snapshots, repeats aside.
    """
    r = refs.select(norm_id("tree").alias("tree"), *PATH, "ref_type", attr.alias("h"), "listed_at")
    s = snaps.select("tree", "num", "ts", "next_ts", "first_num")
    rows = r.join(sized_broadcast(s, n_snaps), "tree").drop("tree")
    key = ["first_num", *PATH]
    w = Window.partitionBy(*key).orderBy("num", F.col("listed_at").asc_nulls_first(), "ref_type", "h")
    return (
        rows.repartition(*key)
        .withColumn("_later", F.lead("num").over(w))
        .filter((F.col("_later").isNull() | (F.col("_later") != F.col("num"))) & (F.col("ref_type") == "FEATURE"))
        .select(*key, "num", "ts", "next_ts", "h")
    )


def object_hash() -> Column:
    return id_hash(norm_id("object_id"))


def snapshot_changes(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """``commit_id parent_path ref_name change_kind``: paths that differ from the line's previous snapshot.

    Each path of a line is windowed by snapshot number: another lagged object hash is MODIFIED, a gap in
    the numbers is REMOVED after its start and ADDED at its end, a last number before the line's last is
    REMOVED. Metadata ids and bounds don't count, nor does a line's first snapshot. Null path parts are
    values like any other, a null object id equals only another null. Empty inputs give no rows.
    """
    snaps, n = snapshots(commits, refs)
    rows = placed(refs, snaps, n, object_hash())
    w = Window.partitionBy("first_num", *PATH).orderBy("num")
    case = lambda on, num, kind: F.when(on, F.struct(num.alias("num"), F.lit(kind).alias("change_kind")))
    num, before = F.col("num"), F.col("_before")
    cases = F.array(
        case(before < num - 1, before + 1, "REMOVED"),
        case(F.when(before.isNull(), num > F.col("first_num")).otherwise(before < num - 1), num, "ADDED"),
        case((before == num - 1) & (F.col("_h") != F.col("h")), num, "MODIFIED"),
        case(F.col("_after").isNull() & (F.col("next_ts") != -1), num + 1, "REMOVED"),
    )
    found = (
        rows.withColumns({"_before": F.lag("num").over(w), "_h": F.lag("h").over(w), "_after": F.lead("num").over(w)})
        .select(*PATH, F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("x"))
        .select(*PATH, "x.num", "x.change_kind")
    )
    return found.join(sized_broadcast(snaps.select("num", "commit_id"), n), "num").select("commit_id", *PATH, "change_kind")
