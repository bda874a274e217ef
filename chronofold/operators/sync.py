"""Synchronisation of repositories as set differences of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bounds
from ..functions.ids import norm_id


def missing_ids(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """``id``: distinct ids of ``wanted`` that ``have`` lacks."""
    w, h = (d.select(norm_id("id").alias("id")).dropna().distinct() for d in (wanted, have))
    return w.join(h, "id", "left_anti")


def shallow(graph, tips: DataFrame, depth: int) -> DataFrame:
    """``start id back``: commits at most ``depth - 1`` first-parent steps from the tips."""
    return graph.first_parents(tips).filter(F.col("back") < depth)


def fast_forwards(graph, pairs: DataFrame) -> DataFrame:
    """``pair forward``: whether ``left_id`` (the remote head) is reached from ``right_id`` (ours), so a push loses nothing."""
    reached = graph.reach(pairs.select(F.col("pair").alias("start"), F.col("right_id").alias("id")))
    hit = reached.withColumnRenamed("start", "pair").join(pairs.select("pair", F.col("left_id").alias("id")), ["pair", "id"], "left_semi")
    flag = hit.select("pair", F.lit(True).alias("forward"))
    return pairs.select("pair").join(flag, "pair", "left").select("pair", F.coalesce("forward", F.lit(False)).alias("forward"))


def sparse_changes(changes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Changes a filtered copy needs: the old side passes the filter, or else the new one does."""
    return changes.filter(bounds.intersects(box, "old_") | bounds.intersects(box, "new_"))


def outdated_refs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``name old new transfer``: what a fetch does to each ref: ADDED, CHANGED or, if the remote lost it, REMOVED."""
    a = local.select("name", F.col("target").alias("old"))
    b = remote.select("name", F.col("target").alias("new"))
    kind = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").otherwise("CHANGED")
    return a.join(b, "name", "full_outer").filter("not (old <=> new)").select("name", "old", "new", kind.alias("transfer"))
