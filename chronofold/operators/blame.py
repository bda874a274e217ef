"""Who set it: the history of features' attributes along lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..functions.ids import norm_id
from .snapshots import PATH, placed, snapshots


def feature_texts(objects: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``object_id object_text``: one text an id, the first put that has one; texts only features have."""
    o = objects.select(norm_id("id").alias("object_id"), "object_text", "put_seq")
    if base is not None:
        o = o.unionByName(base.select(norm_id("id").alias("object_id"), "object_text", F.lit(-1).cast("long").alias("put_seq")))
    return o.dropna(subset=["object_id", "object_text"]).groupBy("object_id").agg(F.min_by("object_text", "put_seq").alias("object_text"))


def feature_history(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """``first_num parent_path ref_name num ts next_ts object_id alive commit_id line``: features by snapshot, at changes only.

    A row where a path appears, or appears again, or has another object than in the snapshot before; ``alive``
    tells whether the path is in the line's last snapshot.
    """
    snaps, n = snapshots(commits, refs)
    rows = placed(refs, snaps, n, norm_id("object_id")).withColumnRenamed("h", "object_id")
    w = Window.partitionBy("first_num", *PATH).orderBy("num")
    before, was = F.lag("num").over(w), F.lag("object_id").over(w)
    alive = F.max(F.col("next_ts") == -1).over(Window.partitionBy("first_num", *PATH))
    changed = rows.withColumns({"_n": before, "_o": was, "alive": alive}).filter("_n is null or _n <> num - 1 or not (_o <=> object_id)").drop("_n", "_o")
    return changed.join(snaps.select("num", "commit_id", "line"), "num")


def blame(commits: DataFrame, refs: DataFrame, texts: DataFrame) -> DataFrame:
    """``line parent_path ref_name pos value commit_id``: for every attribute of a line's latest features, the commit that set it.

    That is the last snapshot at which the attribute's kind or value differs from the one before, or at which
    the feature appeared. Only features of the line's last snapshot have rows; attributes are compared by
    position, a null value equals a null one; features without text have none.
    """
    history = feature_history(commits, refs)
    full = history.filter("alive").join(texts, "object_id", "left")
    none = F.array().cast("array<struct<pos:int,kind:string,value:string>>")
    versions = full.select("line", "first_num", *PATH, "num", "commit_id", F.coalesce(values.attributes("object_text"), none).alias("a"))
    versions = versions.withColumns({"_last": F.max("num").over(Window.partitionBy("first_num", *PATH))})
    each = versions.select("line", "first_num", *PATH, "num", "commit_id", "_last", F.explode("a").alias("x")).select(
        "line", "first_num", *PATH, "num", "commit_id", "_last", "x.pos", "x.kind", "x.value"
    )
    w = Window.partitionBy("first_num", *PATH, "pos").orderBy("num")
    here = F.struct("kind", "value")
    order = each.withColumns({"_was": F.lag(here).over(w), "_now": here})
    sets = order.filter(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.col("_now")))
    last = sets.groupBy("line", *PATH, "pos", "_last").agg(F.max_by(F.struct("value", "commit_id", "num"), "num").alias("x"))
    # the attribute must still be there in the last version
    alive = each.filter("num = _last").select("line", *PATH, "pos")
    return last.join(alive, [last[c].eqNullSafe(alive[c]) for c in ("line", *PATH, "pos")]).select(
        last["line"], last["parent_path"], last["ref_name"], last["pos"], "x.value", "x.commit_id"
    )
