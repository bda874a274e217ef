"""Type-two history: every version of an entity with the period in which it was valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import id_hash, norm_id
from ..workspace import BROADCAST_ROWS, discard, materialize, sized_broadcast
from .snapshots import PATH, placed, snapshots

#: Deliveries into which a whole history is cut, to be merged one after the other.
TURNS = 2
#: A stored version: the dimension's rows. ``last_num`` is the last period in which it was seen.
VERSION = "first_num long, parent_path string, ref_name string, h long, from_num long, last_num long, valid_from long, valid_to long"


def merge_versions(dimension: DataFrame | None, batch: DataFrame, keys: list[str], periods: DataFrame | None = None, n_periods: int | None = None) -> DataFrame:
    """Merge a batch of periodic snapshots into a type-two dimension and return the whole dimension.

    ``batch`` has the key columns, the period number ``num``, its time ``ts``, the time ``next_ts`` of the
    next period (-1: none yet) and the attribute hash ``h``; one row for each key and period in which the
    key is present. ``dimension`` (``None``: empty) has one row a version, with ``valid_to`` -1 if open.
    ``periods`` has ``num`` and ``next_ts`` of every period by now, ``n_periods`` rows of it if counted.

    Each key's batch rows follow its open version, and every row's hash is compared with that of the
    version current before it. The same hash in the period right after extends the version; another hash
    closes it at the time of the period after its last and inserts a new open version; an absence closes
    it likewise, also if the key is in no row of the batch. A version last seen in a period without
    successor stays open. Closed versions are passed through untouched. So a merge of two batches in turn equals
    one merge of both. Null key parts are values like any other; an empty batch only closes.
    """
    w = Window.partitionBy(*keys).orderBy("num")
    seen = [*keys, "num", "ts", "next_ts", "h"]
    rows, closed = batch.select(*seen, F.lit(None).cast("long").alias("from_num")), None
    if dimension is not None:
        closed = dimension.filter("valid_to <> -1")
        p = periods.select("num", F.col("next_ts").alias("_next"))
        known = F.broadcast(p) if n_periods is not None and n_periods <= BROADCAST_ROWS else p
        current = dimension.filter("valid_to = -1").withColumnRenamed("last_num", "num").join(known, "num", "left")
        rows = rows.unionByName(
            current.select(*keys, "num", F.col("valid_from").alias("ts"), F.coalesce("_next", F.lit(-1)).cast("long").alias("next_ts"), "h", "from_num")
        )
    same = (F.lag("h").over(w) == F.col("h")) & (F.lag("num").over(w) == F.col("num") - 1)
    opened = F.coalesce(~same, F.lit(True))
    start = F.when(F.col("_open"), F.struct(F.coalesce("from_num", "num").alias("from_num"), F.col("ts").alias("ts")))
    ends = F.coalesce(F.lead("_open").over(w), F.lit(True))
    merged = (
        rows.withColumn("_open", opened)
        .withColumn("_start", F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_end", ends)
        .filter("_end")
        .select(
            *keys, "h", F.col("_start.from_num").alias("from_num"), F.col("num").alias("last_num"),
            F.col("_start.ts").alias("valid_from"), F.col("next_ts").alias("valid_to"),
        )
    )
    return merged if closed is None else closed.select(merged.columns).unionByName(merged)


def turns_of(snaps: DataFrame, turns: int) -> DataFrame:
    """``snaps`` with ``turn`` and ``next_turn``: each line's snapshots cut into ``turns`` deliveries in order, and when the next one comes."""
    held = snaps.groupBy("first_num").agg(F.count("*").alias("_n"))
    turn = lambda num: F.expr(f"cast(({num} - first_num) * {turns} div _n as int)")
    return snaps.join(held, "first_num").withColumns({"turn": turn("num"), "next_turn": turn("num + 1")}).drop("_n")


def feature_versions(commits: DataFrame, refs: DataFrame, turns: int = TURNS) -> DataFrame:
    """``line parent_path ref_name valid_from valid_to``: the versions of every FEATURE path along its line.

    A version is a longest run of consecutive snapshots with the same object and metadata id; the null and
    the NULL metadata id are the same, bounds don't count. A feature without object id is present with that
    null. Repeated and corrected listings count once. Empty inputs give no rows. Each line's snapshots are
    delivered in ``turns``, and each delivery is merged into the written dimension of those before.
    """
    snaps, n = snapshots(commits, refs)
    cut = materialize(turns_of(snaps, turns))
    attr = id_hash(norm_id("object_id"), norm_id("metadata_id"))
    keys, dimension, before = ["first_num", *PATH], None, None
    for turn in range(turns):
        now = cut.withColumn("next_ts", F.when(F.col("next_turn") <= turn, F.col("next_ts")).otherwise(F.lit(-1).cast("long")))
        batch = placed(refs, now.filter(F.col("turn") == turn), n, attr)
        merged = merge_versions(dimension, batch, keys, now.filter(F.col("turn") <= turn), n)
        if turn < turns - 1:
            merged = materialize(merged)
            if before is not None:
                discard(before)
            before = merged
        dimension = merged
    lines = snaps.filter("num = first_num").select("first_num", "line")
    return dimension.join(sized_broadcast(lines, n), "first_num").select("line", *PATH, "valid_from", "valid_to")
