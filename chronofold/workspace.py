"""Intermediate tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension table may be broadcast; some 200 bytes a row, so about 80 MB at most.
BROADCAST_ROWS = 400_000

#: Partitions up to which their first numbers are looked up in a literal map, and beyond which in a broadcast table.
MAP_ENTRIES = 256

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; unset, a temporary one on a local master and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Delete the tables written in the block when it ends; results must be consumed inside it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            if (spark := _made.pop(path, None)) is not None:
                _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended
        pass


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        _remove(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, without its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronofold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    if _scopes:
        _scopes[-1].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._chronofold_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_chronofold_path", None)
        if path and _made.pop(path, None):
            _remove(t.sparkSession, path)


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``, else left to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def number_rows(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Number the rows 0, 1, 2 ... in the global order of ``order`` without gathering them in one task.

    The rows are range-partitioned and sorted, so a value of the leading column that holds many rows is
    split over tasks as long as the whole ``order`` tells rows apart. Returns the written table and its
    row count. Only one count per partition comes to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in order]
    placed = materialize(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    start, offsets = 0, []
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((r["p"], start - (r["p"] << 33)))
        start += r["count"]
    if len(offsets) > MAP_ENTRIES:
        shift = df.sparkSession.createDataFrame(offsets, "_p long, _shift long")
        out = placed.withColumn("_p", part).join(F.broadcast(shift), "_p").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_p", "_shift")
    else:
        flat = [F.lit(x).cast("long") for pair in offsets for x in pair]
        number = (F.col("_at") + F.create_map(*flat)[part]) if flat else F.col("_at")
        out = placed.withColumn(name, number.cast("long")).drop("_at")
    return out, start
