"""Streams of changes into a store: one commit a micro-batch, and versions kept as listings arrive."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..repo import Repo


def replay(stream: DataFrame, repo: Repo, path: str, fid: str, kinds: dict[str, str], geometry: str | None, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a stream of features to a repository's tree, one commit for each micro-batch that changes it.

    The number of the last batch applied is in the message of its commit, so a batch that comes again after a failure
    is passed over: a batch is done exactly if its commit is. Each tree has numbers of its own.
    """

    def apply(batch: DataFrame, number: int) -> None:
        said = re.compile(rf"batch (\d+) of {re.escape(path)}")
        done = max((int(m.group(1)) for c in repo.log() if (m := said.fullmatch(c["message"]))), default=-1)
        if number <= done or batch.isEmpty():
            return
        repo.insert(path, batch, fid, kinds, geometry)
        try:
            repo.commit(f"batch {number} of {path}", all=True)
        except ValueError:  # the batch says what is there already
            pass

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def change_rates(stream: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Puts by time window and ``by``; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("from"), F.col("window.end").alias("until"), *by, "n"
    )


def read_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def for_each(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
