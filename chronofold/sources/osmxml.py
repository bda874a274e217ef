"""Tagged map data in XML: nodes, ways and change files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "tag array<struct<_k:string,_v:string>>"
_COMMON = f"_id long, _version int, _timestamp string, _changeset long, _uid long, _user string, _visible boolean, {_TAG}"


def _tags() -> Column:
    return F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value"))), F.array().cast("array<struct<key:string,value:string>>")))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``id version timestamp changeset user x y tags`` of the nodes; compressed files are read as well."""
    d = spark.read.format("xml").option("rowTag", "node").schema(f"{_COMMON}, _lat double, _lon double").load(path)
    return d.select(F.col("_id").alias("id"), F.col("_version").alias("version"), F.col("_timestamp").alias("timestamp"), F.col("_changeset").alias("changeset"), F.col("_user").alias("user"), F.col("_lon").alias("x"), F.col("_lat").alias("y"), _tags().alias("tags"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """``id version timestamp changeset user refs tags`` of the ways."""
    d = spark.read.format("xml").option("rowTag", "way").schema(f"{_COMMON}, nd array<struct<_ref:long>>").load(path)
    refs = F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>"))
    return d.select(F.col("_id").alias("id"), F.col("_version").alias("version"), F.col("_timestamp").alias("timestamp"), F.col("_changeset").alias("changeset"), F.col("_user").alias("user"), refs.alias("refs"), _tags().alias("tags"))


#: Entities of change files and changesets in file order.
EDITS = (
    "file string, seq long, action string, kind string, id long, version int, timestamp string, changeset long, user string, visible boolean, x double, y double, "
    "refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"
)
_KINDS = {"node", "way", "relation"}


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entities of whole change files in the order in which they stand, whatever their blocks."""
    from io import BytesIO
    from xml.etree import ElementTree

    number = lambda v, kind=int: None if v is None else kind(v)
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            action, rows, seq = "create", [], 0
            for event, e in ElementTree.iterparse(BytesIO(content), ["start", "end"]):
                if event == "start":
                    action = e.tag if e.tag in ("create", "modify", "delete") else action
                    continue
                if e.tag not in _KINDS:
                    continue
                a = e.attrib
                rows.append((
                    path, seq, action, e.tag, number(a.get("id")), number(a.get("version")), a.get("timestamp"), number(a.get("changeset")), a.get("user"), a.get("visible", "true") == "true",
                    number(a.get("lon"), float), number(a.get("lat"), float), [int(n.get("ref")) for n in e.iter("nd")],
                    [{"type": m.get("type"), "ref": int(m.get("ref")), "role": m.get("role")} for m in e.iter("member")], {t.get("k"): t.get("v") for t in e.iter("tag")},
                ))
                seq += 1
                e.clear()
                if len(rows) == 10_000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in EDITS.split(", ")])
    return out.astype({"id": "Int64", "version": "Int32", "changeset": "Int64", "x": "Float64", "y": "Float64"})


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Every node, way and relation of change files as :data:`EDITS`, ``seq`` counting over all files in the order of their names.

    The order of blocks within a file counts, so a file is read by one task; several are read in parallel.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    edits = files.repartition(F.col("path")).mapInPandas(_edits, EDITS)
    return edits.withColumn("seq", F.struct(F.col("file").alias("file"), F.col("seq").alias("at")))


def read_changesets(spark: SparkSession, path: str) -> DataFrame:
    """``id user created_at closed_at open min_lon min_lat max_lon max_lat tags`` of changeset files."""
    schema = f"_id long, _user string, _created_at string, _closed_at string, _open boolean, _min_lon double, _min_lat double, _max_lon double, _max_lat double, {_TAG}"
    d = spark.read.format("xml").option("rowTag", "changeset").schema(schema).load(path)
    names = ["id", "user", "created_at", "closed_at", "open", "min_lon", "min_lat", "max_lon", "max_lat"]
    return d.select(*[F.col("_" + n).alias(n) for n in names], _tags().alias("tags"))
