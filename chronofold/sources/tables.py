"""Tables of other stores: JDBC databases, delimited and columnar files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: URL forms of the databases features come from and go to. Fixed values.
URLS = {
    "postgis": "jdbc:postgresql://{host}:{port}/{database}", "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@{host}:{port}:{database}", "spatialite": "jdbc:sqlite:{database}",
}
#: Catalogue queries that list a database's tables. Fixed values.
TABLES = {
    "postgis": "select table_name from information_schema.tables where table_schema not in ('pg_catalog', 'information_schema')",
    "sqlserver": "select table_name from information_schema.tables", "oracle": "select table_name from user_tables",
    "spatialite": "select name as table_name from sqlite_master where type = 'table'",
}


def jdbc_options(kind: str, database: str, host: str = "localhost", port: int | None = None, **options: str) -> dict[str, str]:
    return {"url": URLS[kind].format(host=host, port=port, database=database), **options}


def read_jdbc(spark: SparkSession, table: str, options: dict[str, str], key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric key if one is given; filters and columns are pushed down."""
    r = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def write_jdbc(table: DataFrame, name: str, options: dict[str, str], overwrite: bool = False, partitions: int | None = None) -> None:
    """Write a table to a database, by at most ``partitions`` connections; an existing table is an error unless ``overwrite``."""
    out = table.coalesce(partitions) if partitions else table
    out.write.format("jdbc").options(**options).option("dbtable", name).mode("overwrite" if overwrite else "errorifexists").save()


def list_tables(spark: SparkSession, kind: str, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).option("query", TABLES[kind]).load()


def describe(table: DataFrame) -> dict[str, str]:
    """Columns and their types."""
    return dict(table.dtypes)


def export_features(features: DataFrame, fields: list[tuple[str, str]], mode: str = "default", type_id: str | None = None, convert: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Features with attributes as a table of ``fields`` (name, field type), to be written anywhere.

    ``features`` has ``ref_name``, ``metadata_id`` and ``attributes``. Features of another type than the default
    one (those with a metadata id of their own) are an error in mode ``error``, left out in ``default``,
    chosen by ``type_id`` in ``filter``, and fitted by position, with nulls for what they lack, in ``alter``.
    """
    from ..functions.values import typed

    if mode == "default":
        features = features.filter("metadata_id is null")
    elif mode == "filter":
        features = features.filter(F.col("metadata_id") == type_id)
    elif mode == "error":
        if features.filter("metadata_id is not null").limit(1).count():
            raise ValueError("the tree has features of several types")
    elif mode != "alter":
        raise ValueError(f"unknown mode {mode}")
    cols = [typed(F.try_element_at("attributes", F.lit(i + 1))["value"], kind).alias(name) for i, (name, kind) in enumerate(fields)]
    out = features.select(F.col("ref_name").alias("fid"), *cols)
    return convert(out) if convert else out


def strip_prefix(table: DataFrame, fid: str, prefix: str) -> DataFrame:
    """Feature ids without the type's name before them."""
    return table.withColumn(fid, F.when(F.col(fid).startswith(prefix + "."), F.substring(F.col(fid), len(prefix) + 2, 1 << 30)).otherwise(F.col(fid)))


def adapt(table: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, those the table lacks being null and others left out."""
    from pyspark.sql.types import StructType

    want = table.sparkSession.createDataFrame([], schema).schema if not isinstance(schema, StructType) else schema
    return table.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])
