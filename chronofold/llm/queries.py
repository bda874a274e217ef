"""Queries pN_... of the problems tagged llm, over whole tables. Results that depend on tokenizers and fitted models
can't be had by SQL; tests hold them against brute force, exact sums and known cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import membership, mixing, packing, subjects

#: Batches of equal ranges of put numbers that :func:`p3_new_batch` cuts the log into.
EIGHTHS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return membership.seen_before(_table(spark, d, "objects"), _table(spark, d, "base_objects"))


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return membership.wrong_answers(_table(spark, d, "objects"), _table(spark, d, "base_objects"))


def p3_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """The last eighth of the put numbers, decided by the stored partitions of the other seven."""
    puts = _table(spark, d, "objects").select("put_seq", "id")
    span = puts.agg(F.min("put_seq").alias("a"), F.max("put_seq").alias("b")).first()
    low, high = span["a"] or 0, span["b"] or 0
    width = -(-(high - low + 1) // EIGHTHS)
    cut = puts.withColumn("batch", F.expr(f"cast((put_seq - {low}L) div {width}L as int)"))
    new = F.col("batch") == EIGHTHS - 1
    return membership.seen_in_new_batch(cut.filter(~new), cut.filter(new), _table(spark, d, "base_objects"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"), _table(spark, d, "container_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = _table(spark, d, "container_sizes")
    return packing.fill_report(packing.pack_documents(_table(spark, d, "documents"), sizes), sizes)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*(_table(spark, d, t) for t in ("documents", "doc_labels", "subjects")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_error_rate, p3_new_batch, p6_containers, p6_fill, p7_mix, p7_shares, p8_found, p8_composition)}


def oracle_sql() -> dict[str, str]:
    from ..plans.problems import norm

    seen = f"""with o as (select put_seq, {norm('id')} as id from objects),
    m as (select id, min(put_seq) as first_seq from o where id is not null group by id),
    f as (select o.put_seq from o join m on o.id = m.id where o.put_seq > m.first_seq
    or o.id in (select {norm('id')} from base_objects where {norm('id')} is not null))"""
    return {
        "p3_found": f"{seen} select put_seq from f",
        "p3_new_batch": f"""{seen}, r as (select min(put_seq) as a, (max(put_seq) - min(put_seq)) // {EIGHTHS} + 1 as w from objects)
            select put_seq from f, r where (put_seq - a) // w = {EIGHTHS - 1}""",
    }
