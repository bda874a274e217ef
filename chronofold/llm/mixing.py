"""Mixing sources to target weights by hash thresholds, without sorting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize
from .tokens import norm_source, with_tokens

#: Sources that may have a target; more are an error. For each, one row comes to the driver at a time.
MOST_SOURCES = 10_000
#: Bits of a document's hash, and how many of them one histogram tells apart.
HASH_BITS, STEP_BITS = 60, 12


@dataclass
class Quota:
    """What one source gives: every document ``full`` times, and once more those whose hash is below ``below``."""

    share: float
    repeats: int
    tokens: int = 0
    docs: int = 0
    budget: float = 0.0
    full: int = 0
    below: int = 0


def doc_hash() -> Column:
    return F.expr(f"shiftrightunsigned(xxhash64(doc_id, source), {64 - HASH_BITS})")


def _quotas(targets: DataFrame) -> dict[str, Quota]:
    """Targets by source; a fixed table of a few rows. Repeated sources add up, with the larger cap."""
    rows = (
        targets.select(norm_source(F.col("source")).alias("source"), "target_share", "max_repeats")
        .filter("source is not null and target_share > 0")
        .groupBy("source").agg(F.sum("target_share").alias("s"), F.max("max_repeats").alias("r")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = sum(r["s"] for r in rows)
    return {r["source"]: Quota(r["s"] / total, max(0, r["r"] if r["r"] is not None else 1)) for r in rows}


def _budgets(quotas: dict[str, Quota], total: int | None) -> None:
    """Share out ``total`` tokens; what a capped source can't give goes to the others in proportion."""
    able = {s: float(q.repeats * q.tokens) for s, q in quotas.items() if q.repeats * q.tokens > 0}
    if not able:
        return
    if total is None:
        total = min(c / quotas[s].share for s, c in able.items()) * sum(quotas[s].share for s in able)
    left, free = min(float(total), sum(able.values())), dict(able)
    while free:
        weight = sum(quotas[s].share for s in free)
        capped = [s for s in free if left * quotas[s].share / weight >= free[s]]
        if not capped:
            for s in free:
                quotas[s].budget = left * quotas[s].share / weight
            break
        for s in capped:
            quotas[s].budget = free.pop(s)
        left -= sum(quotas[s].budget for s in capped)


def _thresholds(counted: DataFrame, quotas: dict[str, Quota], total: int | None) -> None:
    """Find each source's threshold: histograms over hash prefixes, refining only the bucket the budget ends in.

    A histogram has at most 2^STEP_BITS buckets a source and is summed up in Spark; the driver receives one row
    a source: its boundary bucket.
    """
    spark, h = counted.sparkSession, F.col("h")
    for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect():
        quotas[r["source"]].tokens, quotas[r["source"]].docs = r["n"], r["docs"]
    _budgets(quotas, total)
    edge: list[tuple[str, int, float]] = []  # source, prefix of the bucket, tokens still wanted from it
    for s, q in quotas.items():
        if q.tokens > 0 and q.budget > 0:
            q.full = min(q.repeats, int(q.budget / q.tokens + 1e-12))
            edge.append((s, 0, q.budget - q.full * q.tokens if q.full < q.repeats else 0.0))
    bits = 0
    while edge and bits < HASH_BITS:
        inside = F.broadcast(spark.createDataFrame(edge, "source string, prefix long, want double"))
        bits += STEP_BITS
        rows = counted.join(inside, "source").filter(F.shiftright(h, HASH_BITS - bits + STEP_BITS) == F.col("prefix"))
        hist = rows.groupBy("source", "want", F.shiftright(h, HASH_BITS - bits).alias("b")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
        up_to = Window.partitionBy("source").orderBy("b")
        summed = hist.withColumn("sum", F.sum("n").over(up_to))
        # the first bucket that doesn't fit any more, and what the ones before it hold
        first = summed.filter(F.col("sum") > F.col("want") + 1e-9).groupBy("source").agg(F.min(F.struct("b", "sum", "n", "docs", "want")).alias("x"))
        got = {r["source"]: r["x"] for r in first.collect()}
        more = []
        for s, prefix, _ in edge:
            q, x = quotas[s], got.get(s)
            if x is None:  # all of the bucket fits
                q.below = (prefix + 1) << (HASH_BITS - bits + STEP_BITS)
                continue
            q.below = x["b"] << (HASH_BITS - bits)
            left = x["want"] - (x["sum"] - x["n"])
            if x["docs"] > 1:
                more.append((s, x["b"], left))
            elif left > x["n"] / 2:  # nearer with the document than without
                q.below = (x["b"] + 1) << (HASH_BITS - bits)
        edge = more


def plan_mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokens: DataFrame | None = None) -> tuple[DataFrame, dict[str, Quota]]:
    """Token counts of the documents of targeted sources with their hash, and each source's quota."""
    quotas = _quotas(targets)
    counted = tokens if tokens is not None else with_tokens(docs)
    counted = materialize(counted.filter(F.col("source").isin(list(quotas) or [""])).withColumn("h", doc_hash()))
    _thresholds(counted, quotas, total_tokens)
    return counted, quotas


def mix_documents(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """``doc_id source n_tokens copies``: how often each chosen document appears in the mix.

    Sources are compared without letter case and surrounding blanks; documents of no or another source
    aren't in the mix. ``total_tokens`` is the size of the mix; by default the largest in which every
    source that has documents holds its target share within its ``max_repeats``. Where a given total asks
    more of a source than that, the source gives all it may and the others fill up in proportion. Which
    documents appear once more than the rest is decided by a threshold on a hash of their id: a smaller
    budget's choice is part of a larger one's, a source misses its budget by less than one document, and
    documents that share all hash bits are taken or left together. Texts without tokens appear if their
    hash says so. Empty tables give no rows.
    """
    counted, quotas = plan_mix(docs, targets, total_tokens, tokens)
    plan = counted.sparkSession.createDataFrame([(s, q.full, q.below) for s, q in quotas.items()], "source string, full int, below long")
    copies = F.col("full") + (F.col("h") < F.col("below")).cast("int")
    return counted.join(F.broadcast(plan), "source").select("doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")


def mix_report(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """For every target: its share, what the source has, what the mix took and the actual share of the mix."""
    counted, quotas = plan_mix(docs, targets, total_tokens, tokens)
    spark = counted.sparkSession
    rows = [(s, q.share, q.repeats, q.tokens, q.docs, q.full, q.below) for s, q in quotas.items()]
    schema = "source string, target_share double, max_repeats int, available_tokens long, available_docs long, full int, below long"
    plan = F.broadcast(spark.createDataFrame(rows, schema))
    extra = (F.col("h") < F.col("below")).cast("int")
    took = (
        counted.join(plan.select("source", "full", "below"), "source")
        .groupBy("source")
        .agg(F.sum(F.col("n_tokens") * (F.col("full") + extra)).alias("mix_tokens"), F.sum(F.when(F.col("full") + extra > 0, 1).otherwise(0)).alias("mix_docs"))
    )
    got = {r["source"]: (r["mix_tokens"], r["mix_docs"]) for r in took.collect()}  # a row a target
    whole = sum(n for n, _ in got.values())
    report = [
        (s, q.share, got.get(s, (0, 0))[0] / whole if whole else None, q.repeats, q.tokens, q.docs, *got.get(s, (0, 0))) for s, q in quotas.items()
    ]
    return spark.createDataFrame(
        report,
        "source string, target_share double, actual_share double, max_repeats int, available_tokens long, available_docs long, mix_tokens long, mix_docs long",
    )
