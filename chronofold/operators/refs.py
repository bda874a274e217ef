"""Names of commits: refs, abbreviated ids, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..functions.revisions import is_id_prefix, parse

#: Namespaces in which a short ref name is looked up, in this order. Fixed values.
NAMESPACES = ["refs/heads/", "refs/tags/", "refs/remotes/"]


def resolve_short(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``short name target n_matches``: the ref each short name stands for.

    ``refs`` has ``name`` and ``target``, ``wanted`` has ``short``. A full name wins, then names that end in a slash and the
    short name, of any number of parts, among heads, tags and remotes in turn; several matches in the winning namespace leave ``name`` null, with their number.
    """
    rank = F.when(F.col("full"), 0)
    for i, ns in enumerate(NAMESPACES, 1):
        rank = rank.when(F.col("name").startswith(ns), i)
    parts = F.split("name", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.struct(F.concat_ws("/", F.slice(parts, n, F.size(parts))).alias("short"), F.lit(False).alias("full")))
    full = F.array(F.struct(F.col("name").alias("short"), F.lit(True).alias("full")))
    keys = refs.select("name", "target", F.explode(F.concat(full, F.when(F.size(parts) > 1, ends).otherwise(F.slice(full, 1, 0)))).alias("k"))
    keys = keys.select("name", "target", "k.short", "k.full").withColumn("rank", rank).dropna(subset=["rank"])
    best = keys.groupBy("short", "rank").agg(F.min("name").alias("name"), F.min_by("target", "name").alias("target"), F.count_distinct("name").alias("n_matches"))
    first = best.groupBy("short").agg(F.min_by(F.struct("name", "target", "n_matches"), "rank").alias("x"))
    found = first.select("short", F.when(F.col("x.n_matches") == 1, F.col("x.name")).alias("name"), F.when(F.col("x.n_matches") == 1, F.col("x.target")).alias("target"), "x.n_matches")
    return wanted.select("short").distinct().join(found, "short", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def resolve_prefixes(ids: DataFrame, prefixes: DataFrame, length: int = 7) -> DataFrame:
    """``prefix id n_matches``: the id that each prefix of at least ``length`` digits abbreviates; null if several do."""
    known = ids.select(norm_id("id").alias("id")).dropna().distinct().withColumn("k", F.substring("id", 1, length))
    want = prefixes.select(F.lower(F.btrim("prefix")).alias("prefix")).filter(F.length("prefix") >= length).distinct()
    j = want.withColumn("k", F.substring("prefix", 1, length)).join(known, "k").filter(F.startswith("id", F.col("prefix")))
    found = j.groupBy("prefix").agg(F.count("*").alias("n_matches"), F.min("id").alias("id"))
    return want.join(found, "prefix", "left").select("prefix", F.when(F.col("n_matches") == 1, F.col("id")).alias("id"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def object_kinds(objects: DataFrame, base: DataFrame) -> DataFrame:
    """``id kind``: the kind of every stored object; of differing kinds the first put's."""
    rows = objects.select(norm_id("id").alias("id"), "kind", "put_seq").unionByName(base.select(norm_id("id").alias("id"), "kind", F.lit(-1).cast("long").alias("put_seq")))
    return rows.filter("id is not null").groupBy("id").agg(F.min_by("kind", "put_seq").alias("kind"))


def branches_at(heads: DataFrame, ids: DataFrame) -> DataFrame:
    """``id name``: the refs whose target each id is."""
    return ids.select(norm_id("id").alias("id")).dropna().distinct().join(heads.select("name", F.col("target").alias("id")), "id")


def resolve(spec: str, refs: dict[str, str], commits: DataFrame) -> str | None:
    """The id a revision names: a ref, an id or its beginning, then parents. Raises ValueError if ambiguous.

    ``refs`` maps names to ids or, for symbolic refs, to names. A handful of key lookups, one for each step.
    """
    r = parse(spec)
    at: str | None = None
    name = next((n for n in (r.start, *[ns + r.start for ns in NAMESPACES]) if n in refs), None)
    while name in refs:
        at = name = refs[name]
    if at is None and is_id_prefix(r.start):
        hits = [x["id"] for x in commits.select(norm_id("commit_id").alias("id")).filter(F.col("id").startswith(r.start.lower())).distinct().limit(2).collect()]
        if len(hits) > 1:
            raise ValueError(f"ambiguous: {r.start}")
        at = hits[0] if hits else None
    for kind, n in r.steps:
        if at is None or kind == "type":
            if kind == "type" and n not in ("", "commit"):
                return None
            continue
        hops = [n - 1] if kind == "parent" else [0] * int(n)
        for hop in hops:
            if hop < 0:
                continue
            row = commits.filter(norm_id("commit_id") == at).select("parents").first()
            parents = (row and row["parents"]) or []
            at = (parents[hop] or "").strip().lower() or None if hop < len(parents) else None
            if at is None:
                break
    return at
