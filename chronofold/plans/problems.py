"""Queries pN_... of the general problems, over whole tables, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dangling, hierarchy, snapshots, versions
from ..workspace import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return versions.feature_versions(table(spark, d, "commits"), table(spark, d, "tree_refs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "nodes"), table(spark, d, "edges")).select("id", "root_id", "node_depth")


def _tree(spark: SparkSession, d: str, **how) -> DataFrame:
    return materialize(hierarchy.preorder(hierarchy.hierarchy(table(spark, d, "nodes"), table(spark, d, "edges"), **how)))


def p2_parallel(spark: SparkSession, d: str) -> DataFrame:
    """:func:`p2_found` with loops, tour and ranking distributed down to a few rows a task, as tables too large for one take it."""
    return hierarchy.hierarchy(table(spark, d, "nodes"), table(spark, d, "edges"), base_rows=512).select("id", "root_id", "node_depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    return hierarchy.node_paths(tree).join(tree.select("id", "n_descendants", (F.col("node_depth") < 0).alias("looped")), "id")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node, also those running into loops, whose paths and intervals count from the loop's node.

    The descendants of a node are those at ``pos + 1`` to ``pos + n_descendants``; the nodes of one loop and all below
    them, ``looped`` with the same ``root_id``, also descend from each of the loop's (depth 0 in the path).
    """
    tree = _tree(spark, d)
    return hierarchy.node_paths(tree).join(tree.withColumn("looped", F.col("node_depth") < 0), "id")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each node below it."""
    return hierarchy.descendants(_tree(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "commits"), table(spark, d, "tree_refs"))


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    return dangling.dangling_references(*(table(spark, d, t) for t in ("commits", "objects", "base_objects", "deletions")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).drop("period")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return dangling.dangling_counts(_dangling(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p2_parallel, p2_paths, p2_nodes, p2_descendants, p4_found, p5_found, p5_counts)
    return {f.__name__: f for f in found}


def norm(c: str) -> str:
    """Normalised id in SQL."""
    return f"nullif(nullif(lower(trim({c})), ''), '{'0' * 40}')"


SNAPS = f"""
c as (select line, {norm('commit_id')} as commit_id, {norm('tree')} as tree, committer_ts as ts from commits),
r0 as (select {norm('tree')} as tree, parent_path, ref_name, ref_type, {norm('object_id')} as object_id,
       {norm('metadata_id')} as metadata_id, listed_at from tree_refs),
snap as (select line, commit_id, max(tree) as tree, min(ts) as ts from c
       where line is not null and commit_id is not null and ts is not null and tree in (select tree from r0 where tree is not null)
       group by line, commit_id),
s as (select *, row_number() over (partition by line order by ts, commit_id) as num,
       count(*) over (partition by line) as last_num, coalesce(lead(ts) over (partition by line order by ts, commit_id), -1) as next_ts from snap),
r1 as (select * from (select *, row_number() over (partition by tree, parent_path, ref_name
       order by listed_at desc nulls last, ref_type desc) as k from r0) where k = 1 and ref_type = 'FEATURE'),
f as (select s.line, s.num, s.last_num, s.ts, s.next_ts, parent_path, ref_name, object_id, metadata_id from r1 join s on r1.tree = s.tree)
"""


def oracle_sql() -> dict[str, str]:
    runs = f"""with {SNAPS},
    g as (select *, num - row_number() over (partition by line, parent_path, ref_name, object_id, metadata_id order by num) as island from f),
    v as (select line, parent_path, ref_name, min(ts) as valid_from, max_by(next_ts, num) as valid_to
          from g group by line, parent_path, ref_name, object_id, metadata_id, island)
    select * from v"""
    changes = f"""with {SNAPS},
    a as (select f.*, t.object_id as old_id, t.num as old_num from f left join f t on t.line = f.line and t.num = f.num - 1
          and t.parent_path is not distinct from f.parent_path and t.ref_name is not distinct from f.ref_name),
    x as (select line, num, parent_path, ref_name, case when old_num is null then 'ADDED' else 'MODIFIED' end as change_kind from a
          where num > 1 and (old_num is null or old_id is distinct from object_id)
          union all
          select f.line, f.num + 1, f.parent_path, f.ref_name, 'REMOVED' from f left join f n on n.line = f.line and n.num = f.num + 1
          and n.parent_path is not distinct from f.parent_path and n.ref_name is not distinct from f.ref_name
          where n.num is null and f.num < f.last_num)
    select s.commit_id, x.parent_path, x.ref_name, x.change_kind from x join s on s.line = x.line and s.num = x.num"""
    tree = f"""with recursive n as (select distinct {norm('id')} as id from nodes where {norm('id')} is not null),
    l as (select {norm('src')} as v, min({norm('dst')}) as p from edges where ord = 0 and {norm('src')} in (select id from n)
          and {norm('dst')} in (select id from n) group by 1),
    walk as (select n.id as id, n.id as root_id, 0 as node_depth, n.id as path from n where id not in (select v from l)
          union all select l.v, w.root_id, w.node_depth + 1, w.path || '/' || l.v from walk w join l on l.p = w.id)"""
    loops = """, left_over as (select id from n where id not in (select id from walk)),
    steps as (select id as start, id as at from left_over union select s.start, l.p from steps s join l on l.v = s.at),
    ring as (select start as id from steps s join l on l.v = s.at and l.p = s.start),
    low as (select s.start as id, min(s.at) as root_id from steps s join ring r on r.id = s.at group by 1)
    select id, root_id, node_depth from walk union all select id, root_id, -1 from low"""
    cut = f"""with recursive n as (select distinct {norm('id')} as id from nodes where {norm('id')} is not null),
    l as (select {norm('src')} as v, min({norm('dst')}) as p from edges where ord = 0 and {norm('src')} in (select id from n)
          and {norm('dst')} in (select id from n) group by 1),
    steps as (select v as start, p as here from l union select s.start, l.p from steps s join l on l.v = s.here where s.here <> s.start),
    ring as (select distinct start as id from steps where here = start),
    walk as (select n.id as id, n.id as path, n.id in (select id from ring) as looped from n where id not in (select v from l) or id in (select id from ring)
          union all select l.v, w.path || '/' || l.v, w.looped from walk w join l on l.p = w.id where l.v not in (select id from ring))"""
    paths = """select w.id, any_value(w.path) as path, any_value(w.looped) as looped, count(d.id) as n_descendants from walk w
    left join walk d on starts_with(d.path, w.path || '/') group by w.id"""
    orphans = f"""with c as (select {norm('commit_id')} as commit_id, {norm('tree')} as tree, parents, received_at from commits),
    t as (select commit_id, min(received_at) as received from c where commit_id is not null group by 1),
    r as (select distinct commit_id, 'tree' as ref_field, tree as ref_id from c where tree is not null
          union select distinct commit_id, 'parents', {norm('p')} from (select commit_id, unnest(parents) as p from c)),
    b as (select distinct {norm('id')} as id from base_objects),
    o as (select {norm('id')} as id, min(received_at) as first_put, max(received_at) as last_put from objects group by 1),
    d as (select {norm('id')} as id, max(deleted_at) as last_deleted from deletions group by 1),
    found as (select r.commit_id, r.ref_field, r.ref_id, case when o.id is null then 'missing' when d.last_deleted > o.last_put then 'deleted'
          when o.first_put > t.received then 'late' end as status, strftime(t.received, '%Y-%m') as period
          from r join t on t.commit_id = r.commit_id left join b on b.id = r.ref_id left join o on o.id = r.ref_id left join d on d.id = r.ref_id
          where r.ref_id is not null and b.id is null)"""
    return {
        "p1_found": runs,
        "p2_found": tree + loops,
        "p2_parallel": tree + loops,
        "p2_paths": cut + paths,
        "p2_descendants": cut + " select w.id as ancestor_id, d.id from walk w join walk d on starts_with(d.path, w.path || '/')",
        "p4_found": changes,
        "p5_found": orphans + " select commit_id, ref_field, ref_id, status from found where status is not null",
        "p5_counts": orphans + " select ref_field, period, status, count(*) as n_refs, count(distinct ref_id) as n_ids from found where status is not null group by 1, 2, 3",
    }
