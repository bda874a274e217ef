"""Queries of the feature store's own operators over whole tables, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import natural, values, wkt
from ..functions.geometry import geometry_edits
from ..functions.ids import norm_id
from ..functions.paths import full_path
from ..operators import blame, diff, graph, listing, log, merge, osm, patch, query, refs, snapshots, sync
from ..workspace import materialize
from .problems import SNAPS, norm, table

BOX = (-90.0, -45.0, 90.0, 45.0)
AFTER, BEFORE = 1577836800000, 1640995200000  # the years 2020 and 2021


class _Store:
    """The tables of one folder and what many queries share of them."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.t = lambda name: table(spark, d, name)
        self.commits, self.refs = self.t("commits"), self.t("tree_refs")

    def at(self, *which: str) -> list[DataFrame]:
        """Listings by line at the ``first``, ``middle`` or ``last`` snapshot; only these trees' rows are read."""
        if "middle" in which:
            snaps, _ = snapshots.snapshots(self.commits, self.refs)
            ends = snaps.groupBy("line").agg(F.min("num").alias("first"), F.max("num").alias("last"))
            nums = ends.withColumn("middle", F.expr("first + (last - first) div 2"))
            picked = nums.select("line", F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col(w).alias("num")) for w in which])).alias("x"))
            trees = materialize(picked.select("line", "x.*").join(snaps, ["line", "num"]).select("line", "which", "tree"))
            n = trees.count()
            return [listing.listing(self.refs, trees.filter(F.col("which") == w).drop("which"), n) for w in which]
        ends, n = snapshots.line_ends(self.commits, self.refs)
        return [listing.listing(self.refs, ends.select("line", F.col(w).alias("tree")), n) for w in which]

    def diff(self, **how) -> DataFrame:
        old, new = self.at("first", "last")
        return diff.diff(old, new, ["line"], **how)

    def graph(self, looped: bool) -> graph.Graph:
        """The SQL of queries of nodes and edges leaves loops out with what hangs from them; ``all_`` queries don't."""
        return graph.Graph(self.t("nodes"), self.t("edges"), looped)

    def own_graph(self) -> graph.Graph:
        c = self.commits
        return graph.Graph(c.select(F.col("commit_id").alias("id")), graph.commit_edges(c))

    def log_commits(self) -> DataFrame:
        return materialize(log.clean_commits(self.commits))

    def texts(self) -> DataFrame:
        return blame.feature_texts(self.t("objects"), self.t("base_objects"))


SIDES = ["line", "parent_path", "ref_name", "change_kind", "old_object_id", "new_object_id"]
LAST = ["line", "parent_path", "ref_name", "ref_type", "object_id"]


def _q(f: Callable[[_Store], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(_Store(spark, d))


def _pruned(s: _Store) -> DataFrame:
    old, new = s.at("first", "last")
    return diff.pruned_diff(old, new, ["line"]).select(SIDES)


def _feature_diff(s: _Store) -> DataFrame:
    return diff.attribute_diff(s.diff(change="MODIFIED"), s.texts(), ["line"])


def _renames(s: _Store) -> DataFrame:
    old, new = s.at("first", "last")
    return diff.renames(old, new, ["line"])


def _moves(s: _Store) -> DataFrame:
    old, new = s.at("first", "last")
    return diff.moves(old, new, ["line"])


def _type_changes(s: _Store) -> DataFrame:
    old, new = s.at("first", "last")
    return diff.type_changes(old, new, ["line"])


def _ls(path: str, strategy: str, **how) -> Callable[[_Store], DataFrame]:
    return lambda s: listing.ls_tree(s.at("last")[0], path, strategy, **how).select(*LAST, "path")


def _types(s: _Store) -> DataFrame:
    return listing.with_feature_type(s.at("last")[0], s.t("feature_types"), ["line"]).select("line", "parent_path", "ref_name", "type_id", "type_name")


def _stats(s: _Store) -> DataFrame:
    return listing.subtree_stats(s.at("last")[0], ["line"]).drop("digest")


def _features(s: _Store) -> DataFrame:
    return s.at("last")[0].filter("ref_type = 'FEATURE'")


def _page(s: _Store) -> DataFrame:
    return query.query(_features(s), order=[F.col("minx").desc_nulls_last(), "line"], skip=20, limit=50).select("line", "parent_path", "ref_name", "minx")


def _box_join(s: _Store) -> DataFrame:
    """Lines whose polygons' extent meets that of another line's points."""
    f = _features(s)
    extents = lambda layer: query.extent(f.filter(F.col("parent_path") == layer), ["line"])
    return query.box_join(extents("Polygon"), extents("Points"), 0.25).select("a_line", "b_line", "a_n_features", "b_n_features")


def _log(s: _Store, **how) -> DataFrame:
    return log.log(s.log_commits(), s.own_graph(), **how)


def _log_since(s: _Store) -> DataFrame:
    c = s.log_commits()
    mid = c.filter(F.col("committer_ts") < AFTER).groupBy("line").agg(F.max(F.struct("committer_ts", "commit_id"))["commit_id"].alias("id"))
    return log.log(c, s.own_graph(), since=mid.select(F.col("line").alias("start"), "id")).select("start", "commit_id")


def _topological(s: _Store) -> DataFrame:
    return s.own_graph().topological()


def _reach(g: graph.Graph) -> DataFrame:
    tops = g.children().filter("n_children = 0").select(F.col("id").alias("start"), "id")
    return g.reach(tops).groupBy("start").agg(F.count("*").alias("n_reached"))


def _merge_pairs(g: graph.Graph) -> DataFrame:
    first = g.edges.filter("ord = 0").groupBy("src").agg(F.min("dst").alias("left_id"))
    second = g.edges.filter("ord > 0").select("src", F.col("dst").alias("right_id"))
    return first.join(second, "src").select(F.struct("left_id", "right_id").alias("pair"), "left_id", "right_id").distinct()


def _merge_base(g: graph.Graph) -> DataFrame:
    return g.common_ancestors(_merge_pairs(g)).select("pair.left_id", "pair.right_id", F.col("id").alias("base_id"))


def _sparse(g: graph.Graph) -> DataFrame:
    pairs = g.children().filter("n_children = 0").join(g.tree.select("id", "root_id"), "id").select(F.col("id").alias("pair"), F.col("id").alias("left_id"), F.col("root_id").alias("right_id"))
    return g.passes(pairs, g.merges.select(F.col("src").alias("id"))).withColumnRenamed("pair", "id")


def _before(s: _Store) -> DataFrame:
    return log.commit_before(s.log_commits(), s.own_graph(), AFTER)


def _blame(s: _Store) -> DataFrame:
    return blame.blame(s.commits, s.refs, s.texts())


def _history(s: _Store) -> DataFrame:
    return blame.feature_history(s.commits, s.refs).select("line", "parent_path", "ref_name", "commit_id", "object_id")


def _changes(s: _Store) -> DataFrame:
    return snapshots.snapshot_changes(s.commits, s.refs)


def _classified(s: _Store) -> DataFrame:
    first, middle, last = s.at("first", "middle", "last")
    return merge.classify(first, middle, last, ["line"])


def _classified_trees(s: _Store) -> DataFrame:
    """The trees of a merge in which our side dropped a tree from the first snapshot, and theirs went on to the last."""
    first, last = s.at("first", "last")
    path = full_path("parent_path", "ref_name")
    ours = first.filter(~F.coalesce((path == "osm") | path.startswith("osm/"), F.lit(False)))
    return merge.classify(first, ours, last, ["line"], trees=True).filter("ref_type = 'TREE'")


def _merged(s: _Store) -> DataFrame:
    return merge.merge_attributes(_classified(s), s.texts(), ["line"])


def _verify(s: _Store) -> DataFrame:
    first, middle, last = s.at("first", "middle", "last")
    return patch.verify_patch(last, diff.diff(first, middle, ["line"]), ["line"]).select("line", "parent_path", "ref_name", "change_kind", "verdict")


def _apply(s: _Store) -> DataFrame:
    first, middle, last = s.at("first", "middle", "last")
    return patch.apply_patch(last, diff.diff(first, middle, ["line"]), ["line"], reverse=True).select(LAST)


def _missing(s: _Store) -> DataFrame:
    wanted = s.refs.select(F.col("object_id").alias("id")).unionByName(s.commits.select(F.col("tree").alias("id")))
    return sync.missing_ids(wanted, s.t("objects").select("id").unionByName(s.t("base_objects").select("id")))


def _shallow(g: graph.Graph) -> DataFrame:
    return sync.shallow(g, g.children().filter("n_children = 0").select(F.col("id").alias("start"), "id"), 5)


def _forward(s: _Store) -> DataFrame:
    c, g = s.log_commits(), s.own_graph()
    old = c.filter(F.col("committer_ts") < AFTER).groupBy("line").agg(F.max(F.struct("committer_ts", "commit_id"))["commit_id"].alias("left_id"))
    return sync.fast_forwards(g, old.join(log.heads(c), "line").select(F.col("line").alias("pair"), "left_id", F.col("commit_id").alias("right_id"))).withColumnRenamed("pair", "line")


def _outdated(s: _Store) -> DataFrame:
    c = s.log_commits()
    ref = lambda d: log.heads(d).select(F.col("line").alias("name"), F.col("commit_id").alias("target"))
    return sync.outdated_refs(ref(c.filter(F.col("committer_ts") < BEFORE)), ref(c.filter(F.col("committer_ts") >= AFTER)))


RULES = [
    osm.Rule("clicks", {"type": ["click"]}, fields={"k_value": ("k", "int"), "kind": ("type", "string")}),
    osm.Rule("not_views", {}, exclude={"type": ["view"]}, fields={"kind": ("type", "string")}),
    osm.Rule("with_k", {"k": []}, mandatory=["type"], fields={"k_value": ("k", "int")}),
]


def _entities(s: _Store) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    tags = F.map_filter(F.create_map(F.lit("k"), k, F.lit("type"), F.col("event_type")), lambda _, v: v.isNotNull())
    return s.t("events").select(F.col("event_id").alias("id"), tags.alias("tags"))


def _osm_map(s: _Store) -> DataFrame:
    return osm.map_entities(_entities(s), RULES).select("rule", "id", F.col("fields")["k_value"].alias("k_value"), F.col("fields")["kind"].alias("kind"))


def _osm_tags(s: _Store) -> DataFrame:
    from ..functions import tags

    text = tags.encode("tags")
    return _entities(s).select("id", text.alias("tag_text")).select("id", "tag_text", tags.decode("tag_text")["k"].alias("k"))


def _osm_ways(s: _Store) -> DataFrame:
    items = s.t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    ways = items.select("id", F.transform("x", lambda x: x["l_partkey"]).alias("refs"))
    nodes = s.t("part").filter("p_size <= 40").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_partkey").cast("double").alias("y"))
    got = osm.assemble_ways(ways, nodes)
    return got.select("id", F.size("points").alias("n_points"), "n_missing", "closed", F.try_element_at("points", F.lit(1))["y"].alias("first_y"), F.try_element_at("points", F.lit(-1))["y"].alias("last_y"))


def _change_set(s: _Store) -> DataFrame:
    changes = s.diff()
    return osm.change_set(changes).groupBy("action", "kind").agg(F.count("*").alias("n"))


def _attributes(s: _Store) -> DataFrame:
    x = F.explode(values.attributes("object_text")).alias("x")
    return s.t("objects").filter("kind = 'FEATURE'").select("put_seq", x).select("put_seq", "x.pos", "x.kind", "x.value")


def _object_ids(s: _Store) -> DataFrame:
    back = values.render(values.attributes("object_text"))
    return s.t("objects").filter("object_text is not null").select("put_seq", values.object_id("object_text").alias("content_id"), (back == F.col("object_text")).alias("round_trip"))


def _boxes(s: _Store) -> DataFrame:
    p = s.t("objects").filter("object_text is not null").select("put_seq", wkt.coordinates("object_text").alias("p")).filter("size(p) > 0")
    return p.select("put_seq", F.size("p").cast("long").alias("n_points"), *wkt.box(F.col("p")))


def _prefixes(s: _Store) -> DataFrame:
    ids = s.commits.select(F.col("commit_id").alias("id"))
    return refs.resolve_prefixes(ids, ids.select(F.substring(norm_id("id"), 1, 7).alias("prefix")))


def _short(s: _Store) -> DataFrame:
    """Names of several parts as heads, some of them also as tags; asked for by every one of their endings."""
    h = log.heads(s.log_commits()).select(F.regexp_replace("line", "^[^:]*:(refs/(heads|tags|remotes)/)?", "").alias("b"), F.substring_index("line", ":", 1).alias("repo"), F.col("commit_id").alias("target"))
    heads = h.select(F.concat(F.lit("refs/heads/"), "repo", F.lit("/"), "b").alias("name"), "target")
    names = heads.unionByName(h.groupBy(F.concat(F.lit("refs/tags/"), "b").alias("name")).agg(F.min("target").alias("target")))
    short = F.explode(F.array("name", F.regexp_replace("name", "^refs/(heads|tags)/", ""), F.substring_index("name", "/", -1)))
    return refs.resolve_short(names, names.select(short.alias("short")))


def _two_edits(s: _Store) -> DataFrame:
    """Parts as features, whose size one side edited, and whose price, line or size the other."""
    p = s.t("part").select(F.col("p_partkey").cast("string").alias("ref_name"), "p_name", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))
    size, price = F.col("p_size"), F.col("price")
    shape = lambda x, y: F.concat(F.lit("LINESTRING ("), x.cast("string"), F.lit(" 0, 1 1, 2 2, 3 "), y.cast("string"), F.lit(")"))
    moved = size.between(10, 15)
    sides = {
        "ancestor": (size, price, shape(F.lit(0), F.lit(3))),
        "ours": (F.when(size <= 30, size + 1).otherwise(size), price, shape(F.when(moved, 7).otherwise(0), F.lit(3))),
        "theirs": (F.when(size.between(28, 30), size + 2).otherwise(size), F.when(size >= 20, price + 5).otherwise(price), shape(F.lit(0), F.when(moved, 9).otherwise(3))),
    }
    text = lambda a, b, c: F.concat_ws("\n", F.lit("FEATURE"), F.concat(F.lit("STRING\t"), "p_name"), F.concat(F.lit("INTEGER\t"), a), F.concat(F.lit("LONG\t"), b), F.concat(F.lit("LINESTRING\t"), c))
    return p.select("ref_name", *[text(*cells).alias(k) for k, cells in sides.items()])


def _merge_features(s: _Store) -> DataFrame:
    p = materialize(_two_edits(s))
    side = lambda k: p.select(F.lit("parts").alias("parent_path"), "ref_name", F.lit("FEATURE").alias("ref_type"), F.sha1(k).alias("object_id"), F.lit(None).cast("string").alias("metadata_id"))
    texts = p.select(F.explode(F.array("ancestor", "ours", "theirs")).alias("object_text")).select(F.sha1("object_text").alias("object_id"), "object_text").distinct()
    classes = merge.classify(side("ancestor"), side("ours"), side("theirs"))
    return merge.merge_attributes(classes, texts).select("ref_name", "merged_text", "conflicting")


def _kinds(s: _Store) -> DataFrame:
    return refs.object_kinds(s.t("objects"), s.t("base_objects"))


def _natural(s: _Store) -> DataFrame:
    names = s.refs.select("ref_name").distinct().withColumn("natural_key", natural.natural_key("ref_name"))
    return names.withColumn("bucket", natural.bucket(F.col("natural_key"), 0))


def _edits(s: _Store) -> DataFrame:
    d = _feature_diff(s).filter("change = 'MODIFIED' and old_kind in ('POINT', 'LINESTRING', 'POLYGON')")
    return d.select("line", "parent_path", "ref_name", "pos", geometry_edits(F.col("old_value"), F.col("new_value")).alias("e")).select("line", "parent_path", "ref_name", "pos", "e.*")


def _walk(s: _Store) -> DataFrame:
    """Objects reachable from the lines' heads: commits, their trees, and what listed trees name."""
    g, c = s.own_graph(), s.log_commits()
    commits = g.reach(log.heads(c).select(F.lit(0).alias("start"), F.col("commit_id").alias("id"))).select("id")
    trees = c.join(commits, c["commit_id"] == commits["id"], "left_semi").select(F.col("tree").alias("id")).dropna().distinct()
    nodes = listing.listing(s.refs).withColumnRenamed("tree", "t")
    named = nodes.join(trees, nodes["t"] == trees["id"], "left_semi")
    every = [commits, trees, named.select(F.col("object_id").alias("id")), named.select(F.col("metadata_id").alias("id"))]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).dropna().distinct()


GRAPH: dict[str, Callable[[graph.Graph], DataFrame]] = {
    "graph_depth": lambda g: g.depths(), "graph_children": lambda g: g.children(), "graph_reach": _reach,
    "merge_base": _merge_base, "sparse_path": _sparse, "sync_shallow": _shallow,
}


def _of_graph(f: Callable[[graph.Graph], DataFrame], looped: bool) -> Callable[[_Store], DataFrame]:
    return lambda s: f(s.graph(looped))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "diff_full": lambda s: s.diff().select(SIDES),
        "diff_added": lambda s: s.diff(change="ADDED").select(SIDES),
        "diff_removed": lambda s: s.diff(change="REMOVED").select(SIDES),
        "diff_modified": lambda s: s.diff(change="MODIFIED").select(SIDES),
        "diff_trees": lambda s: s.diff(trees=True).select(SIDES),
        "diff_pruned": _pruned,
        "diff_path_filter": lambda s: diff.filter_path(s.diff(trees=True), "cadastre/north").select(SIDES),
        "diff_bounds_filter": lambda s: diff.filter_bounds(s.diff(), BOX).select(SIDES),
        "diff_count": lambda s: diff.count_changes(s.diff(trees=True), ["line"]),
        "diff_count_rollup": lambda s: diff.count_rollup(s.diff(), "line"),
        "diff_bounds": lambda s: diff.diff_bounds(s.diff(), ["line"]),
        "diff_renames": _renames,
        "diff_moves": _moves,
        "diff_feature_types": _type_changes,
        "feature_diff": _feature_diff,
        "ls_children": _ls("", "CHILDREN"),
        "ls_below": _ls("cadastre", "DEPTHFIRST"),
        "ls_features": _ls("osm", "DEPTHFIRST_ONLY_FEATURES", box=BOX),
        "ls_trees": _ls("", "DEPTHFIRST_ONLY_TREES"),
        "find_child": lambda s: listing.find_child(s.at("last")[0], "osm/node").select(LAST),
        "feature_type_trees": lambda s: listing.feature_type_trees(s.at("last")[0]).select(*LAST, "metadata_id"),
        "feature_types_used": _types,
        "describe_types": lambda s: listing.describe_types(s.t("feature_types")),
        "subtree_stats": _stats,
        "query_bbox": lambda s: query.query(_features(s), box=BOX).select(LAST),
        "query_cql": lambda s: query.query(_features(s), "ref_name LIKE 'pt-%' AND (minx BETWEEN 0 AND 90 OR NOT BBOX(geom, -180, 0, 180, 90)) AND parent_path IN ('Points', 'survey/Points')").select(LAST),
        "query_page": _page,
        "query_extent": lambda s: query.extent(_features(s), ["line"]),
        "query_thin": lambda s: query.thin(_features(s).select("line", "parent_path", "ref_name", "minx", "maxx", "miny", "maxy"), 5.0).select("cell_x", "cell_y", "n_in_cell"),
        "query_box_join": _box_join,
        "log_all": lambda s: _log(s).select("start", "commit_id", "committer_ts"),
        "log_first_parent": lambda s: _log(s, first_parent=True).select("start", "commit_id", "back"),
        "log_since": _log_since,
        "log_time_range": lambda s: _log(s, after=AFTER, before=BEFORE).select("start", "commit_id"),
        "log_author": lambda s: _log(s, author="R.*", committer=".*[aeiou]").select("start", "commit_id"),
        "log_paths": lambda s: log.commits_touching(_changes(s), "osm"),
        "log_change_counts": lambda s: log.change_counts(_changes(s)),
        "commit_before": _before,
        "statistics": lambda s: log.statistics(s.log_commits()),
        "graph_edges": lambda s: graph.commit_edges(s.commits),
        "graph_topological": _topological,
        "walk_graph": _walk,
        "blame": _blame,
        "feature_history": _history,
        "merge_classify": _classified,
        "merge_check": lambda s: merge.check_merge(_classified(s), ["line"]),
        "merge_attributes": _merged,
        "merge_features": _merge_features,
        "merge_trees": _classified_trees,
        "merge_conflicts": lambda s: merge.conflict_lines(_classified(s).filter("merge_class = 'conflict'")),
        "patch_verify": _verify,
        "patch_apply": _apply,
        "patch_lines": lambda s: patch.read_patch_lines(patch.patch_lines(s.diff(), s.texts())),
        "sync_missing": _missing,
        "sync_fast_forward": _forward,
        "sync_refs": _outdated,
        "osm_map": _osm_map,
        "osm_tags": _osm_tags,
        "osm_ways": _osm_ways,
        "osm_change_set": _change_set,
        "feature_attributes": _attributes,
        "object_ids": _object_ids,
        "geometry_boxes": _boxes,
        "geometry_edits": _edits,
        "natural_order": _natural,
        "resolve_prefix": _prefixes,
        "resolve_short_ref": _short,
        "object_kinds": _kinds,
    }
    for name, f in GRAPH.items():
        q |= {name: _of_graph(f, False), "all_" + name: _of_graph(f, True)}
    return {name: _q(f) for name, f in q.items()}


def oracle_sql() -> dict[str, str]:
    base = f"""with {SNAPS},
    l as (select tree, parent_path, ref_name, ref_type, object_id, metadata_id, minx, maxx, miny, maxy from (
        select {norm('tree')} as tree, parent_path, ref_name, ref_type, {norm('object_id')} as object_id, {norm('metadata_id')} as metadata_id,
        minx, maxx, miny, maxy, row_number() over (partition by {norm('tree')}, parent_path, ref_name
        order by listed_at desc nulls last, ref_type desc, object_id desc) as k from tree_refs) where k = 1 and tree is not null),
    a0 as (select s.line, l.* exclude (tree) from l join s on s.tree = l.tree and s.num = 1),
    m0 as (select s.line, l.* exclude (tree) from l join s on s.tree = l.tree and s.num = 1 + (s.last_num - 1) // 2),
    z0 as (select s.line, l.* exclude (tree) from l join s on s.tree = l.tree and s.num = s.last_num),
    zf as (select * from z0 where ref_type = 'FEATURE'),
    """

    def changes(old: str, new: str, name: str, trees: bool = False) -> str:
        only = "" if trees else " where ref_type = 'FEATURE'"
        side = lambda p: ", ".join(f"{p}.{c} as {'old' if p == 'o' else 'new'}_{c}" for c in ("ref_type", "object_id", "metadata_id", "minx", "maxx", "miny", "maxy"))
        return f"""{name} as (select coalesce(n.line, o.line) as line, coalesce(n.parent_path, o.parent_path) as parent_path, coalesce(n.ref_name, o.ref_name) as ref_name,
        case when o.line is null then 'ADDED' when n.line is null then 'REMOVED' else 'MODIFIED' end as change_kind, {side('o')}, {side('n')}
        from (select * from {old}{only}) o full outer join (select * from {new}{only}) n on o.line = n.line and o.parent_path = n.parent_path and o.ref_name = n.ref_name
        where o.line is null or n.line is null or o.object_id is distinct from n.object_id)"""

    d, dt = changes("a0", "z0", "d"), changes("a0", "z0", "d", True)
    six = "line, parent_path, ref_name, change_kind, old_object_id, new_object_id"
    full = "case when coalesce(parent_path, '') = '' then ref_name else parent_path || '/' || ref_name end"
    last = "line, parent_path, ref_name, ref_type, object_id"
    meets = lambda p="", b=BOX: f"({p}minx <= {b[2]} and {p}maxx >= {b[0]} and {p}miny <= {b[3]} and {p}maxy >= {b[1]})"
    texts = f"""o1 as (select {norm('id')} as object_id, object_text, put_seq from objects union all select {norm('id')}, object_text, -1 from base_objects),
    t as (select object_id, min_by(object_text, put_seq) as object_text from o1 where object_id is not null and object_text is not null group by 1),
    at0 as (select object_id, unnest(str_split(object_text, chr(10))[2:]) as ln, generate_subscripts(str_split(object_text, chr(10))[2:], 1) - 1 as pos from t where starts_with(object_text, 'FEATURE' || chr(10))),
    att as (select object_id, pos, str_split(ln, chr(9))[1] as kind, case when str_split(ln, chr(9))[1] <> 'NULL' then substr(ln, instr(ln, chr(9)) + 1) end as value from at0 where contains(ln, chr(9)))"""
    graph_ctes = f"""n as (select distinct {norm('id')} as id from nodes where {norm('id')} is not null),
    e0 as (select {norm('src')} as src, {norm('dst')} as dst, min(ord) as ord from edges where {norm('src')} is not null and {norm('dst')} is not null group by 1, 2),
    fp as (select src, min(dst) as dst from edges_clean where ord = 0 group by 1),
    tree as (select id, id as root, 0 as d from n where id not in (select src from fp) union all select fp.src, t.root, t.d + 1 from tree t join fp on fp.dst = t.id),
    e as (select e0.* from e0 where src in (select id from tree) and dst in (select id from tree))""".replace(
        "edges_clean", f"(select {norm('src')} as src, {norm('dst')} as dst, ord from edges where {norm('src')} in (select id from n) and {norm('dst')} in (select id from n))"
    )
    own = f"""c as (select {norm('commit_id')} as commit_id, line, {norm('tree')} as tree, list_transform(parents, lambda p: {norm('p')}) as parents, author_name, committer_name, committer_ts, received_at from commits),
    cc as (select * from (select *, row_number() over (partition by commit_id, line order by received_at) as k from c where commit_id is not null and line is not null) where k = 1),
    one as (select * from (select *, row_number() over (partition by commit_id order by line) as j from cc) where j = 1),
    x as (select commit_id as src, unnest(parents) as dst, generate_subscripts(parents, 1) - 1 as ord from c where commit_id is not null),
    x0 as (select src, dst, min(ord) as ord from x where dst is not null and dst in (select commit_id from c) group by 1, 2),
    h as (select line, max_by(commit_id, (committer_ts, commit_id)) as id from cc group by 1)"""
    reach = "r as (select line as start, id from h union select r.start, x0.dst from r join x0 on x0.src = r.id)"
    first = """b as (select line as start, id, 0 as back from h union all select b.start, x0.dst, b.back + 1 from b join x0 on x0.src = b.id and x0.ord = 0)"""
    merged = base + changes("a0", "m0", "da") + "," + changes("a0", "z0", "db") + """,
    k as (select coalesce(da.line, db.line) as line, coalesce(da.parent_path, db.parent_path) as parent_path, coalesce(da.ref_name, db.ref_name) as ref_name,
    case when db.line is null then 'ours' when da.line is null then 'theirs'
    when da.change_kind = db.change_kind and da.new_object_id is not distinct from db.new_object_id then 'same'
    when da.change_kind = 'MODIFIED' and db.change_kind = 'MODIFIED' then 'both' else 'conflict' end as merge_class,
    coalesce(da.old_object_id, db.old_object_id) as ancestor,
    case when da.line is null then db.old_object_id else da.new_object_id end as ours,
    case when db.line is null then da.old_object_id else db.new_object_id end as theirs
    from da full outer join db on da.line = db.line and da.parent_path = db.parent_path and da.ref_name = db.ref_name)"""
    verify = base + changes("a0", "m0", "p") + """,
    v as (select p.*, case when change_kind = 'ADDED' then case when z.line is not null then 'present' else 'ok' end when z.line is null then 'absent'
    when z.object_id is not distinct from p.old_object_id then 'ok' else 'changed' end as verdict
    from p left join zf z on z.line = p.line and z.parent_path = p.parent_path and z.ref_name = p.ref_name)"""
    undo = base + changes("m0", "a0", "p") + """,
    v as (select p.*, case when change_kind = 'ADDED' then z.line is null else z.line is not null and z.object_id is not distinct from p.old_object_id end as fits
    from p left join zf z on z.line = p.line and z.parent_path = p.parent_path and z.ref_name = p.ref_name),
    u as (select * from v where fits)"""
    hist = f"""with {SNAPS},
    w as (select *, lag(num) over (partition by line, parent_path, ref_name order by num) as pn, lag(object_id) over (partition by line, parent_path, ref_name order by num) as po from f),
    hist as (select w.line, parent_path, ref_name, s.commit_id, w.num, object_id from w join s on s.line = w.line and s.num = w.num
             where pn is null or pn <> w.num - 1 or po is distinct from object_id)"""
    ch = None  # the SQL of p4_found
    from .problems import oracle_sql as problem_sql

    ch = problem_sql()["p4_found"]
    sql = {
        "diff_full": f"{base}{d} select {six} from d",
        "diff_added": f"{base}{d} select {six} from d where change_kind = 'ADDED'",
        "diff_removed": f"{base}{d} select {six} from d where change_kind = 'REMOVED'",
        "diff_modified": f"{base}{d} select {six} from d where change_kind = 'MODIFIED'",
        "diff_trees": f"{base}{dt} select {six} from d",
        "diff_pruned": f"{base}{d} select {six} from d",
        "diff_path_filter": f"""{base}{dt}, y as (select *, {full} as p, coalesce(new_ref_type, old_ref_type) as ty from d) select {six} from y
            where p = 'cadastre/north' or starts_with(p, 'cadastre/north/') or (ty = 'TREE' and p in ('', 'cadastre'))""",
        "diff_bounds_filter": f"{base}{d} select {six} from d where {meets('old_')} or {meets('new_')}",
        "diff_count": f"""{base}{dt}, y as (select *, coalesce(new_ref_type, old_ref_type) = 'TREE' as tr from d) select line,
            count(*) filter (not tr and change_kind = 'ADDED') as features_added, count(*) filter (not tr and change_kind = 'MODIFIED') as features_modified,
            count(*) filter (not tr and change_kind = 'REMOVED') as features_removed, count(*) filter (tr and change_kind = 'ADDED') as trees_added,
            count(*) filter (tr and change_kind = 'MODIFIED') as trees_modified, count(*) filter (tr and change_kind = 'REMOVED') as trees_removed from y group by line""",
        "diff_count_rollup": f"""{base}{d} select line, parent_path, change_kind, grouping(line, parent_path, change_kind)::int as level, count(*) as n from d
            group by rollup(line, parent_path, change_kind)""",
        "diff_bounds": f"""{base}{d}, y as (select * from d where (old_minx, old_maxx, old_miny, old_maxy) is distinct from (new_minx, new_maxx, new_miny, new_maxy)),
            g as (select line, min(old_minx) as old_minx, max(old_maxx) as old_maxx, min(old_miny) as old_miny, max(old_maxy) as old_maxy,
            min(new_minx) as new_minx, max(new_maxx) as new_maxx, min(new_miny) as new_miny, max(new_maxy) as new_maxy from y group by line)
            select *, least(old_minx, new_minx) as both_minx, greatest(old_maxx, new_maxx) as both_maxx, least(old_miny, new_miny) as both_miny,
            greatest(old_maxy, new_maxy) as both_maxy from g""",
        "diff_renames": f"""{base}{d}, o as (select line, old_object_id as object_id, min({full}) as old_path from d where change_kind = 'REMOVED' and old_object_id is not null group by 1, 2 having count(*) = 1),
            n as (select line, new_object_id as object_id, min({full}) as new_path from d where change_kind = 'ADDED' and new_object_id is not null group by 1, 2 having count(*) = 1)
            select line, object_id, old_path, new_path from o join n using (line, object_id)""",
        "diff_feature_types": f"""{base} o as (select line, {full} as path, metadata_id from a0 where ref_type = 'TREE'), n as (select line, {full} as path, metadata_id from z0 where ref_type = 'TREE')
            select line, path, o.metadata_id as old_metadata_id, n.metadata_id as new_metadata_id from o join n using (line, path) where o.metadata_id is distinct from n.metadata_id""",
        "feature_diff": f"""{base}{d}, {texts}, md as (select * from d where change_kind = 'MODIFIED'),
            o as (select line, parent_path, ref_name, pos, kind, value from md join att on att.object_id = md.old_object_id),
            n as (select line, parent_path, ref_name, pos, kind, value from md join att on att.object_id = md.new_object_id),
            y as (select coalesce(o.line, n.line) as line, coalesce(o.parent_path, n.parent_path) as parent_path, coalesce(o.ref_name, n.ref_name) as ref_name, coalesce(o.pos, n.pos) as pos,
            o.kind as old_kind, o.value as old_value, n.kind as new_kind, n.value as new_value from o full outer join n
            on o.line = n.line and o.parent_path = n.parent_path and o.ref_name = n.ref_name and o.pos = n.pos)
            select *, case when old_kind is null then 'ADDED' when new_kind is null then 'REMOVED' else 'MODIFIED' end as change from y
            where old_kind is distinct from new_kind or old_value is distinct from new_value""",
        "ls_children": f"{base} y as (select {last}, {full} as path from z0) select * from y where coalesce(parent_path, '') = ''",
        "ls_below": f"{base} y as (select {last}, {full} as path from z0) select * from y where parent_path = 'cadastre' or starts_with(parent_path, 'cadastre/')",
        "ls_features": f"{base} y as (select {last}, {full} as path, {meets()} as hit from z0) select * exclude (hit) from y where (parent_path = 'osm' or starts_with(parent_path, 'osm/')) and ref_type = 'FEATURE' and hit",
        "ls_trees": f"{base} y as (select {last}, {full} as path from z0) select * from y where ref_type = 'TREE'",
        "find_child": f"{base} y as (select {last} from z0 where parent_path = 'osm' and ref_name = 'node') select * from y",
        "feature_type_trees": f"{base} y as (select {last}, metadata_id from z0 where ref_type = 'TREE' and metadata_id is not null) select * from y",
        "feature_types_used": f"""{base} ft as (select distinct {norm('metadata_id')} as type_id, type_name from feature_types),
            tr as (select line, {full} as p, metadata_id from z0 where ref_type = 'TREE' and metadata_id is not null),
            y as (select zf.line, parent_path, ref_name, coalesce(zf.metadata_id, tr.metadata_id) as type_id from zf left join tr on tr.line = zf.line and tr.p = zf.parent_path)
            select y.*, type_name from y left join ft on ft.type_id = y.type_id""",
        "describe_types": f"""select {norm('metadata_id')} as metadata_id, type_name, (generate_subscripts(str_split(field_list, ','), 1) - 1)::int as pos,
            str_split(unnest(str_split(field_list, ',')), ':')[1] as field, str_split(unnest(str_split(field_list, ',')), ':')[-1] as field_type from feature_types""",
        "subtree_stats": f"""{base} y as (select line, parent_path, count(*) filter (ref_type = 'FEATURE') as n_features, count(*) as n_rows,
            min(minx) as minx, max(maxx) as maxx, min(miny) as miny, max(maxy) as maxy from z0 group by 1, 2) select * from y""",
        "query_bbox": f"{base} y as (select {last} from zf where {meets()}) select * from y",
        "query_cql": f"""{base} y as (select {last} from zf where ref_name like 'pt-%' and (minx between 0 and 90 or not coalesce({meets('', (-180, 0, 180, 90))}, false))
            and parent_path in ('Points', 'survey/Points')) select * from y""",
        "query_page": f"{base} y as (select line, parent_path, ref_name, minx from zf order by minx desc nulls last, line, parent_path, ref_name limit 50 offset 20) select * from y",
        "query_extent": f"{base} y as (select line, count(*) as n_features, min(minx) as minx, max(maxx) as maxx, min(miny) as miny, max(maxy) as maxy from zf group by 1) select * from y",
        "query_thin": f"""{base} y as (select floor((minx + maxx) / 2 / 5)::bigint as cell_x, floor((miny + maxy) / 2 / 5)::bigint as cell_y, count(*) as n_in_cell from zf
            where minx is not null and maxx is not null and miny is not null and maxy is not null group by 1, 2) select * from y""",
        "query_box_join": f"""{base} k as (select line, parent_path, count(*) as n, min(minx) as minx, max(maxx) as maxx, min(miny) as miny, max(maxy) as maxy from zf group by 1, 2),
            y as (select a.line as a_line, b.line as b_line, a.n as a_n_features, b.n as b_n_features from k a join k b
            on a.minx <= b.maxx and a.maxx >= b.minx and a.miny <= b.maxy and a.maxy >= b.miny where a.parent_path = 'Polygon' and b.parent_path = 'Points') select * from y""",
        "log_all": f"with recursive {own}, {reach} select start, one.commit_id, committer_ts from r join one on one.commit_id = r.id",
        "log_first_parent": f"with recursive {own}, {first} select start, one.commit_id, back from b join one on one.commit_id = b.id",
        "log_since": f"""with recursive {own}, {reach}, mid as (select line, max_by(commit_id, (committer_ts, commit_id)) as id from cc where committer_ts < {AFTER} group by 1),
            q as (select line as start, id from mid union select q.start, x0.dst from q join x0 on x0.src = q.id)
            select start, one.commit_id from (select * from r except select * from q) join one on one.commit_id = id""",
        "log_time_range": f"with recursive {own}, {reach} select start, one.commit_id from r join one on one.commit_id = r.id where committer_ts between {AFTER} and {BEFORE}",
        "log_author": f"""with recursive {own}, {reach} select start, one.commit_id from r join one on one.commit_id = r.id where (author_name is null or regexp_full_match(author_name, 'R.*'))
            and (committer_name is null or regexp_full_match(committer_name, '.*[aeiou]'))""",
        "log_paths": f"select distinct commit_id from ({ch}) where {full} = 'osm' or starts_with({full}, 'osm/')",
        "log_change_counts": f"""select commit_id, count(*) filter (change_kind = 'ADDED') as added, count(*) filter (change_kind = 'MODIFIED') as modified,
            count(*) filter (change_kind = 'REMOVED') as removed from ({ch}) group by 1""",
        "commit_before": f"with recursive {own}, {first} select start as line, min_by(id, back) as commit_id from b join one on one.commit_id = b.id where committer_ts < {AFTER} group by 1",
        "statistics": f"""with {own} select line, count(*) as n_commits, count(distinct coalesce(author_name, committer_name)) as n_authors,
            min_by(commit_id, (committer_ts, commit_id)) as first_commit, max_by(commit_id, (committer_ts, commit_id)) as last_commit from cc group by 1""",
        "graph_edges": f"with {own} select src, dst, min(ord)::int as ord from x where dst is not null group by 1, 2",
        "graph_depth": f"""with recursive {graph_ctes}, w as (select id, 0 as d from tree where id not in (select src from e)
            union select e.src, w.d + 1 from w join e on e.dst = w.id join tree t on t.id = e.src where w.d < t.d)
            select id, min(d) as depth from w group by 1""",
        "graph_children": f"""with recursive {graph_ctes} select id, (select count(*) from e where e.dst = tree.id) as n_children, (select count(*) from e where e.src = tree.id) as n_parents from tree""",
        "graph_topological": f"""with recursive {own}, w as (select distinct commit_id as id, 0 as d from cc where commit_id not in (select src from x0) union select x0.src, w.d + 1 from w join x0 on x0.dst = w.id)
            select id, max(d) as generation from w group by 1""",
        "graph_reach": f"""with recursive {graph_ctes}, r as (select id as start, id from tree where id not in (select dst from e) union select r.start, e.dst from r join e on e.src = r.id)
            select start, count(*) as n_reached from r group by 1""",
        "merge_base": f"""with recursive {graph_ctes}, f1 as (select src, min(dst) as left_id from e where ord = 0 group by 1),
            pr as (select distinct left_id, dst as right_id from f1 join e on e.src = f1.src and e.ord > 0),
            r as (select distinct start, start as id from (select left_id as start from pr union select right_id from pr) union select r.start, e.dst from r join e on e.src = r.id),
            cm as (select distinct left_id, right_id, a.id from pr join r a on a.start = left_id join r b on b.start = right_id and b.id = a.id)
            select left_id, right_id, id as base_id from cm where not exists (select 1 from e join cm k on k.id = e.src where e.dst = cm.id and k.left_id = cm.left_id and k.right_id = cm.right_id)""",
        "sparse_path": f"""with recursive {graph_ctes}, tp as (select id, root from tree where id not in (select dst from e)), mg as (select distinct src as id from e where ord > 0),
            r as (select tp.id as start, root, tp.id as cur, tp.id in (select id from mg) as hit from tp union select r.start, r.root, e.dst, r.hit or e.dst in (select id from mg) from r join e on e.src = r.cur)
            select start as id, bool_or(hit and cur = root) as passes from r group by 1""",
        "walk_graph": f"""with recursive {own}, {reach}, cm as (select distinct id from r), tr as (select distinct tree as id from cc where commit_id in (select id from cm) and tree is not null),
            nm as (select * from (select {norm('tree')} as tree, {norm('object_id')} as object_id, {norm('metadata_id')} as metadata_id, row_number() over (partition by {norm('tree')}, parent_path, ref_name
            order by listed_at desc nulls last) as k from tree_refs) where k = 1 and tree in (select id from tr))
            select * from (select id from cm union select id from tr union select object_id from nm union select metadata_id from nm) where id is not null""",
        "feature_history": f"{hist} select line, parent_path, ref_name, commit_id, object_id from hist",
        "blame": f"""{hist}, {texts}, lastv as (select line, parent_path, ref_name, max(num) as m from hist group by 1, 2, 3),
            live as (select lastv.* from lastv join (select line, parent_path, ref_name from f where num = last_num) q on q.line = lastv.line and q.parent_path = lastv.parent_path and q.ref_name = lastv.ref_name),
            ea as (select hist.line, hist.parent_path, hist.ref_name, hist.commit_id, hist.num, m, pos, kind, value from hist join live on live.line = hist.line and live.parent_path = hist.parent_path and live.ref_name = hist.ref_name
            join att on att.object_id = hist.object_id),
            st as (select *, lag(kind) over w as pk, lag(value) over w as pv from ea window w as (partition by line, parent_path, ref_name, pos order by num)),
            mx as (select line, parent_path, ref_name, pos, max(num) as num from st where pk is null or pk is distinct from kind or pv is distinct from value group by 1, 2, 3, 4)
            select st.line, st.parent_path, st.ref_name, st.pos::int as pos, st.value, st.commit_id from st join mx using (line, parent_path, ref_name, pos, num)
            where exists (select 1 from ea where ea.line = st.line and ea.parent_path = st.parent_path and ea.ref_name = st.ref_name and ea.pos = st.pos and ea.num = ea.m)""",
        "merge_classify": f"{merged} select * from k",
        "merge_check": f"""{merged} select line, count(*) as n_paths, count(*) filter (merge_class = 'both') as n_both, count(*) filter (merge_class = 'conflict') as n_conflicts,
            bool_or(merge_class in ('both', 'conflict')) as would_conflict from k group by 1""",
        "merge_conflicts": f"""{merged} select concat_ws(chr(9), {full}, coalesce(ancestor, '{'0' * 40}'), coalesce(ours, '{'0' * 40}'), coalesce(theirs, '{'0' * 40}')) as conflict from k where merge_class = 'conflict'""",
        "patch_verify": f"{verify} select line, parent_path, ref_name, change_kind, verdict from v",
        "patch_apply": f"""{undo} select {last} from z0 where not exists (select 1 from u where u.line = z0.line and u.parent_path = z0.parent_path and u.ref_name = z0.ref_name)
            union all select line, parent_path, ref_name, new_ref_type, new_object_id from u where change_kind <> 'REMOVED'""",
        "patch_lines": f"{base}{d}, {texts} select parent_path, ref_name, change_kind, old_object_id, new_object_id, object_text as new_text from d left join t on t.object_id = d.new_object_id",
        "sync_missing": f"""with w as (select {norm('object_id')} as id from tree_refs union select {norm('tree')} from commits), hv as (select {norm('id')} as id from objects union select {norm('id')} from base_objects)
            select id from w where id is not null except select id from hv""",
        "sync_shallow": f"""with recursive {graph_ctes}, r as (select id as start, id, 0 as back from tree where id not in (select dst from e) union all select r.start, fp.dst, r.back + 1 from r join fp on fp.src = r.id where r.back < 4)
            select * from r""",
        "sync_fast_forward": f"""with recursive {own}, {reach}, old as (select line, max_by(commit_id, (committer_ts, commit_id)) as left_id from cc where committer_ts < {AFTER} group by 1)
            select line, exists (select 1 from r where r.start = old.line and r.id = left_id) as forward from old""",
        "sync_refs": f"""with {own}, a as (select line as name, max_by(commit_id, (committer_ts, commit_id)) as old from cc where committer_ts < {BEFORE} group by 1),
            b as (select line as name, max_by(commit_id, (committer_ts, commit_id)) as new from cc where committer_ts >= {AFTER} group by 1)
            select name, old, new, case when old is null then 'ADDED' when new is null then 'REMOVED' else 'CHANGED' end as transfer from a full outer join b using (name) where old is distinct from new""",
        "osm_map": """with v as (select event_id as id, props ->> '$.k' as k, event_type as kind from events)
            select 'clicks' as rule, id, k as k_value, kind from v where kind = 'click' union all select 'not_views', id, null, kind from v where coalesce(kind <> 'view', true)
            union all select 'with_k', id, k, null from v where k is not null and kind is not null""",
        "osm_tags": """select event_id as id, concat_ws('|', 'k:' || (props ->> '$.k'), 'type:' || event_type) as tag_text, props ->> '$.k' as k from events""",
        "osm_ways": """with v as (select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as pos, p_size::double as x, p_partkey::double as y from lineitem left join part on p_partkey = l_partkey and p_size <= 40),
            g as (select id, count(x) as n_points, count(*) - count(x) as n_missing, min_by(y, pos) filter (x is not null) as first_y, max_by(y, pos) filter (x is not null) as last_y from v group by 1)
            select id, n_points::int as n_points, n_missing, coalesce(first_y = last_y and n_points >= 4, false) as closed, first_y, last_y from g""",
        "osm_change_set": f"""{base}{d} select case change_kind when 'ADDED' then 'create' when 'MODIFIED' then 'modify' else 'delete' end as action, str_split(parent_path, '/')[-1] as kind, count(*) as n
            from d where str_split(parent_path, '/')[-1] in ('node', 'way') group by 1, 2""",
        "feature_attributes": """with v as (select put_seq, unnest(str_split(object_text, chr(10))[2:]) as ln, generate_subscripts(str_split(object_text, chr(10))[2:], 1) - 1 as pos from objects
            where kind = 'FEATURE' and object_text is not null and str_split(object_text, chr(10))[1] = 'FEATURE')
            select put_seq, pos::int as pos, str_split(ln, chr(9))[1] as kind, case when str_split(ln, chr(9))[1] <> 'NULL' then substr(ln, instr(ln, chr(9)) + 1) end as value from v where contains(ln, chr(9))""",
        "object_ids": "select put_seq, sha1(object_text) as content_id, true as round_trip from objects where object_text is not null",
        "geometry_boxes": """with v as (select put_seq, regexp_extract_all(object_text, '(-?[0-9]+(?:\\.[0-9]+)?) +(-?[0-9]+(?:\\.[0-9]+)?)', 0) as p from objects where object_text is not null),
            u as (select put_seq, unnest(p) as q from v) select put_seq, count(*) as n_points, min(str_split(q, ' ')[1]::double) as minx, max(str_split(q, ' ')[1]::double) as maxx,
            min(str_split(q, ' ')[-1]::double) as miny, max(str_split(q, ' ')[-1]::double) as maxy from u group by 1""",
        "resolve_prefix": f"""with i as (select distinct {norm('commit_id')} as id from commits where {norm('commit_id')} is not null), p as (select distinct substr(id, 1, 7) as prefix from i)
            select prefix, case when count(*) = 1 then min(id) end as id, count(*) as n_matches from p join i on starts_with(id, prefix) group by 1""",
        "resolve_short_ref": f"""with {own}, p as (select str_split(line, ':')[1] as repo, regexp_replace(regexp_replace(line, '^[^:]*:', ''), '^refs/(heads|tags|remotes)/', '') as b, id as target from h),
            nm as (select 'refs/heads/' || repo || '/' || b as name, target from p union all select 'refs/tags/' || b, min(target) from p group by 1),
            w as (select name as short from nm union select regexp_replace(name, '^refs/(heads|tags)/', '') from nm union select str_split(name, '/')[-1] from nm),
            m as (select short, name, target, case when name = short then 0 when starts_with(name, 'refs/heads/') then 1 else 2 end as rank from w join nm on name = short or ends_with(name, '/' || short)),
            k as (select short, min(rank) as rank from m group by 1)
            select short, case when count(*) = 1 then min(name) end as name, case when count(*) = 1 then min(target) end as target, count(*) as n_matches from m join k using (short, rank) group by short""",
        "merge_features": """with e as (select *, round(p_retailprice * 100)::bigint as price, p_size between 10 and 15 as moved from part)
            select p_partkey::varchar as ref_name, 'FEATURE' || chr(10) || 'STRING' || chr(9) || p_name || chr(10) || 'INTEGER' || chr(9) || (p_size + 1) || chr(10) || 'LONG' || chr(9)
            || case when p_size >= 20 then price + 5 else price end || chr(10) || 'LINESTRING' || chr(9) || case when moved then 'LINESTRING (7 0, 1 1, 2 2, 3 9)' else 'LINESTRING (0 0, 1 1, 2 2, 3 3)' end as merged_text,
            p_size >= 28 as conflicting from e where p_size <= 30 and (p_size >= 20 or moved)""",
        "merge_trees": f"""{base} mx as (select * from a0 where not coalesce({full} = 'osm' or starts_with({full}, 'osm/'), false)), a as (select * from a0 where ref_type = 'TREE'), m as (select * from mx where ref_type = 'TREE'), z as (select * from z0 where ref_type = 'TREE'),
            k as (select line, parent_path, ref_name from a union select line, parent_path, ref_name from m union select line, parent_path, ref_name from z),
            v as (select k.*, a.line is not null as ha, m.line is not null as ho, z.line is not null as ht, coalesce(a.metadata_id, '{'0' * 40}') as ka, coalesce(m.metadata_id, '{'0' * 40}') as ko, coalesce(z.metadata_id, '{'0' * 40}') as kt
            from k left join a using (line, parent_path, ref_name) left join m using (line, parent_path, ref_name) left join z using (line, parent_path, ref_name)),
            u as (select *, case when ha then ka end as ancestor, case when ho then ko end as ours, case when ht then kt end as theirs, {full} as path from v),
            g as (select *, ours is distinct from ancestor as co, theirs is distinct from ancestor as ct from u),
            eo as (select f.line, f.parent_path from mx f left join a0 using (line, parent_path, ref_name) left join z0 on z0.line = f.line and z0.parent_path = f.parent_path and z0.ref_name = f.ref_name
                where f.ref_type = 'FEATURE' and f.object_id is distinct from a0.object_id and z0.object_id is not distinct from a0.object_id),
            et as (select f.line, f.parent_path from z0 f left join a0 using (line, parent_path, ref_name) left join mx on mx.line = f.line and mx.parent_path = f.parent_path and mx.ref_name = f.ref_name
                where f.ref_type = 'FEATURE' and f.object_id is distinct from a0.object_id and mx.object_id is not distinct from a0.object_id),
            r as (select g.*, (co and not ct and ha and not ho and exists (select 1 from et where et.line = g.line and (et.parent_path = path or starts_with(et.parent_path, path || '/'))))
                or (ct and not co and ha and not ht and exists (select 1 from eo where eo.line = g.line and (eo.parent_path = path or starts_with(eo.parent_path, path || '/')))) as fought from g where co or ct)
            select line, parent_path, ref_name, 'TREE' as ref_type, case when fought then 'conflict' when not ct then 'ours' when not co then 'theirs' when ours is not distinct from theirs then 'same' else 'conflict' end as merge_class,
            ancestor, ours, theirs from r""",
        "object_kinds": f"""with v as (select {norm('id')} as id, kind, put_seq from objects union all select {norm('id')}, kind, -1 from base_objects) select id, min_by(kind, put_seq) as kind from v where id is not null group by 1""",
    }
    return sql
