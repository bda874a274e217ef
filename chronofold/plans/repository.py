"""Queries that run the commands of a repository on features made of the test tables, with the SQL of what must come out."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import osm_repo
from ..repo import ConflictError, Repo
from ..sources import geojson, tables
from ..workspace import materialize, shared_dir
from .problems import table

KINDS = {"name": "STRING", "size": "INTEGER", "price": "LONG", "shape": "POINT"}


class _Work:
    """A new repository whose tree ``parts`` holds the parts, committed as ``first``."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        root = shared_dir(spark)
        if "://" in root and not root.startswith("file://"):
            raise ValueError("a repository needs a folder that driver and executors see under one path")
        self.path = root.removeprefix("file://").removeprefix("file:") + "/repository-" + uuid.uuid4().hex
        self.spark = spark
        self.parts = materialize(
            table(spark, d, "part").select(
                F.col("p_partkey").cast("string").alias("fid"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"),
                F.concat(F.lit("POINT ("), "p_size", F.lit(" "), F.col("p_partkey"), F.lit(")")).alias("shape"),
            )
        )
        self.repo = Repo.init(spark, self.path + "/a", {"user.name": "tester"})
        self.put("true", {})
        self.commit("first", 1)

    def put(self, where: str, changed: dict[str, str], tree: str = "parts", repo: Repo | None = None) -> None:
        (repo or self.repo).insert(tree, self.parts.filter(where).withColumns({k: F.expr(v) for k, v in changed.items()}), "fid", KINDS, "shape")

    def commit(self, message: str, when: int) -> str:
        return self.repo.commit(message, when=when, all=True)

    def features(self, spec: str = "HEAD", tree: str = "parts", repo: Repo | None = None) -> DataFrame:
        at = lambda i: F.try_element_at("attributes", F.lit(i))["value"]
        return (repo or self.repo).features(tree, spec).select(
            F.col("parent_path").alias("tree"), F.col("ref_name").alias("fid"), at(1).alias("name"), at(2).cast("int").alias("size"), at(3).cast("long").alias("price")
        )

    def end(self, out: DataFrame) -> DataFrame:
        """The result, written apart, so the repository can be deleted."""
        out = materialize(out)
        shutil.rmtree(self.path, ignore_errors=True)
        return out


MORE, DEAR, OTHER = {"size": "size + 1"}, {"price": "price + 5"}, {"size": "size + 100"}


def repo_status(spark: SparkSession, d: str) -> DataFrame:
    """Staged and unstaged changes of features."""
    w = _Work(spark, d)
    w.put("size <= 10", MORE)
    w.put("size > 45", {}, "copies")
    w.repo.add()
    w.put("size >= 40", DEAR)
    w.repo.delete("parts", w.parts.filter("size = 20").select(F.col("fid").alias("ref_name")))
    w.put("size = 3", {}, "loose")
    sides = [w.repo.diff(*how).select(F.lit(side).alias("side"), "parent_path", "ref_name", "change_kind") for side, how in (("staged", ("HEAD", "STAGE_HEAD")), ("unstaged", ("STAGE_HEAD", "WORK_HEAD")))]
    n = w.repo.status()
    counts = spark.createDataFrame([("count", k, str(v), "") for k, v in n.items()], "side string, parent_path string, ref_name string, change_kind string")
    return w.end(sides[0].unionByName(sides[1]).unionByName(counts))


def repo_undo(spark: SparkSession, d: str) -> DataFrame:
    """What is left after committing a path alone, clean, reset and checkout of paths, and removal."""
    w = _Work(spark, d)
    w.put("size <= 10", MORE)
    w.put("size > 45", {}, "copies")
    w.repo.add()
    w.repo.commit("copies alone", when=2, paths=["copies"])
    w.put("size = 3", {}, "loose")
    w.repo.clean("loose")
    w.repo.reset_paths(["parts"])
    w.repo.checkout_paths("parts", "STAGE_HEAD")
    w.put("size >= 40", DEAR)
    w.put("size = 50", MORE, "copies")
    w.repo.remove("copies")
    out = w.features("WORK_HEAD").unionByName(w.features("HEAD", "copies").withColumn("tree", F.lit("committed copies")))
    left = w.repo.nodes("STAGE_HEAD").filter("ref_type = 'FEATURE' and parent_path <> 'parts'").select(F.lit("staged").alias("tree"), F.col("ref_name").alias("fid"), F.lit("").alias("name"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("price"))
    return w.end(out.unionByName(left))


def repo_merge(spark: SparkSession, d: str) -> DataFrame:
    """A merge of two branches: attributes from both, a new tree and a removed feature."""
    w = _Work(spark, d)
    w.repo.branch_create("theirs", checkout=True)
    w.put("size >= 20", DEAR)
    w.put("size > 45", {}, "extra")
    w.repo.delete("parts", w.parts.filter("size = 5").select(F.col("fid").alias("ref_name")))
    w.commit("theirs", 2)
    w.repo.checkout("master")
    w.put("size <= 30 and size <> 5", MORE)
    w.commit("ours", 3)
    w.repo.merge("theirs")
    return w.end(w.features().unionByName(w.features(tree="extra")))


def repo_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The conflicts of a merge, and the features after half of them were decided for ours, the others for theirs."""
    w = _Work(spark, d)
    w.repo.branch_create("theirs", checkout=True)
    w.put("size >= 28", OTHER)
    w.commit("theirs", 2)
    w.repo.checkout("master")
    w.put("size <= 30", MORE)
    w.commit("ours", 3)
    try:
        w.repo.merge("theirs", message="both")
        raise AssertionError("no conflict")
    except ConflictError:
        pass
    asked = materialize(w.repo.open_conflicts().select(F.lit("conflict").alias("tree"), F.col("ref_name").alias("fid"), F.lit(w.repo.merge_message()).alias("name"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("price")))
    w.repo.checkout_side("parts", "theirs")
    w.repo.commit(when=4)
    return w.end(asked.unionByName(w.features()))


def repo_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Features and log after a pick, a revert, a rebase and a squash."""
    w = _Work(spark, d)
    w.repo.branch_create("side", checkout=True)
    w.put("size <= 10", MORE)
    picked = w.commit("small ones", 2)
    w.put("size >= 40", DEAR)
    w.commit("large ones", 3)
    w.repo.checkout("master")
    w.put("size = 25", OTHER)
    w.commit("middle", 4)
    w.repo.cherry_pick(picked)
    w.put("size = 35", OTHER)
    undone = w.commit("mistake", 5)
    w.repo.revert(undone)
    w.repo.checkout("side")
    w.repo.rebase("master")
    w.repo.squash("HEAD~4", "one")
    said = [(f"{i}", c["message"], len(c["parents"])) for i, c in enumerate(w.repo.log(topological=True))]
    log = spark.createDataFrame(said, "fid string, name string, size int").select(F.lit("log").alias("tree"), "fid", "name", "size", F.lit(0).cast("long").alias("price"))
    return w.end(w.features().unionByName(log))


def repo_sync(spark: SparkSession, d: str) -> DataFrame:
    """The origin after a clone pushed to it, and the clone after a pull and a shallow one."""
    w = _Work(spark, d)
    other = Repo.clone(spark, w.repo.path, w.path + "/b")
    w.put("size <= 10", MORE, repo=other)
    other.commit("theirs", when=2, all=True)
    other.push()
    w.put("size > 45", {}, "extra")
    w.commit("ours", 3)
    other.pull()
    shallow = Repo.clone(spark, w.repo.path, w.path + "/c", depth=1)
    name = lambda f, n: f.withColumn("tree", F.concat(F.lit(n + " "), F.col("tree")))
    sides = name(w.features(), "origin").unionByName(name(w.features(tree="extra", repo=other), "clone")).unionByName(name(w.features(repo=shallow), "shallow"))
    heads = [("heads", str(len({w.repo.head, other.head, shallow.head, *other.ls_remote().values()})), str(len(shallow.log())), int(shallow.is_shallow), 0)]
    return w.end(sides.unionByName(spark.createDataFrame(heads, sides.schema)))


def repo_patch(spark: SparkSession, d: str) -> DataFrame:
    """Working tree and rejected rows after a patch was applied to features edited meanwhile, and the tree after it was undone."""
    w = _Work(spark, d)
    w.put("size <= 10", MORE)
    w.put("size > 45", {}, "extra")
    w.commit("second", 2)
    p = materialize(w.repo.create_patch("HEAD~1", "HEAD"))
    w.repo.reset("HEAD~1", "HARD")
    w.put("size = 7", DEAR)
    rejected = materialize(w.repo.apply_patch(p, partial=True))
    after = materialize(w.features("WORK_HEAD").unionByName(w.features("WORK_HEAD", "extra")))
    w.repo.apply_patch(p.join(rejected.select("parent_path", "ref_name"), ["parent_path", "ref_name"], "left_anti").select(p.columns), reverse=True)
    undone = w.features("WORK_HEAD").withColumn("tree", F.lit("undone"))
    bad = rejected.select(F.lit("rejected").alias("tree"), F.col("ref_name").alias("fid"), F.col("verdict").alias("name"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("price"))
    return w.end(after.unionByName(undone).unionByName(bad))


def repo_transaction(spark: SparkSession, d: str) -> DataFrame:
    """Features after a transaction that was merged with what others did meanwhile, and one that was dropped."""
    w = _Work(spark, d)
    t = w.repo.transaction_begin()
    w.put("size <= 10", MORE, repo=t)
    t.commit("inside", when=2, all=True)
    w.put("size >= 40", DEAR)
    w.commit("outside", 3)
    before = materialize(w.features().withColumn("tree", F.lit("before")))
    t.transaction_end()
    gone = w.repo.transaction_begin()
    w.put("size = 25", OTHER, repo=gone)
    gone.commit("dropped", when=4, all=True)
    gone.transaction_end(cancel=True)
    return w.end(before.unionByName(w.features()))


def repo_export(spark: SparkSession, d: str) -> DataFrame:
    """Features exported to a file of map features and read back."""
    w = _Work(spark, d)
    out = tables.export_features(w.repo.features("parts"), [(k, v) for k, v in KINDS.items()])
    geojson.write_geojson(out, w.path + "/out", "fid", "shape")
    return w.end(geojson.read_lines(spark, w.path + "/out", "name string, size int, price long").select("fid", "name", "size", "price", "geom"))


def repo_map(spark: SparkSession, d: str) -> DataFrame:
    """A map of parts as nodes and orders as ways through file, import, mapping, edit and back to tags: the entities' tags."""
    w = _Work(spark, d)
    at = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    nodes = table(spark, d, "part").select(F.concat(
        F.lit("<node id="), at(F.col("p_partkey")), F.lit(" lon="), at(F.col("p_size")), F.lit(" lat="), at(F.pmod("p_partkey", F.lit(80))), F.lit('><tag k="size" v='), at(F.col("p_size")),
        F.when(F.col("p_size") > 25, F.lit('/><tag k="kind" v="large')).otherwise(F.lit('/><tag k="kind" v="small')), F.lit('"/></node>'),
    ).alias("value"))
    ways = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x")).select(F.concat(
        F.lit("<way id="), at(F.col("l_orderkey")), F.lit(">"), F.array_join(F.transform("x", lambda x: F.concat(F.lit('<nd ref="'), x["l_partkey"], F.lit('"/>'))), ""), F.lit('<tag k="kind" v="order"/></way>'),
    ).alias("value"))
    osm_repo.documents(nodes.unionByName(ways)).write.text(w.path + "/map")
    report = osm_repo.import_file(w.repo, w.path + "/map", "import")
    mapping = """{"rules": [{"name": "large", "filter": {"kind": ["large"]}, "fields": {"size": {"name": "size", "type": "INTEGER"}, "geom": {"name": "geom", "type": "POINT"}}}]}"""
    osm_repo.apply_mapping(w.repo, mapping)
    f = w.repo.features("large", "WORK_HEAD").select(F.col("ref_name").alias("fid"), F.col("attributes")[0]["value"].alias("id"), F.lit("99").alias("size"), F.col("attributes")[2]["value"].alias("geom"), F.col("attributes")[1]["value"].cast("int").alias("was"))
    w.repo.insert("large", f.filter("was > 40"), "fid", {"id": "LONG", "size": "INTEGER", "geom": "POINT"}, "geom")
    changed = osm_repo.unmap(w.repo, "large")
    n = osm_repo.stored_nodes(w.repo).select(F.lit("node").alias("kind"), "id", F.col("tags")["size"].alias("value"), F.col("tags")["kind"].alias("tag"))
    y = osm_repo.stored_ways(w.repo).select(F.lit("way").alias("kind"), "id", F.size("refs").cast("string").alias("value"), F.when(F.col("wkt").isNull(), "none").otherwise("line").alias("tag"))
    counts = spark.createDataFrame([("count", changed, str(report["n"]), "")], "kind string, id long, value string, tag string")
    return w.end(n.unionByName(y).unionByName(counts))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (repo_status, repo_undo, repo_merge, repo_conflicts, repo_rewrite, repo_sync, repo_patch, repo_transaction, repo_export, repo_map)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    p = "with p as (select p_partkey::varchar as fid, p_name as name, p_size as size, round(p_retailprice * 100)::bigint as price, p_partkey from part)"

    def put(tree: str = "parts", size: str = "size", price: str = "price", where: str = "true") -> str:
        return f"select '{tree}' as tree, fid, name, ({size})::int as size, ({price})::bigint as price from p where {where}"

    more, dear, both = "size + (size <= 10)::int", "price + 5 * (size >= 40)::int", " union all "
    row = lambda tree, fid, name, size: f"select '{tree}', {fid}, {name}, {size}, 0"
    return {
        "repo_status": p + """, s as (select 'staged' as side, 'parts' as parent_path, fid as ref_name, 'MODIFIED' as change_kind from p where size <= 10
            union all select 'staged', 'copies', fid, 'ADDED' from p where size > 45),
            u as (select 'unstaged' as side, 'parts' as parent_path, fid as ref_name, case when size = 20 then 'REMOVED' else 'MODIFIED' end as change_kind from p where size >= 40 or size = 20
            union all select 'unstaged', 'loose', fid, 'ADDED' from p where size = 3)
            select * from s union all select * from u union all select 'count', 'staged', (select count(*) from s)::varchar, '' union all select 'count', 'unstaged', (select count(*) from u)::varchar, ''
            union all select 'count', 'conflicts', '0', ''""",
        "repo_undo": p + both.join([" " + put(price=dear), put("committed copies", where="size > 45")]),
        "repo_merge": p + both.join([" " + put(size="size + (size <= 30)::int", price="price + 5 * (size >= 20)::int", where="size <> 5"), put("extra", where="size > 45")]),
        "repo_conflicts": p + both.join([" " + put(size="case when size >= 28 then size + 100 else size + 1 end"), "select 'conflict', fid, 'both', 0, 0 from p where size between 28 and 30"]),
        "repo_rewrite": p + both.join([" " + put(size=f"{more} + 100 * (size = 25)::int", price=dear), "select 'log', * from (values ('0', 'one', 1, 0), ('1', 'small ones', 1, 0), ('2', 'middle', 1, 0), ('3', 'first', 0, 0))"]),
        "repo_sync": p + both.join([" " + put("origin parts", more), put("clone extra", where="size > 45"), put("shallow parts", more), row("heads", "'1'", "'1'", 1)]),
        "repo_patch": p + both.join([
            " " + put(size="size + (size <= 10 and size <> 7)::int", price="price + 5 * (size = 7)::int"), put("extra", where="size > 45"),
            put("undone", price="price + 5 * (size = 7)::int"), "select 'rejected', fid, 'changed', 0, 0 from p where size = 7",
        ]),
        "repo_transaction": p + both.join([" " + put("before", price=dear), put(size=more, price=dear)]),
        "repo_export": p + " select fid, name, size, price, 'POINT (' || size || '.0 ' || p_partkey || '.0)' as geom from p",
        "repo_map": """with n as (select 'node' as kind, p_partkey as id, case when p_size > 40 then '99' else p_size::varchar end as value, case when p_size > 25 then 'large' else 'small' end as tag from part),
            y as (select 'way' as kind, l_orderkey as id, count(*)::varchar as value, case when count(p_partkey) >= 2 then 'line' else 'none' end as tag from lineitem left join part on p_partkey = l_partkey group by 2)
            select * from n union all select * from y union all select 'count', (select count(*) from part where p_size > 40), ((select count(*) from n) + (select count(*) from y))::varchar, ''""",
    }
