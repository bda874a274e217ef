"""Map data in a repository: import, mapping and back, change files, history."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as tagging
from ..functions import wkt
from ..repo import Repo
from ..sources import osmxml
from ..workspace import materialize
from . import osm, osm_log

#: Fields of stored nodes and ways. Fixed values.
NODE = {"visible": "BOOLEAN", "version": "INTEGER", "timestamp": "STRING", "tags": "STRING", "changeset": "LONG", "user": "STRING", "location": "POINT"}
WAY = {"visible": "BOOLEAN", "version": "INTEGER", "timestamp": "STRING", "tags": "STRING", "changeset": "LONG", "user": "STRING", "nodes": "STRING", "way": "LINESTRING"}


def _point() -> Column:
    return F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")))


def _rows(d: DataFrame, fields: dict[str, str], **made) -> DataFrame:
    have = {c: F.col(c) for c in d.columns} | {"tags": tagging.encode("tags")} | made
    return d.select(F.col("id").cast("string").alias("fid"), *[have.get(c, F.lit(None).cast("string")).alias(c) for c in fields])


def _put(repo: Repo, nodes: DataFrame | None, ways: DataFrame | None, replace: bool) -> None:
    if nodes is not None:
        repo.insert("node", _rows(nodes, NODE, location=_point()), "fid", NODE, "location", replace)
    if ways is not None:
        known = stored_nodes(repo)
        shaped = materialize(osm.assemble_ways(ways.select("id", "refs"), known).select("id", "points"))
        line = F.when(F.size("points") >= 2, wkt.text(F.col("points"), "LINESTRING"))
        joined = ways.join(shaped, "id")
        refs = F.array_join(F.col("refs").cast("array<string>"), ";")
        repo.insert("way", _rows(joined, WAY, nodes=refs, way=line), "fid", WAY, "way", replace)


def _attribute(name: str, fields: dict[str, str]) -> Column:
    return F.try_element_at("attributes", F.lit(list(fields).index(name) + 1))["value"]


def stored_nodes(repo: Repo, spec: str = "WORK_HEAD") -> DataFrame:
    """``id x y tags`` and the other fields of a repository's nodes."""
    f = repo.features("node", spec)
    p = wkt.coordinates("_w")[0]
    cols = [_attribute(c, NODE).alias(c) for c in NODE if c not in ("tags", "location")]
    return f.withColumn("_w", _attribute("location", NODE)).select(
        F.col("ref_name").cast("long").alias("id"), p["x"].alias("x"), p["y"].alias("y"), tagging.decode(_attribute("tags", NODE)).alias("tags"), *cols
    )


def stored_ways(repo: Repo, spec: str = "WORK_HEAD") -> DataFrame:
    """``id refs tags wkt`` and the other fields of a repository's ways."""
    f = repo.features("way", spec)
    cols = [_attribute(c, WAY).alias(c) for c in WAY if c not in ("tags", "nodes", "way")]
    refs = F.transform(F.filter(F.split(F.coalesce(_attribute("nodes", WAY), F.lit("")), ";"), lambda x: x != ""), lambda x: x.try_cast("long"))
    return f.select(F.col("ref_name").cast("long").alias("id"), refs.alias("refs"), tagging.decode(_attribute("tags", WAY)).alias("tags"), _attribute("way", WAY).alias("wkt"), *cols)


def import_file(repo: Repo, path: str, message: str | None = None, add: bool = False, mapping: str | None = None, raw: bool = True) -> dict:
    """Nodes and ways of a map file into the trees ``node`` and ``way``, then mapped tables, and a commit with ``message``.

    ``add`` keeps what is there. Ways of fewer than two known nodes are stored without geometry and counted.
    """
    spark = repo.spark
    nodes, ways = materialize(osmxml.read_nodes(spark, path)), materialize(osmxml.read_ways(spark, path))
    _put(repo, nodes, ways, not add)
    report = osm.import_report(nodes.select("changeset", "timestamp").unionByName(ways.select("changeset", "timestamp"))).first().asDict()
    report["unprocessed"] = stored_ways(repo).filter("wkt is null").count()
    if mapping:
        apply_mapping(repo, mapping)
        if not raw:
            for tree in ("node", "way"):
                repo.delete(tree)
    if message:
        repo.commit(message, all=True)
        osm_log.add_entry(repo, repo.tree_of("HEAD"), report["latest_changeset"], report["latest_timestamp"])
    return report


def _entities(repo: Repo) -> DataFrame:
    nodes = stored_nodes(repo).select("id", "tags", "timestamp", "changeset", "user", "version", F.lit(False).alias("closed"), _point().alias("wkt"))
    ways = stored_ways(repo).withColumn("_p", wkt.coordinates("wkt"))
    ring = wkt.is_closed(F.col("_p")) & (F.size("_p") >= 4)
    shape = F.when(ring, wkt.text(F.col("_p"), "POLYGON")).otherwise(F.col("wkt"))
    return nodes.unionByName(ways.select("id", "tags", "timestamp", "changeset", "user", "version", F.coalesce(ring, F.lit(False)).alias("closed"), shape.alias("wkt")))


def apply_mapping(repo: Repo, mapping: str, message: str | None = None) -> list[str]:
    """The tables of a mapping file's rules from the raw data, as trees of their own; their names."""
    rules = osm.Rule.all_of(mapping)
    mapped = materialize(osm.map_entities(_entities(repo), rules))
    kinds = {"string": "STRING", "int": "INTEGER", "bigint": "LONG", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "smallint": "SHORT"}
    for r in rules:
        table = osm.mapped_table(mapped, r).withColumn("id", F.col("id").cast("string"))
        types = {"id": "LONG"} | {n: kinds.get(k, k) for n, (_, k) in r.fields.items() if n != "id"} | {c: "STRING" for c in r.defaults}
        shape = next((n for n, (_, k) in r.fields.items() if k in osm.GEOMETRIES), None)
        repo.insert(r.name, table.withColumn("_fid", F.col("id")), "_fid", types, shape, replace=True)
        osm_log.write_mapping(repo, r.name, mapping, repo.refs()["WORK_HEAD"])
    if message:
        repo.commit(message, all=True)
    return [r.name for r in rules]


def unmap(repo: Repo, path: str, message: str | None = None) -> int:
    """Write edits of a mapped table back to the tags of the raw data; how many entities changed."""
    rules = osm_log.read_mapping(repo, path)
    if not rules:
        raise ValueError(f"{path} was not made by a mapping")
    rule = next(r for r in rules if r.name == path)
    names = ["id", *[n for n in rule.fields if n != "id"], *rule.defaults]
    f = repo.features(path, "WORK_HEAD")
    edited = f.select(F.col("ref_name").cast("long").alias("id"), *[F.try_element_at("attributes", F.lit(i + 1))["value"].alias(n) for i, n in enumerate(names) if n != "id"])
    changed, shapes = 0, {k for _, k in rule.fields.values() if k in osm.GEOMETRIES}
    # nodes and ways have ids of their own: a rule's geometry tells which it took, else its filter
    kinds = [k for k, wanted in (("node", not shapes or "POINT" in shapes), ("way", not shapes or "POINT" not in shapes)) if wanted]
    for kind in kinds:
        stored = materialize((stored_nodes if kind == "node" else stored_ways)(repo)).filter(rule.takes(F.col("tags")))
        new = materialize(osm.unmap(edited, rule, stored).filter("changed").drop("changed"))
        if n := new.count():
            changed += n
            rows = stored.drop("tags").join(new, "id")
            _put(repo, rows if kind == "node" else None, rows if kind == "way" else None, False)
    if message and changed:
        repo.commit(message, all=True)
    return changed


def apply_changes(repo: Repo, path: str, box: tuple[float, float, float, float] | None = None) -> None:
    """Replay a change file on the working tree's nodes and ways, in the order of the file."""
    edits = materialize(osmxml.read_changes(repo.spark, path))
    for kind in ("node", "way"):
        last = materialize(osm.last_edits(edits, kind))
        gone = last.filter("action = 'delete'").select(F.col("id").cast("string").alias("ref_name"))
        new = last.filter("action <> 'delete'")
        if box and kind == "node":
            x0, y0, x1, y1 = box
            new = new.filter((F.col("action") != "create") | (F.col("x").between(x0, x1) & F.col("y").between(y0, y1)))
        if gone.limit(1).count():
            repo.delete(kind, gone)
        if new.limit(1).count():
            _put(repo, new if kind == "node" else None, new if kind == "way" else None, False)


def import_history(repo: Repo, folder: str, first: int = 1, last: int | None = None, box: tuple[float, float, float, float] | None = None) -> int:
    """Replay changesets ``<folder>/<number>.xml`` (or ``<number>/download.xml``) in the order of their numbers, one commit each; how many were made."""
    found = {}
    for path in glob.glob(os.path.join(folder, "*")):
        name = os.path.basename(path).removesuffix(".xml")
        file = os.path.join(path, "download.xml") if os.path.isdir(path) else path
        if name.isdigit() and os.path.exists(file):
            found[int(name)] = file
    made = 0
    for n in sorted(k for k in found if k >= first and (last is None or k <= last)):
        apply_changes(repo, found[n], box)
        try:
            repo.commit(f"changeset {n}", all=True)
            made += 1
        except ValueError:  # nothing within the box
            pass
    return made


def documents(entities: DataFrame) -> DataFrame:
    """Lines of entities (``value``) with the beginning and end of a document around those of each task."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["<osm version=\"0.6\">"]})
        yield from batches
        yield pd.DataFrame({"value": ["</osm>"]})

    return entities.select("value").mapInPandas(whole, "value string")


def export(repo: Repo, spec: str, path: str) -> None:
    """Nodes and ways of a revision as map files of one line an entity, one whole document for each task."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    pairs = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(F.lit('<tag k="'), esc(e["key"]), F.lit('" v="'), esc(e["value"]), F.lit('"/>'))), "")
    nodes = stored_nodes(repo, spec).select(F.concat(F.lit('<node id="'), "id", F.lit('" lat="'), "y", F.lit('" lon="'), "x", F.lit('">'), pairs, F.lit("</node>")).alias("value"))
    nds = F.array_join(F.transform("refs", lambda r: F.concat(F.lit('<nd ref="'), r, F.lit('"/>'))), "")
    ways = stored_ways(repo, spec).select(F.concat(F.lit('<way id="'), "id", F.lit('">'), nds, pairs, F.lit("</way>")).alias("value"))
    documents(nodes.unionByName(ways)).write.mode("overwrite").text(path)


def mapped_export(repo: Repo, mapping: str) -> dict[str, DataFrame]:
    """The tables a mapping makes of the raw data, by rule, for any writer; nothing is stored."""
    rules = osm.Rule.all_of(mapping)
    mapped = materialize(osm.map_entities(_entities(repo), rules))
    return {r.name: osm.mapped_table(mapped, r) for r in rules}

