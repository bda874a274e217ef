"""Maps of tagged nodes and ways: mapping rules, way geometry, change sets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as tagging
from ..functions import wkt


#: Types of mapped fields in mapping files and the Spark types that hold them; geometries are the entity's own. Fixed values.
FIELD_TYPES = {
    "STRING": "string", "INTEGER": "int", "LONG": "bigint", "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "boolean", "SHORT": "smallint",
    "POINT": "POINT", "LINESTRING": "LINESTRING", "POLYGON": "POLYGON",
}
GEOMETRIES = ("POINT", "LINESTRING", "POLYGON")


@dataclass
class Rule:
    """What entities a rule takes and what it makes of them.

    ``filter`` and ``exclude`` are tag -> values (an empty list: any value); ``mandatory`` tags must be there.
    ``fields`` is output column -> (tag, Spark type or geometry type); ``geometry`` is ``open``, ``closed`` or ``all`` for
    ways. A field of a geometry type holds the entity's geometry; a POLYGON field takes closed entities only, its ring closed.
    ``defaults`` are columns of the entity that the mapped table has as well.
    """

    name: str
    filter: dict[str, list[str]]
    exclude: dict[str, list[str]] = field(default_factory=dict)
    mandatory: list[str] = field(default_factory=list)
    fields: dict[str, tuple[str, str]] = field(default_factory=dict)
    geometry: str = "all"
    defaults: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, spec: dict) -> Rule:
        """A rule from its JSON form; an exclusion of null makes the tag mandatory, and the filter ``geom`` restricts ways to open or closed ones."""
        no, yes = spec.get("exclude") or {}, dict(spec.get("filter") or {})
        shape = yes.pop("geom", None) or [spec.get("geometry") or "all"]
        fields = {v["name"]: (k, FIELD_TYPES.get(v["type"].upper(), v["type"])) for k, v in (spec.get("fields") or {}).items()}
        kinds = {str(x).lower() for x in shape}
        return cls(
            spec["name"], {k: v or [] for k, v in yes.items()}, {k: v for k, v in no.items() if v is not None}, [k for k, v in no.items() if v is None], fields,
            kinds.pop() if len(kinds) == 1 else "all", [str(c) for c in spec.get("defaultFields") or []],
        )

    @classmethod
    def all_of(cls, text: str) -> list[Rule]:
        """The rules of a mapping file."""
        return [cls.of(r) for r in json.loads(text)["rules"]]

    def takes(self, tags: Column) -> Column:
        def has(k: str, values: list[str]) -> Column:
            v = F.try_element_at(tags, F.lit(k))
            return F.coalesce(v.isin(values) if values else v.isNotNull(), F.lit(False))

        on = F.lit(not self.filter)
        for k, values in self.filter.items():
            on = on | has(k, values)
        for k, values in self.exclude.items():
            on = on & ~has(k, values)
        for k in self.mandatory:
            on = on & has(k, [])
        return on


def map_entities(entities: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule id fields``: each entity once for every rule that takes it, with the rule's fields as texts.

    ``entities`` has ``id``, ``tags`` (a map) and, for rules on geometry, ``closed`` and ``wkt``. One pass: the rules
    become one array of matches that is exploded. A rule with a geometry field leaves out entities whose geometry
    is of another type: lines for POLYGON unless they are closed.
    """
    made = []
    for r in rules:
        on = r.takes(F.col("tags"))
        if r.geometry in ("open", "closed"):
            on = on & (F.col("closed") if r.geometry == "closed" else ~F.col("closed"))
        cells = []
        for name, (tag, kind) in sorted(r.fields.items()):
            if kind in GEOMETRIES:
                is_kind = wkt.kind("wkt") == kind
                on = on & F.coalesce(is_kind | (F.lit(kind == "LINESTRING") & (wkt.kind("wkt") == "POLYGON")), F.lit(False))
                shape = F.when(is_kind, F.col("wkt")).otherwise(F.regexp_replace(F.regexp_replace("wkt", r"^POLYGON \(\(", "LINESTRING ("), r"\)\)$", ")"))
                cells += [F.lit(name), shape]
            else:
                cells += [F.lit(name), F.try_element_at("tags", F.lit(tag)).try_cast(kind).cast("string")]
        cells += [x for c in r.defaults for x in (F.lit(c), F.col(c).cast("string"))]
        cells = F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")
        made.append(F.when(on, F.struct(F.lit(r.name).alias("rule"), cells.alias("fields"))))
    hit = F.filter(F.array(*made), lambda x: x.isNotNull())
    return entities.select("id", F.explode(hit).alias("x")).select("x.rule", "id", "x.fields")


def mapped_table(mapped: DataFrame, rule: Rule) -> DataFrame:
    """The typed table of one rule from :func:`map_entities`; geometries are well-known text."""
    cols = [F.col("fields")[n].try_cast("string" if kind in GEOMETRIES else kind).alias(n) for n, (_, kind) in rule.fields.items()]
    cols += [F.col("fields")[n].alias(n) for n in rule.defaults]
    return mapped.filter(F.col("rule") == rule.name).select("id", *cols)


def unmap(edited: DataFrame, rule: Rule, entities: DataFrame) -> DataFrame:
    """``id tags changed``: the entities' tags with a mapped table's edits written back."""
    back = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(tag).alias("key"), F.col(n).cast("string").alias("value")) for n, (tag, kind) in rule.fields.items() if kind not in GEOMETRIES]), lambda e: e["value"].isNotNull()
    ))
    e = edited.select("id", back.alias("_new"))
    own = lambda m: F.map_filter("tags", lambda k, v: ~F.array_contains(F.map_keys(m), k))
    new = F.map_concat(own(F.col("_new")), "_new")
    return entities.join(e, "id").select("id", new.alias("tags"), (tagging.encode(new) != tagging.encode("tags")).alias("changed"))


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id points n_missing closed wkt`` of ways ``(id, refs array)`` from nodes ``(id, x, y)``, in their order.

    Missing nodes are left out and counted; fewer than two points give no geometry. A closed way of at least
    four points is a polygon. A node that holds a large share of all references is one row of the small side.
    """
    ref = ways.select("id", F.posexplode("refs").alias("pos", "node"))
    at = nodes.select(F.col("id").alias("node"), "x", "y").dropDuplicates(["node"])
    j = ref.join(at, "node", "left")
    got = j.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("pos", "x", "y")))).alias("p"),
        F.count(F.when(F.col("x").isNull(), 1)).alias("n_missing"),
    )
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    got = got.withColumn("points", points).drop("p")
    closed = wkt.is_closed(F.col("points")) & (F.size("points") >= 4)
    text = F.when(closed, wkt.text(F.col("points"), "POLYGON")).when(F.size("points") >= 2, wkt.text(F.col("points"), "LINESTRING"))
    return got.select("id", "points", "n_missing", closed.alias("closed"), text.alias("wkt"))


def change_set(changes: DataFrame) -> DataFrame:
    """``action kind id``: create, modify or delete of each changed node or way of a diff."""
    action = F.create_map(*[F.lit(x) for p in (("ADDED", "create"), ("MODIFIED", "modify"), ("REMOVED", "delete")) for x in p])
    kind = F.substring_index("parent_path", "/", -1)
    return changes.filter(kind.isin("node", "way")).select(action[F.col("change_kind")].alias("action"), kind.alias("kind"), F.col("ref_name").alias("id"))


def last_edits(edits: DataFrame, kind: str) -> DataFrame:
    """The last edit of every entity of a kind (``node``, ``way``, ``relation``), by ``seq``: a column per field of the edit."""
    e = edits.filter(F.col("kind") == kind) if "kind" in edits.columns else edits
    rest = [c for c in e.columns if c not in ("id", "kind")]
    # the columns of maps can't be ordered, so the position alone decides
    return e.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("id", "e.*")


def apply_change_set(entities: DataFrame, edits: DataFrame, box: tuple[float, float, float, float] | None = None, kind: str = "node") -> DataFrame:
    """Entities of a kind after edits (``seq action id`` and the entities' columns); of several edits of an id the last counts.

    ``delete`` drops, ``modify`` replaces or inserts, ``create`` inserts; nodes only within ``box`` if one is given.
    Ways and relations are given by their ``refs`` or ``members``; ways whose nodes are gone keep them.
    """
    last = last_edits(edits, kind)
    kept = entities.join(last, "id", "left_anti")
    new = last.filter("action <> 'delete'")
    if box and kind == "node":
        x0, y0, x1, y1 = box
        inside = (F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1)
        new = new.filter((F.col("action") != "create") | F.coalesce(inside, F.lit(False)))
    cols = [c for c in entities.columns if c in last.columns]
    return kept.select(cols).unionByName(new.select(*[F.col(c).cast(entities.schema[c].dataType).alias(c) for c in cols]))


def import_report(entities: DataFrame) -> DataFrame:
    """``n latest_changeset latest_timestamp``."""
    return entities.agg(F.count("*").alias("n"), F.max("changeset").alias("latest_changeset"), F.max("timestamp").alias("latest_timestamp"))
