from conftest import rows

from chronofold.operators import osm
from chronofold.sources import osmxml
from chronofold.streaming import replay
from chronofold.repo import Repo

XML = """<osm><node id="1" lat="1.0" lon="2.0" version="1"><tag k="amenity" v="bank"/><tag k="name" v="x"/></node><node id="2" lat="1.5" lon="2.5"/><node id="3" lat="2" lon="2"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way><way id="11"><nd ref="1"/><nd ref="99"/></way></osm>"""


def test_import_map_unmap(spark, tmp_path):
    f = tmp_path / "a.osm"
    f.write_text(XML)
    nodes, ways = osmxml.read_nodes(spark, str(f)), osmxml.read_ways(spark, str(f))
    got = {r["id"]: (r["n_missing"], r["closed"], r["wkt"]) for r in osm.assemble_ways(ways, nodes).collect()}
    assert got[10] == (0, True, "POLYGON ((2.0 1.0, 2.5 1.5, 2.0 2.0, 2.0 1.0))") and got[11] == (1, False, None)
    rule = osm.Rule.of({"name": "banks", "filter": {"amenity": ["bank"]}, "exclude": {"name": None}, "fields": {"name": {"name": "label", "type": "string"}}})
    mapped = osm.map_entities(nodes, [rule])
    assert rows(osm.mapped_table(mapped, rule)) == [(1, "x")]
    edited = spark.createDataFrame([(1, "y")], "id long, label string")
    assert osm.unmap(edited, rule, nodes).first()["tags"] == {"amenity": "bank", "name": "y"}
    c = tmp_path / "c.osc"
    c.write_text('<osmChange><create><node id="5" lat="0" lon="0"/><node id="6" lat="50" lon="50"/></create><modify><node id="2" lat="9" lon="9"/></modify><delete><node id="3" lat="2" lon="2"/></delete></osmChange>')
    out = osm.apply_change_set(nodes, osmxml.read_changes(spark, str(c)), (-1.0, -1.0, 10.0, 10.0))
    assert rows(out.select("id", "x")) == [(1, 2.0), (2, 9.0), (5, 0.0)]
    c.write_text('<osmChange><delete><node id="3"/></delete><create><node id="3" lat="7" lon="8"/><way id="12"><nd ref="1"/><nd ref="3"/></way></create><delete><way id="11"/></delete></osmChange>')
    edits = osmxml.read_changes(spark, str(c))
    assert rows(osm.apply_change_set(nodes, edits).select("id", "x")) == [(1, 2.0), (2, 2.5), (3, 8.0)]
    assert rows(osm.apply_change_set(ways, edits, kind="way").select("id", "refs")) == [(10, [1, 2, 3, 1]), (12, [1, 3])]


MAPPING = """{"rules": [{"name": "houses", "filter": {"building": ["yes"], "geom": ["closed"]}, "fields": {"building": {"name": "b", "type": "STRING"}, "geom": {"name": "g", "type": "POLYGON"}}},
 {"name": "banks", "filter": {"amenity": []}, "exclude": {"name": null}, "fields": {"name": {"name": "label", "type": "STRING"}, "geom": {"name": "g", "type": "POINT"}}}]}"""


def test_repository_of_a_map(spark, tmp_path):
    from chronofold.operators import osm_log, osm_repo

    f = tmp_path / "a.osm"
    f.write_text(XML)
    repo = Repo.init(spark, str(tmp_path / "r"))
    report = osm_repo.import_file(repo, str(f), "import", mapping=MAPPING)
    assert report["n"] == 5 and report["unprocessed"] == 1 and len(osm_log.entries(repo)) == 1
    house = repo.features("houses").first()
    assert [a["value"] for a in house["attributes"]] == ["10", "yes", "POLYGON ((2.0 1.0, 2.5 1.5, 2.0 2.0, 2.0 1.0))"]
    repo.insert("banks", spark.createDataFrame([("1", "1", "renamed", "POINT (2.0 1.0)")], "f string, id string, label string, g string"), "f", {"id": "LONG", "label": "STRING", "g": "POINT"}, "g")
    assert osm_repo.unmap(repo, "banks", "back") == 1
    assert osm_repo.stored_nodes(repo).filter("id = 1").first()["tags"]["name"] == "renamed"
    history = tmp_path / "h"
    for n, body in ((1, '<create><node id="8" lat="1" lon="1"/></create>'), (2, '<delete><node id="8"/></delete><create><node id="8" lat="3" lon="3"/></create>'), (10, '<delete><way id="10"/></delete>')):
        (history / str(n)).mkdir(parents=True)
        (history / str(n) / "download.xml").write_text(f"<osmChange>{body}</osmChange>")
    assert osm_repo.import_history(repo, str(history)) == 3
    assert osm_repo.stored_nodes(repo).filter("id = 8").first()["x"] == 3.0 and rows(osm_repo.stored_ways(repo).select("id")) == [(11,)]
    osm_repo.export(repo, "HEAD", str(tmp_path / "out"))
    assert osmxml.read_nodes(spark, str(tmp_path / "out")).count() == 4
    assert osm_log.read_mapping_entry(repo, "banks")["mapping"] == MAPPING and osm_log.read_filter(repo, osm_log.entries(repo)[0]) is None


def test_replay(spark, tmp_path):
    repo = Repo.init(spark, str(tmp_path / "r"))
    schema = "fid string, v int"
    src = tmp_path / "in"
    for i in range(2):
        spark.createDataFrame([(f"f{i}", i), ("f", i)], schema).coalesce(1).write.mode("append").parquet(str(src))
        replay.replay(replay.read_stream(spark, str(src), schema), repo, "t", "fid", {"v": "INTEGER"}, None, str(tmp_path / "cp")).awaitTermination()
    replay.replay(replay.read_stream(spark, str(src), schema), repo, "u", "fid", {"v": "INTEGER"}, None, str(tmp_path / "cp2")).awaitTermination()
    assert len(repo.log()) == 4 and repo.nodes().filter("parent_path = 't' and ref_type = 'FEATURE'").count() == 3
    assert repo.nodes().filter("ref_type = 'FEATURE'").count() == 6
