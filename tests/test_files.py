"""Extracts in splits, change files, archives, joined files: round trips."""

import gzip
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cartoframe.operators import overlay
from cartoframe.sources import diffs, files, geojson, pbf, tables


def elements(n):
    rng = random.Random(n)
    words = ["amenity", "cafe", "Zoë", "", "a" * 200, "日本"]
    rows = [("node", i * 3 - 50, rng.choice([None, 4]), round(rng.uniform(-180, 180), 7), round(rng.uniform(-85, 85), 7), {rng.choice(words) + "k": rng.choice(words) for _ in range(rng.randrange(3))}, None, None) for i in range(n)]
    rows += [("way", 10**10 + i, 2, None, None, {"highway": "primary"} if i % 2 else {}, [rng.randrange(n) for _ in range(rng.randrange(6))], None) for i in range(n // 3)]
    return rows + [("relation", i, None, None, None, {"type": "route"}, None, [{"type": rng.choice(["node", "way", "relation"]), "ref": rng.randrange(10**11), "role": rng.choice(words)} for _ in range(rng.randrange(4))]) for i in range(n // 9)]


def test_an_extract_is_read_in_splits(spark, tmp_path):
    rows = elements(3000)
    df = spark.createDataFrame(rows, pbf.ELEMENTS).repartition(5)
    path = str(tmp_path / "x.osm.pbf")
    pbf.write_pbf(df, path, block=40)
    key = lambda r: (r.osm_type, r.id)
    plain = lambda r: (r.version, r.lon and round(r.lon, 7), r.lat and round(r.lat, 7), r.tags, r.node_refs, r.members)
    want = {key(r): plain(r) for r in df.collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, least in (("20k", 4), ("7k", 10), ("128m", 1)):  # splits smaller than a block, too
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = pbf.read_pbf(spark, path)
            assert got.rdd.getNumPartitions() >= least
            assert {key(r): plain(r) for r in got.collect()} == want and got.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert pbf.read_pbf(spark, path, 7).count() == len(rows)
    whole = (tmp_path / "x.osm.pbf").read_bytes()
    (tmp_path / "cut.pbf").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="cut after"):
        pbf.read_pbf(spark, str(tmp_path / "cut.pbf")).collect()
    pbf.write_pbf(df.limit(0), str(tmp_path / "none.pbf"))
    assert pbf.read_pbf(spark, str(tmp_path / "none.pbf")).collect() == []


OSC = """<?xml version='1.0' encoding='UTF-8'?>
<osmChange version="0.6"><modify><node id="1" version="3" timestamp="2024-01-01T00:00:00Z" changeset="9" user="a&amp;b" lat="1.5" lon="2.5"><tag k="name" v="&quot;x&quot; &lt;y&gt;"/></node></modify>
<delete><node id="2" version="2"/></delete><create><way id="7" version="1"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/></way>
<relation id="8" version="1"><member type="way" ref="7" role="outer"/></relation></create><delete><way id="9" version="5"/></delete></osmChange>"""


def test_change_files_are_read_and_published(spark, tmp_path):
    (tmp_path / "000" / "005").mkdir(parents=True)
    (tmp_path / "000" / "005" / "090.osc.gz").write_bytes(gzip.compress(OSC.encode()))
    (tmp_path / "000" / "005" / "091.osc").write_text("<osmChange/>")
    rows = diffs.read_changes(spark, str(tmp_path)).orderBy("seq_pos").collect()
    assert [(r.sequence, r.seq_pos, r.op, r.osm_type, r.osm_id, r.visible) for r in rows] == [(5090, 0, "modify", "node", 1, True), (5090, 1, "delete", "node", 2, False), (5090, 2, "create", "way", 7, True), (5090, 3, "create", "relation", 8, True), (5090, 4, "delete", "way", 9, False)]
    assert rows[0].tags == {"name": '"x" <y>'} and (rows[0].lon, rows[0].lat, rows[0].user) == (2.5, 1.5, "a&b") and rows[2].node_refs == [1, 2] and rows[3].members[0].role == "outer"
    root = str(tmp_path / "out")
    changes = diffs.read_changes(spark, str(tmp_path / "000"))
    assert diffs.read_state(spark, root) == (None, "")
    diffs.publish(changes, root, 5090, "2024-01-02T00:00:00Z")
    assert diffs.read_state(spark, root) == (5090, "2024-01-02T00:00:00Z") and "\\:" in (tmp_path / "out" / "state.txt").read_text()
    again = diffs.read_changes(spark, root).orderBy("seq_pos").collect()
    assert again == rows
    with pytest.raises(ValueError, match="gap"):
        diffs.publish(changes, root, 5092, "x")
    diffs.publish(changes.limit(0), root, 5091, "2024-01-03T00:00:00Z")
    assert diffs.read_state(spark, root)[0] == 5091 and diffs.read_changes(spark, root).count() == 5
    assert diffs.sequence_path(5090) == "000/005/090" and diffs.sequence_of("a/b/17.osc") == 17
    with pytest.raises(ValueError):
        diffs.sequence_path(-1)


def test_a_sequence_is_cut_to_regions(spark, tmp_path):
    (tmp_path / "000" / "000").mkdir(parents=True)
    (tmp_path / "000" / "000" / "003.osc.gz").write_bytes(gzip.compress(OSC.encode()))
    changes = diffs.read_changes(spark, str(tmp_path / "000"))
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    areas = spark.createDataFrame([("north", box(0.0, 0.0, 5.0)), ("all", box(-50.0, -50.0, 100.0)), ("empty", box(60.0, 60.0, 1.0))], f"region string, coords {overlay.RING}")
    places = spark.createDataFrame([("way", 7, 1.0, 1.0), ("way", 9, -9.0, -9.0), ("node", 2, 4.0, 4.0)], "osm_type string, osm_id long, lon double, lat double")
    root = str(tmp_path / "www")
    assert diffs.publish_regions(changes, areas, places, root, 3, "2024-01-01T00:00:00Z") == {"all": 4, "empty": 0, "north": 3}
    got = {r: sorted((x.osm_type, x.osm_id, x.lon) for x in diffs.read_changes(spark, f"{root}/{r}-updates").collect()) for r in ("north", "all", "empty")}
    assert got["north"] == [("node", 1, 2.5), ("node", 2, None), ("way", 7, None)] and len(got["all"]) == 4 and got["empty"] == []
    assert all(diffs.read_state(spark, f"{root}/{r}-updates")[0] == 3 for r in got) and list(files.folders(spark, root)) == ["all-updates", "empty-updates", "north-updates"]


def test_an_archived_feed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name, text in {"stops": "stop_id,stop_lat\nA,1\n", "routes": "route_id\nR\n", "trips": "trip_id\nT\n", "stop_times": "trip_id,stop_id\nT,A\n", "notes": "x\n"}.items():
            z.writestr(f"export/{name}.txt", text)
        z.writestr("__MACOSX/export/stops.txt", "junk")
    feed = tables.read_feed(spark, str(tmp_path / "feed.zip"))
    assert set(feed) == {"stops", "routes", "trips", "stop_times"} and feed["stops"].first().asDict() == {"stop_id": "A", "stop_lat": "1"}


def test_collections_are_joined_from_many_parts(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)]
    far = [(x + 10, y) for x, y in ring]
    rows = [("p", "Polygon", ring, [[ring, hole]]), ("m", "MultiPolygon", ring, [[ring, hole], [far]]), ("l", "LineString", ring[:2], None), ("n", None, None, None)]
    layer = spark.createDataFrame([(i, None, {"k": i}, g, c, p) for i, g, c, p in rows], f"feature_id string, osm_type string, tags map<string,string>, gtype string, coords {overlay.RING}, parts {overlay.PARTS}")
    path = str(tmp_path / "all.geojson")
    geojson.write_collection(layer.repartition(7), path)
    text = json.loads((tmp_path / "all.geojson").read_text())
    assert {f["id"]: f["geometry"] and f["geometry"]["type"] for f in text["features"]} == {i: g for i, g, *_ in rows}
    back = {r.feature_id: r for r in geojson.read_collection(spark, path).collect()}
    assert [len(p) for p in back["m"].parts] == [2, 1] and back["p"].parts[0][1][1].lat == 2.0 and back["l"].parts is None and (back["m"].lon, back["m"].lat) == (7.0, 2.0)
    area = {r.feature_id: r.a for r in geojson.read_collection(spark, path).select("feature_id", overlay.area_of(F.col("parts")).alias("a")).collect()}
    assert area["p"] == 15.5 and area["m"] == 31.5
    geojson.write_collection(layer.limit(0), path)
    assert json.loads((tmp_path / "all.geojson").read_text())["features"] == []
    (tmp_path / "bad").mkdir()
    for name, content in {"a": '{"type":"Feature"}', "b": "[]", "c": '{"type":"FeatureCollection","features":{}}', "d": '{"type":"FeatureCollection","features":[]}'}.items():
        (tmp_path / "bad" / f"{name}.geojson").write_text(content)
    got = sorted((r.file[-9:-8], r.message) for r in geojson.root_issues(spark, str(tmp_path / "bad")).collect())
    assert got == [("a", "Root is Feature, not FeatureCollection"), ("b", "No type at the root"), ("c", "No list of features")]


def test_class_filters_are_pushed(spark, tmp_path):
    assert "tags->>'highway' IN ('motorway', 'trunk')" in tables.relational_query("roads", "x", kind="motorway,trunk") and "FROM osm_ways" in tables.relational_query("roads", "x")
    assert "'it''s'" in tables.relational_query("amenities", "it's") and "tags->>'protect_class' IN ('1a')" in tables.relational_query("parks", "x", kind="national", protect=("1a",))
    assert "bigint) >= 5000" in tables.relational_query("population", "x", kind="city", min_population=5000) and "'4'" in tables.relational_query("boundaries", "x", kind="state")
    for bad in (("pois", "x"), ("parks", "castle"), ("routes", "rocket")):
        with pytest.raises(KeyError):
            tables.relational_query(bad[0], "x", kind=bad[1])
    rows = spark.sql("select 'a' id, 'motorway' class, 'road' subtype, named_struct('primary', 'A1') names, named_struct('xmin', 1D, 'xmax', 2D, 'ymin', 1D, 'ymax', 2D) bbox union all select 'b', 'path', 'road', null, named_struct('xmin', 1D, 'xmax', 2D, 'ymin', 1D, 'ymax', 2D)")
    rows.write.parquet(f"{tmp_path}/theme=transportation/type=segment")
    df = tables.read_themed(spark, str(tmp_path), "roads", classes=("motorway",))
    assert [r.id for r in df.collect()] == ["a"]
    assert "EqualTo(class,motorway)" in df._jdf.queryExecution().executedPlan().toString().replace(" ", "") or "In(class" in df._jdf.queryExecution().executedPlan().toString()
