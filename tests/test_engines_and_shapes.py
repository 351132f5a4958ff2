"""Routing servers behind a fake transport, shapefiles, joins of any shapes, vocabulary without a cross join."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoframe.functions import rings as R
from cartoframe.operators import catalog, overlay, routing
from cartoframe.sources import shapefile

LINE = overlay.RING


def fake():
    """A transport that tasks can be sent."""

    def answers(url, body):
        """What servers answer; nothing for places east of 100 degrees."""
        if "10" + "1.0" in url + (body or ""):
            return None
        asked = json.loads(body) if body else None
        if "/route/v1/" in url:
            return json.dumps({"routes": [{"distance": 12345, "duration": 600, "geometry": "_p~iF~ps|U_ulLnnqC_mqNvxq`@"}]})
        if "/table/v1/" in url:
            n = url.split("/")[-1].split("?")[0].count(";") + 1
            return json.dumps({"durations": [[60 * (i + j) for j in range(n)] for i in range(n)], "distances": [[None if i == j else 1000 * (i + j) for j in range(n)] for i in range(n)]})
        if url.endswith("/sources_to_targets"):
            n = len(asked["sources"])
            return json.dumps({"sources_to_targets": [[{"time": i, "distance": j} for j in range(n)] for i in range(n)]})
        if url.endswith("/isochrone"):
            return json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}}]})
        if "isochrone?" in url:
            return json.dumps({"polygons": [{"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}]})
        if asked is not None:
            return json.dumps({"trip": {"summary": {"length": 7.5, "time": 540}, "legs": [{"shape": "_p~iF~ps|U_ulLnnqC"}, {}]}})
        assert "point=" in url and "points_encoded=false" in url
        return json.dumps({"paths": [{"distance": 9000, "time": 360_000, "points": {"coordinates": [[1, 2], [3, 4]]}}]})

    return answers


@pytest.mark.parametrize("engine, km, minutes, n", [("osrm", 12.35, 10.0, 3), ("valhalla", 7.5, 9.0, 2), ("graphhopper", 9.0, 6.0, 2)])
def test_routes_of_servers(spark, engine, km, minutes, n):
    rows = [(1, [(1.0, 2.0), (3.0, 4.0)]), (2, [(101.0, 0.0), (102.0, 0.0), (103.0, 0.0)]), (3, [(1.0, 1.0)]), (4, None)]
    got = {r.id: r for r in routing.routes(spark.createDataFrame(rows, f"id long, points {LINE}"), routing.Server(engine, "http://x"), fetch=fake()).collect()}
    assert (got[1].distance_km, got[1].duration_min, len(got[1].coords), got[1].backend) == (km, minutes, n, engine)
    crow = 2 * np.pi * 6371 / 360 * 2 * 1.3
    assert got[2].backend == "estimate" and got[2].distance_km == pytest.approx(crow, abs=0.01) and got[2].duration_min == pytest.approx(crow / 80 * 60, abs=0.1) and len(got[2].coords) == 3
    assert got[3].distance_km is None and got[4].backend is None


def test_matrices_and_isochrones_of_servers(spark):
    rows = [("a", [(1.0, 2.0), (3.0, 4.0)]), ("b", [(101.0, 0.0), (102.0, 0.0)]), ("c", [(0.0, 0.0)])]
    df = spark.createDataFrame(rows, f"g string, points {LINE}")
    cell = lambda engine: {(r.g, r.i, r.j): (r.duration_s, r.distance_m, r.backend) for r in routing.matrix(df, routing.Server(engine, "http://x"), "g", fetch=fake()).collect()}
    got = cell("osrm")
    assert len(got) == 8 and got["a", 0, 1] == (60.0, 1000.0, "osrm") and got["a", 1, 1] == (120.0, 0.0, "osrm") and got["b", 0, 0] == (0.0, 0.0, "estimate")
    assert cell("valhalla")["a", 1, 1] == (1.0, 1000.0, "valhalla") and {v[2] for v in cell("graphhopper").values()} == {"estimate"}
    centres = spark.createDataFrame([(1, 0.0, 0.0), (2, 101.0, 0.0), (3, None, 0.0)], "id long, lon double, lat double")
    for engine, area in (("valhalla", 2.0), ("graphhopper", 0.5)):
        found = {r.id: (r.backend, r.a) for r in routing.isochrones(centres, routing.Server(engine, "http://x"), 15, fake()).select("id", "backend", overlay.area_of(F.col("parts")).alias("a")).collect()}
        assert found[1] == (engine, area) and found[2][0] == found[3][0] == "none"
    with pytest.raises(ValueError):
        routing.Server("horse", "http://x")
    assert routing.over_http("http://127.0.0.1:9/none", None, 1.0) is None


def test_shapefiles_round_trip(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)]
    far = [(x + 10, y) for x, y in ring]
    rows = [("Point", [(1.5, -2.5)], None, {"name": "Zoë", "n": "1"}), ("Point", [(3.0, 4.0)], None, {}), ("LineString", ring[:3], None, {"name": "x" * 300}), ("Polygon", ring, [[ring, hole]], {"name": "holed"}), ("MultiPolygon", ring, [[ring, hole], [far]], None), ("Polygon", far, None, {"n": "7"}), (None, None, None, {})]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], shapefile.LAYER.replace("gtype string, tags map<string,string>, coords array<struct<lon:double,lat:double>>, parts array<array<array<struct<lon:double,lat:double>>>>", f"gtype string, coords {LINE}, parts {overlay.PARTS}, tags map<string,string>"))
    assert shapefile.write_shapefile(df, f"{tmp_path}/x.shp", ("name", "n")) == {"points": 2, "lines": 1, "polygons": 3}
    points = shapefile.read_shapefile(spark, f"{tmp_path}/x_points.shp").collect()
    assert {((r.coords[0].lon, r.coords[0].lat), tuple(sorted(r.tags.items()))) for r in points} == {((1.5, -2.5), (("n", "1"), ("name", "Zoë"))), ((3.0, 4.0), ())}
    line = shapefile.read_shapefile(spark, f"{tmp_path}/x_lines.shp").first()
    assert line.gtype == "LineString" and len(line.coords) == 3 and len(line.tags["name"]) == 254
    areas = shapefile.read_shapefile(spark, f"{tmp_path}/x_polygons.shp")
    assert sorted((r.gtype, r.a) for r in areas.select("gtype", overlay.area_of(F.col("parts")).alias("a")).collect()) == [("MultiPolygon", 31.5), ("Polygon", 15.5), ("Polygon", 16.0)]
    index, shapes = (tmp_path / "x_polygons.shx").read_bytes(), (tmp_path / "x_polygons.shp").read_bytes()
    for k in range(3):  # the index leads to the records
        at, words = struct.unpack(">2i", index[100 + 8 * k : 108 + 8 * k])
        assert struct.unpack(">2i", shapes[2 * at : 2 * at + 8]) == (k + 1, words)
    assert struct.unpack(">i", shapes[24:28])[0] * 2 == len(shapes)
    (tmp_path / "bad.shp").write_bytes(b"junk" * 40)
    with pytest.raises(Exception, match="not a shapefile"):
        shapefile.read_shapefile(spark, f"{tmp_path}/bad.shp").collect()


def test_joins_of_any_shapes(spark):
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    refs = [(1, "A", box(0.0, 0.0, 4.0), [[box(0.0, 0.0, 4.0), box(1.0, 1.0, 1.0)[::-1]]]), (2, "B", box(3.0, 3.0, 4.0), None), (3, "C", box(20.0, 20.0, 1.0), None)]
    subjects = [(1, "Point", [(0.5, 0.5)]), (2, "Point", [(1.5, 1.5)]), (3, "Point", [(4.0, 4.0)]), (4, "LineString", [(-1.0, -1.0), (0.5, 0.5)]), (5, "LineString", [(0.2, 0.2), (0.8, 0.3)]), (6, "LineString", [(0.5, 1.5), (3.5, 1.5)]), (7, "Polygon", box(0.1, 0.1, 0.5)), (8, "Polygon", box(-5.0, -5.0, 30.0)), (9, "Polygon", box(3.5, 3.5, 2.0)), (10, "Polygon", box(7.0, 3.0, 1.0)), (11, "Point", None), (12, "LineString", [(4.0, 0.0), (4.0, 2.0)]), (13, "Polygon", box(1.2, 1.2, 0.5)), (14, "LineString", [(50.0, 50.0), (51.0, 51.0)])]
    s = spark.createDataFrame(subjects, f"sid long, gtype string, coords {LINE}")
    r = spark.createDataFrame(refs, f"rid long, name string, coords {LINE}, parts {overlay.PARTS}").withColumn("parts", F.coalesce("parts", F.array(F.array("coords"))))
    got = lambda predicate, how="left": {x.sid: (x.ref_rid, x.ref_name, x.ref_joined_count) for x in overlay.spatial_join(s, r, key="sid", order="rid", predicate=predicate, how=how).collect()}
    none = (None, None, 0)
    a, b = (1, "A", 1), (2, "B", 1)
    meets = {1: a, 2: none, 3: (1, "A", 2), 4: a, 5: a, 6: a, 7: a, 8: (1, "A", 3), 9: (1, "A", 2), 10: b, 11: none, 12: a, 13: none, 14: none}
    assert got("intersects") == meets
    assert got("within") == {**dict.fromkeys(meets, none), 1: a, 3: (1, "A", 2), 5: a, 7: a, 9: b, 12: a}
    assert got("contains") == {**dict.fromkeys(meets, none), 8: (1, "A", 3)}
    assert set(got("intersects", "inner")) == {k for k, v in meets.items() if v != none}
    with pytest.raises(ValueError):
        got("near")
    assert R.lines_meet(np.array([(0, 0), (2, 2)], float), np.array([(0, 2), (2, 0)], float)) and not R.lines_meet(np.array([(0, 0), (1, 1)], float), np.array([(2, 2), (3, 3)], float)) and R.lines_meet(np.array([(0, 0), (2, 2)], float), np.array([(1, 1), (3, 3)], float))


def test_vocabulary_meets_what_all_pairs_would(spark):
    rng = random.Random(5)
    words = ["a", "gas", "station", "fuel", "pump", "ev", "charger", "as", "ta", "market", "super market"]
    phrase = lambda: rng.choice(["_", " ", "-"]).join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    v = [("k%d" % (i % 3), phrase(), [phrase() for _ in range(rng.randrange(3))] or None) for i in range(60)]
    q = [(x,) for x in sorted({phrase().upper() for _ in range(60)} | {"", "ga", "zzz", "t"})]
    plain = lambda x: " ".join(x.lower().replace("_", " ").replace("-", " ").split())
    want = {}
    for (query,) in q:
        x = plain(query)
        for key, value, synonyms in v:
            for t in [plain(value), *map(plain, synonyms or ())]:
                c = (1.0 if t == plain(value) else 0.9) if x == t else 0.65 if set(x.split(" ")) <= set(t.split(" ")) else 0.5 if x in t or t in x else 0
                if x and c > want.get((query, key, value), 0):
                    want[query, key, value] = c
    got = catalog.match_vocabulary(spark.createDataFrame(q, "query string"), spark.createDataFrame(v, "key string, value string, synonyms array<string>"))
    assert {(r["query"], r.key, r.value): r.confidence for r in got.collect()} == want
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
