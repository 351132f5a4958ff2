"""Extracts rolled forward and cut, sources behind one handle, pages, and the readiness atlas against a plain loop."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_detours import Graph, haversine_m

from cartoframe.operators import extracts, overlay
from cartoframe.plans import atlas, workflows
from cartoframe.sources import diffs, handles, pages, pbf

NODE = "osm_type string, id long, version int, lon double, lat double, tags map<string,string>, node_refs array<long>, members array<struct<type:string,ref:long,role:string>>"


def world(spark):
    rows = [("node", i, 1, float(i), 0.5, {"amenity": "cafe"} if i % 2 else {}, None, None) for i in range(10)]
    rows += [("way", 100, 1, None, None, {"highway": "trunk"}, [0, 1, 2], None), ("way", 101, 1, None, None, {"route": "mtb"}, [7, 8], None), ("way", 102, 1, None, None, {"building": "house"}, [], None)]
    rows += [("relation", 5, 1, None, None, {"type": "x"}, None, [{"type": "way", "ref": 100, "role": "a"}]), ("relation", 6, 1, None, None, {}, None, [{"type": "node", "ref": 9, "role": ""}, {"type": "relation", "ref": 5, "role": ""}])]
    return spark.createDataFrame(rows, NODE)


def test_diffs_roll_an_extract_forward(spark, tmp_path):
    base = world(spark)
    change = lambda seq, pos, op, kind, i, version, lon=None, tags=None, refs=None: (seq, pos, op, kind, i, version, None, None, None, op != "delete", lon, lon and 0.5, tags, refs, None)
    rows = [change(1, 0, "modify", "node", 1, 2, 1.25, {"a": "b"}), change(1, 1, "delete", "node", 2, 2), change(1, 2, "create", "way", 2, 1, refs=[1, 3]), change(2, 0, "delete", "way", 2, 2), change(2, 1, "create", "node", 50, 1, 9.5, {}), change(2, 2, "modify", "node", 3, 2, 3.1, {}), change(2, 3, "modify", "node", 3, 3, 3.2, {}), change(2, 4, "modify", "node", 4, 0, 99.0, {})]
    changes = spark.createDataFrame(rows, diffs.CHANGES).repartition(3)
    got = {(r.osm_type, r.id): r.lon for r in extracts.apply_diffs(base, changes).collect()}
    want = {(r.osm_type, r.id): r.lon for r in base.collect()}
    del want["node", 2]
    want |= {("node", 1): 1.25, ("node", 50): 9.5, ("node", 3): 3.2}  # node 4's change is older than the extract
    assert got == want
    again = extracts.apply_diffs(extracts.apply_diffs(base, changes), changes)
    assert {(r.osm_type, r.id): r.lon for r in again.collect()} == want
    pbf.write_pbf(base, f"{tmp_path}/x.pbf")
    for seq in (1, 2):
        diffs.publish(changes.where(F.col("sequence") == seq), f"{tmp_path}/updates", seq, "2024-01-01T00:00:00Z")
    assert workflows.refresh_extract(spark, f"{tmp_path}/x.pbf", f"{tmp_path}/updates", f"{tmp_path}/y.pbf") == (2, len(want))
    assert {(r.osm_type, r.id) for r in pbf.read_pbf(spark, f"{tmp_path}/y.pbf").collect()} == set(want)


def test_regions_have_whole_ways(spark, tmp_path):
    box = lambda x, w: [(x, 0.0), (x + w, 0.0), (x + w, 1.0), (x, 1.0), (x, 0.0)]
    areas = spark.createDataFrame([("west", box(-0.5, 2.0)), ("east", box(6.5, 5.0)), ("none", box(50.0, 1.0))], f"region string, coords {overlay.RING}")
    got = {}
    for r in extracts.cut_regions(world(spark), areas).collect():
        got.setdefault(r.region, []).append((r.osm_type, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {"west": [("node", 0), ("node", 1), ("node", 2), ("relation", 5), ("way", 100)], "east": [("node", 7), ("node", 8), ("node", 9), ("relation", 6), ("way", 101)]}
    assert workflows.build_region_extracts(world(spark), areas, str(tmp_path)) == ["east", "none", "west"]
    assert pbf.read_pbf(spark, f"{tmp_path}/none-latest.osm.pbf").count() == 0 and pbf.read_pbf(spark, f"{tmp_path}/west-latest.osm.pbf").count() == 5


def test_an_analysis_runs_on_any_source(spark, tmp_path):
    pbf.write_pbf(world(spark), f"{tmp_path}/x.pbf")
    roads = workflows.run_on(spark, "major_roads", handles.Handle("pbf", f"{tmp_path}/x.pbf")).collect()
    assert [(r.feature_id, r.road_class, len(r.coords)) for r in roads] == [(100, "trunk", 3)] and roads[0].length_km > 200
    assert [r.feature_id for r in workflows.run_on(spark, "bicycle_routes", handles.Handle("pbf", f"{tmp_path}/x.pbf")).collect()] == [101]
    assert workflows.run_on(spark, "analyze_amenities", handles.Handle("pbf", f"{tmp_path}/x.pbf")).first().food == 5
    layer = handles.open_layer(spark, handles.Handle("pbf", f"{tmp_path}/x.pbf"), "amenities").select(F.col("feature_id").cast("string").alias("feature_id"), "osm_type", "tags", "gtype", "coords", "lon", "lat")
    pages.geojson.write_collection(layer, f"{tmp_path}/a.geojson")
    pages.geojson.write_lines(layer, f"{tmp_path}/lines")
    for kind, place in (("collection", "a.geojson"), ("geojson", "lines")):
        assert workflows.run_on(spark, "analyze_amenities", handles.Handle(kind, f"{tmp_path}/{place}")).first().food == 5
    world(spark).write.parquet(f"{tmp_path}/table")
    assert workflows.run_on(spark, "healthcare", handles.Handle("table", f"{tmp_path}/table")).count() == 0
    with pytest.raises(ValueError):
        handles.open_layer(spark, handles.Handle("fax", "x"), "roads")
    page = workflows.route_map(handles.open_layer(spark, handles.Handle("pbf", f"{tmp_path}/x.pbf"), "routes"), "bicycle", f"{tmp_path}/map")
    assert "Bicycle routes" in open(page).read() and len(json.loads((tmp_path / "map" / "layer0.geojson").read_text())["features"]) == 1


def test_pages_escape_and_list_regions(spark, tmp_path):
    rows = [("n1", "Point", {"<k>": "</script>"}, [(1.0, 2.0)], 1.0, 2.0, "A/b"), ("n2", "Point", {}, [(3.0, 4.0)], 3.0, 4.0, "C")]
    df = spark.createDataFrame(rows, f"feature_id string, gtype string, tags map<string,string>, coords {overlay.RING}, lon double, lat double, region string")
    pages.render_map({"</script>": df.drop("region")}, f"{tmp_path}/m", "<t>")
    text = (tmp_path / "m" / "index.html").read_text()
    assert "&lt;t&gt;" in text and "setView([3.0, 2.0]" in text and text.count("</script>") == 2
    assert pages.render_regions(df, f"{tmp_path}/r") == ["A-b", "C"] and "A/b" in (tmp_path / "r" / "index.html").read_text() and (tmp_path / "r" / "C" / "layer0.geojson").exists()


def test_atlas_matches_a_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    nodes = {i: (rng.uniform(0, 1), 50 + rng.uniform(0, 1)) for i in range(120)}
    pairs = {(min(i, j), max(i, j)) for i in nodes for j in sorted(nodes, key=lambda j: haversine_m(*nodes[i], *nodes[j]))[1:4]}
    edges = [(k, u, v, haversine_m(*nodes[u], *nodes[v]), 1.0) for k, (u, v) in enumerate(sorted(pairs))]
    nodes[900], nodes[901] = (5.0, 50.0), (5.01, 50.0)  # an island
    edges.append((900, 900, 901, haversine_m(*nodes[900], *nodes[901]), 1.0))
    places = [(i, f"r{i % 3}", rng.uniform(0, 1), 50 + rng.uniform(0, 1), rng.randrange(1, 200) * 1000) for i in range(30)] + [(50, "island", 5.0, 50.001, 90_000), (60, "empty", 0.5, 50.5, 10)]
    kinds = ["hospital", "fire_station", "police", "bench"]
    facilities = [(i, kinds[i % 4], rng.uniform(0, 1), 50 + rng.uniform(0, 1)) for i in range(40)]
    p = spark.createDataFrame([(i, r, x, y, {"place": "city", "population": str(n), "name": f"c{i}"}) for i, r, x, y, n in places], "feature_id long, region string, lon double, lat double, tags map<string,string>")
    a = spark.createDataFrame([(i, {"amenity": k}, x, y) for i, k, x, y in facilities], "feature_id long, tags map<string,string>, lon double, lat double")
    e = spark.createDataFrame([(u, v, w) for _, u, v, w, _ in edges], "u long, v long, length_m double")
    n = spark.createDataFrame([(i, *xy) for i, xy in nodes.items()], "node_id long, lon double, lat double")
    regions = spark.createDataFrame([(r,) for r in ("r0", "r1", "r2", "island", "empty", "unheard")], "region string")
    made = atlas.emergency_atlas(p, a, e, n, regions, max_cities=4, k=3, min_population=25_000)
    g = Graph(edges, nodes)
    near = lambda x, y: min(nodes, key=lambda i: (haversine_m(*nodes[i], x, y), i))
    scores = {}
    for region in ("r0", "r1", "r2", "island"):
        kept = []
        for i, r, x, y, people in sorted(places, key=lambda c: (-c[4], c[0])):
            if r == region and people >= 25_000 and all(haversine_m(x, y, b, c) > 5000 for _, b, c, _ in kept) and len(kept) < 4:
                kept.append((i, x, y, people))
        for i, x, y, _ in kept:
            parts = []
            for kind in kinds[:3]:
                some = sorted((haversine_m(x, y, b, c), f, b, c) for f, k, b, c in facilities if k == kind)[:3]
                ways = sorted(w[0] / 1000 for *_, b, c in some if (w := g.way(near(x, y), near(b, c))))
                parts.append(round(max(0.0, 100 * (1 - round(ways[0], 2) / 50)), 1) if ways else 0.0)
            scores[i] = sum(parts) / 3
    got = {r.city_id: r.score for r in made.cities.collect()}
    assert got.keys() == scores.keys() and all(abs(got[i] - s) <= 0.051 for i, s in scores.items())
    ranked = {r.region: (r["rank"], r.reason) for r in made.regions.collect()}
    assert {k for k, v in ranked.items() if v[0]} == {"r0", "r1", "r2"} and ranked["island"] == (None, "no routable major-road network") and ranked["empty"][1] == ranked["unheard"][1] == "no qualifying cities"
    assert {r.category: r.facilities for r in made.metrics.where("city_id = 50").collect()} == {"hospitals": 10, "fire": 10, "police": 10, "shelters": 0}
    page = pages.render_atlas(made.cities, made.regions, f"{tmp_path}/atlas", "Atlas", "km <by road>")
    assert "km &lt;by road&gt;" in open(page).read() and (tmp_path / "atlas" / "layer3.geojson").exists()
