"""Networks, quality, feeds, sources, catalog, streams, and the registered queries."""

import os
import random
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cartoframe.operators import catalog, history, importance, network, quality, readiness, transit, ways
from cartoframe.operators.graph import connected_components
from cartoframe.plans import layers, registry
from cartoframe.sources import geojson, pbf, tables
from cartoframe.streaming import changes as CH

SF = "/root/testdata/sf0.001"


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _network(spark):
    nodes = spark.createDataFrame([(i, i * 0.01, 0.0) for i in range(6)] + [(9, 5.0, 5.0), (10, 5.01, 5.0)], "node_id long, lon double, lat double")
    refs = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 2), (2, 2, 4), (2, 3, 5), (3, 1, 9), (3, 2, 10), (4, 1, 0), (4, 2, 77), (4, 3, 3)], "way_id long, pos long, node_id long")
    return refs, nodes


def test_network_contracts_and_routes(spark):
    refs, nodes = _network(spark)
    e = {(r.u, r.v): r.length_m for r in network.build_by_nodes(refs, nodes).collect()}
    assert set(e) == {(0, 2), (2, 3), (2, 5), (0, 3), (9, 10)} and e[0, 2] == pytest.approx(2 * e[2, 3], rel=1e-9)
    edges = network.build_by_nodes(refs, nodes)
    for sent in (0, 1000):
        d = {r.node: (r.cost, r.path) for r in network.shortest_paths(edges, spark.createDataFrame([(0,)], "source long"), paths=True, sent_edges=sent).collect()}
        assert set(d) == {0, 2, 3, 5} and d[5][1] == [0, 2, 5] and d[5][0] == pytest.approx(5 * e[2, 3], rel=1e-9)
        near = network.shortest_paths(edges, spark.createDataFrame([(0,)], "source long"), cutoff=e[0, 2] * 1.01, sent_edges=sent)
        assert {r.node for r in near.collect()} == {0, 2}
    row = network.approx_route(edges, nodes, (0.0, 0.0), (5.0, 5.0)).first()
    assert not row.reached_b and row.distance_km >= 0 and row.path[-1] == 5
    assert network.approx_route(edges.limit(0), nodes.limit(0), (0, 0), (1, 1)).first().distance_km == -1
    s = network.component_summary(edges).first()
    assert (s.components, s.nodes, s.largest) == (2, 6, 4)
    with pytest.raises(ValueError):
        network.route_matrix(nodes.where("node_id = 0").withColumnRenamed("node_id", "point_id"), edges, nodes)


def test_network_by_coordinates(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (0.02, 0.02)]), (2, [(0.0, 0.02), (0.02, 0.0)]), (3, [(0.02, 0.0), (0.05, 0.0)]), (4, [(1.0, 1.0), (1.01, 1.0)])], "line_id long, coords array<struct<lon:double,lat:double>>")
    edges, nodes = network.build_by_coordinates(lines)
    assert edges.count() == 6 and nodes.count() == 8
    assert network.component_summary(edges).first().components == 2


def test_quality_counts(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {"shop": "x"}), (1, 1.0, 1.0, {}), (2, 200.0, 1.0, {"a": ""}), (3, None, None, None)], "id long, lon double, lat double, tags map<string,string>")
    w = spark.createDataFrame([(1, [1], {}), (2, [1, 2], {"building": "yes", "name": "n"}), (3, [1, 8, 9], None), (4, None, {})], "id long, node_refs array<long>, tags map<string,string>")
    r = spark.createDataFrame([(1, [("node", 1, ""), ("way", 7, "")], {"name": "x"})], "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    got = sorted((x.issue_type, x.level, x.element_type, x.element_id) for x in quality.verify_all(nodes, w, r).collect())
    assert got == sorted([("duplicate", 1, "node", 1), ("coordinate", 1, "node", 1), ("coordinate", 1, "node", 2), ("coordinate", 1, "node", 3), ("geometry", 1, "way", 1), ("geometry", 1, "way", 4), ("geometry", 2, "way", 2), ("reference", 1, "way", 3), ("reference", 1, "relation", 1), ("tag", 2, "node", 1), ("tag", 3, "node", 2)])
    s = quality.summary(quality.verify_all(nodes, w, r)).first()
    assert s.total_issues == len(got) and s.reference_issues == 2
    assert quality.summary(quality.verify_all(nodes.limit(0), w.limit(0))).first().total_issues == 0
    old = spark.createDataFrame([("a", "2019-01-01 00:00:00")], "name string, made_at string")
    now = F.lit("2019-01-05").cast("timestamp")
    assert quality.require_fresh(old, 10, now).count() == 1
    with pytest.raises(Exception, match="stale"):
        quality.require_fresh(old, 2, now).collect()


def test_transit_feed_files(spark, tmp_path):
    files = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type\nA,a,1.0,1.0,\nB,b,1.0,1.01,0\nC,c,0,0,\nD,d,2,2,1\nE,e,x,2,\n",
        "routes": "route_id,route_short_name,route_type\nr1,1,3\nr2,2,\nr3,3,99\n",
        "trips": "trip_id,route_id,service_id\nt1,r1,on\nt2,r1,off\nt3,r2,unknown\nt4,r1,\n",
        "stop_times": "trip_id,stop_id,stop_sequence\nt1,A,2\nt1,B,1\nt2,A,1\nt3,A,1\nt3,A,2\nt4,B,1\nt1,ZZ,3\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date\non,1,0,0,0,0,0,0,20200101\noff,0,0,0,0,0,0,0,20200101\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    feed = tables.read_feed(spark, str(tmp_path))
    assert {r.stop_id for r in transit.stops(feed).collect()} == {"A", "B"}
    assert {r.stop_id: r.trips_per_day for r in transit.frequency(feed).collect()} == {"A": 1, "B": 2}
    lines = {r.route_id: (r.point_count, r.route_type_label) for r in transit.route_lines(feed).collect()}
    assert lines == {"r1": (2, "Bus"), "r2": (2, "Bus")}
    assert transit.statistics(feed).first().routes_by_type == "Bus: 2, Type 99: 1"
    assert transit.report(feed).first().routes_with_lines == 2
    (tmp_path / "trips.txt").unlink()
    with pytest.raises(FileNotFoundError):
        tables.read_feed(spark, str(tmp_path))


def test_history_windows(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'2020-01-01', timestamp_ntz'2021-01-01', 'CREATION', map('a', '1')), (1, timestamp_ntz'2021-01-01', null, 'TAG', map()) t(osm_id, valid_from, valid_to, contrib_type, tags)")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert [history.as_of(df, at(d)).count() for d in ("2019-01-01", "2020-01-01", "2020-12-31", "2021-01-01", "2030-01-01")] == [0, 1, 1, 1, 1]
    assert history.changes(df, at("2020-01-01"), at("2021-01-01")).count() == 1 and history.changes(df, at("2020-01-01"), None, ("TAG",)).count() == 1 and history.changes(df, None, at("2030-01-01"), tag_key="a").count() == 1
    with pytest.raises(ValueError):
        history.window(df, None, None)
    with pytest.raises(ValueError):
        history.changes(df, at("2020-01-01"), None, ("OTHER",))


def test_geojson_round_trip(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","id":"n1","properties":{"amenity":"cafe","n":3,"x":null},"geometry":{"type":"Point","coordinates":[1.5,2.5]}},{"type":"Feature","properties":{},"geometry":null},{"type":"Feature","id":"w","properties":{"a":"\\"q\\""},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":"bad"}}]}'
    (tmp_path / "a.geojson").write_text(text)
    layer = geojson.read_collection(spark, str(tmp_path / "a.geojson"))
    rows = layer.collect()
    assert [r.gtype for r in rows] == ["Point", None, "Polygon", "LineString"] and rows[0].tags == {"amenity": "cafe", "n": "3", "x": None} and (rows[0].lon, rows[0].lat) == (1.5, 2.5) and rows[3].coords is None and len(rows[2].coords) == 4
    geojson.write_lines(layer, str(tmp_path / "lines"))
    again = geojson.read_lines(spark, str(tmp_path / "lines")).collect()
    key = lambda r: (str(r.feature_id), str(r.coords and r.gtype), str(r.tags), str(r.coords))
    assert sorted(map(key, again)) == sorted(map(key, rows))
    geojson.write_collection(layer, str(tmp_path / "one"))
    assert geojson.read_collection(spark, str(tmp_path / "one")).count() == 4


def _message(*parts):
    """(number, value) pairs as a message: integers as varints, bytes as lengths."""
    def varint(n):
        out = b""
        n &= (1 << 64) - 1
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(varint(k << 3 | (2 if isinstance(v, bytes) else 0)) + (varint(len(v)) + v if isinstance(v, bytes) else varint(v)) for k, v in parts)


def _list(values, signed=False, delta=False):
    if delta:
        values = [b - a for a, b in zip([0, *values], values, strict=False)]
    return b"".join(_message((0, v << 1 ^ (v >> 63) if signed else v))[1:] for v in values)


def test_pbf_elements(spark, tmp_path):
    strings = _message(*[(1, s) for s in (b"", b"amenity", b"cafe", b"name", "Zoë".encode(), b"outer")])
    dense = _message((1, _list([5, 7, 9000000000], True, True)), (8, _list([100000000, 200000000, -300000000], True, True)), (9, _list([10, 20, 30], True, True)), (10, _list([1, 2, 3, 4, 0, 0, 1, 2, 0])))
    way = _message((1, 44), (2, _list([3])), (3, _list([4])), (8, _list([5, 7, 5], True, True)))
    rel = _message((1, 55), (8, _list([5, 0])), (9, _list([44, 7], True, True)), (10, _list([1, 0])))
    block = _message((1, strings), (2, _message((2, dense))), (2, _message((3, way), (4, rel))))
    out = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", block), (b"OSMData", _message((1, strings)))):
        blob = _message((2, len(data)), (3, zlib.compress(data)))
        head = _message((1, kind), (3, len(blob)))
        out += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.osm.pbf").write_bytes(out)
    df = pbf.read_pbf(spark, str(tmp_path / "x.osm.pbf"))
    by = {(r.osm_type, r.id): r for r in df.collect()}
    assert set(by) == {("node", 5), ("node", 7), ("node", 9000000000), ("way", 44), ("relation", 55)}
    n = by["node", 5]
    assert n.tags == {"amenity": "cafe", "name": "Zoë"} and n.lat == pytest.approx(10.0) and by["node", 9000000000].lat == pytest.approx(-30.0) and by["node", 7].tags == {}
    assert by["way", 44].node_refs == [5, 7, 5] and [(m.type, m.ref, m.role) for m in by["relation", 55].members] == [("way", 44, "outer"), ("node", 7, "")]
    assert [(r.id, r.category) for r in pbf.categorised(df).orderBy("id").collect()] == [(5, "food"), (9000000000, "food")]
    (tmp_path / "bad.pbf").write_bytes(b"\x00\x00\x00\x05junk!")
    with pytest.raises(Exception):
        pbf.read_pbf(spark, str(tmp_path / "bad.pbf")).collect()


def test_themed_and_relational_sources(spark, tmp_path):
    rows = spark.sql("select 'a' id, named_struct('primary', 'cafe') categories, named_struct('primary', 'Blue') names, named_struct('xmin', 1D, 'xmax', 2D, 'ymin', 1D, 'ymax', 2D) bbox union all select 'b', named_struct('primary', 'bar'), null, named_struct('xmin', 8D, 'xmax', 9D, 'ymin', 8D, 'ymax', 9D)")
    rows.write.parquet(f"{tmp_path}/theme=places/type=place")
    got = tables.read_themed(spark, str(tmp_path), "amenities", (0, 0, 3, 3)).collect()
    assert [(r.id, r.tags, r.lon) for r in got] == [("a", {"amenity": "cafe", "name": "Blue"}, 1.5)]
    with pytest.raises(Exception):
        tables.read_themed(spark, str(tmp_path), "buildings")
    assert "region = 'o''brien'" in tables.relational_query("roads", "o'brien") and "tags ? 'highway'" in tables.relational_query("roads", "x")
    with pytest.raises(ValueError):
        tables.relational_query("roads", "x", "t; drop table y")
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, o int")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"], "o").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_tag_index_follows_a_feed(spark, tmp_path):
    schema = "sequence long, seq_pos long, osm_id long, op string, kind string"
    index = CH.TagIndex(spark, f"{tmp_path}/index", "osm_id long, kind string", F.col("kind") == "cafe")
    assert index.read().count() == 0 and index.sequence is None
    index.rebuild(spark.createDataFrame([(1, "cafe"), (2, "cafe"), (2, "cafe"), (3, "bar")], "osm_id long, kind string"), 10)
    feed = [(11, 1, 1, "upsert", "bar"), (11, 2, 3, "upsert", "cafe"), (11, 3, 4, "upsert", "cafe"), (12, 1, 4, "delete", None), (12, 2, 2, "upsert", "cafe")]
    index.update(spark.createDataFrame(feed, schema))
    state = lambda: sorted(r.osm_id for r in index.read().collect())
    assert state() == [2, 3] and index.sequence == 12
    assert not index.update(spark.createDataFrame(feed, schema)) and state() == [2, 3]
    with pytest.raises(ValueError, match="gap"):
        index.update(spark.createDataFrame([(14, 1, 9, "upsert", "cafe")], schema))
    spark.createDataFrame([(13, 1, 9, "upsert", "cafe")], schema).write.parquet(f"{tmp_path}/feed")
    q = index.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/feed"), f"{tmp_path}/checkpoint")
    q.awaitTermination()
    assert state() == [2, 3, 9] and index.sequence == 13


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {(r.start, r.event_type): r.n for r in CH.windowed(events, "1 hour").collect()}
    os.makedirs(f"{tmp_path}/in")
    os.symlink(f"{SF}/events.parquet", f"{tmp_path}/in/events.parquet")
    stream = CH.windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "1 hour", late="400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert {(r.start, r.event_type): r.n for r in spark.table("windows").collect()} == want


def test_catalog_and_readiness(spark):
    regions = catalog.with_path_parts(spark.createDataFrame([("Europe", "europe"), ("Georgia", "asia/georgia"), ("Georgia", "north-america/us/georgia"), ("US", "north-america/us")], "name string, path string"))
    q = spark.createDataFrame([("georgia",), ("the u-s",), ("states",), ("nope",)], "query string")
    alias = spark.createDataFrame([("states", "US")], "alias string, name string")
    got = sorted((r.query, r.path or "", r.how, r.n) for r in catalog.resolve(q, regions, alias).collect())
    assert got == [("georgia", "asia/georgia", "direct", 2), ("georgia", "north-america/us/georgia", "direct", 2), ("nope", "", "unknown", 0), ("states", "north-america/us", "alias", 1), ("the u-s", "north-america/us", "direct", 1)]
    with pytest.raises(Exception, match="ambiguous"):
        catalog.resolve(q, regions, alias, strict=True).collect()
    assert [r.path for r in catalog.subregion_leaves(regions, "north-america").collect()] == ["north-america/us/georgia"]
    ranked = readiness.rank_regions(spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 9.0)], "region string, score double"), spark.createDataFrame([("z", "Empty network!")], "region string, error string"))
    assert [(r.region, r["rank"]) for r in ranked.orderBy(F.asc_nulls_last("rank")).collect()] == [("c", 1), ("a", 2), ("b", 3), ("z", None)]
    m = spark.createDataFrame([(1, "fire", 60.0), (1, "fire", 10.0), (1, "police", -1.0)], "city_id long, category string, km double")
    c = readiness.component(readiness.category_metrics(m, spark.createDataFrame([(1, 0)], "city_id long, population long")))
    assert {r.category: (r.nearest_km, r.median_km, r.component) for r in c.collect()} == {"fire": (10.0, 60.0, 80.0), "police": (None, None, 0.0)}
    assert readiness.city_scores(c).first().score == 40.0


def test_importance_reveals_monotonically(spark):
    edges = spark.createDataFrame([(1, 1.0, True, False, "A"), (2, 0.45, False, False, ""), (3, 0.02, False, True, None)], "edge_id long, fc_score double, bridge boolean, tunnel boolean, ref string")
    s = importance.edge_scores(edges, spark.createDataFrame([(2, 5, 1.0)], "edge_id long, zoom int, sb double"))
    by = {(r.edge_id, r.zoom): r.score for r in s.collect()}
    assert by[1, 2] == pytest.approx(0.33) and by[2, 5] == pytest.approx(0.6 + 0.4 * 0.45) and all(0 <= v <= 1.2 for v in by.values())
    shown = [r.edges for r in importance.cumulative(s.where("score > 0.3")).orderBy("zoom").collect()]
    assert shown == sorted(shown) and shown[-1] == 2
    w = spark.createDataFrame([(i, 2, i) for i in range(100)], "edge_id long, zoom int, votes long")
    assert importance.normalised_votes(w).agg(F.max("sb"), F.min("sb")).first()[:] == (1.0, 0.0)


def test_ways(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0), (4, None, 2.0)], "node_id long, lon double, lat double")
    refs = spark.createDataFrame([(1, 2, 2), (1, 1, 1), (1, 3, 3), (1, 4, 1), (2, 1, 1), (2, 2, 99), (3, 1, 4), (3, 2, 2), (3, 3, 3)], "way_id long, pos long, node_id long")
    got = {r.way_id: [(p.lon, p.lat) for p in r.coords] for r in ways.assemble(refs, nodes).collect()}
    assert got == {1: [(0, 0), (1, 0), (1, 1), (0, 0)], 3: [(1, 0), (1, 1)]}
    p = ways.elevation_profile(spark.createDataFrame([(1, 1, 10.0), (1, 2, 30.0), (1, 3, 20.0), (1, 4, None), (2, 1, 5.0)], "way_id long, pos long, elevation double"), feet=False)
    assert {r.way_id: (r.min_elevation, r.max_elevation, r.gain, r.loss) for r in p.collect()} == {1: (10, 30, 20, 10), 2: (5, 5, 0, 0)}


def _rows(cursor_rows):
    return sorted(str([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in cursor_rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    if name == "require_fresh" and not con.sql("select 1 from orders where o_orderdate > timestamp '1997-01-01'").fetchall():
        pytest.skip("no such orders at this size")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert _rows([r[c] for c in columns] for r in got.collect()) == _rows([r[i] for i in order] for r in want.fetchall())


def test_every_query_runs(spark):
    missing = set(registry.queries()) - set(registry.oracle_sql())
    for name in missing:
        assert registry.queries()[name](spark, SF).columns
    assert registry.flagship(spark, SF).count() > 0
    assert layers.layer(spark, SF, "geo_points").count() > 0
