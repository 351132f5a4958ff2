"""Geometry, joins and filters: laws, edge cases, brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cartoframe.functions import geo as G
from cartoframe.functions import parse as P
from cartoframe.functions.script import compile_script
from cartoframe.operators import aggregate as A
from cartoframe.operators import distance as D
from cartoframe.operators import filters as T
from cartoframe.operators import grid, ranking, spatial


def hav(a, b):
    (x1, y1), (x2, y2) = a, b
    p1, p2 = math.radians(y1), math.radians(y2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def world(spark):
    """Points all over the world, at the poles and on both sides of the date line."""
    rng = random.Random(1)
    pts = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(150)] + [(179.99, 10), (-179.99, 10), (0, 90), (90, 89.9), (-90, -90), (180, 0), (-180, 0)]
    refs = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(80)] + [(-179.95, 10.01), (120, 89.95), (0, -89.99)]
    s = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)] + [(900, None, 1.0), (901, None, None)], "feature_id long, lon double, lat double")
    r = spark.createDataFrame([(i, *map(float, p), f"r{i}") for i, p in enumerate(refs)] + [(99, None, None, "x")], "ref_id long, lon double, lat double, name string")
    return pts, refs, s, r


@pytest.mark.parametrize("km", [0.5, 120.0, 900.0, 4000.0, 15000.0])
def test_within_equals_brute_force_anywhere(world, km):
    pts, refs, s, r = world
    want = {(i, j) for i, p in enumerate(pts) for j, q in enumerate(refs) if hav(p, q) <= km}
    got = [(x.feature_id, x.r) for x in D.within(s, r, km).select("feature_id", F.col("ref.ref_id").alias("r")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_and_k_nearest_equal_brute_force(world):
    pts, refs, s, r = world
    order = {i: sorted(range(len(refs)), key=lambda j: (hav(p, refs[j]), j)) for i, p in enumerate(pts)}
    got = {(x.feature_id, x["rank"]): x.r for x in D.k_nearest(s, r, 3, "feature_id", "ref_id").select("feature_id", "rank", F.col("ref.ref_id").alias("r")).collect()}
    assert got == {(i, k + 1): order[i][k] for i in order for k in range(3)}
    assert D.k_nearest(s, r.limit(2), 5, "feature_id", "ref_id").count() in (len(pts), 2 * len(pts))


def test_within_and_beyond_partition_the_subjects(world):
    pts, _, s, r = world
    for km in (100, 1500):
        near = {x.feature_id for x in D.within_distance(s, r, km, key="feature_id", ref_order="ref_id").collect()}
        far = {x.feature_id for x in D.beyond_distance(s, r, km, key="feature_id").collect()}
        assert not near & far and near | far == {*range(len(pts)), 900, 901} and {900, 901} <= far


def test_empty_reference_and_no_cap(world):
    pts, _, s, r = world
    none = r.limit(0)
    assert D.within_distance(s, none, 10, key="feature_id", ref_order="ref_id").count() == 0
    assert D.beyond_distance(s, none, 10, key="feature_id").count() == len(pts) + 2
    assert D.beyond_distance(s, r, 0, key="feature_id").count() == 2
    assert D.within_distance(s, r, 0, key="feature_id", ref_order="ref_id").count() == len(pts)
    assert D.nearest_annotated(s, none, key="feature_id", ref_order="ref_id").count() == len(pts) + 2


def test_units():
    assert G.to_metres(2, " KM ") == 2000 and G.to_metres(1, "mi") == 1609.344
    with pytest.raises(ValueError):
        G.unit_factor("furlong")


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


def test_geometry_functions(spark):
    square = line((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    row = spark.range(1).select(
        G.planar_area(square).alias("area"), G.ring_centroid(square).alias("c"), G.line_length(line((0, 0), (0, 1), (0, 2))).alias("len"), G.line_length(line((0, 0))).alias("none"),
        G.line_centroid(line((0, 0), (4, 0))).alias("mid"), G.point_in_ring(F.lit(1.0), F.lit(1.0), square).alias("inside"), G.point_in_ring(F.lit(3.0), F.lit(1.0), square).alias("outside"),
        G.point_segment_m(F.lit(0.0), F.lit(1.0), F.struct(F.lit(-1.0).alias("lon"), F.lit(0.0).alias("lat")), F.struct(F.lit(1.0).alias("lon"), F.lit(0.0).alias("lat"))).alias("off"),
        F.size(G.densify(line((0, 0), (0, 1)), 10_000)).alias("dense"), G.is_closed(square).alias("closed"), G.planar_area(G.clip_to_bbox(square, F.lit(1.0), F.lit(-5.0), F.lit(9.0), F.lit(1.0))).alias("cut"), F.size(G.clip_to_bbox(square, F.lit(5.0), F.lit(5.0), F.lit(9.0), F.lit(9.0))).alias("gone"),
        G.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("null"),
    ).first()
    assert row.area == 4 and (row.c.lon, row.c.lat) == (1, 1) and (row.mid.lon, row.mid.lat) == (2, 0) and row.inside and not row.outside and row.closed
    assert row.len == pytest.approx(2 * hav((0, 0), (0, 1))) and row.none == 0 and row.off == pytest.approx(111_320, rel=1e-6) and row.dense == 13 and row.cut == 1 and row.gone == 0 and row.null is None


def test_buffer_is_round(spark):
    row = spark.range(1).select(G.point_buffer(F.lit(10.0), F.lit(50.0), F.lit(7.0), 24).alias("b")).first()
    assert len(row.b) == 25 and row.b[0] == row.b[-1]
    assert all(hav((10, 50), (p.lon, p.lat)) == pytest.approx(7, rel=1e-9) for p in row.b)


def test_parsers(spark):
    def run(f, values):
        return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v")).alias("x")).collect()]

    assert run(P.population, ["1234", "1,234", "1.234", "~1000", "≈ 5,000+", "12.5", "-7", "abc", "", None, "1.234.567"]) == [1234, 1234, 1234, 1000, 5000, 125, -7, None, None, None, 1234567]
    assert run(P.population_digits, ["12.5k", "x", None]) == [125, None, None]
    assert run(P.population_plain, ["1,234", "1.5", " 7 ", "x"]) == [1234, None, 7, None]
    assert run(P.speed_limit, ["65 mph", "100", "50 km/h", "30kmh", "signals", None, "49.9"]) == [104, 100, 50, 30, None, None, 49]
    assert run(P.height, ["12 m", "40ft", "x"]) == [12.0, 40.0, None]
    assert run(P.slug, ["Köln (Süd)", "  São Paulo!"]) == ["koeln-sued", "sao-paulo"]
    assert run(P.region_name, ["The Netherlands", "new-york", "New York"]) == ["netherlands", "newyork", "newyork"]
    assert run(P.tokens, ["A1; E40;;", ""]) == [["A1", "E40"], []]
    assert run(lambda c: P.replication_path(c.cast("long")), ["5090"]) == ["000/005/090"]
    assert run(P.state_text, ["#x\ntimestamp=2020-01-01T00\\:00\nsequenceNumber=5\njunk"]) == [{"timestamp": "2020-01-01T00:00", "sequenceNumber": "5"}]


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [(1, {"amenity": "cafe", "name": "Blue"}), (2, {"amenity": ""}), (3, {"shop": "x", "name": "RED"}), (4, {}), (5, None), (6, {"amenity": None, "place": "city", "population": "1,000"}), (7, {"boundary": "administrative", "admin_level": "2", "population": "x"})]
    return spark.createDataFrame(rows, "id long, tags map<string,string>")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_tag_filters(tagged):
    assert ids(tagged.where(T.has_tag("amenity"))) == [1, 2, 6] and ids(tagged.where(T.has_tag("amenity", "cafe"))) == [1]
    assert ids(tagged.where(T.tag_prefix("name", "B"))) == [1] and ids(tagged.where(T.tag_contains("name", "re"))) == [3] and ids(tagged.where(T.tag_contains("name", "re", True))) == []
    assert ids(tagged.where(T.tag_regex("name", "^[BR]"))) == [1, 3] and ids(tagged.where(T.minispec(""))) == list(range(1, 8)) and ids(tagged.where(T.minispec("amenity=cafe|name~ed"))) == [1, 3]
    with pytest.raises(Exception):
        T.tag_regex("name", "(")
    with pytest.raises(ValueError):
        T.minispec("nonsense")
    for bad in ("nwr", "", "x/amenity", "n/amenity=", "n/amenity cafe"):
        with pytest.raises(ValueError):
            T.parse_tag_query(bad)
    assert T.tag_query_key("n/a=2,1 w/b") == T.tag_query_key("w/b n/a=1,2") != T.tag_query_key("n/a")
    with pytest.raises(ValueError):
        T.osm_type(tagged, "thing")


def test_population_filters(tagged):
    assert [(r.id, r.population_value) for r in T.filter_by_population(tagged, "all", "gte", 0).collect()] == [(6, 1000)]
    assert ids(T.filter_by_population(tagged, "country", "ne", 5)) == [] and ids(T.filter_by_population(tagged, "city", "between", 1000, 1000)) == [6]
    with pytest.raises(ValueError):
        T.filter_by_population(tagged, "city", "between", 1)


def test_scripts_are_translated_not_run(tagged):
    assert ids(tagged.where(compile_script("has('amenity') and amenity != 'cafe'"))) == [2]
    assert ids(tagged.where(compile_script("num(population) / 0 > 1"))) == []
    assert ids(tagged.where(compile_script("name is not None and 2 < len(name) <= 3"))) == [3]
    for bad in ("__import__('os')", "(lambda: 1)()", "tags.items()", "[x for x in tags]", "open('x')", "a if b else c"):
        with pytest.raises(ValueError):
            compile_script(bad)


def test_summaries(spark):
    df = spark.createDataFrame([(1, {"k": "a", "v": "2"}), (2, {"k": "a", "v": "x"}), (3, {"v": "5"}), (4, {"k": None, "v": None})], "id long, tags map<string,string>")
    group = A.tag_group(F.col("tags"), "k")
    got = lambda op: {r.group: r.value for r in A.summarize(df, op, F.col("tags")["v"], group).collect()}
    assert got("avg") == {"a": 1.0, "": 5.0, "None": 0.0} and got("min") == {"a": 2.0, "": 5.0, "None": None} and got("count") == {"a": 2.0, "": 1.0, "None": 1.0}
    for bad in (("median", F.lit(1)), ("sum", None)):
        with pytest.raises(ValueError):
            A.summarize(df, *bad)
    with pytest.raises(ValueError):
        A.merge_layers(None)
    assert A.merge_layers(None, df, df).count() == 8


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "tags map<string,string>, category string, building_type string, area_m2 double, levels int, height double, park_type string, area_km2 double, feature_id long, road_class string, length_km double, maxspeed int, surface string, lanes int, oneway boolean, population_value long, exposure string, pm25 double, lon double, lat double")
    for f in (A.amenity_stats, A.building_stats, A.park_stats, A.road_stats, A.population_stats, A.exposure_stats):
        row = f(none).first().asDict()
        assert all(v in (0, 0.0, "mixed") for v in row.values()), row
    assert grid.heat_cells(none, 5.0).count() == 0 and grid.coverage(none, none).count() == 0


def test_spatial_join_shares_edges(spark):
    areas = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 2.0), (3, 0.5, 1.5)], "area_id long, a double, b double")
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("lon"), F.lit(float(y)).alias("lat"))
    areas = areas.withColumn("coords", F.array(p("a", 0), p("b", 0), p("b", 1), p("a", 1), p("a", 0))).drop("a", "b")
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 0.2, 0.2), (3, 9.0, 9.0), (4, None, None)], "id long, lon double, lat double")
    left = {r.id: (r.joined.area_id if r.joined else None, r.joined_count) for r in spatial.spatial_join(points, areas, key="id", order="area_id").collect()}
    assert left == {1: (2, 2), 2: (1, 1), 3: (None, 0), 4: (None, 0)}
    assert spatial.spatial_join(points, areas, key="id", order="area_id", how="inner").count() == 2


def test_kernels(spark):
    assert spatial.decode_polyline6("_izlhA~rlgdF_{geC~ywl@_kwzCn`{nI")[0] == (-120.2, 38.5)
    df = spark.createDataFrame([(1, [(0.0, 0.0), (0.00001, 1.0), (0.0, 2.0), (1.0, 2.0)]), (2, None), (3, [(0.0, 0.0)])], "id long, coords array<struct<lon:double,lat:double>>")
    assert {r.id: r.coords and len(r.coords) for r in spatial.simplify(df, 50.0).collect()} == {1: 3, 2: None, 3: 1}
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]), (2, [(8.0, 8.0), (9.0, 8.0), (9.0, 9.0), (8.0, 8.0)])], "id long, coords array<struct<lon:double,lat:double>>")
    cut = spatial.clip_convex(ring, [(1, -1), (5, -1), (5, 5), (1, 5), (1, -1)]).select("id", G.planar_area(F.col("coords")).alias("a")).collect()
    assert [(r.id, r.a) for r in cut] == [(1, 2.0)]


def test_spacing_and_tiers(spark):
    rows = [(1, 0.0, 0.0, {"place": "city", "population": "100,000", "name": "A"}), (2, 0.01, 0.0, {"place": "town", "population": "90000"}), (3, 1.0, 0.0, {"place": "City", "population": "50000", "name": "C"}), (4, 2.0, 0.0, {"place": "state", "population": "9000000"}), (5, 3.0, 0.0, {"place": "city", "population": "x"})]
    df = spark.createDataFrame(rows, "feature_id long, lon double, lat double, tags map<string,string>")
    assert [r.feature_id for r in ranking.top_cities(df, 10, 1000, "feature_id").orderBy("feature_id").collect()] == [1, 3]
    assert [r.feature_id for r in ranking.top_by_population(df, 3, "feature_id").collect()] == [4, 1, 2]
    assert ranking.top_by_population(df, -1, "feature_id").count() == 5
    t = ranking.tier_cities(df.withColumn("population_value", F.lit(10_000)))
    assert {r.zoom for r in t.collect()} == {10} and {r.zoom: r.n for r in ranking.split_tiers(t).collect()} == {3: 0, 6: 0, 8: 0, 10: 5}


def test_simplified_lines_match_a_recursive_version(spark):
    import math
    import random

    rng = random.Random(8)

    def plain(line, tolerance):
        if len(line) < 3:
            return line
        (ax, ay), (bx, by) = line[0], line[-1]
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        off = []
        for x, y in line[1:-1]:
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / n)) if n else 0.0
            off.append(math.hypot(x - ax - t * dx, y - ay - t * dy))
        far = max(range(len(off)), key=off.__getitem__)
        if off[far] <= tolerance:
            return [line[0], line[-1]]
        return plain(line[: far + 2], tolerance)[:-1] + plain(line[far + 1 :], tolerance)

    rows = [(i, [(rng.uniform(0, 3), 50 + rng.uniform(0, 2)) for _ in range(rng.randrange(2, 40))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, coords array<struct<lon:double,lat:double>>")
    for tolerance in (100.0, 20_000.0, 90_000.0):
        for r in spatial.simplify(df, tolerance).collect():
            line = rows[r.id][1]
            k = 111320.0 * math.cos(math.radians(sum(y for _, y in line) / len(line)))
            want = plain([(x * k, y * 111320.0) for x, y in line], tolerance) if len(line) > 2 else [(x * k, y * 111320.0) for x, y in line]
            assert [(round(p.lon * k, 3), round(p.lat * 111320.0, 3)) for p in r.coords] == [(round(x, 3), round(y, 3)) for x, y in want]
