"""Categories, graph tables, composed analyses."""

import pytest
from pyspark.sql import functions as F

from cartoframe.operators import graph_store, quality
from cartoframe.plans import workflows
from cartoframe.sources import categories, geojson, tables


@pytest.fixture(scope="module")
def elements(spark):
    rows = [(1, "node", {"amenity": "cafe", "name": "A"}), (2, "node", {"place": "city", "population": "70,000"}), (3, "way", {"highway": "trunk_link"}), (4, "way", {"building": "yes", "shop": "x"}), (5, "way", {"amenity": "cafe"}), (6, "relation", {"route": "mtb", "network": "LCN"}), (7, "node", None), (8, "way", {"leisure": "nature_reserve", "designation": "State Park"}), (9, "relation", {"boundary": "administrative", "admin_level": "4"})]
    return spark.createDataFrame(rows, "id long, osm_type string, tags map<string,string>")


def test_one_scan_serves_all_categories(elements):
    got = {(r.id, r.category, r["class"]) for r in categories.scan(elements).collect()}
    assert got == {(1, "amenities", "food"), (1, "pois", "cafe"), (2, "population", "city"), (3, "roads", "trunk"), (4, "buildings", "retail"), (6, "routes", "bicycle"), (8, "parks", "state"), (9, "boundaries", "admin_4")}
    for name in categories.CATEGORIES:
        assert {(r.id, name, r["class"]) for r in categories.load(elements, name).collect()} == {x for x in got if x[1] == name}
    assert {r.category: r.features for r in categories.manifest(categories.scan(elements, ("roads",))).collect()} == {"roads": 1}
    with pytest.raises(ValueError):
        categories.load(elements, "rivers")


def test_places_and_points_of_interest(elements):
    assert [(r.id, r.population_value) for r in categories.places(elements, "city").collect()] == [(2, 70000)]
    assert categories.poi(elements, "hospitals").count() == 0 and categories.poi(elements, "cities").count() == 1
    modes = {r["mode"]: r.routes for r in workflows.transport_overview(elements).collect()}
    assert modes == {"bicycle": 1}
    assert workflows.state_boundaries_with_stats(elements).first().boundaries == 1
    assert workflows.large_cities(elements, 50_000).count() == 1 and workflows.large_cities(elements, 80_000).count() == 0
    assert workflows.analyze_parks(elements.withColumn("area_km2", F.lit(2.0)).withColumn("feature_id", F.col("id")).where("id = 8")).first().state_parks == 1


def test_export_is_refused_before_it_writes(spark, tmp_path):
    layer = spark.createDataFrame([("a", None, {"k": "v"}, "Point", [(1.0, 2.0)])], "feature_id string, osm_type string, tags map<string,string>, gtype string, coords array<struct<lon:double,lat:double>>")
    with pytest.raises(ValueError):
        categories.export(layer, f"{tmp_path}/no", 0)
    assert not (tmp_path / "no").exists()
    assert categories.export(layer, f"{tmp_path}/yes", 5) == 1 and geojson.read_lines(spark, f"{tmp_path}/yes").first().tags == {"k": "v"}


def test_graph_tables(spark, tmp_path):
    nodes = spark.createDataFrame([(i, i * 0.01, 0.0) for i in range(5)], "node_id long, lon double, lat double")
    refs = spark.createDataFrame([(1, k, k) for k in range(4)], "way_id long, pos long, node_id long")
    graph_store.build(refs, nodes, str(tmp_path), "foot")
    edges, used = graph_store.load(spark, str(tmp_path), "foot")
    row = graph_store.validate(edges, used).first()
    assert (row.edges, row.nodes, row.lost_nodes, row.loops, row.without_length) == (1, 2, 0, 0, 0)
    assert graph_store.validate(edges, used.limit(1)).first().lost_nodes == 1
    assert graph_store.clean(spark, str(tmp_path), "foot") and not graph_store.clean(spark, str(tmp_path), "foot")
    with pytest.raises(Exception):
        graph_store.load(spark, str(tmp_path), "foot")


def test_datasets_are_replaced_one_by_one(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "feature_id long, v string")
    path = f"{tmp_path}/store"
    assert tables.import_dataset(spark, rows(1, 2, 2), path, "a") == 2 and tables.import_dataset(spark, rows(5), path, "b") == 1 and tables.import_dataset(spark, rows(3), path, "a") == 1
    assert {(r.dataset_key, r.feature_id) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 5)}
    page = tables.summary_page("<t>", rows(1))
    assert "&lt;t&gt;" in page and "<td>x</td>" in page


def test_layer_rules(spark):
    layer = spark.createDataFrame([(1, {"a": "b"}, "Point", [(1.0, 2.0)]), (2, {}, None, None), (3, {"a": "b"}, "Polygon", [(0.0, 0.0), (1.0, 1.0)]), (4, {"a": "b"}, "Point", [(500.0, 2.0)])], "feature_id long, tags map<string,string>, gtype string, coords array<struct<lon:double,lat:double>>")
    got = sorted((r.element_id, r.message) for r in quality.verify_layer(layer).collect())
    assert got == [(2, "Empty properties"), (2, "Missing geometry"), (3, "Invalid geometry structure"), (4, "Coordinates out of range")]
    row = quality.tag_coverage(layer).first()
    assert (row.elements, row.tag_coverage_pct, row.avg_tags) == (4, 75.0, 0.75)
