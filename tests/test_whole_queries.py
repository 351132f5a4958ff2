"""Queries without SQL run on whole tables: nothing is left out of their layers."""

import pytest
from pyspark.sql import functions as F

from cartoframe.functions import geo as G
from cartoframe.operators import network
from cartoframe.plans import layers, registry

SF = "/root/testdata/sf0.001"


def _km(spark):
    lines = layers.way_lines(spark, SF)
    return lines.agg(F.sum(G.line_length(F.col("coords")))).first()[0]


def test_logical_edges_hold_every_way(spark):
    got = registry.queries()["logical_edges"](spark, SF).agg(F.sum("length_m")).first()[0]
    assert got / 1000 == pytest.approx(_km(spark), rel=1e-4)


def test_cell_budgets_hold_every_way(spark):
    got = registry.queries()["cell_budgets"](spark, SF).groupBy("zoom").agg(F.sum("road_km").alias("km")).collect()
    assert got and all(r.km == pytest.approx(_km(spark), rel=1e-4) for r in got)


def test_every_motorway_is_selected(spark):
    want = layers.way_lines(spark, SF).join(layers.layer(spark, SF, "geo_way_tags").where("highway = 'motorway'"), "way_id")
    got = registry.queries()["select_edges"](spark, SF)
    assert {r.way_id for r in want.select("way_id").collect()} <= {r.edge_id for r in got.where("zoom = 4").collect()}


def test_simplify_takes_every_way(spark):
    assert registry.queries()["simplify"](spark, SF).count() == layers.way_lines(spark, SF).count()


@pytest.mark.parametrize("name, build, table", [("graph_validate", "build_by_nodes", "lineitem"), ("network_by_coordinates", "build_by_coordinates", "part")])
def test_networks_are_built_from_every_row(spark, monkeypatch, name, build, table):
    seen = []
    monkeypatch.setattr(network, build, lambda lines, *_: seen.append(lines.count()) or (_ for _ in ()).throw(StopAsyncIteration))
    with pytest.raises(StopAsyncIteration):
        registry.queries()[name](spark, SF)
    assert seen == [spark.read.parquet(f"{SF}/{table}.parquet").count()]


def test_crossings_far_from_the_ends_are_found(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 3.0)]), (2, [(0.0, 3.0), (5.0, 0.0)]), (3, [(2.5, -1.0), (2.5, 4.0)])], "line_id long, coords array<struct<lon: double, lat: double>>")
    edges, nodes = network.build_by_coordinates(lines, 10.0, 0.5)
    assert edges.count() == 6 and nodes.count() == 7
