"""Pairs of cities of which some share a name."""

from itertools import combinations

from cartoframe.operators import distance as D


def test_cities_of_one_name_get_links_of_their_own(spark):
    rows = [("Springfield", 50, 0.0, 0.0), ("Springfield", 40, 20.0, 0.0), ("Alton", 90, 1.0, 0.0), ("Boone", 10, 22.0, 0.0), ("Cairo", 5, 22.0, 3.0)]
    df = spark.createDataFrame(rows, "name string, population int, lon double, lat double").repartition(3)
    pairs = lambda mode: sorted((r.a, r.b) for r in D.plan_city_pairs(df, mode).collect())
    assert pairs("nearest") == [("Alton", "Springfield"), ("Boone", "Cairo"), ("Boone", "Springfield")]
    assert pairs("hub") == [("Alton", "Boone"), ("Alton", "Cairo"), ("Alton", "Springfield"), ("Alton", "Springfield")]
    assert pairs("all") == sorted(tuple(sorted((a[0], b[0]))) for a, b in combinations(rows, 2))
    twins = spark.createDataFrame([("Same", 2, 5.0, 5.0), ("Same", 1, 5.0, 6.0)], df.schema)
    assert [(r.a, r.b) for r in D.plan_city_pairs(twins).collect()] == [("Same", "Same")]
