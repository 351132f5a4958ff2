"""Rows at one place are searched for once, and no farther than they have to be."""

import pytest
from pyspark.sql import functions as F

from cartoframe.operators import distance as D
from cartoframe.operators import readiness


@pytest.fixture
def searched(monkeypatch):
    seen, within = [], D.within
    monkeypatch.setattr(D, "within", lambda s, r, km, *a, **k: seen.append((s.count(), km)) or within(s, r, km, *a, **k))
    return seen


def _at(spark, n, *columns):
    return spark.range(n).select(*columns, F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))


def test_nearest_with_a_cap(spark, searched):
    subjects = _at(spark, 50, F.col("id").alias("k")).union(spark.sql("select 99L, null, 2.0D"))
    refs = spark.range(20).select(F.col("id").alias("r"), (1.0 + F.col("id") / 1e5).alias("lon"), F.lit(2.0).alias("lat"))
    got = D.nearest(subjects, refs, "k", "r", 60).select("k", "ref.r", "distance_km").collect()
    assert sorted(map(tuple, got)) == [(k, 0, 0.0) for k in range(50)]
    assert sum(n for n, _ in searched) == 1 and max(km for n, km in searched if n) < 1


def test_metrics(spark, searched):
    cities = _at(spark, 50, F.col("id").alias("city_id"), F.when(F.col("id") > 0, 1000).alias("population"))
    got = readiness.metrics_within(cities, _at(spark, 3, F.lit("fire").alias("category")), 150).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(k, "fire", 0.0, 0.0, 3, 300.0 if k else None) for k in range(50)]
    assert sum(n for n, _ in searched) == 1
