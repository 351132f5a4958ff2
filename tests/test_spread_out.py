"""Operators that once went through one task or one cell: equal to their plain versions, and linear where places crowd."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from cartoframe.functions import geo as G
from cartoframe.operators import distance as D
from cartoframe.operators import network, ranking, spatial
from cartoframe.streaming import changes

PLACES = "feature_id long, g string, lon double, lat double, tags map<string,string>"


def haversine_km(x1, y1, x2, y2):
    a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(a)))


def greedy(rows, km, limit):
    out = {}
    for i, g, x, y, people in sorted(rows, key=lambda r: (-r[4], r[0])):
        own = out.setdefault(g, [])
        if all(haversine_km(x, y, a, b) > km for _, a, b in own):
            own.append((i, x, y))
    return sorted((g, i) for g, own in out.items() for i, *_ in own[:limit])


def test_spacing_in_rounds_is_the_pass_in_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.gauss(179.9, 0.15), 60 + rng.gauss(0, 0.1), rng.randrange(1000, 1040)) for i in range(400)]
    rows = [(i, g, (x + 180) % 360 - 180, y, p) for i, g, x, y, p in rows] + [(900 + k, "a", rng.uniform(-180, 180), rng.choice([89.99, -89.99, 0.0]), 2000 + k) for k in range(30)]
    df = spark.createDataFrame([(i, g, x, y, {"place": "town", "population": str(p)}) for i, g, x, y, p in rows], PLACES)
    for limit in (5, 10**6):
        want = greedy(rows, 5.0, limit)
        for one_task in (0, 150, 10**6):
            got = ranking.top_cities(df, limit, 1, "feature_id", "g", 5.0, one_task=one_task)
            assert sorted((r.g, r.feature_id) for r in got.collect()) == want
    pdf = pd.DataFrame([{"lon": x, "lat": y} for _, _, x, y, _ in rows])
    kept: list[int] = []
    for k, r in enumerate(rows):
        if all(haversine_km(r[2], r[3], rows[j][2], rows[j][3]) > 7.0 for j in kept):
            kept.append(k)
    assert list(ranking.spaced(pdf, 7.0).index) == kept


def test_nearest_among_crowds_meets_few(spark):
    """Nine in ten references stand in one square kilometre: a subject there meets the few around it."""
    rng = random.Random(6)
    refs = [(i, rng.uniform(10.0, 10.01), rng.uniform(50.0, 50.01)) for i in range(3600)] + [(5000 + i, rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(400)]
    subjects = [(i, rng.uniform(10.0, 10.01), rng.uniform(50.0, 50.01)) for i in range(150)] + [(500 + i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(50)] + [(900, None, 1.0)]
    s, r = spark.createDataFrame(subjects, "sid long, lon double, lat double"), spark.createDataFrame(refs, "rid long, lon double, lat double")
    for k in (1, 3):
        got = {}
        for row in D.k_nearest(s, r, k, "sid", "rid").collect():
            got.setdefault(row.sid, []).append((row["rank"], row.ref.rid))
        assert set(got) == {i for i, x, _ in subjects if x is not None}
        for i, x, y in subjects:
            if x is not None:
                near = sorted((haversine_km(x, y, a, b), n) for n, a, b in refs)[:k]
                assert sorted(got[i]) == [(j + 1, n) for j, (_, n) in enumerate(near)], i
    levels = {x.sid: x["__level"] for x in D._by_density(s.where("lon is not null"), r, 1, "sid").collect()}
    crowd = s.where("sid < 500").join(spark.createDataFrame(list(levels.items()), "sid long, z int"), "sid")
    pairs = sum(D.within(crowd.where(F.col("z") == z), r, D._levels()[z]).count() for z in set(levels.values()))
    assert pairs < 150 * 3600 / 10


def test_areas_of_all_sizes_meet_points_by_level(spark):
    rng = random.Random(8)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    areas = [(i, box(rng.uniform(-50, 50), rng.uniform(-50, 50), s, s * 0.7)) for i, s in enumerate([0.0005] * 40 + [0.3] * 40 + [7.0] * 20 + [100.0] * 2)]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(300)] + [(1000 + i, a[1][0][0] + 0.0002, a[1][0][1] + 0.0001) for i, a in enumerate(areas)]
    inside = lambda x, y, b: b[0][0] <= x < b[2][0] and b[0][1] <= y < b[2][1]
    want = {(i, a) for i, x, y in points for a, b in areas if inside(x, y, b)}
    p = spark.createDataFrame(points, "pid long, lon double, lat double")
    ring = "array<struct<lon:double,lat:double>>"
    found = spatial.matches(p, spark.createDataFrame(areas, f"aid long, coords {ring}"))
    assert {(r.pid, r.area.aid) for r in found.collect()} == want
    # with a hole, and in two parts
    holed = [(a, [b, box(b[0][0] + 0.25 * w, b[0][1] + 0.2 * w, 0.3 * w, 0.3 * w), box(b[0][0] + 200, b[0][1], 1.0, 1.0)]) for a, b in areas for w in [b[1][0] - b[0][0]]]
    want = {(i, a) for i, x, y in points for a, rs in holed if sum(inside(x, y, b) for b in rs) % 2}
    found = spatial.matches(p, spark.createDataFrame(holed, f"aid long, rings array<{ring}>"))
    assert {(r.pid, r.area.aid) for r in found.collect()} == want
    assert spatial.matches(p, spark.createDataFrame([], f"aid long, coords {ring}")).collect() == []


def test_gaps_between_neighbours(spark, monkeypatch):
    monkeypatch.setattr(changes, "RANGE", 10)
    for have in ([3, 4, 9, 9, 30, 31, 55], [7], [], [None, 2, 4], list(range(0, 100, 3)), [0, 10**4]):
        there = {x for x in have if x is not None}
        want = sorted(set(range(min(there), max(there))) - there) if there else []
        df = spark.createDataFrame([(x,) for x in have], "sequence long").repartition(3)
        assert sorted(r.sequence for r in changes.missing_sequences(df).collect()) == want


def test_hulls_of_large_groups_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in (1, 2) for _ in range(300)] + [(3, 0.0, 0.0)] * 5 + [(4, 0.0, 0.0), (4, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, lon double, lat double")
    whole = {r.k: r.hull for r in network.convex_hulls(df, "k").collect()}
    monkeypatch.setattr(network, "HULL_POINTS", 20)
    assert {r.k: r.hull for r in network.convex_hulls(df, "k").collect()} == whole and len(whole) == 4
    area = {r.k: r.a for r in network.convex_hulls(df, "k").select("k", G.planar_area(F.col("hull")).alias("a")).collect()}
    for k in (1, 2):
        pts = [(x, y) for g, x, y in rows if g == k]
        ring = [(p.lon, p.lat) for p in whole[k]]
        assert area[k] > 0 and set(ring) <= set(pts)
        for a, b in zip(ring, ring[1:]):  # noqa: B905
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-12 for x, y in pts)
