"""Polygon operations against counted points, laws of area, and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoframe.functions import rings as R
from cartoframe.operators import overlay as O

RING = O.RING


def star(rng, x, y, r, n):
    t = sorted(rng.random() * 2 * math.pi for _ in range(n))
    ring = [(x + r * (0.4 + 0.6 * rng.random()) * math.cos(a), y + r * 0.8 * math.sin(a)) for a in t]
    return [*ring, ring[0]]


def inside(parts, pts):
    a, b, _ = R._edges([[np.array([(p["lon"], p["lat"]) for p in ring]) for part in parts for ring in part]])
    return R._inside(pts, a, b)


def plain(ring, pts):
    a, b, _ = R._edges([[np.array(ring)]])
    return R._inside(pts, a, b)


def layer(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, g string, coords {RING}")


def sample(rng, n=3000):
    return np.array([(rng.uniform(-1, 7), rng.uniform(49, 57)) for _ in range(n)])


def test_kernel_keeps_the_laws_of_area():
    rng = random.Random(2)
    for trial in range(30):
        a, b = ([np.array(star(rng, rng.uniform(0, 2), 50, 1.0, rng.randrange(3, 20)))] for _ in range(2))
        if trial % 3 == 0:
            a.append(a[0] * 0.3 + a[0].mean(0) * 0.7)
        if trial % 5 == 0:
            b = [x.copy() for x in a]
        one = lambda s: R.area(R.union([s]))
        assert R.area(R.union([a, b])) + R.area(R.intersection([a, b])) == pytest.approx(one(a) + one(b), abs=1e-7)
        assert R.area(R.difference(a, [b])) == pytest.approx(one(a) - R.area(R.intersection([a, b])), abs=1e-7)
    assert R.union([]) == [] and R.intersection([[], []]) == []
    box = lambda x, y, w: [np.array([(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)], float)]
    joined = R.union([box(0, 0, 1), box(1, 0, 1), box(0, 1, 1), box(5, 5, 1)])
    assert len(joined) == 2 and R.area(joined) == pytest.approx(4) and min(len(p[0]) for p in joined) == 5
    frame = R.difference(box(0, 0, 3), [box(1, 1, 1)])
    assert len(frame) == 1 and len(frame[0]) == 2 and R.area(frame) == pytest.approx(8)


def test_pairs_clips_and_rests(spark):
    rng = random.Random(5)
    a = [(i, "a", star(rng, rng.uniform(0, 6), rng.uniform(50, 56), rng.choice([0.01, 0.5, 2.0]), 12)) for i in range(25)]
    b = [(i, "b", star(rng, rng.uniform(0, 6), rng.uniform(50, 56), rng.choice([0.02, 0.4, 3.0]), 9)) for i in range(25)]
    left, right, pts = layer(spark, a, "i"), layer(spark, b, "j"), sample(rng)
    got = O.intersect(left, right).collect()
    want = {(x[0], y[0]) for x in a for y in b if R.area(R.intersection([[np.array(x[2])], [np.array(y[2])]])) > 1e-12}
    assert sorted((r.a.i, r.b.j) for r in got) == sorted(want)
    for r in got:
        assert (inside(r.parts, pts) == (plain(a[r.a.i][2], pts) & plain(b[r.b.j][2], pts))).all()
    rest = {r.i: r.parts for r in O.difference(left, right, "i").collect()}
    gone = np.stack([plain(y[2], pts) for y in b]).any(0)
    for x in a:
        here = plain(x[2], pts) & ~gone
        assert (inside(rest[x[0]], pts) == here).all() if x[0] in rest else not here.any()
    window = [[[(1, 51), (5, 51), (5, 55), (3, 53), (1, 55), (1, 51)], [(2, 51.5), (3, 51.5), (3, 52), (2, 51.5)]]]
    for r in O.clip(left, window).collect():
        assert (inside(r.parts, pts) == (plain(a[r.i][2], pts) & (plain(window[0][0], pts) ^ plain(window[0][1], pts)))).all()
    assert O.intersect(left.limit(0), right).collect() == []


def test_dissolve_and_union(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("xyz"), star(rng, rng.uniform(0, 6), rng.uniform(50, 56), 0.9, 10)) for i in range(40)] + [(90, "x", None), (91, None, star(rng, 1, 51, 1, 5))]
    df, pts = layer(spark, rows, "i"), sample(rng)
    got = {r.group: r for r in O.dissolve(df, F.col("g")).collect()}
    assert {g: r.dissolved_count for g, r in got.items()} == {g: sum(x[1] == g and x[2] is not None for x in rows) for g in {x[1] for x in rows}}
    for g, r in got.items():
        assert (inside(r.parts, pts) == np.stack([plain(x[2], pts) for x in rows if x[1] == g and x[2]]).any(0)).all()
    every = O.union_layers(df.where("i < 20"), df.where("i >= 20")).collect()[0]
    assert every.merged_count == 41 and (inside(every.parts, pts) == np.stack([plain(x[2], pts) for x in rows if x[2]]).any(0)).all()


def test_buffers_of_points_lines_and_areas(spark):
    rng = random.Random(9)
    line = [(x / 10, 50 + rng.uniform(0, 0.5)) for x in range(12)]
    ring = star(rng, 0.5, 50.2, 0.4, 9)
    rows = [(1, "Point", [(0.5, 50.0)]), (2, "LineString", line), (3, "Polygon", ring), (4, "MultiPoint", line[::4]), (5, "LineString", None), (6, None, ring)]
    got = {r.i: r.buffer for r in O.buffer(spark.createDataFrame(rows, f"i long, gtype string, coords {RING}"), 9.0, "km").collect()}
    assert got[5] is None and O.area_km2 is not None
    for i, kind, coords in rows:
        if coords is None:
            continue
        xy = np.array(coords)
        middle = (xy.min(0) + xy.max(0)) / 2
        scale = np.array([111320.0 * math.cos(math.radians(middle[1])), 111320.0])
        pts = np.array([(rng.uniform(-0.3, 1.5), rng.uniform(49.7, 50.9)) for _ in range(2500)])
        p, d = (pts - middle) * scale, np.full(len(pts), np.inf)
        flat = (xy - middle) * scale
        for a, b in [(q, q) for q in flat] if kind == "MultiPoint" or len(flat) == 1 else zip(flat[:-1], flat[1:]):  # noqa: B905
            v = b - a
            t = np.clip((p - a) @ v / (v @ v), 0, 1) if v @ v else np.zeros(len(p))
            d = np.minimum(d, np.hypot(*(p - a - t[:, None] * v).T))
        if i in (3, 6):
            d[plain(coords, pts)] = 0
        now = inside(got[i], pts)
        assert not (now & (d > 9000.001)).any() and not (~now & (d < 9000 * math.cos(math.pi / 32) - 0.001)).any() and now.any() and not now.all()
    with pytest.raises(ValueError):
        O.buffer(spark.createDataFrame(rows, f"i long, gtype string, coords {RING}"), 0)


def test_simplified_areas_stay_valid(spark):
    rng = random.Random(1)
    rows = []
    for i in range(30):  # combs: plain simplification lets their teeth cross
        n, top = 40, []
        for k in range(n):
            top += [(k / n, 1 + 0.02 * (k % 2) + 0.001 * rng.random()), ((k + 0.9) / n, 1.02 * rng.random() + 0.1 if k % 5 == 0 else 1.0)]
        rows.append((i, "g", [(0.0, 0.0), (1.0, 0.0), *reversed(top), (0.0, 0.0)]))
    df = layer(spark, [r for r in rows if not R.crosses_itself(np.array(r[2]))], "i")
    n = df.count()
    got = O.simplify(df, 20_000.0).collect()
    assert n > 5 and len(got) == n
    for r in got:
        ring = [(p.lon, p.lat) for p in r.parts[0][0]]
        assert not R.crosses_itself(np.array(ring)) and ring[0] == ring[-1] and set(ring) <= set(map(tuple, rows[r.i][2]))
    assert sum(len(r.parts[0][0]) for r in got) < sum(len(x[2]) for x in rows if x[0] in {r.i for r in got}) / 2
    assert R.crosses_itself(np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], float)) and not R.crosses_itself(np.array([(0, 0), (1, 0), (1, 1), (0, 0)], float))
