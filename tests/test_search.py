"""Searches in arrays against a plain heap; networks larger than what is sent, by components."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from cartoframe.operators import graph, network, search


def plain(edges, start, cutoff=None):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    done, best, heap = {}, {start: (0.0, (start,))}, [(0.0, (start,))]
    while heap:
        d, path = heapq.heappop(heap)
        if path[-1] in done:
            continue
        done[path[-1]] = (d, list(path))
        for to, w in near.get(path[-1], ()):
            step = (d + w, (*path, to))
            if to not in done and (cutoff is None or step[0] <= cutoff) and (to not in best or step < best[to]):
                best[to] = step
                heapq.heappush(heap, step)
    return done


def world(seed, weight):
    rng = random.Random(seed)
    edges = []
    for island in range(4):
        ids = [rng.randrange(10**12) * 4 + island for _ in range(40)]
        edges += [(*rng.choices(ids, k=2), weight(rng)) for _ in range(90)]
    return edges + [(v, u, w) for u, v, w in edges[:9]] + edges[20:25]


@pytest.mark.parametrize("weight", [lambda r: r.uniform(1, 9), lambda r: float(r.randrange(3))])
@pytest.mark.parametrize("most", [10**6, 120, 50])
def test_searches_match_a_plain_heap(spark, weight, most, monkeypatch):
    edges = world(7, weight)
    # parts are made on purpose; a component of more than `most` edges is relaxed by joins
    by_rounds = []
    real = network._by_rounds
    monkeypatch.setattr(network, "_by_rounds", lambda *a: by_rounds.append(1) or real(*a))
    df = spark.createDataFrame(edges, "u long, v long, length_m double")
    starts = [edges[k][0] for k in (0, 1, 100, 200, 300)] + [-5]
    cutoff = 6.0 if most == 50 else None
    src = spark.createDataFrame([(x,) for x in starts], "source long")
    want = {s: plain(edges, s, cutoff) for s in starts}
    got = network.shortest_paths(df, src, cutoff=cutoff, paths=True, sent_edges=most).collect()
    assert {(r.source, r.node): (r.cost, r.path) for r in got} == {(s, n): x for s, w in want.items() for n, x in w.items()}
    assert len(got) == sum(map(len, want.values())) and bool(by_rounds) == (most == 50)
    pairs = [(s, n) for s in starts for n in (edges[3][1], edges[110][1], edges[210][1], s, 77)]
    got = network.shortest_paths(df, spark.createDataFrame(pairs, "source long, node long"), cutoff=cutoff, sent_edges=most).collect()
    assert {(r.source, r.node): r.cost for r in got} == {(s, n): want[s][n][0] for s, n in pairs if n in want[s]} and len(got) == len({(r.source, r.node) for r in got})


@pytest.mark.parametrize("most", [10**6, 120])
def test_matrix_and_layer_of_points(spark, monkeypatch, most):
    monkeypatch.setattr(search, "SEARCHED_EDGES", most)
    edges = world(8, lambda r: r.uniform(1, 9))
    ids = sorted({x for e in edges for x in e[:2]})
    rng = random.Random(2)
    at = {i: (rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in ids}
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()], "node_id long, lon double, lat double")
    chosen = [edges[k][0] for k in (0, 1, 100, 101, 200)] + [edges[0][0]]
    points = spark.createDataFrame([(f"p{k}", *at[i]) for k, i in enumerate(chosen)], "point_id string, lon double, lat double")
    df = spark.createDataFrame(edges, "u long, v long, length_m double")
    ways = {i: plain(edges, i) for i in chosen}
    want = {(f"p{a}", f"p{b}"): ways[i][j][0] / 1000 if j in ways[i] else -1.0 for a, i in enumerate(chosen) for b, j in enumerate(chosen) if a != b}
    got = network.route_matrix(points, df, nodes).collect()
    assert {(r["from"], r["to"]): r.distance_km for r in got} == pytest.approx(want) and len(got) == len(want)
    lines = {(f"p{a}", f"p{b}"): [at[n] for n in ways[i][j][1]] for a, i in enumerate(chosen) for b, j in enumerate(chosen) if a < b and j in ways[i] and i != j}
    got = network.route_layer(points, df, nodes).collect()
    assert {(r["from"], r["to"]): [tuple(p) for p in r.coords] for r in got} == lines and len(got) == len(lines)


def test_stars_of_parts_are_the_components(spark, monkeypatch):
    df = spark.createDataFrame([(u, v) for u, v, _ in world(9, lambda r: 1.0)], "u long, v long").repartition(5)
    want = sorted(map(tuple, graph.connected_components(df, "u", "v").collect()))
    monkeypatch.setattr(graph, "FOLDED_EDGES", 7)
    assert sorted(map(tuple, graph.component_stars(df).collect())) == want
    monkeypatch.setattr(graph, "ONE_TASK_STARS", 1)
    assert sorted(map(tuple, graph.component_stars(df.withColumn("x", F.lit(1))).collect())) == want
