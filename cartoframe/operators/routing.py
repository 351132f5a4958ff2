"""Routes, matrices and isochrones of routing servers, behind one interface.

A server is an engine and an address.  Requests are made by the tasks that hold the
rows, one for each, and what a server does not answer is estimated from the
great-circle distance.  `fetch` (url, body) -> text or None stands for the transport.
"""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoframe.functions import geo as G
from cartoframe.operators.overlay import _PARTS, _PARTS_TYPE
from cartoframe.operators.spatial import decode_polyline6

# Detour and speed of an estimate, and what engines call the ways of travelling.
DETOUR, KMH = 1.3, 80.0
PROFILES = {"valhalla": {"car": "auto", "bike": "bicycle", "foot": "pedestrian"}, "graphhopper": {}, "osrm": {"car": "driving", "bike": "cycling", "foot": "walking"}}
Fetch = Callable[[str, str | None], str | None]


@dataclass(frozen=True)
class Server:
    engine: str
    address: str
    profile: str = "car"

    def __post_init__(self):
        if self.engine not in PROFILES:
            raise ValueError(f"engine: {', '.join(sorted(PROFILES))}, not {self.engine}")

    @property
    def travel(self) -> str:
        return PROFILES[self.engine].get(self.profile, self.profile)


def over_http(url: str, body: str | None, timeout: float = 30.0) -> str | None:
    """A GET, or a POST of JSON; None for whatever goes wrong."""
    try:
        request = urllib.request.Request(url, None if body is None else body.encode(), {"Content-Type": "application/json"} if body else {})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read().decode()
    except (OSError, ValueError):
        return None


def _at(points: list[tuple[float, float]]) -> list[dict]:
    return [{"lat": y, "lon": x} for x, y in points]


def route_request(s: Server, points: list[tuple[float, float]]) -> tuple[str, str | None]:
    """(url, body) of a way through points (lon, lat)."""
    if s.engine == "valhalla":
        return f"{s.address}/route", json.dumps({"locations": _at(points), "costing": s.travel})
    if s.engine == "graphhopper":
        return f"{s.address}/route?" + urlencode([*(("point", f"{y},{x}") for x, y in points), ("profile", s.travel), ("points_encoded", "false"), ("calc_points", "true")]), None
    return f"{s.address}/route/v1/{s.travel}/" + ";".join(f"{x},{y}" for x, y in points) + "?overview=full&geometries=polyline6", None


def parse_route(s: Server, text: str | None) -> tuple[float, float, list[tuple[float, float]]] | None:
    """(km, minutes, points) of an answer, None if it has no way."""
    try:
        data = json.loads(text or "")
        if s.engine == "valhalla":
            trip = data["trip"]
            return float(trip["summary"]["length"]), float(trip["summary"]["time"]) / 60, [p for leg in trip.get("legs", ()) if leg.get("shape") for p in decode_polyline6(leg["shape"])]
        if s.engine == "graphhopper":
            way = data["paths"][0]
            return float(way["distance"]) / 1000, float(way["time"]) / 60_000, [(p[0], p[1]) for p in way.get("points", {}).get("coordinates", ())]
        way = data["routes"][0]
        return float(way["distance"]) / 1000, float(way["duration"]) / 60, decode_polyline6(way.get("geometry") or "")
    except (KeyError, IndexError, TypeError, ValueError):
        return None


def matrix_request(s: Server, points: list[tuple[float, float]]) -> tuple[str, str | None] | None:
    if s.engine == "valhalla":
        return f"{s.address}/sources_to_targets", json.dumps({"sources": _at(points), "targets": _at(points), "costing": s.travel})
    if s.engine == "osrm":
        return f"{s.address}/table/v1/{s.travel}/" + ";".join(f"{x},{y}" for x, y in points) + "?annotations=duration,distance", None
    return None


def parse_matrix(s: Server, text: str | None, n: int) -> list[list[tuple[float, float]]] | None:
    """n rows of n (seconds, metres), None if the answer is not that."""
    try:
        data = json.loads(text or "")
        if s.engine == "valhalla":
            out = [[(float(c.get("time") or 0), float(c.get("distance") or 0) * 1000) for c in row] for row in data["sources_to_targets"]]
        else:
            out = [[(float(d or 0), float(m or 0)) for d, m in zip(ds, ms, strict=True)] for ds, ms in zip(data["durations"], data["distances"], strict=True)]
        return out if len(out) == n and all(len(r) == n for r in out) else None
    except (KeyError, TypeError, ValueError):
        return None


def isochrone_request(s: Server, centre: tuple[float, float], minutes: float) -> tuple[str, str | None] | None:
    if s.engine == "valhalla":
        return f"{s.address}/isochrone", json.dumps({"locations": _at([centre]), "costing": s.travel, "contours": [{"time": minutes}], "polygons": True})
    if s.engine == "graphhopper":
        return f"{s.address}/isochrone?" + urlencode([("point", f"{centre[1]},{centre[0]}"), ("time_limit", str(int(minutes * 60))), ("profile", s.travel), ("buckets", "1")]), None
    return None


def parse_isochrone(s: Server, text: str | None) -> list | None:
    """Polygons (rings of points) of an answer."""
    try:
        found = json.loads(text or "")["features" if s.engine == "valhalla" else "polygons"]
        out = []
        for f in found:
            shape = f.get("geometry") or {}
            out += [shape["coordinates"]] if shape.get("type") == "Polygon" else shape["coordinates"] if shape.get("type") == "MultiPolygon" else []
        return out or None
    except (KeyError, TypeError, ValueError):
        return None


def estimate(x0: float, y0: float, x1: float, y1: float) -> tuple[float, float]:
    """(km, minutes) from the great-circle distance."""
    a = math.sin(math.radians(y1 - y0) / 2) ** 2 + math.cos(math.radians(y0)) * math.cos(math.radians(y1)) * math.sin(math.radians(x1 - x0) / 2) ** 2
    km = 2 * G.EARTH_KM * math.asin(min(1.0, math.sqrt(a))) * DETOUR
    return km, km / KMH * 60


_LINE = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
_LINE_ARROW = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))


def routes(stops: DataFrame, server: Server, points: str = "points", fetch: Fetch = over_http) -> DataFrame:
    """Rows with `points` (arrays of lon, lat; two or more) and distance_km, duration_min, coords, backend (the engine, or `estimate`).  Rows of fewer points get nulls."""
    schema = T.StructType([*stops.schema.fields, T.StructField("distance_km", T.DoubleType()), T.StructField("duration_min", T.DoubleType()), T.StructField("coords", _LINE), T.StructField("backend", T.StringType())])
    at = stops.columns.index(points)

    def one(line) -> tuple:
        if not line or len(line) < 2:
            return None, None, None, None
        through = [(p["lon"], p["lat"]) for p in line]
        found = parse_route(server, fetch(*route_request(server, through)))
        if found:
            km, minutes, way = found
            backend = server.engine
        else:
            legs = [estimate(*a, *b) for a, b in zip(through, through[1:], strict=False)]
            km, minutes, way, backend = sum(x for x, _ in legs), sum(m for _, m in legs), through, "estimate"
        return round(km, 2), round(minutes, 1), [{"lon": x, "lat": y} for x, y in way or through], backend

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(line) for line in batch.column(at).to_pylist()]
            columns = [pa.array([m[c] for m in made], k) for c, k in enumerate((pa.float64(), pa.float64(), _LINE_ARROW, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return stops.mapInArrow(run, schema)


def matrix(groups: DataFrame, server: Server, key: str, points: str = "points", fetch: Fetch = over_http) -> DataFrame:
    """key, i, j, duration_s, distance_m, backend for each two points of a row's list, the diagonal too; a list of fewer than two has none."""
    kind = groups.schema[key]
    schema = T.StructType([kind, *[T.StructField(n, t) for n, t in (("i", T.IntegerType()), ("j", T.IntegerType()), ("duration_s", T.DoubleType()), ("distance_m", T.DoubleType()), ("backend", T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, line in enumerate(batch.column(1).to_pylist()):
                where = [(p["lon"], p["lat"]) for p in line or ()]
                if len(where) < 2:
                    continue
                asked = matrix_request(server, where)
                found = parse_matrix(server, fetch(*asked), len(where)) if asked else None
                cells = found or [[(m * 60, km * 1000) for km, m in (estimate(*a, *b) for b in where)] for a in where]
                n = len(where)
                columns = [pa.array([i for i in range(n) for _ in range(n)], pa.int32()), pa.array(list(range(n)) * n, pa.int32()), *(pa.array([round(c[k], 1) for row in cells for c in row], pa.float64()) for k in (0, 1)), pa.array([server.engine if found else "estimate"] * (n * n), pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r] * (n * n))), *columns], schema.names)

    return groups.select(key, points).mapInArrow(run, schema)


def isochrones(centres: DataFrame, server: Server, minutes: float, fetch: Fetch = over_http) -> DataFrame:
    """Centres (lon, lat) with parts, the area reached in so many minutes, and backend; `none`, and no area, where no server answers."""
    schema = T.StructType([*centres.schema.fields, T.StructField("parts", _PARTS_TYPE), T.StructField("backend", T.StringType())])
    lon, lat = centres.columns.index("lon"), centres.columns.index("lat")

    def one(x: float | None, y: float | None) -> list | None:
        asked = isochrone_request(server, (x, y), minutes) if x is not None and y is not None else None
        found = parse_isochrone(server, fetch(*asked)) if asked else None
        return found and [[[{"lon": float(p[0]), "lat": float(p[1])} for p in ring] for ring in part] for part in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(x, y) for x, y in zip(batch.column(lon).to_pylist(), batch.column(lat).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, _PARTS), pa.array([server.engine if m else "none" for m in made], pa.string())], schema.names)

    return centres.mapInArrow(run, schema)


def pair_points(pairs: DataFrame) -> DataFrame:
    """Pairs (from_lon, from_lat, to_lon, to_lat) with `points`."""
    p = lambda a: F.struct(F.col(f"{a}_lon").cast("double").alias("lon"), F.col(f"{a}_lat").cast("double").alias("lat"))
    return pairs.withColumn("points", F.array(p("from"), p("to")))
