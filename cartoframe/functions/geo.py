"""Geometry as Column expressions.

Points are (lon, lat) in degrees; lines and rings are ARRAY<STRUCT<lon, lat>>.
Everything here stays in the JVM; what needs loops over loops is in
operators/spatial.py.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii (kilometres; metres in transit and road importance; metres in the network), degree length, mile.
EARTH_KM = 6371.0
EARTH_M = 6371000.0
EARTH_NETWORK_M = 6371008.8
KM_PER_DEGREE = 111.19
M_PER_DEGREE = 111320.0
MILE_M = 1609.344

_UNITS = {"m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "km": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "kilometre": 1000.0, "kilometres": 1000.0, "mi": MILE_M, "mile": MILE_M, "miles": MILE_M}


def unit_factor(unit: str) -> float:
    """Metres in a unit; an unknown unit is an error."""
    try:
        return _UNITS[unit.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown unit: {unit!r} (m, km or mi)") from None


def to_metres(value: float, unit: str) -> float:
    return value * unit_factor(unit)


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of the radius."""
    lon1, lat1, lon2, lat2 = (F.col(x) if isinstance(x, str) else x for x in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))


def pairs(coords: Column, f) -> Column:
    """f(a, b) of each two neighbours of a line."""
    n = F.size(coords)
    heads = F.slice(coords, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(coords, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(heads, tails, f)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def line_length(coords: Column, radius: float = EARTH_KM) -> Column:
    """Sum of segment lengths; 0 for fewer than two points, null for null."""
    return F.when(coords.isNull(), F.lit(None).cast("double")).otherwise(total(pairs(coords, lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"], radius))))


def is_closed(coords: Column) -> Column:
    """A ring: four points or more, the last equal to the first."""
    return (F.size(coords) >= 4) & (F.element_at(coords, 1) == F.element_at(coords, -1))


def _shoelace(coords: Column, f) -> Column:
    return total(pairs(coords, lambda a, b: f(a, b) * (a["lon"] * b["lat"] - b["lon"] * a["lat"])))


def planar_area(ring: Column) -> Column:
    """Area of a closed ring in square degrees."""
    return F.abs(_shoelace(ring, lambda a, b: F.lit(1.0))) / 2


def bbox(coords: Column) -> Column:
    lon, lat = F.transform(coords, lambda p: p["lon"]), F.transform(coords, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def area_m2(ring: Column, lat_scale: str = "both") -> Column:
    """Area of a closed ring in square metres: planar, scaled at the middle latitude.

    `lat_scale` "both" scales each axis by its own degree length; "square" uses
    the longitude's for both, the cheap variant of buildings.
    """
    box = bbox(ring)
    m_lon = F.lit(M_PER_DEGREE) * F.cos(F.radians((box["min_lat"] + box["max_lat"]) / 2))
    return planar_area(ring) * m_lon * (F.lit(M_PER_DEGREE) if lat_scale == "both" else m_lon)


def equivalent_radius_m(area: Column) -> Column:
    """Radius of the circle of that area."""
    return F.sqrt(area / F.lit(math.pi))


def ring_centroid(ring: Column) -> Column:
    """Planar centroid of a closed ring; of one without area, the mean of its points but the last."""
    a2 = _shoelace(ring, lambda a, b: F.lit(1.0))
    x = _shoelace(ring, lambda a, b: a["lon"] + b["lon"]) / (a2 * 3)
    y = _shoelace(ring, lambda a, b: a["lat"] + b["lat"]) / (a2 * 3)
    open_ring = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
    mean = vertex_mean(open_ring)
    return F.when(a2 == 0, mean).otherwise(F.struct(x.alias("lon"), y.alias("lat")))


def line_centroid(coords: Column) -> Column:
    """Mean of the segments' middles, weighted with their planar lengths."""
    def length(a, b):
        return F.sqrt(F.pow(b["lon"] - a["lon"], F.lit(2.0)) + F.pow(b["lat"] - a["lat"], F.lit(2.0)))

    whole = total(pairs(coords, length))
    x = total(pairs(coords, lambda a, b: (a["lon"] + b["lon"]) / 2 * length(a, b)))
    y = total(pairs(coords, lambda a, b: (a["lat"] + b["lat"]) / 2 * length(a, b)))
    return F.when(whole == 0, F.element_at(coords, 1)).otherwise(F.struct((x / whole).alias("lon"), (y / whole).alias("lat")))


def centroid(gtype: Column, coords: Column) -> Column:
    """Point, LineString or Polygon (outer ring)."""
    return F.when(gtype == "Point", F.element_at(coords, 1)).when(gtype == "Polygon", ring_centroid(coords)).otherwise(line_centroid(coords))


def vertex_mean(coords: Column) -> Column:
    """Plain mean of the vertices; the closing vertex counts twice."""
    n = F.size(coords)
    return F.struct((total(F.transform(coords, lambda p: p["lon"])) / n).alias("lon"), (total(F.transform(coords, lambda p: p["lat"])) / n).alias("lat"))


def bbox_centre(coords: Column) -> Column:
    box = bbox(coords)
    return F.struct(((box["min_lon"] + box["max_lon"]) / 2).alias("lon"), ((box["min_lat"] + box["max_lat"]) / 2).alias("lat"))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting with half-open edges: of two rings that share an edge, a point on it is in one."""
    def crosses(a, b):
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return F.when(spans & (lon < at), F.lit(1)).otherwise(F.lit(0))

    return F.aggregate(pairs(ring, crosses), F.lit(0), lambda acc, x: acc + x) % 2 == 1


def point_in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """In an odd number of rings: in a part of a multipolygon and in none of its holes."""
    return F.size(F.filter(rings, lambda r: point_in_ring(lon, lat, r))) % 2 == 1


def parts_area(parts: Column, area=planar_area) -> Column:
    """Area of a multipolygon: parts are arrays of rings, the outer one first, its holes after it."""
    return total(F.transform(parts, lambda rings: total(F.transform(rings, lambda ring, i: F.when(i == 0, area(ring)).otherwise(-area(ring))))))


def point_segment_m(lon: Column, lat: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment in metres, on the plane around the point."""
    kx = F.lit(M_PER_DEGREE) * F.cos(F.radians(lat))
    ax, ay = (a["lon"] - lon) * kx, (a["lat"] - lat) * M_PER_DEGREE
    dx, dy = (b["lon"] - a["lon"]) * kx, (b["lat"] - a["lat"]) * M_PER_DEGREE
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square)))
    return F.sqrt(F.pow(ax + t * dx, F.lit(2.0)) + F.pow(ay + t * dy, F.lit(2.0)))


def destination(lon: Column, lat: Column, bearing: Column, distance: Column, radius: float = EARTH_KM) -> Column:
    """The point at a bearing (radians) and distance (in the unit of the radius)."""
    d = distance / radius
    phi = F.radians(lat)
    to = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(bearing))
    lam = F.radians(lon) + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(to))
    return F.struct(F.degrees(lam).alias("lon"), F.degrees(to).alias("lat"))


def point_buffer(lon: Column, lat: Column, distance: Column, sides: int = 32, radius: float = EARTH_KM) -> Column:
    """A closed polygon of `sides` corners around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda k: destination(lon, lat, (k % sides) * (2 * math.pi / sides), distance, radius))


def densify(coords: Column, step: float, radius: float = EARTH_M) -> Column:
    """The line's points, and points at equal steps of at most `step` between them."""
    def between(a, b):
        n = F.greatest(F.lit(1), F.ceil(haversine(a["lon"], a["lat"], b["lon"], b["lat"], radius) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a["lon"] + (b["lon"] - a["lon"]) * k / n).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * k / n).alias("lat")))

    return F.when(F.size(coords) < 2, coords).otherwise(F.concat(F.flatten(pairs(coords, between)), F.slice(coords, F.lit(-1), F.lit(1))))


def region_scale(diagonal_km: Column) -> Column:
    """Diagonal over 2000 km, at most 1."""
    return F.least(F.lit(1.0), diagonal_km / 2000.0)


def pair_minimum_km(base_km: float, diagonal_km: Column) -> Column:
    """Least distance of an origin and a destination: scaled with the region, 5 km at least."""
    return F.greatest(F.lit(5.0), F.lit(base_km) * region_scale(diagonal_km))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def clip_to_bbox(ring: Column, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """A closed ring cut to a rectangle (four half-planes in turn); empty if nothing is left."""
    def half(points: Column, inside, cross) -> Column:
        def step(a, b):
            return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(cross(a, b))).when(inside(b), F.array(cross(a, b), b)).otherwise(F.expr("cast(array() as array<struct<lon:double,lat:double>>)"))

        return let(F.flatten(let(points, lambda p: pairs(p, step))), lambda cut: F.when(F.size(cut) > 0, F.concat(F.slice(cut, F.lit(-1), F.lit(1)), cut)).otherwise(cut))

    def at_lon(v):
        return lambda a, b: F.struct(v.alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * (v - a["lon"]) / (b["lon"] - a["lon"])).alias("lat"))

    def at_lat(v):
        return lambda a, b: F.struct((a["lon"] + (b["lon"] - a["lon"]) * (v - a["lat"]) / (b["lat"] - a["lat"])).alias("lon"), v.alias("lat"))

    out = half(ring, lambda p: p["lon"] >= min_lon, at_lon(min_lon))
    out = half(out, lambda p: p["lon"] <= max_lon, at_lon(max_lon))
    out = half(out, lambda p: p["lat"] >= min_lat, at_lat(min_lat))
    return half(out, lambda p: p["lat"] <= max_lat, at_lat(max_lat))


def tile_x(lon: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    return F.greatest(F.lit(0), F.least(n.cast("long") - 1, F.floor((lon + 180) / 360 * n)))


def tile_y(lat: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    phi = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    return F.greatest(F.lit(0), F.least(n.cast("long") - 1, F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)))
