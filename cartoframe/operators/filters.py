"""Filters over tagged features.

A layer is a DataFrame with a tag map (`tags`), and where needed `osm_type`,
`gtype`, `coords`, `lon`, `lat`.  Every filter is a predicate Column on the same
scan, so several filters cost one pass and Catalyst can push them down.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoframe.functions import classify as C
from cartoframe.functions import geo as G
from cartoframe.functions import parse as P

#: Aliases of comparison operators.
COMPARE = {"gt": operator.gt, ">": operator.gt, "gte": operator.ge, ">=": operator.ge, "lt": operator.lt, "<": operator.lt, "lte": operator.le, "<=": operator.le, "eq": operator.eq, "=": operator.eq, "==": operator.eq, "ne": operator.ne, "!=": operator.ne}

_TYPES = {"node": "node", "n": "node", "nodes": "node", "way": "way", "w": "way", "ways": "way", "relation": "relation", "r": "relation", "rel": "relation", "relations": "relation", "any": "any", "all": "any", "*": "any"}


def osm_type(df: DataFrame, kind: str, column: str = "osm_type") -> DataFrame:
    """node, way, relation or any, and their aliases."""
    try:
        want = _TYPES[kind.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown element type: {kind!r}") from None
    return df if want == "any" else df.where(F.col(column) == want)


def has_tag(key: str, value: str = "*", tags: str = "tags") -> Column:
    """The key is there and, unless the value is * or empty, equal to it."""
    there = C.has(F.col(tags), key)
    return there if value in ("*", "") else F.coalesce(F.col(tags)[key] == value, F.lit(False))


def tag_prefix(key: str, prefix: str, tags: str = "tags") -> Column:
    return F.coalesce(F.col(tags)[key].startswith(prefix), F.lit(False))


def tag_contains(key: str, part: str, case_sensitive: bool = False, tags: str = "tags") -> Column:
    value = F.col(tags)[key]
    return F.coalesce(value.contains(part) if case_sensitive else F.lower(value).contains(part.lower()), F.lit(False))


def tag_regex(key: str, pattern: str, case_sensitive: bool = True, tags: str = "tags") -> Column:
    """Searches anywhere.  A pattern that does not compile is an error when the plan is made."""
    re.compile(pattern)
    return F.coalesce(F.col(tags)[key].rlike(pattern if case_sensitive else f"(?i){pattern}"), F.lit(False))


def minispec(spec: str, tags: str = "tags") -> Column:
    """Terms k=v (exact) or k~s (part, any case), joined by |; an empty spec keeps everything."""
    terms = [t.strip() for t in spec.split("|") if t.strip()]
    if not terms:
        return F.lit(True)
    out = []
    for t in terms:
        m = re.fullmatch(r"([^=~]+)([=~])(.*)", t)
        if not m:
            raise ValueError(f"not a term: {t!r}")
        key, how, value = m[1].strip(), m[2], m[3].strip()
        out.append(F.coalesce(F.col(tags)[key] == value, F.lit(False)) if how == "=" else tag_contains(key, value, tags=tags))
    return functools.reduce(operator.or_, out)


_TERM = re.compile(r"([nwr]{1,3})/([A-Za-z0-9_:.-]+)(?:=([^\s,]+(?:,[^\s,]+)*))?")


def parse_tag_query(expression: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """Terms `[nwr]/key[=v1,v2]`, sorted: [(element types, key, values)].  A term without a key is refused: it would match everything."""
    terms = sorted(set(expression.split()))
    if not terms:
        raise ValueError("an empty expression")
    out = []
    for t in terms:
        m = _TERM.fullmatch(t)
        if not m:
            raise ValueError(f"not a term: {t!r}; write types/key or types/key=value,value")
        out.append((m[1], m[2], tuple(sorted(m[3].split(","))) if m[3] else ()))
    return out


def tag_query_key(expression: str) -> str:
    """Digest of the normalised expression: the order of terms and values does not matter."""
    import hashlib

    norm = " ".join(f"{''.join(sorted(k))}/{key}{'=' + ','.join(v) if v else ''}" for k, key, v in parse_tag_query(expression))
    return hashlib.sha256(norm.encode()).hexdigest()


def tag_query(expression: str, tags: str = "tags", kind: str = "osm_type") -> Column:
    names = {"n": "node", "w": "way", "r": "relation"}
    out = []
    for kinds, key, values in parse_tag_query(expression):
        one = C.has(F.col(tags), key) if not values else F.coalesce(F.col(tags)[key].isin(*values), F.lit(False))
        out.append(F.col(kind).isin(*[names[k] for k in kinds]) & one)
    return functools.reduce(operator.or_, out)


def radius_matches(radius_m: Column, how: str, threshold_m: float) -> Column:
    """eq and ne hold within one hundredth of the threshold."""
    key = how.strip().lower()
    if key not in COMPARE:
        raise ValueError(f"unknown operator: {how!r}")
    close = F.abs(radius_m - threshold_m) <= abs(threshold_m) * 0.01
    f = COMPARE[key]
    return close if f is operator.eq else ~close if f is operator.ne else f(radius_m, F.lit(threshold_m))


def with_radius(df: DataFrame, ring: str = "coords") -> DataFrame:
    """equivalent_radius_m and _km of the ring's area; rows without a valid ring are dropped."""
    r = G.equivalent_radius_m(G.area_m2(F.col(ring)))
    return df.where(F.col(ring).isNotNull() & G.is_closed(F.col(ring))).withColumn("equivalent_radius_m", r).withColumn("equivalent_radius_km", F.col("equivalent_radius_m") / 1000)


def filter_by_radius(df: DataFrame, radius: float, unit: str = "km", how: str = "gte", ring: str = "coords") -> DataFrame:
    return with_radius(df, ring).where(radius_matches(F.col("equivalent_radius_m"), how, G.to_metres(radius, unit)))


def filter_by_radius_range(df: DataFrame, low: float, high: float, unit: str = "km", ring: str = "coords") -> DataFrame:
    return with_radius(df, ring).where(F.col("equivalent_radius_m").between(G.to_metres(low, unit), G.to_metres(high, unit)))


def filter_by_type_and_radius(df: DataFrame, boundary: str, radius: float, unit: str = "km", how: str = "gte", ring: str = "coords", tags: str = "tags") -> DataFrame:
    """The type in `boundary_type`, else `type`, in any case."""
    own = F.lower(P.first_filled(F.col(tags)["boundary_type"], F.col(tags)["type"]))
    return filter_by_radius(df.where(own == boundary.lower()), radius, unit, how, ring)


def filter_by_population(df: DataFrame, place: str = "all", how: str = "gte", least: int = 0, most: int | None = None, tags: str = "tags") -> DataFrame:
    """Place type, then the parsed population; what cannot be parsed is dropped.  `between` is inclusive."""
    df = df.where(C.place_matches(F.col(tags), place)).withColumn("population_value", P.population(F.col(tags)["population"])).where("population_value is not null")
    if how == "between":
        if most is None:
            raise ValueError("between needs an upper bound")
        return df.where(F.col("population_value").between(least, most))
    return df.where(COMPARE[how](F.col("population_value"), F.lit(least)))


def populated_places(df: DataFrame, place: str = "all", min_population: int = 0, tags: str = "tags") -> DataFrame:
    """Nodes with a place or population tag; with a minimum, what cannot be parsed is dropped."""
    t = F.col(tags)
    df = df.where(C.has(t, "place") | C.has(t, "population"))
    if place != "all":
        df = df.where(C.place_matches(t, place))
    df = df.withColumn("population_value", P.population_digits(t["population"]))
    return df.where(F.col("population_value") >= min_population) if min_population > 0 else df


def amenities(df: DataFrame, category: str = "all", tags: str = "tags") -> DataFrame:
    df = df.where(C.is_amenity(F.col(tags))).withColumn("category", C.amenity(F.col(tags)))
    return df if category in ("all", "*") else df.where(F.col("category") == category)


def search_amenities(df: DataFrame, pattern: str, tags: str = "tags") -> DataFrame:
    """A pattern in the name, in any case; a missing name is empty."""
    re.compile(pattern)
    return df.where(F.coalesce(F.col(tags)["name"], F.lit("")).rlike(f"(?i){pattern}"))


#: Presets: name -> (key, values).
AMENITY_PRESETS = {
    "restaurants": ("amenity", ("restaurant",)), "cafes": ("amenity", ("cafe",)), "bars": ("amenity", ("bar", "pub")), "fast_food": ("amenity", ("fast_food",)),
    "food_and_drink": ("amenity", C.AMENITY_CATEGORIES["food"]), "supermarkets": ("shop", ("supermarket",)), "shopping_malls": ("shop", ("mall",)), "convenience_stores": ("shop", ("convenience",)),
    "all_shopping": ("shop", C.SHOPS), "banks": ("amenity", ("bank",)), "atms": ("amenity", ("atm",)), "post_offices": ("amenity", ("post_office",)), "fuel_stations": ("amenity", ("fuel",)),
    "ev_charging": ("amenity", ("charging_station",)), "parking": ("amenity", ("parking",)), "hospitals": ("amenity", ("hospital",)), "pharmacies": ("amenity", ("pharmacy",)),
    "doctors": ("amenity", ("doctors",)), "all_healthcare": ("amenity", C.AMENITY_CATEGORIES["healthcare"]), "schools": ("amenity", ("school",)), "universities": ("amenity", ("university", "college")),
    "libraries": ("amenity", ("library",)), "all_education": ("amenity", C.AMENITY_CATEGORIES["education"]), "cinemas": ("amenity", ("cinema",)), "theatres": ("amenity", ("theatre",)),
    "nightclubs": ("amenity", ("nightclub",)), "all_entertainment": ("amenity", C.AMENITY_CATEGORIES["entertainment"]),
}


def amenity_preset(df: DataFrame, name: str, tags: str = "tags") -> DataFrame:
    key, values = AMENITY_PRESETS[name]
    return df.where(F.col(tags)[key].isin(*values))


def buildings(df: DataFrame, kind: str = "all", min_area_m2: float = 0.0, only_3d: bool = False, tags: str = "tags") -> DataFrame:
    t = F.col(tags)
    df = df.where(C.has(t, "building")).withColumn("building_type", C.building(t)).withColumn("height", P.height(t["height"])).withColumn("levels", P.levels(t["building:levels"]))
    if "coords" in df.columns:
        df = df.withColumn("area_m2", F.when(G.is_closed(F.col("coords")), G.area_m2(F.col("coords"), "square")).otherwise(F.lit(0.0)))
    if kind != "all":
        df = df.where(F.col("building_type") == kind)
    if only_3d:
        df = df.where("height is not null or levels is not null")
    return df.where(F.col("area_m2") >= min_area_m2) if min_area_m2 > 0 else df


def parks(df: DataFrame, kind: str = "all", protect: tuple[str, ...] = (), min_area_km2: float = 0.0, tags: str = "tags") -> DataFrame:
    """By a ready `park_type` column where it is filled, else by the tags.  A list of protection classes only tests rows that have one."""
    own = C.park(F.col(tags))
    if "park_type" in df.columns:
        own = F.coalesce(F.when(F.col("park_type") != "", F.col("park_type")), own)
    df = df.withColumn("park_type", own)
    if kind == "protected_area":
        df = df.where(F.col("park_type").isin(*C.PROTECTED_KINDS))
    elif kind != "all":
        df = df.where(F.col("park_type") == kind)
    if protect:
        cls = F.coalesce(F.col(tags)["protect_class"], F.lit(""))
        df = df.where((cls == "") | cls.isin(*protect))
    return df.where(F.col("area_km2") >= min_area_km2) if min_area_km2 > 0 else df


def roads(df: DataFrame, requested: str = "all", tags: str = "tags") -> DataFrame:
    """Ways with a highway, with class, speed, lanes, surface kind and flags; composite classes are known."""
    t = F.col(tags)
    df = df.where(C.has(t, "highway")).withColumn("road_class", C.road(t["highway"])).withColumn("maxspeed", P.speed_limit(t["maxspeed"])).withColumn("lanes", P.lanes(t["lanes"])).withColumn("surface", t["surface"])
    df = df.withColumn("paved", F.when(t["surface"].isin(*C.PAVED), True).when(t["surface"].isin(*C.UNPAVED), False))
    for flag in ("oneway", "bridge", "tunnel"):
        df = df.withColumn(flag, P.truthy(t[flag]))
    if "coords" in df.columns:
        df = df.withColumn("length_km", G.line_length(F.col("coords")))
    return df.where(C.road_matches(requested, F.col("road_class")))


def roads_by_class(df: DataFrame, cls: str) -> DataFrame:
    """Exact class; composites are not known here."""
    return df.where(F.col("road_class") == cls)


def roads_by_speed(df: DataFrame, low: int, high: int) -> DataFrame:
    """Inclusive; roads without a limit are dropped."""
    return df.where(F.col("maxspeed").between(low, high))


# Route modes and their tags.
ROUTE_MODES = {
    "bicycle": ("bicycle", "mtb"),
    "hiking": ("hiking", "foot", "walking"),
    "train": ("train", "railway", "light_rail", "subway", "tram"),
    "bus": ("bus", "trolleybus"),
    "public_transport": ("train", "railway", "light_rail", "subway", "tram", "bus", "trolleybus", "ferry"),
}


def routes_by_type(df: DataFrame, mode: str, network: str = "*", tags: str = "tags") -> DataFrame:
    """In the array of route types, or the route tag is one of the mode's; the network in any case."""
    match = F.coalesce(F.col(tags)["route"].isin(*ROUTE_MODES[mode]), F.lit(False))
    if "route_types" in df.columns:
        match = match | F.coalesce(F.array_contains("route_types", mode), F.lit(False))
    df = df.where(match)
    return df if network == "*" else df.where(F.lower(F.coalesce(F.col(tags)["network"], F.lit(""))) == network.lower())


# Tags of natural boundaries.
NATURAL = {
    "water": {"natural": ("water",), "water": ("lake", "reservoir", "pond")},
    "forest": {"natural": ("wood",), "landuse": ("forest",)},
    "park": {"leisure": ("park", "nature_reserve"), "boundary": ("national_park",)},
}
ADMIN_LEVELS = {"country": 2, "state": 4, "county": 6, "city": 8}


def admin_boundaries(df: DataFrame, level: int | str, tags: str = "tags") -> DataFrame:
    level = ADMIN_LEVELS.get(level, level)
    t = F.col(tags)
    return df.where((t["boundary"] == "administrative") & (t["admin_level"] == str(level)))


def natural_boundaries(df: DataFrame, kind: str, tags: str = "tags") -> DataFrame:
    return df.where(functools.reduce(operator.or_, [F.coalesce(F.col(tags)[k].isin(*v), F.lit(False)) for k, v in NATURAL[kind].items()]))


def attribute_equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column).eqNullSafe(F.lit(value)))


def clip_bbox(df: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    if min_lon > max_lon or min_lat > max_lat:
        raise ValueError("an empty box")
    return df.where(F.col("lon").between(min_lon, max_lon) & F.col("lat").between(min_lat, max_lat))


def clip_polygon(df: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points inside a closed ring; its box goes first, so that the scan can skip."""
    lons, lats = [p[0] for p in ring], [p[1] for p in ring]
    points = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring])
    return clip_bbox(df, min(lons), min(lats), max(lons), max(lats)).where(G.point_in_ring(F.col("lon"), F.col("lat"), points))


def with_dependencies(kept: DataFrame, nodes: DataFrame, refs: str = "node_refs") -> DataFrame:
    """The nodes that kept ways refer to, each once."""
    return nodes.join(kept.select(F.explode(refs).alias("id")).distinct(), "id", "left_semi")
