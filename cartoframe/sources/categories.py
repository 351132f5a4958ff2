"""Feature categories: a predicate and a projection each, over any element layer.

The same eight categories are served from extracts, GeoJSON layers, relational
and columnar sources and histories.  A combined scan assigns all categories in
one pass; a category's rows are then a filter on one column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoframe.functions import classify as C
from cartoframe.functions import parse as P
from cartoframe.operators import filters as T
from cartoframe.sources import geojson


@dataclass(frozen=True)
class Category:
    """What belongs to a category, of which element types, and the class of a row.  Other categories are added the same way."""

    name: str
    kinds: tuple[str, ...]
    match: Callable[[Column], Column]
    cls: Callable[[Column], Column]


def _any(tags: Column, *keys: str) -> Column:
    out = C.has(tags, keys[0])
    for k in keys[1:]:
        out = out | C.has(tags, k)
    return out


def _is(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tags[key].isin(*values), F.lit(False))


_MODES = {m: v for m, v in T.ROUTE_MODES.items() if m != "public_transport"}

CATEGORIES = {c.name: c for c in (
    Category("amenities", ("node",), C.is_amenity, C.amenity),
    Category("boundaries", ("way", "relation"), lambda t: _is(t, "boundary", "administrative"), lambda t: F.concat(F.lit("admin_"), F.coalesce(t["admin_level"], F.lit("?")))),
    Category("buildings", ("way", "relation"), lambda t: C.has(t, "building"), C.building),
    Category("parks", ("way", "relation"), lambda t: _is(t, "leisure", "park", "nature_reserve") | _is(t, "boundary", "national_park", "protected_area"), C.park),
    Category("population", ("node",), lambda t: _any(t, "place", "population"), lambda t: F.coalesce(t["place"], F.lit(""))),
    Category("roads", ("way",), lambda t: C.has(t, "highway"), lambda t: C.road(t["highway"])),
    Category("routes", ("node", "way", "relation"), lambda t: C.has(t, "route"), lambda t: F.coalesce(*[F.when(t["route"].isin(*v), m) for m, v in _MODES.items()], F.lit("other"))),
    Category("pois", ("node",), lambda t: _any(t, "amenity", "tourism", "historic"), lambda t: F.coalesce(t["amenity"], t["tourism"], t["historic"])),
)}


def load(df: DataFrame, category: str, kind: str = "osm_type", tags: str = "tags") -> DataFrame:
    """Rows of one category with `class`; an unknown category is an error, never an empty layer."""
    if category not in CATEGORIES:
        raise ValueError(f"unknown category: {category!r}; one of {', '.join(CATEGORIES)}")
    c = CATEGORIES[category]
    return df.where(F.col(kind).isin(*c.kinds) & c.match(F.col(tags))).withColumn("class", c.cls(F.col(tags)))


def scan(df: DataFrame, names: tuple[str, ...] = tuple(CATEGORIES), kind: str = "osm_type", tags: str = "tags") -> DataFrame:
    """One pass for several categories: `category` and `class`, a row for each category that an element is in."""
    t = F.col(tags)
    each = [F.when(F.col(kind).isin(*CATEGORIES[n].kinds) & CATEGORIES[n].match(t), F.struct(F.lit(n).alias("category"), CATEGORIES[n].cls(t).alias("class"))) for n in names]
    return df.withColumn("__c", F.explode(F.array_compact(F.array(*each)))).select(*df.columns, "__c.category", "__c.class")


def manifest(scanned: DataFrame) -> DataFrame:
    """category, features."""
    return scanned.groupBy("category").agg(F.count(F.lit(1)).alias("features"))


# Points of interest and the tags that name them.
POIS = {
    "volcanos": ("natural", ("volcano",)), "prisons": ("amenity", ("prison",)), "national_parks": ("boundary", ("national_park",)), "state_parks": ("leisure", ("park",)), "hospitals": ("amenity", ("hospital",)), "airports": ("aeroway", ("aerodrome",)), "military": ("landuse", ("military",)),
    "cities": ("place", ("city",)), "towns": ("place", ("town",)), "suburbs": ("place", ("suburb",)), "villages": ("place", ("village",)), "hamlets": ("place", ("hamlet",)), "countries": ("place", ("country",)),
}


def poi(df: DataFrame, kind: str, tags: str = "tags") -> DataFrame:
    key, values = POIS[kind]
    return df.where(_is(F.col(tags), key, *values))


def places(df: DataFrame, place: str, tags: str = "tags") -> DataFrame:
    """Places of a type with their parsed population."""
    return df.where(C.place_matches(F.col(tags), place)).withColumn("population_value", P.population(F.col(tags)["population"]))


def export(df: DataFrame, path: str, max_features: int | None = None) -> int:
    """A layer as a feature a line; beyond max_features it is refused before anything is written."""
    n = df.count()
    if max_features is not None and n > max_features:
        raise ValueError(f"{n} features; the limit is {max_features}")
    geojson.write_lines(df, path)
    return n
