"""Classification of tagged features, as Column expressions over a tag map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories of the amenity tag.
AMENITY_CATEGORIES = {
    "food": ("restaurant", "cafe", "bar", "pub", "fast_food", "food_court", "ice_cream", "biergarten"),
    "services": ("bank", "atm", "post_office", "fuel", "car_wash", "car_rental", "charging_station", "parking"),
    "healthcare": ("hospital", "clinic", "doctors", "dentist", "pharmacy", "veterinary"),
    "education": ("school", "university", "college", "library", "kindergarten"),
    "entertainment": ("cinema", "theatre", "nightclub", "casino", "arts_centre"),
    "transport": ("bus_station", "ferry_terminal", "taxi"),
}
SHOPS = ("supermarket", "convenience", "mall", "department_store", "clothes", "shoes", "electronics")
TOURISM_SERVICES = ("hotel", "motel", "hostel", "guest_house")
TOURISM_ENTERTAINMENT = ("museum", "gallery", "zoo", "theme_park")

# Types of the building tag.
BUILDING_TYPES = {
    "residential": ("house", "residential", "apartments", "detached", "semidetached_house", "terrace", "dormitory"),
    "commercial": ("commercial", "hotel"),
    "office": ("office",),
    "industrial": ("industrial", "warehouse", "factory", "manufacture"),
    "retail": ("retail", "supermarket", "kiosk"),
    "public": ("public", "civic", "government", "hospital", "school", "university", "kindergarten"),
    "religious": ("church", "chapel", "cathedral", "mosque", "temple", "synagogue"),
}
PUBLIC_AMENITIES = ("hospital", "school", "university", "library", "townhall")

# Classes of the highway tag, surfaces, composite classes.
ROAD_CLASSES = {
    "motorway": ("motorway", "motorway_link"),
    "trunk": ("trunk", "trunk_link"),
    "primary": ("primary", "primary_link"),
    "secondary": ("secondary", "secondary_link"),
    "tertiary": ("tertiary", "tertiary_link"),
    "residential": ("residential", "living_street"),
    "service": ("service",),
    "unclassified": ("unclassified",),
    "track": ("track",),
    "path": ("path", "footway", "cycleway", "bridleway"),
}
COMPOSITE_ROADS = {"major": ("motorway", "trunk"), "freeway": ("motorway", "trunk")}
PAVED = ("asphalt", "concrete", "paved", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "cobblestone")
UNPAVED = ("unpaved", "gravel", "dirt", "sand", "grass", "ground", "earth", "mud", "compacted", "fine_gravel")
FUNCTIONAL_SCORES = {"motorway": 1.0, "trunk": 0.88, "primary": 0.75, "secondary": 0.60, "tertiary": 0.45, "unclassified": 0.30, "residential": 0.18, "service": 0.08, "track": 0.04, "path": 0.02, "ferry": 0.0}

# Place types and the tags that name them.
PLACES = {
    "city": (("city",), None),
    "town": (("town",), None),
    "village": (("village",), None),
    "hamlet": (("hamlet",), None),
    "suburb": (("suburb", "neighbourhood", "quarter"), None),
    "country": (("country",), "2"),
    "state": (("state", "province"), "4"),
    "county": (("county",), "6"),
    "municipality": (("municipality",), "8"),
}

# Protection classes.
PROTECT_ALL = ("1a", "1b", "2", "3", "4", "5", "6")
PROTECTED_KINDS = ("protected_area", "national", "state", "nature_reserve")


def _lookup(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for name, values in table.items():
        out = F.when(value.isin(*values), name) if out is None else out.when(value.isin(*values), name)
    return out


def has(tags: Column, key: str) -> Column:
    """The key is there, whatever its value."""
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def amenity(tags: Column) -> Column:
    """By the amenity tag, then any shop, then tourism."""
    return F.coalesce(
        _lookup(tags["amenity"], AMENITY_CATEGORIES),
        F.when(has(tags, "shop"), "shopping"),
        F.when(tags["tourism"].isin(*TOURISM_SERVICES), "services").when(tags["tourism"].isin(*TOURISM_ENTERTAINMENT), "entertainment"),
        F.lit("other"),
    )


def is_amenity(tags: Column) -> Column:
    return has(tags, "amenity") | has(tags, "shop") | F.coalesce(tags["tourism"].isin(*TOURISM_SERVICES, *TOURISM_ENTERTAINMENT), F.lit(False))


def building(tags: Column) -> Column:
    """By the building tag, then a public amenity, shop, office."""
    return F.coalesce(_lookup(tags["building"], BUILDING_TYPES), F.when(tags["amenity"].isin(*PUBLIC_AMENITIES), "public"), F.when(has(tags, "shop"), "retail"), F.when(has(tags, "office"), "office"), F.lit("other"))


def park(tags: Column) -> Column:
    """National before state before reserve before any protected area before a plain park."""
    boundary, leisure, cls = tags["boundary"], tags["leisure"], tags["protect_class"]
    designation = F.lower(F.coalesce(tags["designation"], F.lit("")))
    named = lambda *names: designation.rlike("|".join(n.replace(" ", "[_ ]") for n in names))
    return (
        F.when((boundary == "national_park") | (cls == "2") | named("national park"), "national")
        .when((cls == "5") | named("state park", "regional park", "provincial park"), "state")
        .when((leisure == "nature_reserve") | cls.isin("1a", "1b") | named("nature reserve"), "nature_reserve")
        .when(boundary == "protected_area", "protected_area")
        .when(leisure == "park", "park")
        .otherwise("protected_area")
    )


def road(highway: Column) -> Column:
    """Links fold into their parent's class."""
    return F.coalesce(_lookup(highway, ROAD_CLASSES), F.lit("other"))


def road_matches(requested: str, cls: Column) -> Column:
    """all keeps everything, a composite its members, else equality."""
    if requested == "all":
        return F.lit(True)
    return cls.isin(*COMPOSITE_ROADS[requested]) if requested in COMPOSITE_ROADS else cls == requested


def functional_score(cls: Column, ref: Column, bridge: Column, tunnel: Column, unpaved: Column, restricted: Column) -> Column:
    """Base of the class, bonuses and maluses, within 0 and 1."""
    base = F.coalesce(*[F.when(cls == k, F.lit(v)) for k, v in FUNCTIONAL_SCORES.items()], F.lit(0.0))
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    score = base + flag(ref != "", 0.05) + flag(F.coalesce(bridge, F.lit(False)) | F.coalesce(tunnel, F.lit(False)), 0.03) + flag(unpaved, -0.10) + flag(restricted, -0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def place_matches(tags: Column, place: str) -> Column:
    """`all` means any row with a population tag; else the place tag, or an administrative boundary of the type's level."""
    if place == "all":
        return has(tags, "population")
    values, level = PLACES[place]
    out = F.coalesce(tags["place"].isin(*values), F.lit(False))
    if level is not None:
        out = out | F.coalesce((tags["boundary"] == "administrative") & (tags["admin_level"] == level), F.lit(False))
    return out


def exposure(value: Column) -> Column:
    """high from 35, medium from 15, else low."""
    return F.when(value >= 35, "high").when(value >= 15, "medium").otherwise("low")
