"""Grouped aggregates and the statistics family.  All are built-in aggregates with map-side combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoframe.functions import geo as G


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def tag_group(tags: Column, key: str) -> Column:
    """A missing tag groups as an empty string, an explicit null as None."""
    return F.when(~F.coalesce(F.map_contains_key(tags, key), F.lit(False)), "").otherwise(F.coalesce(tags[key], F.lit("None")))


def summarize(df: DataFrame, op: str = "count", measure: Column | None = None, group: Column | None = None) -> DataFrame:
    """group, value, n: count, sum, avg, min or max of what parses as a number.

    avg divides by all rows of the group, also those that do not parse; min and
    max are null if none does.
    """
    if op not in ("count", "sum", "avg", "min", "max"):
        raise ValueError(f"op: count, sum, avg, min or max, not {op}")
    if op != "count" and measure is None:
        raise ValueError(f"{op} needs a measure")
    x = measure.try_cast("double") if measure is not None else None
    n = F.count(F.lit(1))
    value = {"count": lambda: n.cast("double"), "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "avg": lambda: F.coalesce(F.sum(x), F.lit(0.0)) / n, "min": lambda: F.min(x), "max": lambda: F.max(x)}[op]()
    return df.groupBy((group if group is not None else F.lit("")).alias("group")).agg(value.alias("value"), n.alias("n"))


def headline(summary: DataFrame) -> DataFrame:
    """The group of the largest value, ties to the smaller name."""
    return summary.orderBy(F.desc_nulls_last("value"), "group").limit(1)


def summarize_levels(df: DataFrame, keys: list[str], measure: str, how: str = "rollup") -> DataFrame:
    """Extension: rollup or cube totals of a measure."""
    grouped = {"rollup": df.rollup, "cube": df.cube}[how](*keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))


def dissolve(df: DataFrame, key: Column, coords: str = "coords") -> DataFrame:
    """group, dissolved_count, box and parts: the group's geometries as one multi-geometry.

    Parts of one group are gathered, so this is for layers whose groups fit a
    task; dissolve_counts() gives counts and boxes for any size.
    """
    return df.where(F.col(coords).isNotNull() & (F.size(coords) > 0)).groupBy(key.alias("group")).agg(F.count(F.lit(1)).alias("dissolved_count"), F.collect_list(coords).alias("parts"))


def dissolve_counts(df: DataFrame, key: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(key.alias("group")).agg(F.count(F.lit(1)).alias("dissolved_count"), F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"), F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"))


def union_layers(*layers: DataFrame) -> DataFrame:
    """One row over all layers: merged_count and the box of everything located."""
    return dissolve_counts(merge_layers(*layers), F.lit("")).select(F.col("dissolved_count").alias("merged_count"), "min_lon", "min_lat", "max_lon", "max_lat")


def merge_layers(*layers: DataFrame | None) -> DataFrame:
    """All rows of all layers; absent layers are skipped, absent columns are null, nothing is deduplicated."""
    there = [x for x in layers if x is not None]
    if not there:
        raise ValueError("no layer to merge")
    out = there[0]
    for x in there[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def amenity_stats(df: DataFrame, tags: str = "tags") -> DataFrame:
    t = F.col(tags)
    kinds = ("food", "shopping", "services", "healthcare", "education", "entertainment", "transport", "other")
    return df.agg(F.count(F.lit(1)).alias("total_amenities"), *[_count(F.col("category") == k).alias(k) for k in kinds], _count(_filled(t["name"])).alias("with_name"), _count(_filled(t["opening_hours"])).alias("with_opening_hours"))


def building_stats(df: DataFrame) -> DataFrame:
    kinds = ("residential", "commercial", "industrial", "retail", "office", "public", "religious", "other")
    some = F.col("levels") > 0
    return df.agg(F.count(F.lit(1)).alias("total_buildings"), *[_count(F.col("building_type") == k).alias(k) for k in kinds], F.round(F.coalesce(F.sum("area_m2"), F.lit(0.0)) / 1e6, 4).alias("total_area_km2"), F.coalesce(F.avg(F.when(some, F.col("levels"))), F.lit(0.0)).alias("avg_levels"), _count(F.col("height").isNotNull()).alias("with_height"))


def park_stats(df: DataFrame, order: str = "feature_id") -> DataFrame:
    first = F.min_by(F.when(F.col("park_type") != "", F.col("park_type")), F.when(F.col("park_type") != "", F.col(order)))
    n = {"national_parks": "national", "state_parks": "state", "nature_reserves": "nature_reserve"}
    return df.agg(F.count(F.lit(1)).alias("total_parks"), F.round(F.coalesce(F.sum("area_km2"), F.lit(0.0)), 2).alias("total_area_km2"), *[_count(F.col("park_type") == v).alias(k) for k, v in n.items()], _count(~F.coalesce(F.col("park_type").isin(*n.values()), F.lit(False))).alias("other_protected"), F.coalesce(first, F.lit("mixed")).alias("park_type"))


def road_stats(df: DataFrame) -> DataFrame:
    """Kilometres by class (classes without a column go to other_km), counts of filled attributes."""
    own = ("motorway", "primary", "secondary", "tertiary", "residential")
    km = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("length_km"))), F.lit(0.0)), 2)
    cls = F.col("road_class")
    return df.agg(F.count(F.lit(1)).alias("total_roads"), km(F.lit(True)).alias("total_length_km"), *[km(cls == c).alias(f"{c}_km") for c in own], km(~F.coalesce(cls.isin(*own), F.lit(False))).alias("other_km"), _count(F.col("maxspeed") > 0).alias("with_speed_limit"), _count(_filled(F.col("surface"))).alias("with_surface"), _count(F.col("lanes") > 0).alias("with_lanes"), _count(F.col("oneway")).alias("one_way_count"))


def roads_summary(df: DataFrame) -> DataFrame:
    """What the class and speed filters report: count, kilometres, roads with a limit."""
    return df.agg(F.count(F.lit(1)).alias("feature_count"), F.round(F.coalesce(F.sum("length_km"), F.lit(0.0)), 2).alias("total_length_km"), _count(F.col("maxspeed") > 0).alias("with_speed_limit"))


def route_stats(df: DataFrame) -> DataFrame:
    kind = F.col("feature_type")
    km = F.when((kind == "way") & (F.col("gtype") == "LineString"), G.line_length(F.col("coords")))
    return df.agg(_count(kind == "route").alias("route_count"), F.coalesce(F.sum(km), F.lit(0.0)).alias("total_length_km"), _count(kind == "infrastructure").alias("infrastructure_count"))


def population_stats(df: DataFrame, column: str = "population_value") -> DataFrame:
    """Over parsed populations above 0; the mean is an integer, rounded down."""
    x = F.when(F.col(column) > 0, F.col(column))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.agg(F.count(x).alias("total_places"), zero(F.sum(x)).alias("total_population"), zero(F.min(x)).alias("min_population"), zero(F.max(x)).alias("max_population"), F.when(F.count(x) > 0, F.floor(F.sum(x) / F.count(x))).otherwise(0).cast("long").alias("avg_population"))


def exposure_stats(df: DataFrame) -> DataFrame:
    e = F.col("exposure")
    base = df.agg(_count(e.isin("high", "medium", "low")).alias("total_sites"), F.count("pm25").alias("matched_sites"), *[_count(e == k).alias(f"{k}_count") for k in ("high", "medium", "low")], *[F.coalesce(f("pm25"), F.lit(0.0)).alias(f"{n}_pm25") for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))])
    pct = lambda k: F.when(F.col("total_sites") > 0, F.round(F.col(f"{k}_count") / F.col("total_sites") * 100, 1)).otherwise(0.0).alias(f"{k}_pct")
    avg = F.when(F.col("matched_sites") > 0, F.round(F.col("sum_pm25") / F.col("matched_sites"), 2)).otherwise(0.0).alias("avg_pm25")
    return base.select("total_sites", "matched_sites", "high_count", "medium_count", "low_count", pct("high"), pct("medium"), pct("low"), avg, F.round("min_pm25", 2).alias("min_pm25"), F.round("max_pm25", 2).alias("max_pm25"))


# Spans in degrees beyond which a zoom level is taken.
ZOOM_SPANS = ((100, 2), (50, 3), (20, 4), (10, 5), (5, 6), (2, 7), (1, 8), (0.5, 9), (0.2, 10), (0.1, 11), (0.05, 12))


def bounds_and_zoom(df: DataFrame) -> DataFrame:
    """Box, centre and zoom level; without anything located, level 4."""
    box = df.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    span = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    zoom = None
    for limit, z in ZOOM_SPANS:
        zoom = F.when(span > limit, z) if zoom is None else zoom.when(span > limit, z)
    return box.select("*", ((F.col("min_lon") + F.col("max_lon")) / 2).alias("centre_lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("centre_lat"), F.when(span.isNull(), 4).otherwise(zoom.otherwise(13)).cast("int").alias("zoom"))
