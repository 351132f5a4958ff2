"""Ways: assembly from node references, lengths, elevation profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoframe.functions import geo as G

AREA_KEYS = ("building", "landuse", "natural", "leisure", "amenity", "area", "boundary", "place")
FEET = 3.28084


def assemble(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, coords, n_refs: refs (way_id, pos, node_id) with the coordinates of nodes (node_id, lon, lat), in order.

    References without a node are skipped; a way of fewer than two points is dropped.
    """
    found = refs.join(nodes.select("node_id", "lon", "lat"), "node_id", "left")
    grouped = found.groupBy("way_id").agg(F.count(F.lit(1)).alias("n_refs"), F.array_sort(F.collect_list(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("pos", "lon", "lat")))).alias("p"))
    return grouped.withColumn("coords", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))).where(F.size("coords") >= 2).select("way_id", "coords", "n_refs")


def geometry_type(coords: Column, tags: Column | None = None) -> Column:
    """A closed way with an area tag is a polygon, any other a line."""
    area = F.lit(False)
    if tags is not None:
        for k in AREA_KEYS:
            area = area | F.coalesce(F.map_contains_key(tags, k), F.lit(False))
    return F.when(G.is_closed(coords) & area, "Polygon").otherwise("LineString")


def elevation_profile(points: DataFrame, feet: bool = True) -> DataFrame:
    """way_id, min/max elevation, gain, loss from (way_id, pos, elevation in metres); points without elevation are skipped."""
    scale = FEET if feet else 1.0
    profile = points.where("elevation is not null").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("elevation").cast("double").alias("e")))), lambda x: x["e"] * scale).alias("e"))
    n = F.size("e")
    steps = F.zip_with(F.slice("e", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("e", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: b - a)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return profile.select("way_id", F.array_min("e").alias("min_elevation"), F.array_max("e").alias("max_elevation"), total(F.filter(steps, lambda d: d > 0)).alias("gain"), (-total(F.filter(steps, lambda d: d <= 0))).alias("loss"), n.cast("long").alias("n_points"))


def with_elevation(points: DataFrame, dem: DataFrame, cell: float = 1.0) -> DataFrame:
    """Points (lon, lat) with `elevation` of a raster table (tile_lon, tile_lat, elevation) of that cell size."""
    keyed = points.withColumn("tile_lon", F.floor(F.col("lon") / cell).cast("long")).withColumn("tile_lat", F.floor(F.col("lat") / cell).cast("long"))
    return keyed.join(dem, ["tile_lon", "tile_lat"], "left").drop("tile_lon", "tile_lat")


def elevation_tiles(min_lon: float, min_lat: float, max_lon: float, max_lat: float, spark) -> DataFrame:
    """Whole-degree tiles that a box touches."""
    row = spark.range(1).select(F.explode(F.sequence(F.floor(F.lit(min_lat)), F.floor(F.lit(max_lat)))).alias("tile_lat"))
    return row.select(F.explode(F.sequence(F.floor(F.lit(min_lon)), F.floor(F.lit(max_lon)))).alias("tile_lon"), "tile_lat")


def by_max_elevation(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("max_elevation") >= least)


def by_min_elevation(df: DataFrame, most: float) -> DataFrame:
    return df.where(F.col("min_elevation") <= most)


def by_gain(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("gain") >= least)


def by_elevation_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """Profiles that overlap the range."""
    return df.where((F.col("min_elevation") <= high) & (F.col("max_elevation") >= low))


def high_routes(routes: DataFrame, profiles: DataFrame, least: float) -> DataFrame:
    """Extract, enrich, filter: routes whose profile reaches a height."""
    return by_max_elevation(routes.join(profiles, "way_id"), least)


def climbing_routes(routes: DataFrame, profiles: DataFrame, least_gain: float) -> DataFrame:
    return by_gain(routes.join(profiles, "way_id"), least_gain)
