"""Emergency readiness of regions: cities, facilities near them by road, scores, ranking.

All regions and cities are rows of one pipeline: what the analysis of one city does
is joins and aggregations on its id.  A region without cities, without facilities or
without roads is in the ranking as excluded, with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoframe.operators import distance as D
from cartoframe.operators import filters as T
from cartoframe.operators import network, ranking, readiness
from cartoframe.runtime import Scratch

# The amenity of each kind of facility; circles that facilities are counted in.
FACILITIES = {"hospitals": "hospital", "fire": "fire_station", "police": "police"}
CIRCLES_KM = (10, 25, 50)


@dataclass(frozen=True)
class Atlas:
    cities: DataFrame
    metrics: DataFrame
    regions: DataFrame


def facility_sets(amenities: DataFrame) -> DataFrame:
    """facility_id, category, lon, lat of the amenities (feature_id, tags, lon, lat) that are facilities."""
    kind = F.coalesce(*[F.when(F.col("tags")["amenity"] == v, F.lit(k)) for k, v in FACILITIES.items()])
    return amenities.where("lon is not null and lat is not null").select(F.col("feature_id").alias("facility_id"), kind.alias("category"), "lon", "lat").where("category is not null")


def route_candidates(cities: DataFrame, facilities: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """city_id, category, facility_id, km: the way by road to each of the k nearest facilities of each kind; -1 if there is none.

    cities: city_id, lon, lat.  A city and a facility are on the network where its
    nearest node is; the way between the nodes counts.
    """
    scratch = Scratch(cities.sparkSession, "candidates")
    at = cities.select("city_id", "lon", "lat")
    near = None
    for category in readiness.WEIGHTS:
        own = D.k_nearest(at, facilities.where(F.col("category") == category), k, "city_id", "facility_id").select("city_id", F.lit(category).alias("category"), F.col("ref.facility_id").alias("facility_id"))
        near = own if near is None else near.union(own)
    near = scratch.table(near)
    city_node = network.nearest_node(at, nodes, "city_id").select("city_id", F.col("node_id").alias("source"))
    some = facilities.join(near.select("facility_id").distinct(), "facility_id", "left_semi").select("facility_id", "lon", "lat").dropDuplicates(["facility_id"])
    facility_node = network.nearest_node(some, nodes, "facility_id").select("facility_id", F.col("node_id").alias("node"))
    pairs = scratch.table(near.join(city_node, "city_id", "left").join(facility_node, "facility_id", "left"))
    costs = network.shortest_paths(edges, pairs.where("source is not null").select("source").distinct())
    return pairs.join(costs, ["source", "node"], "left").select("city_id", "category", "facility_id", F.coalesce(F.col("cost") / 1000, F.lit(-1.0)).alias("km"))


def city_metrics(cities: DataFrame, facilities: DataFrame, routed: DataFrame) -> DataFrame:
    """city_id, category, nearest_km, median_km (of the ways that there are), within_10/25/50 (as the crow flies), facilities, per_100k, unroutable, component."""
    ways = routed.groupBy("city_id", "category").agg(F.array_sort(F.filter(F.collect_list("km"), lambda x: x >= 0)).alias("d"), F.count(F.lit(1)).alias("tried"))
    ways = ways.select("city_id", "category", F.round(F.get("d", F.lit(0)), 2).alias("nearest_km"), F.round(F.get("d", F.floor(F.size("d") / 2).cast("int")), 2).alias("median_km"), ((F.size("d") == 0) & (F.col("tried") > 0)).alias("unroutable"))
    circles = D.within(cities.select("city_id", "lon", "lat"), facilities, float(max(CIRCLES_KM))).groupBy("city_id", F.col("ref.category").alias("category")).agg(*[F.sum((F.col("distance_km") <= r).cast("long")).alias(f"within_{r}") for r in CIRCLES_KM])
    totals = facilities.groupBy("category").agg(F.count(F.lit(1)).alias("facilities"))
    kinds = F.explode(F.array(*map(F.lit, readiness.WEIGHTS)))
    every = cities.select("city_id", "population", kinds.alias("category"))
    out = every.join(ways, ["city_id", "category"], "left").join(circles, ["city_id", "category"], "left").join(totals, "category", "left")
    out = out.withColumn("facilities", F.coalesce("facilities", F.lit(0))).withColumn("unroutable", F.coalesce("unroutable", F.lit(False)))
    for r in CIRCLES_KM:
        out = out.withColumn(f"within_{r}", F.coalesce(f"within_{r}", F.lit(0)))
    out = out.withColumn("per_100k", F.when(F.col("population") > 0, F.round(F.col("facilities") * 100_000.0 / F.col("population"), 2)))
    return readiness.component(out).drop("population")


def emergency_atlas(places: DataFrame, amenities: DataFrame, edges: DataFrame, nodes: DataFrame, regions: DataFrame, max_cities: int = 10, k: int = 5, min_population: int = 25_000, weights: dict[str, float] | None = None, spacing_km: float = 5.0) -> Atlas:
    """Scores of cities and regions, ranked.

    places: feature_id, region, lon, lat, tags; regions: region, all that are asked
    for.  Categories without a facility anywhere do not count.
    """
    scratch = Scratch(places.sparkSession, "atlas")
    top = ranking.top_cities(places, max_cities, min_population, "feature_id", "region", spacing_km)
    cities = scratch.table(top.select(F.col("feature_id").alias("city_id"), "region", "name", "lon", "lat", F.col("population_value").alias("population")))
    facilities = scratch.table(facility_sets(amenities))
    routed = route_candidates(cities, facilities, edges, nodes, k)
    metrics = scratch.table(city_metrics(cities, facilities, routed))
    there = metrics.where("facilities > 0")
    scored = cities.join(readiness.city_scores(there, weights or readiness.WEIGHTS), "city_id")
    scored = scratch.table(scored)
    good = readiness.region_scores(scored)
    routable = there.join(cities.select("city_id", "region"), "city_id").groupBy("region").agg(F.min("unroutable").alias("lost"))
    fate = regions.select("region").distinct().join(good.select("region", F.lit(True).alias("ok")), "region", "left").join(routable, "region", "left")
    failed = fate.where("ok is null or lost").select("region", F.when(F.col("lost"), "empty network").otherwise("no cities").alias("error"))
    ranked = readiness.rank_regions(good.join(failed.select("region"), "region", "left_anti"), failed)
    return Atlas(scored, metrics, ranked)


def amenities_of(layer: DataFrame) -> DataFrame:
    """The facilities' layer of a tagged one."""
    return T.amenities(layer)
