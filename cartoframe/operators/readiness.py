"""Emergency readiness: category metrics, city components, region scores, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoframe.operators import distance as D

# Weights, and the distance at which a component reaches 0.
WEIGHTS = {"hospitals": 0.25, "fire": 0.25, "police": 0.25, "shelters": 0.25}
ZERO_KM = 50.0


def require_categories(facilities: DataFrame) -> DataFrame:
    """Categories that have facilities; none at all is an error.  facilities: category, ..."""
    out = facilities.groupBy("category").agg(F.count(F.lit(1)).alias("facilities"))
    if not out.limit(1).count():
        raise ValueError("every facility layer is empty")
    return out


def category_metrics(distances: DataFrame, cities: DataFrame) -> DataFrame:
    """city_id, category, nearest_km, median_km, facilities, per_100k.

    distances: city_id, category, km (negative: no route).  The median is the
    element at half the length of the sorted list.
    """
    ok = F.sort_array(F.collect_list(F.when(F.col("km") >= 0, F.col("km"))))
    g = distances.groupBy("city_id", "category").agg(ok.alias("d"), F.count(F.lit(1)).alias("facilities"))
    g = g.select("city_id", "category", F.round(F.get("d", F.lit(0)), 2).alias("nearest_km"), F.round(F.get("d", F.floor(F.size("d") / 2).cast("int")), 2).alias("median_km"), "facilities")
    return g.join(cities.select("city_id", "population"), "city_id").select(*g.columns, _per_100k().alias("per_100k"))


def metrics_within(cities: DataFrame, facilities: DataFrame, max_km: float) -> DataFrame:
    """category_metrics of great-circle distances up to max_km.  cities: city_id, population, lon, lat; facilities: category, lon, lat.

    Cities at one place have the same distances, which are found once for the place.
    """
    places = cities.groupBy("lon", "lat").agg(F.min("city_id").alias("place"))
    pairs = D.within(places, facilities.select("category", "lon", "lat"), max_km).select(F.col("place").alias("city_id"), F.col("ref.category").alias("category"), F.col("distance_km").alias("km"))
    found = category_metrics(pairs, cities).drop("per_100k").withColumnRenamed("city_id", "place")
    every = cities.select("city_id", "population", "lon", "lat").join(places, ["lon", "lat"]).join(found, "place")
    return every.select("city_id", "category", "nearest_km", "median_km", "facilities", _per_100k().alias("per_100k"))


def _per_100k() -> Column:
    return F.when(F.col("population") > 0, F.round(F.col("facilities") * 100000.0 / F.col("population"), 2))


def component(df: DataFrame) -> DataFrame:
    """100 at the door, 0 from ZERO_KM on or without facilities."""
    return df.withColumn("component", F.when(F.col("nearest_km").isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1.0 - F.col("nearest_km") / ZERO_KM))), 1)))


def city_scores(components: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """city_id, score: the weighted mean over the categories that are present.  Halves of a tenth go up, whatever the order of the sums."""
    w = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in weights.items()])
    return components.withColumn("w", w).where("w is not null").groupBy("city_id").agg(F.round(F.round(F.sum(F.col("w") * F.col("component")) / F.sum("w"), 6), 1).alias("score"))


def region_scores(cities: DataFrame) -> DataFrame:
    """region, score, cities, best_city; cities: region, city_id, name, population, score.  Weighted by population, or plainly where there is none."""
    people = F.sum(F.coalesce("population", F.lit(0)))
    return cities.groupBy("region").agg(F.round(F.round(F.when(people > 0, F.sum(F.col("score") * F.coalesce("population", F.lit(0))) / people).otherwise(F.avg("score")), 6), 1).alias("score"), F.count(F.lit(1)).alias("cities"), F.max_by("name", F.struct("score", -F.col("city_id"))).alias("best_city"))


def rank_regions(scores: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Ranked by score (ties by name); failed regions follow without a rank, with their reason."""
    out = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "region"))).withColumn("reason", F.lit(None).cast("string"))
    if failed is None:
        return out
    low = F.lower(F.coalesce("error", F.lit("")))
    reason = F.when(low.contains("empty network"), "no routable major-road network").when(low.contains("no cities") | low.contains("empty"), "no qualifying cities").otherwise("analysis failed")
    return out.unionByName(failed.select("region", reason.alias("reason")), allowMissingColumns=True)
