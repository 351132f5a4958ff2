"""Composed analyses: the operator chains that are asked for by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoframe.operators import aggregate as A
from cartoframe.operators import catalog, extracts, grid, importance, network, quality, ranking, transit, ways
from cartoframe.operators import distance as D
from cartoframe.operators import filters as T
from cartoframe.runtime import Scratch
from cartoframe.sources import diffs, handles, pages, pbf


def amenity_heatmap(layer: DataFrame, spec: str, cell_km: float = 10.0) -> DataFrame:
    """Filter by a tag spec, then count by cell."""
    return grid.heat_cells(layer.where(T.minispec(spec)), cell_km)


def continent_heatmap(layer: DataFrame, regions: DataFrame, under: str, spec: str, cell_km: float = 25.0, region: str = "region") -> DataFrame:
    """The finest regions below one, their features, filtered and binned in one job: the region is a column, not a loop."""
    chosen = catalog.subregion_leaves(regions, under).select(F.col("path").alias(region))
    return amenity_heatmap(layer.join(chosen, region, "left_semi"), spec, cell_km)


def places_beyond_reach(places: DataFrame, facilities: DataFrame, km: float, min_population: int = 0) -> DataFrame:
    """Populated places without a facility in reach."""
    return D.beyond_distance(T.populated_places(places, "all", min_population), facilities, km, "km", key="feature_id")


def cities_by_zoom(places: DataFrame, tiers=ranking.TIERS) -> DataFrame:
    return ranking.tier_cities(T.populated_places(places, "all", 1).where("lon is not null"), tiers)


def cities_by_zoom_tiled(places: DataFrame, tiers=ranking.TIERS, max_zoom: int = 10) -> DataFrame:
    c = cities_by_zoom(places, tiers)
    return grid.tiles(c, min(z for _, z in tiers), max_zoom)


def city_routes_by_population(places: DataFrame, edges: DataFrame, nodes: DataFrame, n: int, key: str = "feature_id") -> DataFrame:
    """Lines between the n most populous places on the network."""
    top = ranking.top_by_population(places, n, key).select(F.col(key).alias("point_id"), "lon", "lat")
    return network.route_layer(top, edges, nodes)


def analyze_parks(layer: DataFrame) -> DataFrame:
    return A.park_stats(T.parks(layer))


def national_parks(layer: DataFrame) -> DataFrame:
    return A.park_stats(T.parks(layer, "national"))


def large_cities(layer: DataFrame, min_population: int = 100_000) -> DataFrame:
    return T.filter_by_population(layer, "city", "gte", min_population)


def discover_cities_and_towns(layer: DataFrame) -> DataFrame:
    return A.merge_layers(T.filter_by_population(layer, "city").withColumn("kind", F.lit("city")), T.filter_by_population(layer, "town").withColumn("kind", F.lit("town")))


def city_analysis(layer: DataFrame) -> DataFrame:
    return A.population_stats(T.filter_by_population(layer, "city"))


def transport_overview(layer: DataFrame, modes: tuple[str, ...] = ("bicycle", "hiking", "train", "bus")) -> DataFrame:
    """mode, routes for each mode, one pass."""
    modes_of = F.array_compact(F.array(*[F.when(F.coalesce(F.col("tags")["route"].isin(*T.ROUTE_MODES[m]), F.lit(False)), m) for m in modes]))
    return layer.withColumn("mode", F.explode(modes_of)).groupBy("mode").agg(F.count(F.lit(1)).alias("routes"))


def routes_with_stats(layer: DataFrame, mode: str, network_level: str = "*") -> DataFrame:
    return A.route_stats(T.routes_by_type(layer, mode, network_level))


def state_boundaries_with_stats(layer: DataFrame) -> DataFrame:
    return T.admin_boundaries(layer, "state").agg(F.count(F.lit(1)).alias("boundaries"))


def validate_and_summarize(nodes: DataFrame, ways_: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    return quality.summary(quality.verify_all(nodes, ways_, relations))


def transit_accessibility(feed: dict[str, DataFrame], features: DataFrame, threshold_m: float = 400.0, key: str = "feature_id") -> DataFrame:
    """Features by band of their distance to a stop."""
    return D.accessibility_bands(features, transit.stops(feed), threshold_m, key=key).groupBy("access").agg(F.count(F.lit(1)).alias("n"))


def high_routes(routes: DataFrame, points: DataFrame, dem: DataFrame, least: float) -> DataFrame:
    """Extract, enrich with a raster, filter by height."""
    return ways.high_routes(routes, ways.elevation_profile(ways.with_elevation(points, dem)), least)


def climbing_routes(routes: DataFrame, points: DataFrame, dem: DataFrame, least_gain: float) -> DataFrame:
    return ways.climbing_routes(routes, ways.elevation_profile(ways.with_elevation(points, dem)), least_gain)


def school_air_quality(sites: DataFrame, stations: DataFrame, max_km: float) -> DataFrame:
    return A.exposure_stats(D.exposure_join(sites, stations, max_km, key="feature_id", station_key="ref_id"))


def clip_and_extract(layer: DataFrame, box: tuple[float, float, float, float], spec: str) -> DataFrame:
    return T.clip_bbox(layer, *box).where(T.minispec(spec))


def regional_analysis(layer: DataFrame, region: str) -> DataFrame:
    """Amenities of every region by category."""
    return T.amenities(layer).groupBy(region, "category").agg(F.count(F.lit(1)).alias("n"))


def route_map(layer: DataFrame, mode: str, folder: str, network_level: str = "*", title: str | None = None) -> str:
    """The routes of a mode as a map; returns its page."""
    return pages.render_map({mode: T.routes_by_type(layer, mode, network_level)}, folder, title or f"{mode.capitalize()} routes")


def national_cycle_network(layer: DataFrame) -> DataFrame:
    """Cycle routes of the national network."""
    return T.routes_by_type(layer, "bicycle", "ncn")


def elevation_map(routes: DataFrame, points: DataFrame, dem: DataFrame, least: float, folder: str) -> str:
    return pages.render_map({f"above {least:g}": high_routes(routes, points, dem, least)}, folder, "High routes")


def cities_and_routes_by_zoom(places: DataFrame, roads: DataFrame, scores: DataFrame, tiers=ranking.TIERS) -> tuple[DataFrame, DataFrame]:
    """(places with the zoom they appear at, edges with theirs)"""
    return cities_by_zoom(places, tiers), importance.reveal(scores).join(roads, "edge_id")


def across_subregions(layers: DataFrame, regions: DataFrame, under: str, analysis: Callable[[DataFrame], DataFrame], region: str = "region") -> DataFrame:
    """An analysis of all finest regions below one, in one job: the region is a column, not a loop."""
    chosen = catalog.subregion_leaves(regions, under).select(F.col("path").alias(region))
    return analysis(layers.join(chosen, region, "left_semi"))


def transit_analysis(feed: dict[str, DataFrame]) -> DataFrame:
    return transit.report(feed)


def refresh_extract(spark: SparkSession, extract: str, updates: str, out: str) -> tuple[int | None, int]:
    """Rolls an extract forward by all change files of a replication folder, in one pass; (last sequence, elements)."""
    changed = extracts.apply_diffs(pbf.read_pbf(spark, extract), diffs.read_changes(spark, updates))
    pbf.write_pbf(changed, out)
    return diffs.read_state(spark, updates)[0], pbf.read_pbf(spark, out).count()


def build_region_extracts(elements: DataFrame, areas: DataFrame, root: str) -> list[str]:
    """root/<region>-latest.osm.pbf of every region, cut in one pass; returns the regions."""
    cut = Scratch(elements.sparkSession, "cut").table(extracts.cut_regions(elements, areas))
    names = sorted(r[0] for r in areas.select("region").distinct().collect())
    for name in names:
        pbf.write_pbf(cut.where(F.col("region") == name).drop("region"), f"{root}/{name}-latest.osm.pbf")
    return names


#: Analyses of one category's layer that run on any source: name -> (category, analysis).
ON_SOURCES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "bicycle_routes": ("routes", lambda df: T.routes_by_type(df, "bicycle")),
    "hiking_trails": ("routes", lambda df: T.routes_by_type(df, "hiking")),
    "national_cycle_network": ("routes", national_cycle_network),
    "analyze_amenities": ("amenities", lambda df: A.amenity_stats(T.amenities(df))),
    "healthcare": ("amenities", lambda df: T.amenities(df, "healthcare")),
    "major_roads": ("roads", lambda df: T.roads(df, "major")),
    "analyze_parks": ("parks", lambda df: A.park_stats(T.parks(df.withColumn("area_km2", F.col("area_km2") if "area_km2" in df.columns else F.lit(0.0))))),
    "large_cities": ("population", large_cities),
    "discover_cities_and_towns": ("population", discover_cities_and_towns),
    "city_analysis": ("population", city_analysis),
    "buildings": ("buildings", T.buildings),
    "state_boundaries": ("boundaries", lambda df: T.admin_boundaries(df, "state")),
    "transport_overview": ("routes", transport_overview),
}


def run_on(spark: SparkSession, name: str, handle: handles.Handle) -> DataFrame:
    """A composed analysis on a source: an extract, a layer file, a table, a columnar or a relational source."""
    category, analysis = ON_SOURCES[name]
    layer = handles.open_layer(spark, handle, category)
    return analysis(layer if "feature_id" in layer.columns else layer.withColumn("feature_id", F.col("id" if "id" in layer.columns else "osm_id")))


#: Operators and analyses by name, for callers that look them up.
REGISTRY: dict[str, Callable] = {
    "within_distance": D.within_distance, "beyond_distance": D.beyond_distance, "nearest": D.nearest_annotated, "k_nearest": D.k_nearest, "nearest_stops": D.nearest_stops, "stop_accessibility": D.accessibility_bands, "exposure": D.exposure_join, "plan_city_pairs": D.plan_city_pairs,
    "merge_layers": A.merge_layers, "summarize": A.summarize, "dissolve": A.dissolve, "union": A.union_layers, "amenity_statistics": A.amenity_stats, "building_statistics": A.building_stats, "park_statistics": A.park_stats, "road_statistics": A.road_stats, "route_statistics": A.route_stats, "population_statistics": A.population_stats, "exposure_statistics": A.exposure_stats,
    "filter_by_radius": T.filter_by_radius, "filter_by_population": T.filter_by_population, "amenities": T.amenities, "buildings": T.buildings, "parks": T.parks, "roads": T.roads, "routes": T.routes_by_type, "populated_places": T.populated_places, "clip_bbox": T.clip_bbox, "clip_polygon": T.clip_polygon,
    "top_n_by_population": ranking.top_by_population, "top_cities": ranking.top_cities, "tier_cities": ranking.tier_cities, "split_tiers": ranking.split_tiers, "heat_map": grid.heat_cells, "coverage_gaps": grid.coverage, "route_density": grid.route_density, "tiles": grid.tiles,
    "verify_all": quality.verify_all, "verify_layer": quality.verify_layer, "require_fresh": quality.require_fresh, "transit_report": transit.report, "transit_frequency": transit.frequency, "transit_routes": transit.route_lines, "transit_stops": transit.stops,
    "build_network": network.build_by_nodes, "build_network_by_coordinates": network.build_by_coordinates, "approx_route": network.approx_route, "route_matrix": network.route_matrix, "route_layer": network.route_layer, "isochrone": network.isochrone, "logical_graph": network.logical_edges,
    "resolve_regions": catalog.resolve, "subregions": catalog.subregion_leaves, "geocode": catalog.geocode, "reverse_geocode": catalog.reverse_geocode, "resolve_tag": catalog.match_vocabulary, "inventory": catalog.inventory,
    "amenity_heatmap": amenity_heatmap, "continent_heatmap": continent_heatmap, "places_beyond_reach": places_beyond_reach, "cities_by_zoom": cities_by_zoom, "city_routes_by_population": city_routes_by_population, "transport_overview": transport_overview, "transit_accessibility": transit_accessibility, "school_air_quality": school_air_quality, "clip_and_extract": clip_and_extract,
}
