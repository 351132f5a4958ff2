"""Registered queries: filters, joins, aggregates, grids, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoframe.functions import geo as G
from cartoframe.functions import parse as P
from cartoframe.operators import aggregate as A
from cartoframe.operators import distance as D
from cartoframe.operators import filters as T
from cartoframe.operators import grid, ranking
from cartoframe.plans.layers import ctes, hav, layer, tagged
from cartoframe.plans.registry import query


def _tagged(spark, d):
    return tagged(layer(spark, d, "geo_tagged"), "amenity", "shop", "tourism", "opening_hours", "name=pname")


def _places(spark, d):
    return tagged(layer(spark, d, "geo_places"), "place", "population", "name")


# --- filters ---------------------------------------------------------------------------------------


@query("tag_exact", ctes("geo_tagged") + " SELECT feature_id, amenity FROM geo_tagged WHERE amenity = 'cafe'")
def _(spark, d):
    return _tagged(spark, d).where(T.has_tag("amenity", "cafe")).select("feature_id", "amenity")


@query("tag_present", ctes("geo_tagged") + " SELECT feature_id, shop FROM geo_tagged WHERE shop IS NOT NULL")
def _(spark, d):
    return _tagged(spark, d).where(T.has_tag("shop")).select("feature_id", "shop")


@query("tag_prefix", ctes("geo_tagged") + " SELECT feature_id, pname FROM geo_tagged WHERE starts_with(pname, 'blue')")
def _(spark, d):
    return _tagged(spark, d).where(T.tag_prefix("name", "blue")).select("feature_id", "pname")


@query("tag_contains", ctes("geo_tagged") + " SELECT feature_id, amenity FROM geo_tagged WHERE contains(lower(amenity), 'est')")
def _(spark, d):
    return _tagged(spark, d).where(T.tag_contains("amenity", "EST")).select("feature_id", "amenity")


@query("tag_regex", ctes("geo_tagged") + " SELECT feature_id, amenity FROM geo_tagged WHERE regexp_matches(amenity, '^(s|h).*l$')")
def _(spark, d):
    return _tagged(spark, d).where(T.tag_regex("amenity", "^(s|h).*l$")).select("feature_id", "amenity")


@query("tag_minispec", ctes("geo_tagged") + " SELECT feature_id FROM geo_tagged WHERE amenity = 'cafe' OR contains(lower(tourism), 'ote')")
def _(spark, d):
    return _tagged(spark, d).where(T.minispec("amenity=cafe | tourism~OTE")).select("feature_id")


@query("tag_query", "SELECT o_orderkey AS id, 'way' AS osm_type FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT p_partkey, 'node' FROM part WHERE p_size > 40")
def _(spark, d):
    ways = tagged(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lit("way").alias("osm_type"), F.col("o_orderstatus").alias("s")), "status=s")
    nodes = tagged(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.lit("node").alias("osm_type"), F.when(F.col("p_size") > 40, "yes").alias("s")), "large=s")
    return ways.drop("s").union(nodes.drop("s")).where(T.tag_query("w/status=F,O n/large")).select("id", "osm_type")


@query("osm_type_filter", "SELECT o_orderkey AS id FROM orders")
def _(spark, d):
    ways = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lit("way").alias("osm_type"))
    nodes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.lit("node").alias("osm_type"))
    return T.osm_type(ways.union(nodes), "w").select("id")


_POP = """CASE WHEN p IS NULL THEN NULL WHEN contains(p, ',') AND NOT contains(p, '.') THEN replace(p, ',', '') WHEN regexp_matches(p, '^[^.,]*[.][0-9]{3}$') THEN replace(p, '.', '') ELSE p END"""
_POPULATION = f"""{ctes('geo_places')}, clean AS (SELECT *, regexp_replace(regexp_replace(trim(population), '^[~≈≅]+', ''), '[+]+$', '') AS p FROM geo_places),
parsed AS (SELECT *, try_cast(regexp_replace({_POP}, '[^0-9]', '', 'g') AS BIGINT) AS population_value FROM clean)"""


@query("population_filter", _POPULATION + " SELECT feature_id, population_value FROM parsed WHERE place = 'city' AND population_value >= 50000")
def _(spark, d):
    return T.filter_by_population(_places(spark, d), "city", "gte", 50000).select("feature_id", "population_value")


@query("population_range", _POPULATION + " SELECT feature_id, population_value FROM parsed WHERE population IS NOT NULL AND population_value BETWEEN 1000 AND 100000")
def _(spark, d):
    return T.filter_by_population(_places(spark, d), "all", "between", 1000, 100000).select("feature_id", "population_value")


@query("populated_places", ctes("geo_places") + " SELECT feature_id, try_cast(regexp_replace(population, '[^0-9]', '', 'g') AS BIGINT) AS population_value FROM geo_places WHERE place = 'town' AND try_cast(regexp_replace(population, '[^0-9]', '', 'g') AS BIGINT) >= 500")
def _(spark, d):
    return T.populated_places(_places(spark, d), "town", 500).select("feature_id", "population_value")


@query("population_topn", _POPULATION + " SELECT feature_id, coalesce(population_value, -1) AS population_value FROM parsed ORDER BY coalesce(population_value, -1) DESC, feature_id LIMIT 25")
def _(spark, d):
    return ranking.top_by_population(_places(spark, d), 25, "feature_id").select("feature_id", "population_value")


@query("population_stats", _POPULATION + " SELECT count(*) AS total_places, CAST(sum(population_value) AS BIGINT) AS total_population, min(population_value) AS min_population, max(population_value) AS max_population, CAST(floor(sum(population_value) / count(*)) AS BIGINT) AS avg_population FROM parsed WHERE population_value > 0")
def _(spark, d):
    return A.population_stats(_places(spark, d).withColumn("population_value", P.population(F.col("population"))))


@query("amenity_classes", ctes("geo_tagged") + """ SELECT CASE WHEN amenity IN ('restaurant', 'cafe') THEN 'food' WHEN amenity = 'hospital' THEN 'healthcare' WHEN amenity = 'school' THEN 'education' WHEN shop IS NOT NULL THEN 'shopping' WHEN tourism = 'hotel' THEN 'services' WHEN tourism = 'museum' THEN 'entertainment' ELSE 'other' END AS category, count(*) AS n
FROM geo_tagged WHERE amenity IS NOT NULL OR shop IS NOT NULL OR tourism IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return T.amenities(_tagged(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("amenity_search", ctes("geo_tagged") + " SELECT feature_id FROM geo_tagged WHERE (amenity IS NOT NULL OR shop IS NOT NULL OR tourism IS NOT NULL) AND regexp_matches(lower(pname), '^s.*(ring|bolt)$')")
def _(spark, d):
    return T.search_amenities(T.amenities(_tagged(spark, d)), "^S.*(RING|bolt)$").select("feature_id")


@query("amenity_preset", ctes("geo_tagged") + " SELECT feature_id FROM geo_tagged WHERE amenity IN ('restaurant', 'cafe')")
def _(spark, d):
    return T.amenity_preset(_tagged(spark, d), "food_and_drink").select("feature_id")


@query("amenity_stats", ctes("geo_tagged") + """, c AS (SELECT *, CASE WHEN amenity IN ('restaurant', 'cafe') THEN 'food' WHEN amenity = 'hospital' THEN 'healthcare' WHEN amenity = 'school' THEN 'education' WHEN shop IS NOT NULL THEN 'shopping' WHEN tourism = 'hotel' THEN 'services' WHEN tourism = 'museum' THEN 'entertainment' ELSE 'other' END AS category FROM geo_tagged WHERE amenity IS NOT NULL OR shop IS NOT NULL OR tourism IS NOT NULL)
SELECT count(*) AS total_amenities, count(*) FILTER (category = 'food') AS food, count(*) FILTER (category = 'shopping') AS shopping, count(*) FILTER (category = 'services') AS services, count(*) FILTER (category = 'healthcare') AS healthcare, count(*) FILTER (category = 'education') AS education, count(*) FILTER (category = 'entertainment') AS entertainment, count(*) FILTER (category = 'transport') AS transport, count(*) FILTER (category = 'other') AS other, count(*) FILTER (pname <> '') AS with_name, count(*) FILTER (opening_hours <> '') AS with_opening_hours FROM c""")
def _(spark, d):
    return A.amenity_stats(T.amenities(_tagged(spark, d)))


# --- distance joins --------------------------------------------------------------------------------

_PAIR = f"{ctes('geo_points', 'geo_refs')}, p AS (SELECT s.feature_id, s.lon AS slon, s.lat AS slat, s.name AS sname, r.ref_id, r.name AS rname, r.value, {hav('s.lon', 's.lat', 'r.lon', 'r.lat')} AS km FROM geo_points s, geo_refs r)"
_NEAR = _PAIR + ", n AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY km, ref_id) AS rn FROM p)"


def _points(spark, d):
    return layer(spark, d, "geo_points"), layer(spark, d, "geo_refs")


@query("within_distance", _NEAR + " SELECT feature_id, round(km*1000, 3) AS nearest_distance_m, round(km*1000/1000e0, 6) AS nearest_distance, rname AS nearest_ref_name FROM n WHERE rn = 1 AND km <= 25")
def _(spark, d):
    s, r = _points(spark, d)
    return D.within_distance(s.select("feature_id", "lon", "lat"), r, 25, "km", key="feature_id", ref_order="ref_id").drop("lon", "lat")


@query("within_pairs", _PAIR + " SELECT feature_id, ref_id, round(km, 6) AS km FROM p WHERE km <= 40")
def _(spark, d):
    s, r = _points(spark, d)
    return D.within(s.select("feature_id", "lon", "lat"), r.select("ref_id", "lon", "lat"), 40).select("feature_id", F.col("ref.ref_id").alias("ref_id"), F.round("distance_km", 6).alias("km"))


@query("beyond_distance", _PAIR + " SELECT feature_id FROM p GROUP BY feature_id HAVING min(km) > 25")
def _(spark, d):
    s, r = _points(spark, d)
    return D.beyond_distance(s, r, 25, "km", key="feature_id").select("feature_id")


@query("nearest", _NEAR + " SELECT feature_id, ref_id, round(km, 6) AS km FROM n WHERE rn = 1")
def _(spark, d):
    s, r = _points(spark, d)
    return D.nearest(s.select("feature_id", "lon", "lat"), r, "feature_id", "ref_id").select("feature_id", F.col("ref.ref_id").alias("ref_id"), F.round("distance_km", 6).alias("km"))


@query("nearest_left_capped", _NEAR + " SELECT feature_id, CASE WHEN km <= 12*1.609344 THEN round(km*1000/1609.344, 6) END AS nearest_distance, CASE WHEN km <= 12*1.609344 THEN rname END AS nearest_ref_name FROM n WHERE rn = 1")
def _(spark, d):
    s, r = _points(spark, d)
    return D.nearest_annotated(s.select("feature_id", "lon", "lat"), r, 12, "mi", key="feature_id", ref_order="ref_id").select("feature_id", "nearest_distance", "nearest_ref_name")


@query("knn", _NEAR + " SELECT feature_id, CAST(rn AS INTEGER) AS rank, ref_id, round(km, 6) AS km FROM n WHERE rn <= 5")
def _(spark, d):
    s, r = _points(spark, d)
    return D.k_nearest(s.select("feature_id", "lon", "lat"), r.select("ref_id", "lon", "lat"), 5, "feature_id", "ref_id").select("feature_id", "rank", F.col("ref.ref_id").alias("ref_id"), F.round("distance_km", 6).alias("km"))


@query("knn_buckets", _PAIR + " SELECT feature_id, count(*) FILTER (km <= 10) AS within_10, count(*) FILTER (km <= 25) AS within_25, count(*) FILTER (km <= 50) AS within_50 FROM p GROUP BY feature_id")
def _(spark, d):
    s, r = _points(spark, d)
    return D.candidates_with_buckets(s, r, 5, key="feature_id", ref_key="ref_id")[1]


@query("nearest_stops", _NEAR + " SELECT feature_id, CASE WHEN km*1000 <= 20000 THEN CAST(ref_id AS VARCHAR) ELSE '' END AS nearest_stop_id, CASE WHEN km*1000 <= 20000 THEN rname ELSE '' END AS nearest_stop_name, CASE WHEN km*1000 <= 20000 THEN round(km*1000, 1) ELSE -1e0 END AS distance_m FROM n WHERE rn = 1")
def _(spark, d):
    s, r = _points(spark, d)
    return D.nearest_stops(s.select("feature_id", "lon", "lat"), r.withColumnsRenamed({"ref_id": "stop_id", "name": "stop_name"}), 20000, key="feature_id").drop("lon", "lat")


@query("exposure_join", _NEAR + " SELECT feature_id, rname AS nearest_station, round(km, 2) AS distance_km, value/200 AS pm25, CASE WHEN value/200 >= 35 THEN 'high' WHEN value/200 >= 15 THEN 'medium' ELSE 'low' END AS exposure FROM n WHERE rn = 1 AND km <= 30")
def _(spark, d):
    s, r = _points(spark, d)
    return D.exposure_join(s.select("feature_id", "lon", "lat"), r.withColumn("value", F.col("value") / 200), 30, key="feature_id", station_key="ref_id").drop("lon", "lat")


@query("exposure_stats", _NEAR + """, x AS (SELECT value/200 AS v FROM n WHERE rn = 1 AND km <= 30), e AS (SELECT count(*) FILTER (v >= 35) AS h, count(*) FILTER (v >= 15 AND v < 35) AS m, count(*) FILTER (v < 15) AS l, count(*) AS t, sum(v) AS s, min(v) AS lo, max(v) AS hi FROM x)
SELECT t AS total_sites, t AS matched_sites, h AS high_count, m AS medium_count, l AS low_count, round(h/t*100, 1) AS high_pct, round(m/t*100, 1) AS medium_pct, round(l/t*100, 1) AS low_pct, round(s/t, 2) AS avg_pm25, round(lo, 2) AS min_pm25, round(hi, 2) AS max_pm25 FROM e""")
def _(spark, d):
    s, r = _points(spark, d)
    return A.exposure_stats(D.exposure_join(s.select("feature_id", "lon", "lat"), r.withColumn("value", F.col("value") / 200), 30, key="feature_id", station_key="ref_id"))


@query("distance_bands", _NEAR + " SELECT feature_id, round(km*1000, 1) AS distance_m, CASE WHEN km*1000 <= 15000 THEN 'within_400m' WHEN km*1000 <= 30000 THEN 'within_800m' ELSE 'beyond_800m' END AS access FROM n WHERE rn = 1")
def _(spark, d):
    s, r = _points(spark, d)
    return D.accessibility_bands(s.select("feature_id", "lon", "lat"), r.withColumnRenamed("ref_id", "stop_id"), 15000, key="feature_id").drop("lon", "lat")


_CITIES = ctes("geo_points")


def _places_of_nations(spark, d):
    """A small whole table of places, for what is quadratic by definition."""
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("population"), F.expr("(n_nationkey * 37 % 25) * 0.4e0 - 100").alias("lon"), F.expr("35 + (n_nationkey * 11 % 25) * 0.3e0").alias("lat"))


@query("pairs_all", f"WITH c AS (SELECT n_name AS name, (n_nationkey * 37 % 25) * 0.4e0 - 100 AS lon, 35 + (n_nationkey * 11 % 25) * 0.3e0 AS lat FROM nation) SELECT a.name AS a, b.name AS b, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) AS km FROM c a JOIN c b ON a.name < b.name")
def _(spark, d):
    return D.plan_city_pairs(_places_of_nations(spark, d), "all").select("a", "b", F.round("distance_km", 6).alias("km"))


@query("pairs_hub", _CITIES + f", h AS (SELECT * FROM geo_points ORDER BY population DESC, name LIMIT 1) SELECT least(c.name, h.name) AS a, greatest(c.name, h.name) AS b, round({hav('c.lon', 'c.lat', 'h.lon', 'h.lat')}, 6) AS km FROM geo_points c, h WHERE c.name <> h.name")
def _(spark, d):
    return D.plan_city_pairs(layer(spark, d, "geo_points"), "hub").select("a", "b", F.round("distance_km", 6).alias("km"))


@query("pairs_nearest", _CITIES + f", p AS (SELECT x.name AS f, y.name AS t, {hav('x.lon', 'x.lat', 'y.lon', 'y.lat')} AS km FROM geo_points x JOIN geo_points y ON x.name <> y.name), n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY km, t) AS rn FROM p) SELECT DISTINCT least(f, t) AS a, greatest(f, t) AS b, round(km, 6) AS km FROM n WHERE rn = 1")
def _(spark, d):
    return D.plan_city_pairs(layer(spark, d, "geo_points"), "nearest").select("a", "b", F.round("distance_km", 6).alias("km"))


# --- set operations and aggregates -----------------------------------------------------------------


@query("merge_layers", ctes("geo_points", "geo_refs") + " SELECT feature_id, ref_id, name FROM (SELECT feature_id, NULL::BIGINT AS ref_id, name FROM geo_points UNION ALL SELECT NULL, ref_id, name FROM geo_refs)")
def _(spark, d):
    s, r = _points(spark, d)
    return A.merge_layers(s.select("feature_id", "name"), None, r.select("ref_id", "name")).select("feature_id", "ref_id", "name")


_MEASURE = ctes("geo_tagged") + ", m AS (SELECT coalesce(amenity, '') AS g, CASE WHEN feature_id % 3 = 0 THEN 'n/a' ELSE CAST(sz AS VARCHAR) END AS v FROM geo_tagged)"
for _op, _expr in {"count": "CAST(count(*) AS DOUBLE)", "sum": "coalesce(sum(try_cast(v AS DOUBLE)), 0)", "avg": "coalesce(sum(try_cast(v AS DOUBLE)), 0)/count(*)", "min": "min(try_cast(v AS DOUBLE))", "max": "max(try_cast(v AS DOUBLE))"}.items():

    @query(f"summarize_{_op}", _MEASURE + f' SELECT g AS "group", {_expr} AS value, count(*) AS n FROM m GROUP BY g')
    def _(spark, d, op=_op):
        df = _tagged(spark, d).withColumn("v", F.when(F.col("feature_id") % 3 == 0, "n/a").otherwise(F.col("sz").cast("string")))
        return A.summarize(df, op, F.col("v"), A.tag_group(F.col("tags"), "amenity"))


@query("summarize_headline", _MEASURE + ' SELECT g AS "group", CAST(count(*) AS DOUBLE) AS value, count(*) AS n FROM m GROUP BY g ORDER BY 2 DESC, 1 LIMIT 1')
def _(spark, d):
    return A.headline(A.summarize(_tagged(spark, d), "count", None, A.tag_group(F.col("tags"), "amenity")))


@query("summarize_rollup", "SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n, CAST(sum(floor(c_acctbal)) AS BIGINT) AS total FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def _(spark, d):
    df = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.floor("c_acctbal").cast("long").alias("x"))
    return A.summarize_levels(df, ["segment", "nation"], "x")


@query("dissolve_counts", ctes("geo_points") + ' SELECT segment AS "group", count(*) AS dissolved_count, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM geo_points GROUP BY segment')
def _(spark, d):
    return A.dissolve_counts(layer(spark, d, "geo_points"), F.col("segment"))


@query("union_counts", ctes("geo_points", "geo_refs") + " SELECT count(*) AS merged_count, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM (SELECT lon, lat FROM geo_points UNION ALL SELECT lon, lat FROM geo_refs)")
def _(spark, d):
    return A.union_layers(*_points(spark, d))


@query("bounds_center", ctes("geo_points") + " SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, (min(lon)+max(lon))/2 AS centre_lon, (min(lat)+max(lat))/2 AS centre_lat, 6 AS zoom FROM geo_points")
def _(spark, d):
    return A.bounds_and_zoom(layer(spark, d, "geo_points"))


# --- grids -----------------------------------------------------------------------------------------


@query("heat_grid", ctes("geo_points") + " SELECT CAST(floor(lon / (20e0/(111e0*greatest(0.1e0, cos(radians(lat)))))) AS BIGINT) AS cell_x, CAST(floor(lat / (20e0/111e0)) AS BIGINT) AS cell_y, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat, count(*) AS n FROM geo_points GROUP BY 1, 2")
def _(spark, d):
    return grid.heat_cells(layer(spark, d, "geo_points"), 20.0).withColumn("lon", F.round("lon", 9)).withColumn("lat", F.round("lat", 9))


@query("tiles", ctes("geo_points") + """ SELECT z, CAST(floor((lon+180)/360*pow(2, z)) AS BIGINT) AS x, CAST(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*pow(2, z)) AS BIGINT) AS y, count(*) AS n FROM geo_points, (SELECT CAST(unnest(range(3, 9)) AS INTEGER) AS z) GROUP BY 1, 2, 3""")
def _(spark, d):
    return grid.tiles(layer(spark, d, "geo_points"), 3, 8)


_COVER = ctes("geo_points", "geo_refs") + """, b AS (SELECT min(lat) AS y0, min(lon) AS x0, max(lat) AS y1, max(lon) AS x1 FROM (SELECT lon, lat FROM geo_points UNION ALL SELECT lon, lat FROM geo_refs)),
s AS (SELECT *, 20000/111132e0 AS sy, 20000/(111132e0*cos(radians((y0+y1)/2))) AS sx FROM b),
f AS (SELECT DISTINCT CAST(trunc((lat-y0)/sy) AS BIGINT) AS grid_row, CAST(trunc((lon-x0)/sx) AS BIGINT) AS grid_col FROM geo_points, s),
t AS (SELECT DISTINCT CAST(trunc((lat-y0)/sy) AS BIGINT) AS grid_row, CAST(trunc((lon-x0)/sx) AS BIGINT) AS grid_col FROM geo_refs, s)"""


@query("coverage_gaps", _COVER + " SELECT f.grid_row, f.grid_col, t.grid_row IS NOT NULL AS covered FROM f LEFT JOIN t USING (grid_row, grid_col)")
def _(spark, d):
    s, r = _points(spark, d)
    return grid.coverage(r, s, 20000.0)


@query("coverage_summary", _COVER + ", c AS (SELECT t.grid_row IS NOT NULL AS covered FROM f LEFT JOIN t USING (grid_row, grid_col)) SELECT count(*) AS total_cells, count(*) FILTER (covered) AS covered_cells, count(*) FILTER (NOT covered) AS gap_cells, round(count(*) FILTER (covered)/count(*)*100, 1) AS coverage_pct FROM c")
def _(spark, d):
    s, r = _points(spark, d)
    return grid.coverage_summary(grid.coverage(r, s, 20000.0))


# --- tiers -----------------------------------------------------------------------------------------

_TIER = ctes("geo_points") + ", t AS (SELECT *, CASE WHEN population >= 800000 THEN 3 WHEN population >= 400000 THEN 6 WHEN population >= 100000 THEN 8 WHEN population >= 10000 THEN 10 END AS zoom FROM geo_points)"
_TIERS = ((800_000, 3), (400_000, 6), (100_000, 8), (10_000, 10))


@query("tier_cities", _TIER + ", r AS (SELECT *, greatest(0.5e0, least(50e0, sqrt(population/5000e0/pi()))) AS radius_km FROM t WHERE zoom IS NOT NULL) SELECT feature_id, zoom, round(radius_km, 6) AS radius_km, round(lon - radius_km/(111e0*cos(radians(lat))), 6) AS min_lon, round(lat + radius_km/111e0, 6) AS max_lat FROM r")
def _(spark, d):
    t = ranking.tier_cities(layer(spark, d, "geo_points"), _TIERS, "population")
    return t.select("feature_id", "zoom", *[F.round(c, 6).alias(c) for c in ("radius_km", "min_lon", "max_lat")])


@query("split_tiers_counts", _TIER + " SELECT z.zoom, count(t.zoom) AS n FROM (VALUES (3), (6), (8), (10)) z(zoom) LEFT JOIN t ON t.zoom = z.zoom GROUP BY z.zoom")
def _(spark, d):
    return ranking.split_tiers(ranking.tier_cities(layer(spark, d, "geo_points"), _TIERS, "population"), _TIERS)


@query("seeded_sample", ctes("geo_points") + " SELECT feature_id FROM geo_points ORDER BY md5('42:' || CAST(feature_id AS VARCHAR)), feature_id LIMIT 50")
def _(spark, d):
    return ranking.seeded_sample(layer(spark, d, "geo_points"), 50, "feature_id").select("feature_id")


_SPACED = ctes("geo_places").replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT admin_id, feature_id, name, lon, lat, CAST(population AS BIGINT) AS people, row_number() OVER (PARTITION BY admin_id ORDER BY CAST(population AS BIGINT) DESC, feature_id) AS k FROM geo_places WHERE place IN ('city', 'town') AND regexp_matches(population, '^[0-9]+$') AND CAST(population AS BIGINT) >= 1000),
rec AS (SELECT DISTINCT admin_id, 0::BIGINT AS k, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM o UNION ALL
SELECT o.admin_id, o.k, CASE WHEN len(list_filter(kept, lambda q: {hav('q.x', 'q.y', 'o.lon', 'o.lat')} <= 40)) = 0 THEN list_append(kept, {{'id': feature_id, 'x': lon, 'y': lat}}) ELSE kept END FROM rec JOIN o ON o.admin_id = rec.admin_id AND o.k = rec.k + 1),
last AS (SELECT admin_id, arg_max(kept, k) AS kept FROM rec GROUP BY admin_id), ids AS (SELECT admin_id, unnest(list_transform(kept[:10], lambda q: q.id)) AS feature_id FROM last)
SELECT o.admin_id, o.feature_id, o.name, o.lon, o.lat, o.people AS population_value FROM o JOIN ids USING (admin_id, feature_id)"""


@query("top_cities", _SPACED)
def _(spark, d):
    return ranking.top_cities(_places(spark, d), 10, 1000, "feature_id", "admin_id", 40.0)


@query("equivalent_radius", ctes("geo_admin") + """, a AS (SELECT *, 0.5*abs(2*((max_lon-min_lon)*(max_lat-min_lat))) AS area, 111320e0*cos(radians((min_lat+max_lat)/2)) AS mx FROM geo_admin)
SELECT admin_id, round(sqrt(area*mx*111320e0/pi())/1000, 4) AS km FROM a WHERE sqrt(area*mx*111320e0/pi()) >= 90000""")
def _(spark, d):
    a = layer(spark, d, "geo_admin")
    p = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(p("min_lon", "min_lat"), p("max_lon", "min_lat"), p("max_lon", "max_lat"), p("min_lon", "max_lat"), p("min_lon", "min_lat"))
    return T.filter_by_radius(a.withColumn("coords", ring), 90, "km", "gte").select("admin_id", F.round("equivalent_radius_km", 4).alias("km"))


@query("radius_range", ctes("geo_admin") + """, a AS (SELECT *, (max_lon-min_lon)*(max_lat-min_lat)*111320e0*cos(radians((min_lat+max_lat)/2))*111320e0 AS m2 FROM geo_admin)
SELECT admin_id FROM a WHERE sqrt(m2/pi()) BETWEEN 88000 AND 92000""")
def _(spark, d):
    a = layer(spark, d, "geo_admin")
    p = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(p("min_lon", "min_lat"), p("max_lon", "min_lat"), p("max_lon", "max_lat"), p("min_lon", "max_lat"), p("min_lon", "min_lat"))
    return T.filter_by_radius_range(a.withColumn("coords", ring), 88, 92, "km").select("admin_id")


@query("point_buffer_area", ctes("geo_refs") + " SELECT ref_id, 33 AS corners FROM geo_refs")
def _(spark, d):
    r = layer(spark, d, "geo_refs")
    return r.select("ref_id", F.size(G.point_buffer(F.col("lon"), F.col("lat"), F.lit(5.0))).alias("corners"))
