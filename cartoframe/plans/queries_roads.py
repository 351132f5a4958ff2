"""Registered queries: roads, ways, elevation, quality, transit, history, networks, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoframe.functions import classify as C
from cartoframe.functions import geo as G
from cartoframe.functions import parse as P
from cartoframe.operators import aggregate as A
from cartoframe.operators import filters as T
from cartoframe.operators import grid, history, importance, network, quality, spatial, transit, ways
from cartoframe.plans.layers import ctes, hav, layer, tagged, way_lines
from cartoframe.plans.registry import query
from cartoframe.runtime import Scratch

_SPEED = "CASE WHEN contains(lower(maxspeed), 'mph') THEN CAST(trunc(try_cast(trim(replace(lower(maxspeed), 'mph', '')) AS DOUBLE)*1.60934e0) AS INTEGER) ELSE CAST(trunc(try_cast(maxspeed AS DOUBLE)) AS INTEGER) END"
_SEGMENTS = f"""{ctes('geo_ways', 'geo_nodes', 'geo_way_tags')}, pl AS (SELECT way_id, pos, node_id, lon, lat FROM geo_ways JOIN geo_nodes USING (node_id)),
sg AS (SELECT way_id, pos, lon, lat, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0 FROM pl WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
ln AS (SELECT way_id, count(*) AS n, sum(coalesce({hav('x0', 'y0', 'lon', 'lat')}, 0)) AS km FROM sg GROUP BY way_id HAVING count(*) >= 2),
rd AS (SELECT way_id, highway, ref, bridge, {_SPEED} AS maxspeed, km FROM ln JOIN geo_way_tags USING (way_id))"""


def _roads(spark, d):
    t = tagged(layer(spark, d, "geo_way_tags"), "highway", "maxspeed", "ref", "bridge").select("way_id", "tags")
    return T.roads(way_lines(spark, d).join(t, "way_id"))


@query("way_assembly_length", _SEGMENTS + " SELECT way_id, n AS n_points, round(km, 6) AS km FROM ln")
def _(spark, d):
    return way_lines(spark, d).select("way_id", F.size("coords").cast("long").alias("n_points"), F.round(G.line_length(F.col("coords")), 6).alias("km"))


@query("roads_extract", _SEGMENTS + " SELECT way_id, highway AS road_class, maxspeed, round(km, 6) AS length_km, bridge FROM rd WHERE highway IN ('motorway', 'trunk')")
def _(spark, d):
    r = _roads(spark, d)
    return r.where(C.road_matches("major", F.col("road_class"))).select("way_id", "road_class", "maxspeed", F.round("length_km", 6).alias("length_km"), "bridge")


@query("roads_by_class", _SEGMENTS + " SELECT count(*) AS feature_count, round(sum(km), 2) AS total_length_km, count(*) FILTER (maxspeed > 0) AS with_speed_limit FROM rd WHERE highway = 'primary'")
def _(spark, d):
    return A.roads_summary(T.roads_by_class(_roads(spark, d), "primary"))


@query("roads_by_speed", _SEGMENTS + " SELECT way_id, maxspeed FROM rd WHERE maxspeed BETWEEN 101 AND 120")
def _(spark, d):
    return T.roads_by_speed(_roads(spark, d), 101, 120).select("way_id", "maxspeed")


@query("road_stats", _SEGMENTS + """ SELECT count(*) AS total_roads, round(sum(km), 2) AS total_length_km, coalesce(round(sum(km) FILTER (highway = 'motorway'), 2), 0) AS motorway_km, coalesce(round(sum(km) FILTER (highway = 'primary'), 2), 0) AS primary_km, 0e0 AS secondary_km, coalesce(round(sum(km) FILTER (highway = 'tertiary'), 2), 0) AS tertiary_km, 0e0 AS residential_km, 0e0 AS other_km, count(*) FILTER (maxspeed > 0) AS with_speed_limit, 0 AS with_surface, 0 AS with_lanes, 0 AS one_way_count FROM rd""")
def _(spark, d):
    return A.road_stats(_roads(spark, d))


@query("route_stats", _SEGMENTS + ", k AS (SELECT *, CASE way_id % 3 WHEN 0 THEN 'route' WHEN 1 THEN 'way' ELSE 'infrastructure' END AS kind FROM ln) SELECT count(*) FILTER (kind = 'route') AS route_count, round(sum(km) FILTER (kind = 'way'), 4) AS total_length_km, count(*) FILTER (kind = 'infrastructure') AS infrastructure_count FROM k")
def _(spark, d):
    df = way_lines(spark, d).withColumn("gtype", F.lit("LineString")).withColumn("feature_type", F.when(F.col("way_id") % 3 == 0, "route").when(F.col("way_id") % 3 == 1, "way").otherwise("infrastructure"))
    return A.route_stats(df).withColumn("total_length_km", F.round("total_length_km", 4))


@query("routes_by_type", "SELECT o_orderkey AS id FROM orders WHERE (o_orderstatus = 'F' OR o_orderkey % 4 = 0) AND o_orderpriority = '1-URGENT'")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "mtb").otherwise("road").alias("route"), F.upper("o_orderpriority").alias("network"), F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("bicycle"))).alias("route_types"))
    return T.routes_by_type(tagged(o, "route", "network"), "bicycle", "1-urgent").select("id")


@query("line_centroids", _SEGMENTS + """, m AS (SELECT way_id, sqrt(pow(lon-x0, 2)+pow(lat-y0, 2)) AS l, (lon+x0)/2 AS mx, (lat+y0)/2 AS my FROM sg WHERE x0 IS NOT NULL)
SELECT way_id, round(sum(l*mx)/sum(l), 6) AS lon, round(sum(l*my)/sum(l), 6) AS lat FROM m GROUP BY way_id HAVING sum(l) > 0""")
def _(spark, d):
    c = way_lines(spark, d).where(F.expr("exists(coords, p -> p <> coords[0])")).select("way_id", G.line_centroid(F.col("coords")).alias("c"))
    return c.select("way_id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query("dependencies", ctes("geo_ways", "geo_way_tags", "geo_nodes") + " SELECT DISTINCT node_id AS id FROM geo_ways JOIN geo_way_tags USING (way_id) JOIN geo_nodes USING (node_id) WHERE highway = 'motorway'")
def _(spark, d):
    w = layer(spark, d, "geo_ways").join(layer(spark, d, "geo_way_tags").where("highway = 'motorway'"), "way_id")
    kept = w.groupBy("way_id").agg(F.collect_list("node_id").alias("node_refs"))
    return T.with_dependencies(kept, layer(spark, d, "geo_nodes").select(F.col("node_id").alias("id")))


@query("building_stats", ctes("geo_tagged") + """, b AS (SELECT CASE WHEN shop IS NOT NULL THEN 'retail' ELSE CASE k WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' WHEN 3 THEN 'religious' ELSE CASE WHEN amenity IN ('hospital', 'school') THEN 'public' ELSE 'other' END END END AS t0, * FROM geo_tagged),
c AS (SELECT *, CASE k WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' WHEN 3 THEN 'religious' ELSE CASE WHEN amenity IN ('hospital', 'school') THEN 'public' WHEN shop IS NOT NULL THEN 'retail' ELSE 'other' END END AS t FROM b)
SELECT count(*) AS total_buildings, count(*) FILTER (t = 'residential') AS residential, count(*) FILTER (t = 'commercial') AS commercial, count(*) FILTER (t = 'industrial') AS industrial, count(*) FILTER (t = 'retail') AS retail, 0 AS office, count(*) FILTER (t = 'public') AS public, count(*) FILTER (t = 'religious') AS religious, count(*) FILTER (t = 'other') AS other, round(sum(price)/1e6, 4) AS total_area_km2, round(avg(sz) FILTER (sz > 0), 6) AS avg_levels, count(*) FILTER (k < 6) AS with_height FROM c""")
def _(spark, d):
    df = layer(spark, d, "geo_tagged").withColumn("building", F.expr("case k when 0 then 'house' when 1 then 'hotel' when 2 then 'factory' when 3 then 'mosque' else 'yes' end")).withColumn("h", F.when(F.col("k") < 6, F.concat(F.col("k").cast("string"), F.lit(" m"))))
    df = T.buildings(tagged(df, "building", "amenity", "shop", "height=h", "building:levels=sz")).withColumn("area_m2", F.col("price"))
    return A.building_stats(df).withColumn("avg_levels", F.round("avg_levels", 6))


@query("park_stats", ctes("geo_tagged") + """, p AS (SELECT feature_id, price/100 AS area, CASE WHEN k = 0 OR k = 5 THEN 'national' WHEN k = 1 THEN 'state' WHEN k IN (2, 3) THEN 'nature_reserve' WHEN k = 4 THEN 'park' ELSE 'protected_area' END AS t FROM geo_tagged)
SELECT count(*) AS total_parks, round(sum(area), 2) AS total_area_km2, count(*) FILTER (t = 'national') AS national_parks, count(*) FILTER (t = 'state') AS state_parks, count(*) FILTER (t = 'nature_reserve') AS nature_reserves, count(*) FILTER (t IN ('park', 'protected_area')) AS other_protected, (SELECT t FROM p ORDER BY feature_id LIMIT 1) AS park_type FROM p""")
def _(spark, d):
    df = layer(spark, d, "geo_tagged").withColumn("area_km2", F.col("price") / 100)
    df = df.withColumn("boundary", F.expr("case k when 0 then 'national_park' end")).withColumn("designation", F.expr("case k when 1 then 'A State Park' when 5 then 'old national_park' end")).withColumn("leisure", F.expr("case k when 2 then 'nature_reserve' when 4 then 'park' end")).withColumn("pc", F.expr("case k when 3 then '1a' end"))
    return A.park_stats(T.parks(tagged(df, "boundary", "designation", "leisure", "protect_class=pc")))


@query("parks_by_type", ctes("geo_tagged") + " SELECT feature_id FROM geo_tagged WHERE k IN (0, 1, 2, 3, 5, 6) AND (k <> 3 OR true)")
def _(spark, d):
    df = layer(spark, d, "geo_tagged").withColumn("park_type", F.expr("case k when 0 then 'national' when 1 then 'state' when 2 then 'nature_reserve' when 3 then 'protected_area' when 4 then 'park' end")).withColumn("boundary", F.expr("case when k in (5, 6) then 'protected_area' when k > 6 then 'x' end")).withColumn("leisure", F.expr("case when k > 6 then 'park' end")).withColumn("pc", F.expr("case k when 3 then '6' end"))
    return T.parks(tagged(df, "boundary", "leisure", "protect_class=pc"), "protected_area", ("5", "6")).select("feature_id")


# --- elevation -------------------------------------------------------------------------------------

_PROFILE = ctes("geo_ways", "geo_nodes") + """, e AS (SELECT way_id, pos, sz*3.28084e0 AS e FROM geo_ways JOIN geo_nodes USING (node_id)), s AS (SELECT *, e - lag(e) OVER (PARTITION BY way_id ORDER BY pos) AS d FROM e),
pr AS (SELECT way_id, min(e) AS lo, max(e) AS hi, coalesce(sum(d) FILTER (d > 0), 0) AS gain, coalesce(-sum(d) FILTER (d <= 0), 0) AS loss, count(*) AS n FROM s GROUP BY way_id)"""


def _profile(spark, d):
    return ways.elevation_profile(layer(spark, d, "geo_ways").join(layer(spark, d, "geo_nodes"), "node_id").withColumn("elevation", F.col("sz")))


@query("elevation_profile_stats", _PROFILE + " SELECT way_id, round(lo, 4) AS min_elevation, round(hi, 4) AS max_elevation, round(gain, 4) AS gain, round(abs(loss), 4) AS loss, n AS n_points FROM pr")
def _(spark, d):
    return _profile(spark, d).select("way_id", *[F.round(F.abs(c), 4).alias(c) for c in ("min_elevation", "max_elevation", "gain", "loss")], "n_points")


@query("elevation_filters", _PROFILE + " SELECT way_id FROM pr WHERE hi >= 120 AND lo <= 60 AND gain >= 50 AND lo <= 100 AND hi >= 30")
def _(spark, d):
    return ways.by_elevation_range(ways.by_gain(ways.by_min_elevation(ways.by_max_elevation(_profile(spark, d), 120), 60), 50), 30, 100).select("way_id")


@query("high_elevation_routes", _PROFILE + " SELECT way_id, round(hi, 4) AS max_elevation FROM pr JOIN (SELECT o_orderkey AS way_id FROM orders WHERE o_orderstatus = 'F') USING (way_id) WHERE hi >= 150")
def _(spark, d):
    routes = layer(spark, d, "geo_way_tags").where("highway = 'motorway'").select("way_id")
    return ways.high_routes(routes, _profile(spark, d), 150).select("way_id", F.round("max_elevation", 4).alias("max_elevation"))


# --- spatial join ----------------------------------------------------------------------------------

_INSIDE = ctes("geo_points", "geo_admin") + ", j AS (SELECT feature_id, a.admin_id, a.name FROM geo_points p JOIN geo_admin a ON p.lon >= a.min_lon AND p.lon < a.max_lon AND p.lat >= a.min_lat AND p.lat < a.max_lat)"


def _areas(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(p("min_lon", "min_lat"), p("max_lon", "min_lat"), p("max_lon", "max_lat"), p("min_lon", "max_lat"), p("min_lon", "min_lat"))
    return layer(spark, d, "geo_admin").withColumn("coords", ring)


@query("spatial_join_inner", _INSIDE + " SELECT feature_id, admin_id, name FROM j")
def _(spark, d):
    j = spatial.spatial_join(layer(spark, d, "geo_points").select("feature_id", "lon", "lat"), _areas(spark, d).select("admin_id", "name", "coords"), key="feature_id", order="admin_id", how="inner")
    return j.select("feature_id", F.col("joined.admin_id").alias("admin_id"), F.col("joined.name").alias("name"))


@query("spatial_join_left", _INSIDE + ", c AS (SELECT feature_id, count(*) AS n, min(admin_id) AS admin_id FROM j WHERE admin_id % 2 = 0 GROUP BY feature_id) SELECT p.feature_id, coalesce(n, 0) AS joined_count, c.admin_id FROM geo_points p LEFT JOIN c USING (feature_id)")
def _(spark, d):
    j = spatial.spatial_join(layer(spark, d, "geo_points").select("feature_id", "lon", "lat"), _areas(spark, d).where("admin_id % 2 = 0").select("admin_id", "name", "coords"), key="feature_id", order="admin_id", how="left")
    return j.select("feature_id", "joined_count", F.col("joined.admin_id").alias("admin_id"))


@query("clip_bbox", ctes("geo_points") + " SELECT feature_id FROM geo_points WHERE lon BETWEEN -97 AND -94 AND lat BETWEEN 36 AND 39")
def _(spark, d):
    return T.clip_bbox(layer(spark, d, "geo_points"), -97, 36, -94, 39).select("feature_id")


@query("clip_polygon", ctes("geo_points") + " SELECT feature_id FROM geo_points WHERE lat >= 36 AND lat < 40 AND lon >= -98 AND lon < -98 + (40 - lat)")
def _(spark, d):
    return T.clip_polygon(layer(spark, d, "geo_points"), [(-98, 36), (-94, 36), (-98, 40), (-98, 36)]).select("feature_id")


@query("intersect_areas", ctes("geo_admin") + """, c AS (SELECT admin_id, greatest(0, least(max_lon, -95e0) - greatest(min_lon, -97.5e0)) * greatest(0, least(max_lat, 39e0) - greatest(min_lat, 36e0)) AS a FROM geo_admin) SELECT admin_id, round(a, 6) AS area FROM c WHERE a > 0""")
def _(spark, d):
    v = F.lit
    cut = _areas(spark, d).select("admin_id", G.clip_to_bbox(F.col("coords"), v(-97.5), v(36.0), v(-95.0), v(39.0)).alias("c")).select("admin_id", F.when(F.size("c") >= 4, G.planar_area(F.col("c"))).otherwise(0.0).alias("a"))
    return cut.where("a > 1e-12").select("admin_id", F.round("a", 6).alias("area"))


# --- quality ---------------------------------------------------------------------------------------


def _elements(spark, d):
    nodes = layer(spark, d, "geo_nodes").where("node_id % 11 <> 0")
    nodes = nodes.withColumn("lat", F.when(F.col("node_id") % 97 == 0, F.lit(99.0)).otherwise(F.col("lat"))).withColumn("shop", F.when(F.col("node_id") % 5 == 0, F.when(F.col("node_id") % 10 == 0, "").otherwise("x"))).withColumn("n", F.when(F.col("node_id") % 2 == 0, F.col("name")))
    nodes = tagged(nodes, "shop", "name=n").select(F.col("node_id").alias("id"), "lon", "lat", "tags")
    refs = layer(spark, d, "geo_ways")
    w = refs.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("p")).select(F.col("way_id").alias("id"), F.transform("p", lambda x: x["node_id"]).alias("node_refs")).withColumn("landuse", F.when(F.col("id") % 3 == 0, "grass"))
    return nodes.union(nodes.where("id % 50 = 1")), tagged(w, "landuse").select("id", "node_refs", "tags")


_VERIFY = ctes("geo_nodes", "geo_ways") + """, n0 AS (SELECT node_id AS id, lon, CASE WHEN node_id % 97 = 0 THEN 99e0 ELSE lat END AS lat, CASE WHEN node_id % 10 = 0 THEN '' WHEN node_id % 5 = 0 THEN 'x' END AS shop, CASE WHEN node_id % 2 = 0 THEN name END AS name FROM geo_nodes WHERE node_id % 11 <> 0),
n AS (SELECT * FROM n0 UNION ALL SELECT * FROM n0 WHERE id % 50 = 1), w AS (SELECT way_id AS id, count(*) AS k, min_by(node_id, pos) AS a, max_by(node_id, pos) AS b FROM geo_ways GROUP BY way_id),
lost AS (SELECT way_id, min_by(node_id, pos) AS ref FROM geo_ways WHERE node_id NOT IN (SELECT id FROM n) GROUP BY way_id),
issues AS (SELECT 'duplicate' AS issue_type, 1 AS level, 'Duplicate node ID ' || id AS message, 'node' AS element_type, id AS element_id FROM n GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'coordinate', 1, 'Out-of-bounds coordinates', 'node', id FROM n WHERE lat > 90
UNION ALL SELECT 'geometry', 1, 'Degenerate way with ' || k || ' node(s)', 'way', id FROM w WHERE k < 2
UNION ALL SELECT 'geometry', 2, 'Unclosed polygon-tagged way', 'way', id FROM w WHERE k >= 2 AND id % 3 = 0 AND a <> b
UNION ALL SELECT 'reference', 1, 'Way references unknown node ' || ref, 'way', way_id FROM lost
UNION ALL SELECT 'tag', 3, 'Empty value for tag ''shop''', 'node', id FROM n WHERE shop = ''
UNION ALL SELECT 'tag', 2, 'Missing ''name'' tag on named feature', 'node', id FROM n WHERE shop IS NOT NULL AND name IS NULL)"""


@query("verify_issues", _VERIFY + " SELECT * FROM issues")
def _(spark, d):
    return quality.verify_all(*_elements(spark, d))


@query("verify_summary", _VERIFY + " SELECT count(*) AS total_issues, count(*) FILTER (issue_type = 'geometry') AS geometry_issues, count(*) FILTER (issue_type = 'tag') AS tag_issues, count(*) FILTER (issue_type = 'reference') AS reference_issues, count(*) FILTER (issue_type = 'coordinate') AS coordinate_issues, count(*) FILTER (issue_type = 'duplicate') AS duplicate_issues, count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2, count(*) FILTER (level = 3) AS level_3 FROM issues")
def _(spark, d):
    return quality.summary(quality.verify_all(*_elements(spark, d)))


@query("duplicate_ids", "SELECT l_orderkey AS id, count(*) - 1 AS extra FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"))
    return quality.duplicates(df, "way", "id").groupBy(F.col("element_id").alias("id")).agg(F.count(F.lit(1)).alias("extra"))


@query("dangling_refs", ctes("geo_ways", "geo_nodes") + " SELECT way_id AS element_id, 'Way references unknown node ' || min_by(node_id, pos) AS message FROM geo_ways WHERE node_id NOT IN (SELECT node_id FROM geo_nodes WHERE node_id % 7 <> 0) GROUP BY way_id")
def _(spark, d):
    return quality.way_references(layer(spark, d, "geo_ways"), layer(spark, d, "geo_nodes").where("node_id % 7 <> 0")).select("element_id", "message")


@query("tag_coverage", ctes("geo_tagged") + ", k AS (SELECT (amenity IS NOT NULL)::INT + (shop IS NOT NULL)::INT + (tourism IS NOT NULL)::INT AS k FROM geo_tagged) SELECT count(*) AS elements, round(count(*) FILTER (k > 0)/count(*)*100, 2) AS tag_coverage_pct, round(sum(k)/count(*), 4) AS avg_tags FROM k")
def _(spark, d):
    return quality.tag_coverage(tagged(layer(spark, d, "geo_tagged"), "amenity", "shop", "tourism"))


@query("require_fresh", "SELECT o_orderkey AS name FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'")
def _(spark, d):
    a = spark.read.parquet(f"{d}/orders.parquet").where(F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("made_at"))
    return quality.require_fresh(a, 100000, F.lit("2020-01-01").cast("timestamp")).select("name")


# --- transit ---------------------------------------------------------------------------------------


def feed(spark, d):
    """A transit feed over the driver's tables: suppliers stop, parts are routes, orders trips, line items stop times."""
    s = layer(spark, d, "geo_refs").select(F.col("ref_id").cast("string").alias("stop_id"), F.col("name").alias("stop_name"), F.col("lat").cast("string").alias("stop_lat"), F.col("lon").cast("string").alias("stop_lon"), F.when(F.col("ref_id") % 9 == 0, "1").when(F.col("ref_id") % 2 == 0, "0").otherwise("").alias("location_type"))
    o = spark.read.parquet(f"{d}/orders.parquet")
    trips = o.select(F.col("o_orderkey").cast("string").alias("trip_id"), (F.col("o_custkey") % 60).cast("string").alias("route_id"), F.when(F.col("o_orderkey") % 6 != 0, (F.col("o_orderkey") % 5).cast("string")).alias("service_id"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 60).cast("string")).alias("shape_id"), F.col("o_orderkey").alias("k"))
    routes = spark.range(60).select(F.col("id").cast("string").alias("route_id"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("route_short_name"), (F.col("id") % 14).cast("string").alias("route_type"))
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    times = li.select(F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_suppkey").cast("string").alias("stop_id"), F.col("l_linenumber").cast("string").alias("stop_sequence"))
    shapes = layer(spark, d, "geo_nodes").select((F.col("node_id") % 60).cast("string").alias("shape_id"), F.col("node_id").cast("string").alias("shape_pt_sequence"), F.col("lat").cast("string").alias("shape_pt_lat"), F.col("lon").cast("string").alias("shape_pt_lon"))
    calendar = spark.range(5).select(F.col("id").cast("string").alias("service_id"), *[F.when((F.col("id") + k) % 5 < 1, "1").otherwise("0").alias(day) if k < 4 else F.lit("0").alias(day) for k, day in enumerate(transit.DAYS)])
    return {"stops": s, "trips": trips, "routes": routes, "stop_times": times, "shapes": shapes, "calendar": calendar}


@query("transit_stops", ctes("geo_refs") + " SELECT CAST(ref_id AS VARCHAR) AS stop_id, name AS stop_name, lon, lat FROM geo_refs WHERE ref_id % 9 <> 0")
def _(spark, d):
    return transit.stops(feed(spark, d)).select("stop_id", "stop_name", "lon", "lat")


_FREQ = ctes("geo_refs") + """, f AS (SELECT l_suppkey AS ref_id, count(DISTINCT l_orderkey) AS trips_per_day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 6 = 0 OR o_orderkey % 5 IN (0, 4, 3, 2) GROUP BY 1), q AS (SELECT CAST(ref_id AS VARCHAR) AS stop_id, name AS stop_name, trips_per_day FROM geo_refs JOIN f USING (ref_id) WHERE ref_id % 9 <> 0)"""


@query("transit_frequency", _FREQ + " SELECT * FROM q")
def _(spark, d):
    return transit.frequency(feed(spark, d)).select("stop_id", "stop_name", "trips_per_day")


@query("transit_frequency_summary", _FREQ + " SELECT count(*) AS stop_count, round(avg(trips_per_day), 1) AS avg_trips_per_day, max(trips_per_day) AS max_trips_per_day FROM q")
def _(spark, d):
    return transit.frequency_summary(transit.frequency(feed(spark, d)))


_SHAPES = ctes("geo_nodes") + f""", sh AS (SELECT node_id % 60 AS r, node_id, lon, lat, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0 FROM geo_nodes WINDOW w AS (PARTITION BY node_id % 60 ORDER BY node_id)),
ln AS (SELECT CAST(r AS VARCHAR) AS route_id, count(*) AS point_count, round(sum(coalesce({hav('x0', 'y0', 'lon', 'lat')}, 0)), 4) AS km FROM sh GROUP BY r)"""


@query("transit_route_shapes", _SHAPES + " SELECT ln.* FROM ln WHERE route_id IN (SELECT CAST(o_custkey % 60 AS VARCHAR) FROM orders WHERE o_orderkey % 3 <> 0)")
def _(spark, d):
    return transit.route_lines(feed(spark, d), "k").select("route_id", "point_count", F.round(G.line_length(F.col("coords")), 4).alias("km"))


_LABEL = "CASE k WHEN 0 THEN 'Tram' WHEN 1 THEN 'Subway' WHEN 2 THEN 'Rail' WHEN 3 THEN 'Bus' WHEN 4 THEN 'Ferry' WHEN 5 THEN 'Cable Tram' WHEN 6 THEN 'Aerial Lift' WHEN 7 THEN 'Funicular' WHEN 11 THEN 'Trolleybus' WHEN 12 THEN 'Monorail' ELSE 'Type ' || k END"


@query("transit_report", _FREQ + f""", lb AS (SELECT {_LABEL} || ': ' || count(*) AS x FROM (SELECT range % 14 AS k FROM range(60)) GROUP BY k)
SELECT (SELECT count(*) FROM geo_refs WHERE ref_id % 9 <> 0) AS stop_count, 60 AS route_count, (SELECT count(*) FROM orders) AS trip_count, (SELECT string_agg(x, ', ' ORDER BY x) FROM lb) AS routes_by_type,
(SELECT round(min(lat), 6) FROM geo_refs WHERE ref_id % 9 <> 0) AS bbox_min_lat, (SELECT round(min(lon), 6) FROM geo_refs WHERE ref_id % 9 <> 0) AS bbox_min_lon, (SELECT round(max(lat), 6) FROM geo_refs WHERE ref_id % 9 <> 0) AS bbox_max_lat, (SELECT round(max(lon), 6) FROM geo_refs WHERE ref_id % 9 <> 0) AS bbox_max_lon,
(SELECT round(avg(trips_per_day), 1) FROM q) AS avg_trips_per_day, (SELECT max(trips_per_day) FROM q) AS max_trips_per_day, (SELECT count(DISTINCT o_custkey % 60) FROM orders WHERE o_orderkey % 3 <> 0) AS routes_with_lines""")
def _(spark, d):
    return transit.report(feed(spark, d))


@query("route_density", ctes("geo_ways", "geo_nodes") + """, p AS (SELECT way_id, pos, lon, lat FROM geo_ways JOIN geo_nodes USING (node_id)), k AS (SELECT way_id FROM p GROUP BY way_id HAVING count(*) >= 2), q AS (SELECT p.* FROM p JOIN k USING (way_id)),
c AS (SELECT way_id, avg(lon) AS lon, avg(lat) AS lat FROM q GROUP BY way_id), b AS (SELECT min(lat) AS y0, min(lon) AS x0, 30000/111132e0 AS sy, 30000/(111132e0*cos(radians((min(lat)+max(lat))/2))) AS sx FROM c)
SELECT CAST(trunc((lat-y0)/sy) AS BIGINT) AS grid_row, CAST(trunc((lon-x0)/sx) AS BIGINT) AS grid_col, count(DISTINCT way_id) AS route_count FROM q, b GROUP BY 1, 2""")
def _(spark, d):
    lines = ways.assemble(layer(spark, d, "geo_ways"), layer(spark, d, "geo_nodes"))
    return grid.route_density(lines, 30000.0, "way_id")


# --- history ---------------------------------------------------------------------------------------

_AT = "TIMESTAMP '1997-06-01 00:00:00'"


def _moment(text):
    return F.lit(text).cast("timestamp_ntz")


@query("history_as_of", ctes("geo_history") + f" SELECT osm_id, version_id FROM geo_history WHERE valid_from <= {_AT} AND (valid_to > {_AT} OR valid_to IS NULL)")
def _(spark, d):
    return history.as_of(layer(spark, d, "geo_history"), _moment("1997-06-01")).select("osm_id", "version_id")


@query("history_latest", ctes("geo_history") + " SELECT osm_id, version_id FROM geo_history WHERE valid_to IS NULL")
def _(spark, d):
    return history.extract(layer(spark, d, "geo_history")).select("osm_id", "version_id")


@query("history_window_counts", ctes("geo_history") + " SELECT count(*) AS edits, count(*) FILTER (contrib_type = 'CREATION') AS creation, count(*) FILTER (contrib_type = 'DELETION') AS deletion, count(*) FILTER (contrib_type = 'TAG') AS tag, count(*) FILTER (contrib_type = 'GEOMETRY') AS geometry, count(*) FILTER (contrib_type = 'TAG_GEOMETRY') AS tag_geometry, count(DISTINCT osm_id) AS objects FROM geo_history WHERE valid_from >= TIMESTAMP '1996-01-01' AND valid_from < TIMESTAMP '1998-01-01'")
def _(spark, d):
    return history.change_counts(history.changes(layer(spark, d, "geo_history"), _moment("1996-01-01"), _moment("1998-01-01")))


@query("history_overlaps", ctes("geo_history") + " SELECT a.osm_id, a.version_id AS v1, b.version_id AS v2 FROM geo_history a JOIN geo_history b ON a.osm_id = b.osm_id AND a.contrib_type = 'CREATION' AND b.contrib_type = 'TAG' AND a.valid_from < coalesce(b.valid_to, TIMESTAMP '9999-12-31') AND b.valid_from < coalesce(a.valid_to, TIMESTAMP '9999-12-31')")
def _(spark, d):
    h = layer(spark, d, "geo_history")
    return history.overlaps(h.where("contrib_type = 'CREATION'"), h.where("contrib_type = 'TAG'"), "osm_id").select("osm_id", F.col("a.version_id").alias("v1"), F.col("b.version_id").alias("v2"))


# --- networks --------------------------------------------------------------------------------------


def _network(spark, d):
    return network.build_by_nodes(layer(spark, d, "geo_ways", "l_orderkey"), layer(spark, d, "geo_nodes"))


def _network_once(spark, d):
    """The network as a table, for queries that read it more than once.  The shuffles that made it are freed."""
    made = Scratch(spark, "network").table(_network(spark, d))
    spark._jvm.System.gc()
    return made


def _snapped(spark, d, edges):
    """(source): the network node nearest to every reference place."""
    at = layer(spark, d, "geo_nodes").join(edges.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
    return network.nearest_node(layer(spark, d, "geo_refs").select("ref_id", "lon", "lat"), at, "ref_id").select(F.col("node_id").alias("source"))


_NET = ctes("geo_ways", "geo_nodes") + f""", r AS (SELECT w.* FROM geo_ways w), v AS (SELECT DISTINCT node_id FROM (SELECT min_by(node_id, pos) AS node_id FROM r GROUP BY way_id UNION ALL SELECT max_by(node_id, pos) FROM r GROUP BY way_id UNION ALL SELECT node_id FROM (SELECT DISTINCT way_id, node_id FROM r) GROUP BY node_id HAVING count(*) >= 2)),
pl AS (SELECT way_id, pos, r.node_id, lon, lat, v.node_id IS NOT NULL AS stop, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0 FROM r JOIN geo_nodes USING (node_id) LEFT JOIN v ON v.node_id = r.node_id WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
al AS (SELECT *, sum(coalesce({hav('x0', 'y0', 'lon', 'lat', 6371008.8)}, 0)) OVER (PARTITION BY way_id ORDER BY pos) AS along FROM pl),
sp AS (SELECT way_id, node_id AS u, lead(node_id) OVER w AS v, lead(along) OVER w - along AS m FROM al WHERE stop WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
ed AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(m) AS length_m FROM sp WHERE v IS NOT NULL AND u <> v GROUP BY 1, 2)"""


@query("network_edges", _NET + " SELECT u, v, round(length_m, 3) AS length_m FROM ed")
def _(spark, d):
    return _network(spark, d).withColumn("length_m", F.round("length_m", 3))


_LABEL_SPREAD = """, rc(id, r) USING KEY (id) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT e2.b, min(p.r) FROM rc p JOIN e2 ON e2.a = p.id JOIN recurring.rc c ON c.id = e2.b WHERE p.r < c.r GROUP BY e2.b)"""


@query("network_components", _NET.replace("WITH ", "WITH RECURSIVE ", 1) + ", e2 AS (SELECT u AS a, v AS b FROM ed UNION ALL SELECT v, u FROM ed)" + _LABEL_SPREAD + " SELECT id, r AS component FROM rc")
def _(spark, d):
    return network.connected_components(_network(spark, d), "u", "v")


_SNAPPED = ctes("geo_refs").replace("WITH ", "WITH RECURSIVE ", 1) + _NET.replace("WITH ", ", ", 1) + f""", sn AS (SELECT point_id, node_id FROM (SELECT r.ref_id AS point_id, n.node_id, row_number() OVER (PARTITION BY r.ref_id ORDER BY {hav('r.lon', 'r.lat', 'n.lon', 'n.lat')}, n.node_id) AS k FROM geo_refs r, geo_nodes n WHERE n.node_id IN (SELECT u FROM ed)) WHERE k = 1),
e2 AS (SELECT u AS a, v AS b, length_m FROM ed UNION ALL SELECT v, u, length_m FROM ed), s AS (SELECT DISTINCT node_id AS source FROM sn),
w(source, node, cost) USING KEY (source, node) AS (SELECT source, source, 0e0 FROM s UNION SELECT p.source, e2.b, min(p.cost + e2.length_m) FROM w p JOIN e2 ON e2.a = p.node LEFT JOIN recurring.w r ON r.source = p.source AND r.node = e2.b WHERE r.cost IS NULL OR p.cost + e2.length_m < r.cost GROUP BY p.source, e2.b)"""


@query("shortest_paths", _SNAPPED + " SELECT source, node, round(cost, 3) AS cost FROM w")
def _(spark, d):
    e = _network_once(spark, d)
    return network.shortest_paths(e, _snapped(spark, d, e)).withColumn("cost", F.round("cost", 3))


@query("isochrone_nodes", _SNAPPED + """ SELECT source, l AS "limit", node, round(cost, 3) AS cost, lon, lat FROM w JOIN geo_nodes ON node = node_id, (SELECT unnest([100000e0, 200000e0]) AS l) WHERE cost <= l""")
def _(spark, d):
    e = _network(spark, d)
    return network.isochrone(e, _snapped(spark, d, e), (100_000.0, 200_000.0), layer(spark, d, "geo_nodes")).withColumn("cost", F.round("cost", 3))


@query("route_matrix", _SNAPPED + """ SELECT a.point_id AS "from", b.point_id AS "to", round(coalesce(w.cost/1000, -1), 4) AS distance_km FROM sn a JOIN sn b ON a.point_id <> b.point_id LEFT JOIN w ON w.source = a.node_id AND w.node = b.node_id""")
def _(spark, d):
    e = _network_once(spark, d)
    at = layer(spark, d, "geo_nodes").join(e.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
    points = layer(spark, d, "geo_refs").select(F.col("ref_id").alias("point_id"), "lon", "lat")
    return network.route_matrix(points, e, at).withColumn("distance_km", F.round("distance_km", 4))


@query("logical_decision_nodes", ctes("geo_ways", "geo_way_tags") + """, r AS (SELECT * FROM geo_ways), e AS (SELECT min_by(node_id, pos) AS node_id FROM r GROUP BY way_id UNION ALL SELECT max_by(node_id, pos) FROM r GROUP BY way_id),
u AS (SELECT node_id FROM r JOIN geo_way_tags USING (way_id) GROUP BY node_id HAVING count(*) >= 3 OR count(DISTINCT highway) > 1 OR count(DISTINCT coalesce(ref, '')) > 1) SELECT DISTINCT node_id FROM (SELECT * FROM e UNION ALL SELECT * FROM u)""")
def _(spark, d):
    attributes = layer(spark, d, "geo_way_tags").select("way_id", F.col("highway").alias("cls"), "ref")
    return network.decision_nodes(layer(spark, d, "geo_ways"), attributes)


#: Where every decision node has three uses or more, as here, no two pieces are chained.
_PIECES = ctes("geo_ways", "geo_nodes", "geo_way_tags") + f""", e AS (SELECT min_by(node_id, pos) AS node_id FROM geo_ways GROUP BY way_id UNION ALL SELECT max_by(node_id, pos) FROM geo_ways GROUP BY way_id),
dn AS (SELECT node_id FROM e UNION SELECT node_id FROM geo_ways JOIN geo_way_tags USING (way_id) GROUP BY node_id HAVING count(*) >= 3 OR count(DISTINCT highway) > 1 OR count(DISTINCT coalesce(ref, '')) > 1),
pl AS (SELECT way_id, pos, node_id, lon, lat, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0, node_id IN (SELECT node_id FROM dn) AS stop FROM geo_ways JOIN geo_nodes USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
al AS (SELECT *, sum(coalesce({hav('x0', 'y0', 'lon', 'lat', 6371000.0)}, 0)) OVER (PARTITION BY way_id ORDER BY pos) AS along FROM pl),
sp AS (SELECT way_id, node_id AS a, lead(node_id) OVER w AS b, lead(along) OVER w - along AS m FROM al WHERE stop WINDOW w AS (PARTITION BY way_id ORDER BY pos))
SELECT least(a, b) AS u, greatest(a, b) AS v, round(m, 3) AS length_m, highway AS cls, ref, 1 AS pieces FROM sp JOIN geo_way_tags USING (way_id) WHERE b IS NOT NULL AND a <> b"""


@query("logical_edges", _PIECES)
def _(spark, d):
    attributes = layer(spark, d, "geo_way_tags").select("way_id", F.col("highway").alias("cls"), "ref")
    return network.logical_edges(layer(spark, d, "geo_ways"), layer(spark, d, "geo_nodes"), attributes).withColumn("length_m", F.round("length_m", 3)).drop("edge_id")


# --- importance ------------------------------------------------------------------------------------

_SCORE = ctes("geo_way_tags") + """, f AS (SELECT way_id AS edge_id, greatest(0, least(1, CASE highway WHEN 'motorway' THEN 1e0 WHEN 'primary' THEN 0.75e0 ELSE 0.45e0 END + CASE WHEN ref <> '' THEN 0.05e0 ELSE 0 END + CASE WHEN bridge THEN 0.03e0 ELSE 0 END)) AS fc, bridge, ref FROM geo_way_tags),
z AS (SELECT * FROM (VALUES (2, 0.25e0), (3, 0.30e0), (4, 0.35e0), (5, 0.40e0), (6, 0.45e0), (7, 0.50e0)) t(zoom, w))"""


def _edges(spark, d):
    t = layer(spark, d, "geo_way_tags")
    none = F.lit(False)
    return t.select(F.col("way_id").alias("edge_id"), "ref", "bridge", F.lit(False).alias("tunnel"), C.functional_score(F.col("highway"), F.col("ref"), F.col("bridge"), none, none, none).alias("fc_score"))


@query("edge_scores", _SCORE + " SELECT edge_id, zoom, round(greatest(0, least(1.2e0, w*fc + CASE WHEN bridge THEN 0.05e0 ELSE 0 END + CASE WHEN ref <> '' THEN 0.03e0 ELSE 0 END)), 6) AS score FROM f, z")
def _(spark, d):
    return importance.edge_scores(_edges(spark, d)).withColumn("score", F.round("score", 6))


@query("monotonic_reveal", _SCORE + ", s AS (SELECT edge_id, zoom FROM f, z WHERE w*fc + CASE WHEN bridge THEN 0.05e0 ELSE 0 END + CASE WHEN ref <> '' THEN 0.03e0 ELSE 0 END >= 0.4) SELECT edge_id, min(zoom) AS min_zoom FROM s GROUP BY edge_id")
def _(spark, d):
    return importance.reveal(importance.edge_scores(_edges(spark, d)).where("score >= 0.4"))


@query("sbs_normalise", "WITH v AS (SELECT l_partkey AS edge_id, 2 AS zoom, count(*) AS votes FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY votes, edge_id) - 1 AS r, count(*) OVER () AS n FROM v), p AS (SELECT votes AS p95 FROM r WHERE r = least(floor(n*0.95), n - 1)) SELECT edge_id, zoom, votes, round(least(1, ln(1+votes)/ln(1+p95)), 6) AS sb FROM v, p")
def _(spark, d):
    v = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("edge_id")).agg(F.count(F.lit(1)).alias("votes")).withColumn("zoom", F.lit(2))
    return importance.normalised_votes(v).withColumn("sb", F.round("sb", 6)).select("edge_id", "zoom", "votes", "sb")


_BUDGETS = ctes("geo_ways", "geo_nodes") + f""", pt AS (SELECT way_id, pos, lon, lat, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0 FROM geo_ways JOIN geo_nodes USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
sg AS (SELECT *, {hav('x0', 'y0', 'lon', 'lat')} AS km FROM pt WHERE x0 IS NOT NULL), ln AS (SELECT way_id, sum(km) AS km, max_by(lon, pos) AS lx, max_by(lat, pos) AS ly FROM sg GROUP BY way_id),
st AS (SELECT *, greatest(1, ceil(km/20)) AS n FROM sg), sm AS (SELECT way_id, x0 + (lon-x0)*k/n AS x, y0 + (lat-y0)*k/n AS y FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS k FROM st) UNION ALL SELECT way_id, lx, ly FROM ln),
c AS (SELECT DISTINCT way_id, CAST(floor(x/(100/111.19e0)) AS BIGINT) AS cell_x, CAST(floor(y/(100/111.19e0)) AS BIGINT) AS cell_y FROM sm), q AS (SELECT way_id, count(*) AS n FROM c GROUP BY way_id),
r AS (SELECT cell_x, cell_y, sum(km/n) AS road_km FROM c JOIN q USING (way_id) JOIN ln USING (way_id) GROUP BY 1, 2), f AS (SELECT *, CASE WHEN road_km/10000 < 0.2 THEN 1.3e0 WHEN road_km/10000 < 1 THEN 1e0 WHEN road_km/10000 < 5 THEN 0.6e0 ELSE 0.4e0 END AS density_factor FROM r)
SELECT cell_x, cell_y, round(road_km, 4) AS road_km, density_factor, zoom, 500e0*density_factor AS budget_km FROM f, (SELECT CAST(unnest(range(2, 8)) AS INTEGER) AS zoom)"""


@query("cell_budgets", _BUDGETS)
def _(spark, d):
    """Total length over all cells of a zoom is the length of all edges."""
    lines = way_lines(spark, d).select(F.col("way_id").alias("edge_id"), "coords", (G.line_length(F.col("coords")) * 1000).alias("length_m"))
    cells = importance.edge_cells(lines, 100.0, 20000.0)
    return importance.cell_budgets(cells, dict.fromkeys(importance.ZOOMS, 500.0), 10000.0).withColumn("road_km", F.round("road_km", 4))


@query("corridors", _NET.replace("WITH ", "WITH RECURSIVE ", 1) + """, ce AS (SELECT u*100000 + v AS id, u, v, u % 3 AS t FROM ed), en AS (SELECT id, t, u AS n FROM ce UNION ALL SELECT id, t, v FROM ce),
e2 AS (SELECT -(n*3 + t) - 1 AS a, id AS b FROM en UNION ALL SELECT id, -(n*3 + t) - 1 FROM en), rc(id, r) USING KEY (id) AS (SELECT DISTINCT a, CASE WHEN a < 0 THEN 9e15::BIGINT ELSE a END FROM e2 UNION SELECT e2.b, min(p.r) FROM rc p JOIN e2 ON e2.a = p.id JOIN recurring.rc c ON c.id = e2.b WHERE p.r < c.r GROUP BY e2.b)
SELECT id AS edge_id, r AS corridor FROM rc WHERE id >= 0""")
def _(spark, d):
    e = _network(spark, d).withColumn("edge_id", F.col("u") * 100000 + F.col("v"))
    e = e.withColumn("ref", F.concat(F.lit("R"), (F.col("u") % 3).cast("string"))).withColumn("name", F.lit(""))
    return importance.corridors(e)


@query("select_edges")
def _(spark, d):
    lines = way_lines(spark, d).select(F.col("way_id").alias("edge_id"), "coords", (G.line_length(F.col("coords")) * 1000).alias("length_m"))
    t = layer(spark, d, "geo_way_tags").select(F.col("way_id").alias("edge_id"), F.col("highway").alias("cls"), "ref", F.lit("").alias("name"))
    scratch = Scratch(spark, "selection")
    edges = scratch.table(lines.select("edge_id", "length_m").join(t, "edge_id").withColumn("u", F.col("edge_id")).withColumn("v", F.col("edge_id") + 1))
    cells = scratch.table(importance.edge_cells(lines, 200.0, 20000.0))
    budgets = importance.cell_budgets(cells, {4: 4000.0, 6: 20000.0}, 40000.0)
    scores = importance.edge_scores(_edges(spark, d)).where("zoom in (4, 6)")
    return importance.select_edges(edges, scores, importance.corridors(edges), cells, budgets)


@query("parse_functions", "SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 9, '0')[1:3] || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')[4:6] || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')[7:9] AS path, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), P.replication_path(F.col("o_orderkey")).alias("path"), P.slug(F.col("o_orderpriority")).alias("slug"))
