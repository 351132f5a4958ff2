"""Registered queries: polygon overlay, detours, files written and read again, network applications, composed analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoframe.functions import geo as G
from cartoframe.functions import parse as P
from cartoframe.operators import detours, importance, network, overlay, readiness, spatial, ways
from cartoframe.operators import filters as T
from cartoframe.plans import workflows
from cartoframe.plans.layers import ctes, hav, layer, tagged
from cartoframe.plans.queries_roads import _NET, _SNAPPED, _network, _network_once, _snapped
from cartoframe.plans.registry import query
from cartoframe.runtime import Scratch
from cartoframe.sources import diffs, geojson, pbf, tables
from cartoframe.streaming import changes as CH

# --- overlay -----------------------------------------------------------------------------------------


def _box(x0: str, y0: str, x1: str, y1: str):
    p = lambda x, y: F.struct(F.expr(x).alias("lon"), F.expr(y).alias("lat"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def _areas(spark, d):
    return layer(spark, d, "geo_admin").select("admin_id", "parent_id", _box("min_lon", "min_lat", "max_lon", "max_lat").alias("coords"))


def _around(spark, d):
    """A box around every reference place."""
    return layer(spark, d, "geo_refs").select("ref_id", _box("lon - 0.3", "lat - 0.2", "lon + 0.3", "lat + 0.2").alias("coords"))


_COMMON = ctes("geo_admin", "geo_refs") + ", i AS (SELECT geo_admin.admin_id, ref_id, least(max_lon, lon + 0.3e0) - greatest(min_lon, lon - 0.3e0) AS w, least(max_lat, lat + 0.2e0) - greatest(min_lat, lat - 0.2e0) AS h FROM geo_admin, geo_refs)"


@query("intersect_layers", _COMMON + " SELECT admin_id, ref_id, round(w*h, 6) AS area FROM i WHERE w > 1e-9 AND h > 1e-9")
def _(spark, d):
    found = overlay.intersect(_areas(spark, d), _around(spark, d))
    return found.select(F.col("a.admin_id").alias("admin_id"), F.col("b.ref_id").alias("ref_id"), F.round(overlay.area_of(F.col("parts")), 6).alias("area"))


@query("dissolve_areas", ctes("geo_admin") + ' SELECT CAST(parent_id AS VARCHAR) AS "group", count(*) AS dissolved_count, round(sum((max_lon-min_lon)*(max_lat-min_lat)), 6) AS area FROM geo_admin GROUP BY parent_id')
def _(spark, d):
    return overlay.dissolve(_areas(spark, d), F.col("parent_id")).select("group", "dissolved_count", F.round(overlay.area_of(F.col("parts")), 6).alias("area"))


#: Area of a union of boxes: of the grid of all their edges, the cells inside of some.
_UNION = ctes("geo_refs") + """, b AS (SELECT lon - 0.3e0 AS x0, lon + 0.3e0 AS x1, lat - 0.2e0 AS y0, lat + 0.2e0 AS y1 FROM geo_refs),
xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS xn FROM (SELECT x0 AS x FROM b UNION SELECT x1 FROM b)), ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS yn FROM (SELECT y0 AS y FROM b UNION SELECT y1 FROM b)),
c AS (SELECT DISTINCT x, y, xn, yn FROM b JOIN xs ON x >= x0 AND x < x1 JOIN ys ON y >= y0 AND y < y1)"""


@query("union_areas", _UNION + " SELECT (SELECT count(*) FROM b) AS merged_count, round(sum((xn-x)*(yn-y)), 5) AS area FROM c")
def _(spark, d):
    return overlay.union_layers(_around(spark, d)).select("merged_count", F.round(overlay.area_of(F.col("parts")), 5).alias("area"))


@query("difference_areas", _UNION.replace("geo_refs", "geo_admin, geo_refs", 0).replace(ctes("geo_refs"), ctes("geo_admin", "geo_refs"), 1) + """, o AS (SELECT admin_id, sum(greatest(0, least(xn, max_lon) - greatest(x, min_lon)) * greatest(0, least(yn, max_lat) - greatest(y, min_lat))) AS gone FROM geo_admin, c GROUP BY admin_id)
SELECT admin_id, round((max_lon-min_lon)*(max_lat-min_lat) - gone, 5) AS area FROM geo_admin JOIN o USING (admin_id) WHERE (max_lon-min_lon)*(max_lat-min_lat) - gone > 1e-9""")
def _(spark, d):
    return overlay.difference(_areas(spark, d), _around(spark, d), "admin_id").select("admin_id", F.round(overlay.area_of(F.col("parts")), 5).alias("area"))


@query("buffer_areas", ctes("geo_admin") + """, m AS (SELECT *, (max_lon-min_lon)*111320e0*cos(radians((min_lat+max_lat)/2)) AS w, (max_lat-min_lat)*111320e0 AS h FROM geo_admin)
SELECT admin_id, round((w*h + 2*(w+h)*5000 + 16*5000e0*5000*sin(2*pi()/32))/1e6, 2) AS km2 FROM m""")
def _(spark, d):
    grown = overlay.buffer(_areas(spark, d), 5, "km")
    middle = G.bbox(F.col("coords"))
    scale = F.lit(G.M_PER_DEGREE * G.M_PER_DEGREE / 1e6) * F.cos(F.radians((middle["min_lat"] + middle["max_lat"]) / 2))
    return grown.select("admin_id", F.round(overlay.area_of(F.col("buffer")) * scale, 2).alias("km2"))


@query("clip_areas", ctes("geo_refs") + ", i AS (SELECT ref_id, least(-92e0, lon + 0.3e0) - greatest(-98e0, lon - 0.3e0) AS w, least(41e0, lat + 0.2e0) - greatest(36e0, lat - 0.2e0) AS h FROM geo_refs) SELECT ref_id, round(w*h, 6) AS area FROM i WHERE w > 1e-9 AND h > 1e-9")
def _(spark, d):
    window = [[[(-98.0, 36.0), (-92.0, 36.0), (-92.0, 41.0), (-98.0, 41.0), (-98.0, 36.0)]]]
    return overlay.clip(_around(spark, d), window).select("ref_id", F.round(overlay.area_of(F.col("parts")), 6).alias("area"))


@query("type_and_radius", ctes("geo_admin") + ", a AS (SELECT *, (max_lon-min_lon)*(max_lat-min_lat)*111320e0*cos(radians((min_lat+max_lat)/2))*111320e0 AS m2 FROM geo_admin) SELECT admin_id FROM a WHERE parent_id IN (1, 3) AND sqrt(m2/pi()) < 92000")
def _(spark, d):
    a = _areas(spark, d).withColumn("boundary_type", F.when(F.col("parent_id").isin(1, 3), "County").otherwise("state"))
    return T.filter_by_type_and_radius(tagged(a, "boundary_type"), "county", 92, "km", "lt").select("admin_id")


@query("districts", "SELECT n_nationkey AS admin_id FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    return T.attribute_equals(_areas(spark, d), "parent_id", 2).select("admin_id")


@query("buildings_by_type", ctes("geo_tagged") + " SELECT feature_id FROM geo_tagged WHERE k IN (1, 4) AND sz >= 30")
def _(spark, d):
    df = layer(spark, d, "geo_tagged").withColumn("building", F.when(F.col("k").isin(1, 4), "house").when(F.col("k") == 2, "factory"))
    return T.buildings(tagged(df, "building").withColumn("area_m2", F.col("sz").cast("double")), "residential", 30.0).select("feature_id")


# --- detours -----------------------------------------------------------------------------------------


def _weighted(spark, d):
    """The network with a class and minutes for every edge."""
    e = _network(spark, d).withColumn("fc_score", F.expr("element_at(array(0.3, 0.45, 0.6, 0.75, 1.0), cast((u + v) % 5 + 1 as int))").cast("double"))
    return e.withColumn("edge_id", F.col("u") * 1000000 + F.col("v")).withColumn("minutes", F.col("length_m") / 1000 / (30 + 90 * F.col("fc_score")) * 60)


def _settlements(spark, d):
    return layer(spark, d, "geo_refs").select(F.col("ref_id").alias("place_id"), "lon", "lat", F.when(F.col("ref_id") % 2 == 0, 150_000).otherwise(20_000).cast("long").alias("population"), F.when(F.col("ref_id") % 3 == 0, "village").alias("place"))


_PLACED = ctes("geo_refs") + _NET.replace("WITH ", ", ", 1) + """, st AS (SELECT ref_id AS place_id, lon, lat, CASE WHEN ref_id % 2 = 0 THEN 3000e0 ELSE 1500e0 END AS core, CASE WHEN ref_id % 2 = 0 THEN 150000 ELSE 20000 END AS people FROM geo_refs),
fe AS (SELECT u, v, [0.3e0, 0.45e0, 0.6e0, 0.75e0, 1e0][(u + v) % 5 + 1] AS fc FROM ed)"""


def _ends(radius: str, least: str, keep: str = "true") -> str:
    """Entries of the places, as SQL: outer ends of edges with one end within the radius."""
    return f""", inn AS (SELECT place_id, node_id FROM st, geo_nodes g WHERE {keep} AND {hav('st.lon', 'st.lat', 'g.lon', 'g.lat')}*1000 <= {radius}),
cr AS (SELECT place_id, v AS node FROM inn JOIN fe ON u = node_id AND fc >= {least} UNION SELECT place_id, u FROM inn JOIN fe ON v = node_id AND fc >= {least}),
en AS (SELECT cr.place_id, cr.node, atan2(g.lat - st.lat, g.lon - st.lon) AS angle FROM cr JOIN st USING (place_id) JOIN geo_nodes g ON g.node_id = cr.node WHERE NOT EXISTS (SELECT 1 FROM inn WHERE inn.place_id = cr.place_id AND inn.node_id = cr.node)),
rk AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY angle, node) AS pos, count(*) OVER (PARTITION BY place_id) AS n FROM en)"""


@query("bypass_pairs", _PLACED + _ends("core*2.5", "0.45") + """, pr AS (SELECT a.place_id, a.node AS a, b.node AS b, row_number() OVER (PARTITION BY a.place_id ORDER BY a.pos, b.pos) AS pair FROM rk a JOIN rk b ON a.place_id = b.place_id AND a.pos < b.pos AND CASE WHEN b.angle - a.angle > pi() THEN 2*pi() - (b.angle - a.angle) ELSE b.angle - a.angle END >= pi()/2)
SELECT place_id, a, b, pair FROM pr WHERE pair <= 50""")
def _(spark, d):
    return detours.bypass_pairs(_settlements(spark, d), _weighted(spark, d), layer(spark, d, "geo_nodes"), detours.BYPASS_PAIRS)


@query("ring_entries", _PLACED + _ends("least(25000, (8 + sqrt(people/50000e0))*1000)", "0.6", "people >= 100000") + " SELECT place_id, node, round(angle, 9) AS angle FROM en")
def _(spark, d):
    cities = detours.large_cities(_settlements(spark, d))
    return detours.entries(cities, _weighted(spark, d), layer(spark, d, "geo_nodes"), detours.boundary_m(F.col("population")), detours.RING_CLASS, 25_000.0).withColumn("angle", F.round("angle", 9))


@query("bypass_flags")
def _(spark, d):
    """Tested against a plain loop; here for every settlement, with searches of up to four hours' driving."""
    return detours.bypasses(_settlements(spark, d), _weighted(spark, d), layer(spark, d, "geo_nodes"), 240.0)


@query("ring_flags")
def _(spark, d):
    return detours.rings(_settlements(spark, d), _weighted(spark, d), layer(spark, d, "geo_nodes"), 240.0)


# --- files written and read again ----------------------------------------------------------------------


@query("geojson_lines", ctes("geo_places") + " SELECT CAST(feature_id AS VARCHAR) AS feature_id, place, population, round(lon, 6) AS lon, round(lat, 6) AS lat FROM geo_places")
def _(spark, d):
    p = tagged(layer(spark, d, "geo_places"), "place", "population")
    at = F.struct("lon", "lat")
    path = f"{Scratch(spark, 'geojson').root}/lines"
    geojson.write_lines(p.select(F.col("feature_id").cast("string").alias("feature_id"), F.lit("Point").alias("gtype"), "tags", F.array(at).alias("coords")), path)
    back = geojson.read_lines(spark, path)
    return back.select("feature_id", F.col("tags")["place"].alias("place"), F.col("tags")["population"].alias("population"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("geojson_collection", ctes("geo_admin") + " SELECT CAST(admin_id AS VARCHAR) AS feature_id, round((max_lon-min_lon)*(max_lat-min_lat), 6) AS area FROM geo_admin")
def _(spark, d):
    path = f"{Scratch(spark, 'geojson').root}/all.geojson"
    geojson.write_collection(_areas(spark, d).select(F.col("admin_id").cast("string").alias("feature_id"), F.lit("Polygon").alias("gtype"), F.expr("map('k', 'v')").alias("tags"), "coords"), path)
    return geojson.read_collection(spark, path).select("feature_id", F.round(overlay.area_of(F.col("parts")), 6).alias("area"))


@query("pbf_extract", ctes("geo_nodes", "geo_ways", "geo_way_tags") + """ SELECT 'node' AS osm_type, node_id AS id, round(lon, 6) AS lon, round(lat, 6) AS lat, name, 0 AS refs, -1 AS first FROM geo_nodes
UNION ALL SELECT 'way', way_id, NULL, NULL, highway, n, f FROM geo_way_tags JOIN (SELECT way_id, count(*) AS n, min_by(node_id, pos) AS f FROM geo_ways GROUP BY way_id) USING (way_id)""")
def _(spark, d):
    nodes = tagged(layer(spark, d, "geo_nodes"), "name").select(F.lit("node").alias("osm_type"), F.col("node_id").alias("id"), F.lit(1).alias("version"), "lon", "lat", "tags", F.lit(None).cast("array<long>").alias("node_refs"))
    refs = layer(spark, d, "geo_ways").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("node_refs"))
    w = tagged(layer(spark, d, "geo_way_tags"), "name=highway").join(refs, "way_id").select(F.lit("way").alias("osm_type"), F.col("way_id").alias("id"), F.lit(2).alias("version"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), "tags", "node_refs")
    path = f"{Scratch(spark, 'extract').root}/x.osm.pbf"
    pbf.write_pbf(nodes.union(w).withColumn("members", F.lit(None).cast("array<struct<type:string,ref:long,role:string>>")), path)
    back = pbf.read_pbf(spark, path)
    return back.select("osm_type", "id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.col("tags")["name"].alias("name"), F.coalesce(F.size("node_refs"), F.lit(0)).alias("refs"), F.coalesce(F.get("node_refs", F.lit(0)), F.lit(-1)).alias("first")).withColumn("refs", F.greatest("refs", F.lit(0)))


@query("change_files", ctes("geo_points") + " SELECT 17 AS sequence, CASE feature_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' ELSE 'delete' END AS op, feature_id AS osm_id, CASE WHEN feature_id % 3 < 2 THEN round(lon, 6) END AS lon, CASE WHEN feature_id % 3 < 2 THEN name END AS name FROM geo_points")
def _(spark, d):
    p = layer(spark, d, "geo_points")
    op = F.element_at(F.array(*map(F.lit, ("create", "modify", "delete"))), (F.col("feature_id") % 3 + 1).cast("int"))
    alive = F.col("feature_id") % 3 < 2
    none = lambda kind: F.lit(None).cast(kind)
    rows = p.select(F.lit(17).cast("long").alias("sequence"), F.col("feature_id").alias("seq_pos"), op.alias("op"), F.lit("node").alias("osm_type"), F.col("feature_id").alias("osm_id"), F.lit(1).alias("version"), F.lit(5).cast("long").alias("changeset"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), none("string").alias("user"), alive.alias("visible"), F.when(alive, F.col("lon")).alias("lon"), F.when(alive, F.col("lat")).alias("lat"), F.when(alive, F.create_map(F.lit("name"), "name")).alias("tags"), none("array<long>").alias("node_refs"), none("array<struct<type:string,ref:long,role:string>>").alias("members"))
    root = f"{Scratch(spark, 'diffs').root}/day"
    diffs.publish(rows, root, 17, "2024-01-02T00:00:00Z")
    return diffs.read_changes(spark, root).select(F.col("sequence").cast("int").alias("sequence"), "op", "osm_id", F.round("lon", 6).alias("lon"), F.col("tags")["name"].alias("name"))


@query("themed_source", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS highway, p_name AS name FROM part WHERE p_size > 25 AND p_type IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part)")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    ends = p.agg(F.min("p_type"), F.max("p_type")).first()
    at = F.struct(F.col("p_size").cast("double").alias("xmin"), F.col("p_size").cast("double").alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(0.0).alias("ymax"))
    root = f"{Scratch(spark, 'themed').root}/maps"
    p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("class"), F.struct(F.col("p_name").alias("primary")).alias("names"), at.alias("bbox")).write.parquet(f"{root}/theme=transportation/type=segment")
    found = tables.read_themed(spark, root, "roads", (25.5, -1.0, 1000.0, 1.0), (ends[0], ends[1]))
    return found.select("id", F.col("tags")["highway"].alias("highway"), F.col("tags")["name"].alias("name"))


@query("replication_state", "SELECT o_orderkey AS id, o_orderkey AS sequence FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("#x\nsequenceNumber="), F.col("o_orderkey").cast("string"), F.lit("\ntimestamp=2024-01-01T00\\:00\\:00Z\n")).alias("text"))
    return o.select("id", P.state_text(F.col("text"))["sequenceNumber"].cast("long").alias("sequence"))


# --- network applications ------------------------------------------------------------------------------


@query("route_layer", _SNAPPED + """ SELECT a.point_id AS "from", b.point_id AS "to", round(w.cost/1000, 4) AS distance_km FROM sn a JOIN sn b ON a.point_id < b.point_id AND a.node_id <> b.node_id JOIN w ON w.source = a.node_id AND w.node = b.node_id""")
def _(spark, d):
    e = _network_once(spark, d)
    at = layer(spark, d, "geo_nodes").join(e.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
    points = layer(spark, d, "geo_refs").select(F.col("ref_id").alias("point_id"), "lon", "lat")
    return network.route_layer(points, e, at).select("from", "to", F.round("distance_km", 4).alias("distance_km"))


@query("approx_route", _SNAPPED.replace("geo_refs r, geo_nodes n", "(SELECT 0 AS ref_id, -99e0 AS lon, 36e0 AS lat UNION ALL SELECT 1, -92e0, 41e0) r, geo_nodes n", 1) + " SELECT round(cost/1000, 4) AS distance_km, true AS reached_b FROM w, sn a, sn b WHERE a.point_id = 0 AND b.point_id = 1 AND w.source = a.node_id AND w.node = b.node_id")
def _(spark, d):
    e = _network(spark, d)
    at = layer(spark, d, "geo_nodes").join(e.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
    return network.approx_route(e, at, (-99.0, 36.0), (-92.0, 41.0)).select(F.round("distance_km", 4).alias("distance_km"), "reached_b")


@query("votes", _NET + """, st AS (SELECT least(node_id, lead(node_id) OVER o) AS u, greatest(node_id, lead(node_id) OVER o) AS v FROM geo_ways WINDOW o AS (PARTITION BY way_id ORDER BY pos))
SELECT ed.u*1000000 + ed.v AS edge_id, count(*) AS votes FROM ed JOIN st USING (u, v) GROUP BY 1""")
def _(spark, d):
    paths = layer(spark, d, "geo_ways").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("path"))
    return importance.votes(paths, _weighted(spark, d))


@query("ferry_access", _SNAPPED.replace("SELECT DISTINCT node_id AS source FROM sn", "SELECT DISTINCT node_id AS source FROM geo_nodes JOIN ed ON node_id = u WHERE sz = 1", 1) + ", fa AS (SELECT source, node, cost, row_number() OVER (PARTITION BY source ORDER BY cost, node) AS k FROM w JOIN geo_nodes ON node = node_id WHERE sz > 45 AND cost <= 150000) SELECT source, node, round(cost, 3) AS cost FROM fa WHERE k = 1")
def _(spark, d):
    e, nodes = _network(spark, d), layer(spark, d, "geo_nodes")
    ends = nodes.where("sz = 1").join(e.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
    return network.ferry_access(ends, nodes.where("sz > 45"), e, 150_000.0).select("source", "node", F.round("cost", 3).alias("cost"))


@query("prune", _NET.replace("WITH ", "WITH RECURSIVE ", 1) + """, se AS (SELECT u*1000000 + v AS edge_id, u, v, length_m FROM ed WHERE (u*7 + v) % 23 = 0), e2 AS (SELECT u AS a, v AS b FROM se UNION ALL SELECT v, u FROM se),
rc(id, r) USING KEY (id) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT e2.b, min(p.r) FROM rc p JOIN e2 ON e2.a = p.id JOIN recurring.rc c ON c.id = e2.b WHERE p.r < c.r GROUP BY e2.b),
sz AS (SELECT edge_id, sum(length_m) OVER (PARTITION BY r) AS m FROM se JOIN rc ON rc.id = u) SELECT edge_id, 5 AS zoom FROM sz WHERE m >= 300000""")
def _(spark, d):
    # by both ends: from node 1,000,000 on, edges have numbers in common
    e = _weighted(spark, d).withColumn("edge_id", F.struct("u", "v"))
    chosen = e.where("(u * 7 + v) % 23 = 0").select("edge_id", F.lit(5).alias("zoom"))
    return importance.prune(chosen, e, None, dict.fromkeys(importance.ZOOMS, 300.0)).select((F.col("edge_id.u") * 1000000 + F.col("edge_id.v")).alias("edge_id"), "zoom")


@query("anchors", ctes("geo_points") + """, r AS (SELECT feature_id, population, row_number() OVER (ORDER BY population DESC, feature_id) AS k FROM geo_points WHERE population > 0),
a2 AS (SELECT feature_id FROM r WHERE population >= 900000 AND k <= 5), a3 AS (SELECT feature_id FROM r WHERE population >= 500000 AND k <= 40), a4 AS (SELECT feature_id FROM r WHERE population >= 1000 AND k <= 200)
SELECT 2 AS zoom, feature_id FROM a2 UNION ALL SELECT 3, feature_id FROM a3 UNION ALL SELECT 4, feature_id FROM a4""")
def _(spark, d):
    p = layer(spark, d, "geo_points").withColumnRenamed("population", "population_value")
    return importance.anchors(p, {2: (900_000, 5), 3: (500_000, 40), 4: (1000, 200)}).select("zoom", "feature_id")


@query("user_sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER o IS NULL OR ts >= lag(ts) OVER o + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def _(spark, d):
    return CH.sessions(spark.read.parquet(f"{d}/events.parquet").where("user_id is not null"), "30 minutes")


@query("point_to_segment", ctes("geo_points") + """, k AS (SELECT feature_id, (-98 - lon)*111320e0*cos(radians(lat)) AS ax, (36 - lat)*111320e0 AS ay, 6*111320e0*cos(radians(lat)) AS dx, 4*111320e0 AS dy FROM geo_points),
t AS (SELECT *, greatest(0e0, least(1e0, -(ax*dx + ay*dy)/(dx*dx + dy*dy))) AS t FROM k) SELECT feature_id, round(sqrt(pow(ax + t*dx, 2) + pow(ay + t*dy, 2)), 3) AS m FROM t""")
def _(spark, d):
    at = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    return layer(spark, d, "geo_points").select("feature_id", F.round(G.point_segment_m(F.col("lon"), F.col("lat"), at(-98.0, 36.0), at(-92.0, 40.0)), 3).alias("m"))


@query("decoded_lines", "SELECT n_nationkey AS id, 3 AS n, -12.02 AS lon, 3.85 AS lat FROM nation")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@").alias("polyline"))
    found = spatial.with_decoded(n)
    return found.select("id", F.size("coords").alias("n"), F.round(F.element_at("coords", 1)["lon"], 6).cast("decimal(5,2)").alias("lon"), F.round(F.element_at("coords", 1)["lat"], 6).cast("decimal(4,2)").alias("lat"))


@query("category_set", ctes("geo_refs") + " SELECT ['hospitals', 'fire', 'police', 'shelters'][ref_id % 4 + 1] AS category, count(*) AS facilities FROM geo_refs GROUP BY 1")
def _(spark, d):
    kinds = F.array(*map(F.lit, readiness.WEIGHTS))
    return readiness.require_categories(layer(spark, d, "geo_refs").select(F.get(kinds, (F.col("ref_id") % 4).cast("int")).alias("category")))


@query("raster_elevation", ctes("geo_nodes") + ", t AS (SELECT CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y, avg(sz) AS elevation FROM geo_nodes GROUP BY 1, 2) SELECT node_id, round(elevation, 6) AS elevation FROM geo_nodes JOIN t ON x = floor(lon) AND y = floor(lat)")
def _(spark, d):
    nodes = layer(spark, d, "geo_nodes")
    dem = nodes.groupBy(F.floor("lon").alias("tile_lon"), F.floor("lat").alias("tile_lat")).agg(F.avg("sz").alias("elevation"))
    return ways.with_elevation(nodes.select("node_id", "lon", "lat"), dem).select("node_id", F.round("elevation", 6).alias("elevation"))


# --- composed analyses -----------------------------------------------------------------------------------


@query("regional_analysis", ctes("geo_tagged") + " SELECT CAST(feature_id % 25 AS VARCHAR) AS region, CASE WHEN amenity IN ('restaurant', 'cafe') THEN 'food' WHEN amenity = 'hospital' THEN 'healthcare' WHEN amenity = 'school' THEN 'education' WHEN shop IS NOT NULL THEN 'shopping' ELSE 'other' END AS category, count(*) AS n FROM geo_tagged WHERE amenity IS NOT NULL OR shop IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    t = tagged(layer(spark, d, "geo_tagged"), "amenity", "shop").withColumn("region", (F.col("feature_id") % 25).cast("string"))
    return workflows.regional_analysis(t, "region")


@query("clip_and_extract", ctes("geo_places") + " SELECT feature_id FROM geo_places WHERE lon BETWEEN -97 AND -93 AND lat BETWEEN 36 AND 40 AND place = 'town'")
def _(spark, d):
    return workflows.clip_and_extract(tagged(layer(spark, d, "geo_places"), "place"), (-97.0, 36.0, -93.0, 40.0), "place=town").select("feature_id")


@query("transport_overview", "SELECT 'bicycle' AS mode, count(*) AS routes FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'bus', count(*) FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("route", F.expr("case o_orderstatus when 'F' then 'mtb' when 'O' then 'bus' end"))
    return workflows.transport_overview(tagged(o, "route"))


@query("city_routes", _SNAPPED.replace("geo_refs r, geo_nodes n", "(SELECT feature_id AS ref_id, lon, lat FROM geo_points ORDER BY population DESC, feature_id LIMIT 12) r, geo_nodes n", 1).replace(ctes("geo_refs").replace("WITH ", "WITH RECURSIVE ", 1), ctes("geo_points").replace("WITH ", "WITH RECURSIVE ", 1), 1) + """ SELECT a.point_id AS "from", b.point_id AS "to", round(w.cost/1000, 4) AS distance_km FROM sn a JOIN sn b ON a.point_id < b.point_id AND a.node_id <> b.node_id JOIN w ON w.source = a.node_id AND w.node = b.node_id""")
def _(spark, d):
    """Ways between the twelve most populous places (a top-k report)."""
    e = _network_once(spark, d)
    at = layer(spark, d, "geo_nodes").join(e.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
    places = layer(spark, d, "geo_points").withColumn("tags", F.create_map(F.lit("population"), F.col("population").cast("string"))).withColumnRenamed("population", "population_value")
    return workflows.city_routes_by_population(places, e, at, 12).select("from", "to", F.round("distance_km", 4).alias("distance_km"))
