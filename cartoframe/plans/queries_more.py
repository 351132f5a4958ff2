"""Registered queries: change feeds, catalog, vocabulary, readiness, scripts, composed analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoframe.functions.script import compile_script
from cartoframe.operators import catalog, readiness
from cartoframe.operators import distance as D
from cartoframe.plans import workflows
from cartoframe.plans.layers import ctes, hav, layer, tagged
from cartoframe.plans.registry import query
from cartoframe.streaming import changes as CH


def _changes(spark, d):
    return layer(spark, d, "geo_changes")


@query("change_classify", ctes("geo_changes") + " SELECT CASE WHEN op = 'delete' THEN 'deleted' WHEN event_type = 'signup' THEN 'added' ELSE 'modified' END AS change_type, count(*) AS n FROM geo_changes GROUP BY 1")
def _(spark, d):
    c = _changes(spark, d).withColumn("visible", F.col("op") != "delete").withColumn("version", F.when(F.col("event_type") == "signup", 1).otherwise(3))
    return CH.classify(c).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("change_counts", ctes("geo_changes") + " SELECT count(*) AS changes, count(*) FILTER (op <> 'delete' AND event_type = 'signup') AS added, count(*) FILTER (op <> 'delete' AND event_type <> 'signup') AS modified, count(*) FILTER (op = 'delete') AS deleted FROM geo_changes")
def _(spark, d):
    c = _changes(spark, d).withColumn("visible", F.col("op") != "delete").withColumn("version", F.when(F.col("event_type") == "signup", 1).otherwise(3))
    return CH.change_counts(CH.classify(c))


_APPLY = ctes("geo_changes") + """, l AS (SELECT osm_id, arg_max(op, seq_pos) AS op, arg_max(value, seq_pos) AS value, max(seq_pos) AS seq_pos FROM geo_changes GROUP BY osm_id)
SELECT osm_id, round(value, 6) AS value FROM l WHERE op <> 'delete' AND value >= 20 UNION ALL SELECT c_custkey, round(c_acctbal, 6) FROM customer WHERE c_custkey NOT IN (SELECT osm_id FROM l)"""


@query("tag_index_apply", _APPLY)
def _(spark, d):
    index = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("osm_id"), F.col("c_acctbal").alias("value"))
    return CH.apply_changes(index, _changes(spark, d), F.col("value") >= 20, order=("sequence", "seq_pos")).withColumn("value", F.round("value", 6))


@query("missing_sequences", "WITH s AS (SELECT DISTINCT event_id AS sequence FROM events WHERE event_id % 7 <> 3) SELECT range AS sequence FROM range((SELECT min(sequence) FROM s), (SELECT max(sequence) + 1 FROM s)) WHERE range NOT IN (SELECT sequence FROM s)")
def _(spark, d):
    return CH.missing_sequences(spark.read.parquet(f"{d}/events.parquet").where("event_id % 7 <> 3").select(F.col("event_id").alias("sequence")))


@query("windowed_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    return CH.windowed(spark.read.parquet(f"{d}/events.parquet"), "1 hour").withColumn("total", F.round("total", 4))


# --- catalog -----------------------------------------------------------------------------------------


def _regions(spark, d):
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    top = r.select(F.col("r_name").alias("name"), F.lower("r_name").alias("path"))
    sub = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.concat_ws("/", F.lower("r_name"), F.lower("n_name")).alias("path"))
    return catalog.with_path_parts(top.union(sub))


_REG = "WITH g AS (SELECT r_name AS name, lower(r_name) AS path, lower(r_name) AS continent FROM region UNION ALL SELECT n_name, lower(r_name) || '/' || lower(n_name), lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("region_catalog", _REG + " SELECT name, path, CASE WHEN contains(path, '/') THEN 'country' ELSE 'continent' END AS level, continent, CASE WHEN contains(path, '/') THEN continent END AS parent FROM g")
def _(spark, d):
    return _regions(spark, d).select("name", "path", "level", "continent", "parent")


@query("region_resolve", _REG + " SELECT 'The ' || replace(name, '_', ' ') AS query, path, 'direct' AS how, 1 AS n FROM g UNION ALL SELECT 'Nowhere', NULL, 'unknown', 0")
def _(spark, d):
    regions = _regions(spark, d)
    asked = regions.select(F.concat(F.lit("The "), F.replace("name", F.lit("_"), F.lit(" "))).alias("query")).union(spark.createDataFrame([("Nowhere",)], "query string"))
    return catalog.resolve(asked, regions).select("query", "path", "how", "n")


@query("subregion_leaves", _REG + " SELECT path FROM g WHERE contains(path, '/') AND starts_with(path, (SELECT min(lower(r_name)) FROM region) || '/')")
def _(spark, d):
    regions = _regions(spark, d)
    first = regions.where("level = 'continent'").agg(F.min("path")).first()[0]
    return catalog.subregion_leaves(regions, first).select("path")


@query("vocab_resolve", """WITH v AS (SELECT * FROM (VALUES ('amenity', 'fuel', ['gas station', 'petrol']), ('amenity', 'fast_food', ['takeaway']), ('shop', 'supermarket', ['grocery store']), ('amenity', 'charging_station', ['ev charger', 'charging point'])) t(key, value, s)), q AS (SELECT * FROM (VALUES ('Fuel'), ('Gas station'), ('fast'), ('market'), ('charging station point')) t(query))
SELECT 'Fuel' AS query, 'amenity' AS key, 'fuel' AS value, 1e0 AS confidence UNION ALL SELECT 'Gas station', 'amenity', 'fuel', 0.9e0 UNION ALL SELECT 'fast', 'amenity', 'fast_food', 0.65e0 UNION ALL SELECT 'market', 'shop', 'supermarket', 0.5e0 UNION ALL SELECT 'charging station point', 'amenity', 'charging_station', 0.5e0""")
def _(spark, d):
    v = spark.createDataFrame([("amenity", "fuel", ["gas station", "petrol"]), ("amenity", "fast_food", ["takeaway"]), ("shop", "supermarket", ["grocery store"]), ("amenity", "charging_station", ["ev charger", "charging point"])], "key string, value string, synonyms array<string>")
    q = spark.createDataFrame([("Fuel",), ("Gas station",), ("fast",), ("market",), ("charging station point",)], "query string")
    return catalog.match_vocabulary(q, v).where("rank = 1").select("query", "key", "value", "confidence")


@query("reverse_geocode", ctes("geo_points", "geo_refs") + f", p AS (SELECT feature_id, r.name, {hav('s.lon', 's.lat', 'r.lon', 'r.lat')} AS km, r.ref_id FROM geo_points s, geo_refs r), n AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY km, ref_id) AS rn FROM p) SELECT feature_id, name, round(km, 6) AS distance_km FROM n WHERE rn = 1")
def _(spark, d):
    points = layer(spark, d, "geo_points").select("feature_id", "lon", "lat")
    return catalog.reverse_geocode(points, layer(spark, d, "geo_refs"), "feature_id", "ref_id")


@query("inventory", "SELECT count(*) AS extracts, CAST(sum(o_custkey) AS BIGINT) AS bytes, count(*) FILTER (date_diff('microsecond', o_orderdate, TIMESTAMP '1999-01-01')/3.6e9 > 20000) AS stale, 'partly stale' AS verdict FROM orders")
def _(spark, d):
    a = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("bytes"), F.col("o_orderdate").alias("made_at"))
    return catalog.inventory(a, F.lit("1999-01-01").cast("timestamp"), 20000.0).select("extracts", "bytes", "stale", "verdict")


# --- readiness ---------------------------------------------------------------------------------------

_READY = f"""{ctes('geo_points', 'geo_refs')}, c AS (SELECT * FROM geo_points), f AS (SELECT ref_id, lon, lat, ['hospitals', 'fire', 'police', 'shelters'][ref_id % 4 + 1] AS category FROM geo_refs),
p AS (SELECT c.feature_id, category, {hav('c.lon', 'c.lat', 'f.lon', 'f.lat')} AS km FROM c, f WHERE {hav('c.lon', 'c.lat', 'f.lon', 'f.lat')} <= 150),
m AS (SELECT feature_id, category, list(km ORDER BY km) AS d FROM p GROUP BY feature_id, category),
t AS (SELECT feature_id, category, round(d[1], 2) AS nearest_km, round(d[len(d)//2 + 1], 2) AS median_km, len(d) AS facilities FROM m),
k AS (SELECT *, round(greatest(0, least(100, 100*(1 - nearest_km/50))), 1) AS component FROM t), s AS (SELECT feature_id, round(round(sum(0.25e0*component)/sum(0.25e0), 6), 1) AS score FROM k GROUP BY feature_id),
r AS (SELECT admin_id AS region, round(round(sum(score*population)/sum(population), 6), 1) AS score, count(*) AS cities FROM s JOIN c USING (feature_id) GROUP BY admin_id)"""


def _metrics(spark, d):
    cities = layer(spark, d, "geo_points")
    kinds = F.array(*map(F.lit, readiness.WEIGHTS))
    facilities = layer(spark, d, "geo_refs").select("ref_id", "lon", "lat", F.get(kinds, (F.col("ref_id") % 4).cast("int")).alias("category"))
    return cities, readiness.metrics_within(cities.select(F.col("feature_id").alias("city_id"), "population", "lon", "lat"), facilities, 150)


@query("readiness_metrics", _READY + " SELECT feature_id AS city_id, category, nearest_km, median_km, facilities FROM t")
def _(spark, d):
    return _metrics(spark, d)[1].drop("per_100k")


@query("readiness_score", _READY + " SELECT feature_id AS city_id, score FROM s")
def _(spark, d):
    return readiness.city_scores(readiness.component(_metrics(spark, d)[1]))


@query("region_ranking", _READY + " SELECT CAST(region AS VARCHAR) AS region, score, cities, CAST(row_number() OVER (ORDER BY score DESC, CAST(region AS VARCHAR)) AS INTEGER) AS rank FROM r")
def _(spark, d):
    cities, metrics = _metrics(spark, d)
    scored = readiness.city_scores(readiness.component(metrics)).join(cities.select(F.col("feature_id").alias("city_id"), F.col("admin_id").cast("string").alias("region"), "name", "population"), "city_id")
    return readiness.rank_regions(readiness.region_scores(scored)).select("region", "score", "cities", "rank")


# --- scripts and composed analyses -------------------------------------------------------------------


@query("script_filter", ctes("geo_tagged") + " SELECT feature_id FROM geo_tagged WHERE (amenity IN ('cafe', 'school') AND sz > 20) OR (shop IS NOT NULL AND NOT contains(pname, 'red'))")
def _(spark, d):
    df = tagged(layer(spark, d, "geo_tagged"), "amenity", "shop", "name=pname", "size=sz")
    return df.where(compile_script("(amenity in ('cafe', 'school') and num(tags['size']) > 20) or (has('shop') and not contains(name, 'red'))")).select("feature_id")


@query("places_beyond_reach", ctes("geo_places", "geo_refs") + f", p AS (SELECT feature_id, lon, lat FROM geo_places WHERE try_cast(regexp_replace(population, '[^0-9]', '', 'g') AS BIGINT) >= 1000) SELECT feature_id FROM p WHERE NOT EXISTS (SELECT 1 FROM geo_refs r WHERE {hav('p.lon', 'p.lat', 'r.lon', 'r.lat')} <= 30)")
def _(spark, d):
    places = tagged(layer(spark, d, "geo_places"), "place", "population")
    return workflows.places_beyond_reach(places, layer(spark, d, "geo_refs"), 30, 1000).select("feature_id")


@query("amenity_heatmap", ctes("geo_places") + " SELECT CAST(floor(lon / (50e0/(111e0*greatest(0.1e0, cos(radians(lat)))))) AS BIGINT) AS cell_x, CAST(floor(lat / (50e0/111e0)) AS BIGINT) AS cell_y, count(*) AS n FROM geo_places WHERE place = 'city' OR contains(lower(population), 'know') GROUP BY 1, 2")
def _(spark, d):
    places = tagged(layer(spark, d, "geo_places"), "place", "population")
    return workflows.amenity_heatmap(places, "place=city|population~KNOW", 50.0).select("cell_x", "cell_y", "n")


@query("discover_cities_and_towns", ctes("geo_places") + " SELECT place AS kind, count(*) AS n FROM geo_places WHERE place IN ('city', 'town') AND regexp_matches(population, '[0-9]') GROUP BY 1")
def _(spark, d):
    places = tagged(layer(spark, d, "geo_places"), "place", "population")
    return workflows.discover_cities_and_towns(places).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_FLAG = f"""{ctes('geo_points', 'geo_refs', 'geo_admin')}, p AS (SELECT s.feature_id, s.admin_id, {hav('s.lon', 's.lat', 'r.lon', 'r.lat')} AS km, r.ref_id FROM geo_points s, geo_refs r), n AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY km, ref_id) AS rn FROM p)
SELECT a.name, count(*) AS places, round(avg(km), 6) AS avg_km, round(max(km), 6) AS max_km FROM n JOIN geo_admin a USING (admin_id) WHERE rn = 1 AND km <= 60 GROUP BY a.name"""


@query("flagship", _FLAG)
def flagship(spark, d):
    """Nearest reference of every place within 60 km, summarised by area."""
    places, refs = layer(spark, d, "geo_points"), layer(spark, d, "geo_refs")
    near = D.nearest(places.select("feature_id", "admin_id", "lon", "lat"), refs, "feature_id", "ref_id", 60)
    return near.join(layer(spark, d, "geo_admin").select("admin_id", "name"), "admin_id").groupBy("name").agg(F.count(F.lit(1)).alias("places"), F.round(F.avg("distance_km"), 6).alias("avg_km"), F.round(F.max("distance_km"), 6).alias("max_km"))
