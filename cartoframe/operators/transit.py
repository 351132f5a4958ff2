"""Transit feeds: stops, route lines, frequency, statistics, report.

A feed is a dict of all-string DataFrames named as its files without .txt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of route types.
ROUTE_LABELS = {0: "Tram", 1: "Subway", 2: "Rail", 3: "Bus", 4: "Ferry", 5: "Cable Tram", 6: "Aerial Lift", 7: "Funicular", 11: "Trolleybus", 12: "Monorail"}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def route_label(kind: Column) -> Column:
    n = kind.try_cast("int")
    return F.coalesce(*[F.when(n == k, v) for k, v in ROUTE_LABELS.items()], F.concat(F.lit("Type "), F.coalesce(kind, F.lit(""))))


def _is_stop(df: DataFrame) -> DataFrame:
    return df.where(F.trim(F.coalesce("location_type", F.lit("0"))).isin("", "0")) if "location_type" in df.columns else df


def _placed(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    return df.withColumn("lat", F.col(lat).try_cast("double")).withColumn("lon", F.col(lon).try_cast("double")).where("lat is not null and lon is not null")


def stops(feed: dict[str, DataFrame]) -> DataFrame:
    """Stops (no stations or entrances) with a place; (0, 0) is none."""
    df = _placed(_is_stop(feed["stops"])).where("not (lat = 0 and lon = 0)")
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in ("stop_id", "stop_name", "stop_code", "zone_id", "wheelchair_boarding")], "lon", "lat")


def stops_summary(found: DataFrame) -> DataFrame:
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return found.agg(F.count(F.lit(1)).alias("stop_count"), z(F.min("lat")).alias("bbox_min_lat"), z(F.min("lon")).alias("bbox_min_lon"), z(F.max("lat")).alias("bbox_max_lat"), z(F.max("lon")).alias("bbox_max_lon"))


def _line(df: DataFrame, key: str) -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    return df.groupBy(key).agg(points.alias("p")).select(key, F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("coords")).where(F.size("coords") >= 2)


def route_lines(feed: dict[str, DataFrame], trip_order: str = "trip_id") -> DataFrame:
    """A line for each route: the shape of its first trip that has one, else (in a feed without shapes) the stops of its first trip."""
    routes, trips = feed["routes"], feed["trips"]
    info = routes.select("route_id", F.coalesce("route_short_name", F.lit("")).alias("route_short_name"), F.coalesce("route_type", F.lit("3")).alias("route_type")).withColumn("route_type_label", route_label(F.col("route_type")))
    if "shapes" in feed:
        first = trips.where("shape_id is not null and shape_id <> ''").groupBy("route_id").agg(F.min_by("shape_id", trip_order).alias("shape_id"))
        points = _placed(feed["shapes"], "shape_pt_lat", "shape_pt_lon").withColumn("seq", F.col("shape_pt_sequence").try_cast("int")).where("seq is not null")
        # only the shapes that a route uses are gathered
        lines = _line(points.join(first.select("shape_id").distinct(), "shape_id", "left_semi"), "shape_id")
        return info.join(first, "route_id").join(lines, "shape_id").select("route_id", "route_short_name", "route_type", "route_type_label", "shape_id", F.size("coords").cast("long").alias("point_count"), "coords")
    times = feed["stop_times"].withColumn("seq", F.col("stop_sequence").try_cast("int")).where("seq is not null")
    timed = trips.join(times.select("trip_id").distinct(), "trip_id", "left_semi")
    first = timed.groupBy("route_id").agg(F.min_by("trip_id", trip_order).alias("trip_id"))
    points = times.join(first, "trip_id").join(_placed(feed["stops"]).select("stop_id", "lon", "lat"), "stop_id")
    return info.join(_line(points, "route_id"), "route_id").select("route_id", "route_short_name", "route_type", "route_type_label", F.lit("").alias("shape_id"), F.size("coords").cast("long").alias("point_count"), "coords")


def frequency(feed: dict[str, DataFrame]) -> DataFrame:
    """stop_id, stop_name, lon, lat, trips_per_day: distinct trips at each stop, of services that run on some day; trips of unknown services count."""
    times = feed["stop_times"].select("trip_id", "stop_id")
    if "calendar" in feed:
        runs = F.lit(False)
        for d in DAYS:
            runs = runs | (F.coalesce(F.col(d), F.lit("0")) == "1")
        services = feed["calendar"].groupBy("service_id").agg(F.max(runs).alias("active"))
        active = services.where("active").select("service_id", F.lit(True).alias("runs"))
        some = F.broadcast(services.agg(F.coalesce(F.max("active"), F.lit(False)).alias("some")))  # one row
        by_trip = feed["trips"].groupBy("trip_id").agg(F.max("service_id").alias("service_id")).join(active, "service_id", "left").select("trip_id", "service_id", F.coalesce("runs", F.lit(False)).alias("runs"))
        times = times.join(by_trip, "trip_id", "left").join(some, F.lit(True)).where("not some or service_id is null or service_id = '' or runs")
    counts = times.groupBy("stop_id").agg(F.countDistinct("trip_id").alias("trips_per_day"))
    where = _placed(_is_stop(feed["stops"])).select("stop_id", F.coalesce("stop_name", F.lit("")).alias("stop_name"), "lon", "lat")
    return where.join(counts, "stop_id")


def frequency_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("stop_count"), F.coalesce(F.round(F.avg("trips_per_day"), 1), F.lit(0.0)).alias("avg_trips_per_day"), F.coalesce(F.max("trips_per_day"), F.lit(0)).alias("max_trips_per_day"))


def statistics(feed: dict[str, DataFrame]) -> DataFrame:
    """One row: stops, routes, trips, and routes by label."""
    labels = feed["routes"].select(route_label(F.coalesce("route_type", F.lit("3"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    by = labels.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit(": "), F.col("n").cast("string")))), ", "), F.lit("")).alias("routes_by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("route_count"))
    n_stops = _is_stop(feed["stops"]).agg(F.count(F.lit(1)).alias("stop_count"))
    n_trips = feed["trips"].agg(F.countDistinct("trip_id").alias("trip_count"))
    return by.join(n_stops, F.lit(True)).join(n_trips, F.lit(True)).select("stop_count", "route_count", "trip_count", "routes_by_type")


def report(feed: dict[str, DataFrame]) -> DataFrame:
    """All analyses in one row; a part whose files are missing is null, not an error."""
    out = statistics(feed)
    parts = [lambda: stops_summary(stops(feed)).drop("stop_count"), lambda: frequency_summary(frequency(feed)).drop("stop_count"), lambda: route_lines(feed).agg(F.count(F.lit(1)).alias("routes_with_lines"))]
    names = [["bbox_min_lat", "bbox_min_lon", "bbox_max_lat", "bbox_max_lon"], ["avg_trips_per_day", "max_trips_per_day"], ["routes_with_lines"]]
    for part, columns in zip(parts, names, strict=True):
        try:
            out = out.join(part(), F.lit(True))
        except KeyError:
            out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in columns])
    return out
