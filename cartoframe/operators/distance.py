"""Distance joins.

A join within d becomes an equi-join on grid cells: cells are at least d wide, so
a point's partners are in its own or the eight cells around.  The reference side
is repeated into its nine cells; the exact distance is tested on what meets.
Cells are sized for the latitude farthest from the equator, wrap at 180 degrees
and cover the whole circle near the poles, so nothing is lost.  The plan is a
shuffle on the cell; AQE splits crowded cells.

A join without a cap gives each subject a radius by the references around it: the
width of the smallest cell, of levels that are each RATIO times as wide, that holds
the subject and enough references.  So a subject in a crowded place meets the few
around it, one far out meets what lies that far, and each is joined once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoframe.functions import geo as G
from cartoframe.runtime import Scratch

_HALF_WORLD_KM = 20040.0


def _grid(d_km: float, max_abs_lat: float) -> tuple[float, float, int]:
    """Height and width of a cell in degrees, and cells around the world."""
    dlat = d_km / G.KM_PER_DEGREE * 1.001 + 1e-9
    edge = max_abs_lat + dlat
    if edge >= 89.9:
        return dlat, 360.0, 1
    # a circle of angular radius delta reaches asin(sin delta / cos lat) in longitude
    reach = math.sin(math.radians(min(90.0, dlat))) / math.cos(math.radians(max_abs_lat)) if max_abs_lat < 90 else 1.0
    dlon = 360.0 if reach >= 1 else math.degrees(math.asin(reach)) * 1.001 + 1e-9
    n = max(1, math.floor(360.0 / dlon))
    return dlat, 360.0 / n, n


def _cell(lon: Column, lat: Column, dlat: float, dlon: float, n: int) -> tuple[Column, Column]:
    return F.pmod(F.floor((lon + 180) / dlon), F.lit(n)).cast("long"), F.floor((lat + 90) / dlat).cast("long")


def _max_abs_lat(df: DataFrame) -> float:
    return float(df.agg(F.max(F.abs("lat"))).first()[0] or 0.0)


def within(subject: DataFrame, reference: DataFrame, d_km: float, max_abs_lat: float | None = None, radius: float = G.EARTH_KM) -> DataFrame:
    """Pairs at most d_km apart: subject columns, `ref` (a struct of the reference row), `distance_km`.  Both need lon and lat."""
    if d_km >= _HALF_WORLD_KM / 2:
        dlat, dlon, n, rows = 181.0, 360.0, 1, 1
    else:
        dlat, dlon, n = _grid(d_km, _max_abs_lat(subject.select("lat").union(reference.select("lat"))) if max_abs_lat is None else max_abs_lat)
        rows = 3
    sx, sy = _cell(F.col("lon"), F.col("lat"), dlat, dlon, n)
    left = subject.where("lon is not null and lat is not null").withColumn("__x", sx).withColumn("__y", sy)
    around = sorted({k % n for k in (-1, 0, 1)})
    right = reference.where("lon is not null and lat is not null").select(F.struct(*reference.columns).alias("ref"))
    rx, ry = _cell(F.col("ref.lon"), F.col("ref.lat"), dlat, dlon, n)
    steps = (-1, 0, 1) if rows == 3 else (0,)
    right = right.withColumn("__x", F.explode(F.array(*[F.pmod(rx + k, F.lit(n)) for k in around]))).withColumn("__y", F.explode(F.array(*[ry + k for k in steps])))
    out = left.join(right, ["__x", "__y"]).withColumn("distance_km", G.haversine(F.col("lon"), F.col("lat"), F.col("ref.lon"), F.col("ref.lat"), radius))
    return out.where(F.col("distance_km") <= d_km).drop("__x", "__y")


#: Radii in kilometres of the levels of cells, each RATIO times the one before.
FIRST_KM, RATIO = 0.05, 4.0


def _levels() -> list[float]:
    out = [FIRST_KM]
    while out[-1] * RATIO < _HALF_WORLD_KM / 2:
        out.append(out[-1] * RATIO)
    return [*out, _HALF_WORLD_KM]


def _by_density(subject: DataFrame, reference: DataFrame, k: int, key: str) -> DataFrame:
    """Located subjects with `__level`: of the smallest cell around them that holds k references.  The cell's diagonal is at most the level's radius, so k references are within it."""
    side = [r / math.sqrt(2) / G.EARTH_KM * 180 / math.pi * 0.999 for r in _levels()]
    cells = F.array(*[F.struct(F.lit(i).alias("z"), F.lit(s).alias("s")) for i, s in enumerate(side[:-1])])
    at = lambda df: df.select("*", F.explode(cells).alias("__c")).select("*", F.col("__c.z").alias("__z"), F.floor(F.col("lon") / F.col("__c.s")).cast("long").alias("__x"), F.floor(F.col("lat") / F.col("__c.s")).cast("long").alias("__y")).drop("__c")
    full = at(reference.select("lon", "lat")).groupBy("__z", "__x", "__y").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= k).select("__z", "__x", "__y")
    found = at(subject.select(key, "lon", "lat")).join(full, ["__z", "__x", "__y"]).groupBy(key).agg(F.min("__z").alias("__level"))
    return subject.join(found, key, "left").withColumn("__level", F.coalesce("__level", F.lit(len(side) - 1)))


def k_nearest(subject: DataFrame, reference: DataFrame, k: int, key: str, ref_order: str, max_km: float | None = None, radius: float = G.EARTH_KM) -> DataFrame:
    """Each subject's k nearest (fewer, if there are no more within max_km): within()'s columns and `rank`.  Ties by `ref_order`.  The key names a subject."""
    order = Window.partitionBy(key).orderBy("distance_km", f"ref.{ref_order}")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if max_km is not None:
        return ranked(within(subject, reference, max_km, radius=radius))
    located = reference.where("lon is not null and lat is not null")
    todo = subject.where("lon is not null and lat is not null")
    n = located.count()
    if not n:
        return ranked(within(todo, located, 1.0, 0.0, radius))
    scratch = Scratch(subject.sparkSession, "nearest")
    todo = scratch.table(_by_density(todo, located, min(k, n), key))
    used = sorted(r[0] for r in todo.select("__level").distinct().collect())  # as many as levels at most
    high = _max_abs_lat(todo.select("lat").union(located.select("lat")))
    levels, out = _levels(), None
    for i in used:
        # the cells are cut on the sphere of the default radius
        part = within(todo.where(F.col("__level") == i).drop("__level"), located, levels[i] * max(1.0, radius / G.EARTH_KM) * (1 + 1e-9), high, radius)
        out = part if out is None else out.unionByName(part)
    return ranked(out) if out is not None else ranked(within(todo.drop("__level"), located, 1.0, 0.0, radius))


def nearest(subject: DataFrame, reference: DataFrame, key: str, ref_order: str, max_km: float | None = None, radius: float = G.EARTH_KM) -> DataFrame:
    """Each subject with its nearest reference.  With a cap, the least is taken by aggregation, without a sort, once for all subjects at one place, which meets what is around it as far as it has to."""
    if max_km is None:
        return k_nearest(subject, reference, 1, key, ref_order, None, radius).drop("rank")
    # 0.0 and -0.0 are one place
    x, y = (F.col(c) + 0.0 for c in ("lon", "lat"))
    places = subject.where("lon is not null and lat is not null").select(x.alias("lon"), y.alias("lat")).distinct()
    best = F.min_by(F.struct("ref", "distance_km"), F.struct("distance_km", F.col(f"ref.{ref_order}")))
    located = reference.where("lon is not null and lat is not null")
    places = Scratch(subject.sparkSession, "nearest").table(_by_density(places.withColumn("__at", F.struct("lon", "lat")), located, 1, "__at").drop("__at"))
    high = _max_abs_lat(places.select("lat").union(located.select("lat")))
    wide = [r * max(1.0, radius / G.EARTH_KM) * (1 + 1e-9) for r in _levels()]
    pairs = within(places.where(F.element_at(F.array(*map(F.lit, wide)), F.col("__level") + 1) >= max_km), reference, max_km, high, radius)
    for i in sorted(r[0] for r in places.select("__level").distinct().collect()):  # as many as levels at most
        if wide[i] < max_km:
            pairs = pairs.unionByName(within(places.where(F.col("__level") == i), reference, wide[i], high, radius))
    found = pairs.groupBy(F.col("lon").alias("__lon"), F.col("lat").alias("__lat")).agg(best.alias("__b"))
    return subject.join(found, (x == F.col("__lon")) & (y == F.col("__lat"))).select(*subject.columns, "__b.ref", "__b.distance_km")


def _annotated(df: DataFrame, unit: str, name: str) -> DataFrame:
    metres = F.col("distance_km") * 1000
    return df.withColumn("nearest_distance_m", F.round(metres, 3)).withColumn("nearest_distance", F.round(metres / G.unit_factor(unit), 6)).withColumn("nearest_ref_name", F.when(F.col(f"ref.{name}") != "", F.col(f"ref.{name}"))).drop("ref", "distance_km")


def within_distance(subject: DataFrame, reference: DataFrame, distance: float, unit: str = "km", *, key: str, ref_order: str, name: str = "name") -> DataFrame:
    """Subjects with a reference in reach, annotated with the nearest; 0 or less is no cap.  Subjects without a place are dropped; an empty reference keeps none."""
    cap = G.to_metres(distance, unit) / 1000 if distance > 0 else None
    return _annotated(nearest(subject, reference, key, ref_order, cap), unit, name)


def beyond_distance(subject: DataFrame, reference: DataFrame, distance: float, unit: str = "km", *, key: str) -> DataFrame:
    """The complement: subjects without a place stay, an empty reference keeps all; 0 or less is no cap."""
    if distance <= 0:
        some = reference.where("lon is not null and lat is not null").limit(1).count()
        return subject.where("lon is null or lat is null") if some else subject
    near = within(subject.select(key, "lon", "lat"), reference.select("lon", "lat"), G.to_metres(distance, unit) / 1000).select(key).distinct()
    return subject.join(near, key, "left_anti")


def nearest_annotated(subject: DataFrame, reference: DataFrame, max_distance: float = 0, unit: str = "km", *, key: str, ref_order: str, name: str = "name", strict: bool = False) -> DataFrame:
    """Every subject with its nearest reference, nulls where there is none in reach; `strict` drops those."""
    cap = G.to_metres(max_distance, unit) / 1000 if max_distance > 0 else None
    found = _annotated(nearest(subject, reference, key, ref_order, cap), unit, name)
    return found if strict else subject.join(found.select(key, "nearest_distance_m", "nearest_distance", "nearest_ref_name"), key, "left")


def candidates_with_buckets(subject: DataFrame, reference: DataFrame, k: int, *, key: str, ref_key: str, radii: tuple[float, ...] = (10.0, 25.0, 50.0)) -> tuple[DataFrame, DataFrame]:
    """(the k nearest, counts within the radii for every located subject)."""
    near = k_nearest(subject, reference, k, key, ref_key)
    counted = within(subject.select(key, "lon", "lat"), reference.select(ref_key, "lon", "lat"), max(radii)).groupBy(key).agg(*[F.sum((F.col("distance_km") <= r).cast("long")).alias(f"within_{int(r)}") for r in radii])
    located = subject.where("lon is not null and lat is not null").select(key)
    counts = located.join(counted, key, "left").select(key, *[F.coalesce(f"within_{int(r)}", F.lit(0)).alias(f"within_{int(r)}") for r in radii])
    return near, counts


def nearest_stops(features: DataFrame, stops: DataFrame, max_m: float, *, key: str, stop_key: str = "stop_id", stop_name: str = "stop_name") -> DataFrame:
    """Every located feature with the nearest stop in reach, else empty names and -1."""
    found = nearest(features, stops, key, stop_key, max_m / 1000 * (1 + 1e-12), G.EARTH_KM)
    found = found.select(key, F.col(f"ref.{stop_key}").alias("nearest_stop_id"), F.col(f"ref.{stop_name}").alias("nearest_stop_name"), F.round(F.col("distance_km") * 1000, 1).alias("distance_m"))
    located = features.where("lon is not null and lat is not null")
    return located.join(found, key, "left").withColumn("nearest_stop_id", F.coalesce(F.col("nearest_stop_id").cast("string"), F.lit(""))).withColumn("nearest_stop_name", F.coalesce("nearest_stop_name", F.lit(""))).withColumn("distance_m", F.coalesce("distance_m", F.lit(-1.0)))


def accessibility_bands(features: DataFrame, stops: DataFrame, threshold_m: float = 400.0, *, key: str, stop_key: str = "stop_id") -> DataFrame:
    """The least distance and its band.  Labels are fixed, cut-offs are the threshold and its double; the distance is the true least."""
    found = nearest(features, stops, key, stop_key)
    d = F.col("distance_km") * 1000
    return found.select(*features.columns, F.round(d, 1).alias("distance_m"), F.when(d <= threshold_m, "within_400m").when(d <= 2 * threshold_m, "within_800m").otherwise("beyond_800m").alias("access"))


def exposure_join(sites: DataFrame, stations: DataFrame, max_km: float, *, key: str, station_key: str, value: str = "value", name: str = "name") -> DataFrame:
    """Inner join with the nearest station in reach, if that station has a value; classed by value."""
    from cartoframe.functions import classify as C

    found = nearest(sites, stations, key, station_key, max_km).where(F.col(f"ref.{value}").isNotNull())
    return found.select(*sites.columns, F.col(f"ref.{name}").alias("nearest_station"), F.round("distance_km", 2).alias("distance_km"), F.col(f"ref.{value}").alias("pm25"), C.exposure(F.col(f"ref.{value}")).alias("exposure"))


def point_pairs(points: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Unordered pairs a < b (of a group) with their distance.  The result is quadratic by definition: meant for a set of chosen places."""
    a = points.select(*([group] if group else []), F.struct(*points.columns).alias("a"))
    b = points.select(*([group] if group else []), F.struct(*points.columns).alias("b"))
    on = F.col(f"a.{key}") < F.col(f"b.{key}")
    joined = a.join(b, group).where(on) if group else a.join(b, on)
    return joined.withColumn("distance_km", G.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")))


def plan_city_pairs(cities: DataFrame, mode: str = "nearest", name: str = "name", population: str = "population") -> DataFrame:
    """(a, b) by name, a <= b: `nearest` links each city with its nearest other, `hub` all with the most populous, `all` all pairs.

    Cities are told apart by row, not by name.  Only `nearest` keeps one link of two
    names: the most populous city's, of these the shortest.
    """
    if mode not in ("nearest", "hub", "all"):
        raise ValueError(f"mode: nearest, hub or all, not {mode}")
    named = cities.select(F.col(name).alias("name"), F.col(population).alias("population"), "lon", "lat").withColumn("__city", F.monotonically_increasing_id())
    named = Scratch(cities.sparkSession, "cities").table(named)  # ids must not change between the sides of a join
    a, b = F.least("name", "ref.name").alias("a"), F.greatest("name", "ref.name").alias("b")
    if mode == "all":
        pairs = point_pairs(named, "__city")
        return pairs.select(F.least("a.name", "b.name").alias("a"), F.greatest("a.name", "b.name").alias("b"), "distance_km")
    if mode == "hub":
        hub = named.orderBy(F.desc("population"), "name", "__city").limit(1)
        return within(named, hub, _HALF_WORLD_KM).where("__city <> ref.__city").select(a, b, "distance_km")
    named = named.withColumn("__order", F.struct("name", "__city"))
    pairs = k_nearest(named, named, 2, "__city", "__order").where("__city <> ref.__city")
    pairs = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("__city").orderBy("distance_km", "ref.__order"))).where("__r = 1")
    return pairs.select(a, b, "population", "distance_km").groupBy("a", "b").agg(F.max_by("distance_km", F.struct("population", -F.col("distance_km"))).alias("distance_km"))
