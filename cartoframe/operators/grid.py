"""Grids: heat cells, coverage gaps, route density, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoframe.functions import geo as G

# Kilometres of a degree in heat maps, metres of one in transit grids, and the number of cells at which those coarsen.
HEAT_KM_PER_DEGREE = 111.0
TRANSIT_M_PER_DEGREE = 111_132.0
MAX_CELLS = 10_000


def heat_cells(df: DataFrame, cell_km: float) -> DataFrame:
    """cell_x, cell_y, lon, lat (means), n.  A cell's width follows each point's own latitude."""
    dlat = cell_km / HEAT_KM_PER_DEGREE
    dlon = F.lit(cell_km) / (F.lit(HEAT_KM_PER_DEGREE) * F.greatest(F.lit(0.1), F.cos(F.radians("lat"))))
    return df.where("lon is not null and lat is not null").groupBy(F.floor(F.col("lon") / dlon).alias("cell_x"), F.floor(F.col("lat") / dlat).alias("cell_y")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("n"))


def heat_weights(df: DataFrame, weight: Column) -> DataFrame:
    """Points with a weight; what is not a number or 0 weighs 1."""
    w = weight.try_cast("double")
    return df.withColumn("weight", F.when(w.isNull() | F.isnan(w) | (w == 0), F.lit(1.0)).otherwise(w))


def transit_grid(box: tuple[float, float, float, float], cell_m: float) -> tuple[float, float, float, float]:
    """(least lat, least lon, lat step, lon step) for a box (min_lat, min_lon, max_lat, max_lon); coarser beyond MAX_CELLS cells."""
    min_lat, min_lon, max_lat, max_lon = box
    lat = cell_m / TRANSIT_M_PER_DEGREE
    lon = cell_m / (TRANSIT_M_PER_DEGREE * math.cos(math.radians((min_lat + max_lat) / 2)))
    count = lambda: max(1, math.ceil((max_lat - min_lat) / lat)) * max(1, math.ceil((max_lon - min_lon) / lon))
    if (n := count()) > MAX_CELLS:
        lat, lon = lat * math.sqrt(n / MAX_CELLS), lon * math.sqrt(n / MAX_CELLS)
    return min_lat, min_lon, lat, lon


def _box(df: DataFrame) -> tuple[float, float, float, float] | None:
    row = tuple(df.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first())
    return None if row[0] is None else row


def _cells(df: DataFrame, grid: tuple[float, float, float, float]) -> DataFrame:
    """Rows and columns, truncated towards 0 as an integer conversion does."""
    y, x, sy, sx = grid
    return df.withColumn("grid_row", ((F.col("lat") - y) / sy).cast("long")).withColumn("grid_col", ((F.col("lon") - x) / sx).cast("long"))


def coverage(stops: DataFrame, features: DataFrame, cell_m: float = 500.0) -> DataFrame:
    """grid_row, grid_col, covered of every cell with features: a cell without stops is a gap."""
    stops, features = (df.where("lon is not null and lat is not null").select("lon", "lat") for df in (stops, features))
    box = _box(stops.union(features))
    if box is None:
        return stops.sparkSession.createDataFrame([], "grid_row long, grid_col long, covered boolean")
    grid = transit_grid(box, cell_m)
    with_features = _cells(features, grid).select("grid_row", "grid_col").distinct()
    with_stops = _cells(stops, grid).select("grid_row", "grid_col").distinct().withColumn("covered", F.lit(True))
    return with_features.join(with_stops, ["grid_row", "grid_col"], "left").select("grid_row", "grid_col", F.coalesce("covered", F.lit(False)).alias("covered"))


def coverage_summary(cells: DataFrame) -> DataFrame:
    n, covered = F.count(F.lit(1)), F.coalesce(F.sum(F.col("covered").cast("long")), F.lit(0))
    return cells.agg(n.alias("total_cells"), covered.alias("covered_cells"), (n - covered).alias("gap_cells"), F.when(n > 0, F.round(covered / n * 100, 1)).otherwise(0.0).alias("coverage_pct"))


def route_density(routes: DataFrame, cell_m: float = 500.0, key: str = "route_id", coords: str = "coords") -> DataFrame:
    """grid_row, grid_col, route_count: routes with a vertex in the cell.  The grid spans the routes' vertex means."""
    lines = routes.where((F.col("gtype") == "LineString") & (F.size(coords) > 0)) if "gtype" in routes.columns else routes.where(F.size(coords) > 0)
    centre = lines.select(G.vertex_mean(F.col(coords)).alias("c")).select("c.lon", "c.lat")
    box = _box(centre)
    if box is None:
        return routes.sparkSession.createDataFrame([], "grid_row long, grid_col long, route_count long")
    points = lines.select(key, F.explode(coords).alias("p")).select(key, "p.lon", "p.lat")
    return _cells(points, transit_grid(box, cell_m)).groupBy("grid_row", "grid_col").agg(F.countDistinct(key).alias("route_count"))


def density_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count(F.lit(1)).alias("total_cells"), F.coalesce(F.max("route_count"), F.lit(0)).alias("max_routes_per_cell"), F.coalesce(F.round(F.avg("route_count"), 1), F.lit(0.0)).alias("avg_routes_per_cell"))


def tiles(df: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """z, x, y, n of the slippy tiles that hold points, for every zoom of a range."""
    z = df.where("lon is not null and lat is not null").withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    return z.groupBy("z", G.tile_x(F.col("lon"), F.col("z")).alias("x"), G.tile_y(F.col("lat"), F.col("z")).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def square_cells(df: DataFrame, cell_km: float) -> DataFrame:
    """cell_x, cell_y of square cells on a plane scaled at the equator: the stand-in for hexagons."""
    step = cell_km / G.KM_PER_DEGREE
    return df.withColumn("cell_x", F.floor(F.col("lon") / step)).withColumn("cell_y", F.floor(F.col("lat") / step))
