"""Columnar and relational sources, transit feeds, and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoframe.functions import classify as C
from cartoframe.operators import filters as T
from cartoframe.operators import history
from cartoframe.runtime import Scratch
from cartoframe.sources import files

# --- columnar map data -------------------------------------------------------------------------------

# Fixed values of the columnar format: category -> theme, type, column with the class, tag that the class becomes.
THEMES = {
    "routes": ("transportation", "segment", "subtype", "route"),
    "roads": ("transportation", "segment", "class", "highway"),
    "amenities": ("places", "place", "categories.primary", "amenity"),
    "pois": ("places", "place", "categories.primary", "amenity"),
    "buildings": ("buildings", "building", "class", "building"),
    "boundaries": ("divisions", "division_area", "subtype", "boundary"),
    "population": ("divisions", "division", "subtype", "place"),
    "parks": ("base", "land_use", "class", "leisure"),
}


def read_themed(spark: SparkSession, root: str, category: str, bbox: tuple[float, float, float, float] | None = None, classes: tuple[str, ...] = ()) -> DataFrame:
    """id, tags (class, name), lon, lat of a category under root/theme=/type=; the filters of box and classes reach the scan.  Missing data is an error, never an empty layer."""
    theme, kind, cls, tag = THEMES[category]
    df = spark.read.parquet(f"{root}/theme={theme}/type={kind}")
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        df = df.where((F.col("bbox.xmin") <= x1) & (F.col("bbox.xmax") >= x0) & (F.col("bbox.ymin") <= y1) & (F.col("bbox.ymax") >= y0))
    if classes:
        df = df.where(F.col(cls).isin(*classes))
    entries = [F.struct(F.lit(tag).alias("k"), F.col(cls).cast("string").alias("v")), F.struct(F.lit("name").alias("k"), F.col("names.primary").cast("string").alias("v"))]
    return df.select("id", F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull())).alias("tags"), ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("lon"), ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("lat"))


def read_history(spark: SparkSession, path: str, match: Column | None = None, as_of: Column | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Contributions of a Parquet history at a moment, over a window, or the latest; metadata only under reserved names."""
    df = history.extract(spark.read.parquet(path), as_of, since, until, match)
    meta = [c for c in ("osm_type", "osm_id", "osm_version", "contrib_type", "valid_from", "valid_to") if c in df.columns]
    return df.select(*[F.col(c).alias(c if c.startswith("osm_") else f"osm_{c}") for c in meta], "tags", *[c for c in ("lon", "lat", "area", "length") if c in df.columns])


# --- relational --------------------------------------------------------------------------------------

# Category -> condition on a jsonb column `tags`.
_CONDITIONS = {
    "routes": "tags ? 'route'",
    "amenities": "tags ? 'amenity' OR tags ? 'shop' OR tags ? 'tourism'",
    "roads": "tags ? 'highway'",
    "parks": "tags->>'leisure' IN ('park', 'nature_reserve') OR tags->>'boundary' IN ('national_park', 'protected_area')",
    "buildings": "tags ? 'building'",
    "boundaries": "tags->>'boundary' = 'administrative'",
    "population": "tags ? 'place' OR tags ? 'population'",
    "pois": "tags ? 'amenity' OR tags ? 'tourism' OR tags ? 'historic'",
}


#: category -> tables of the schema that hold it.
_TABLE = {"roads": "osm_ways", "routes": "osm_ways", "parks": "osm_ways", "buildings": "osm_ways", "boundaries": "osm_ways"}
_PARK_KINDS = {"national": "tags->>'boundary' = 'national_park' OR tags->>'protect_class' = '2'", "state": "tags->>'protect_class' = '5'", "nature_reserve": "tags->>'leisure' = 'nature_reserve'"}


def _quoted(*values: object) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def class_condition(category: str, kind: str) -> str | None:
    """What a class of a category adds to its condition; None for `all`.  An unknown class is an error."""
    if kind in ("all", "*"):
        return None
    if category == "routes":
        return f"tags->>'route' IN ({_quoted(*T.ROUTE_MODES[kind])})"
    if category == "amenities":
        return f"tags->>'amenity' IN ({_quoted(*C.AMENITY_CATEGORIES[kind])})"
    if category == "parks":
        return _PARK_KINDS[kind]
    key = {"roads": "highway", "buildings": "building", "population": "place"}.get(category)
    if key is None and category != "boundaries":
        raise KeyError(f"{category} has no classes")
    if category == "boundaries":
        return f"tags->>'admin_level' = {_quoted(T.ADMIN_LEVELS.get(kind, kind))}"
    return f"tags->>'{key}' IN ({_quoted(*kind.split(','))})"


def relational_query(category: str, region: str, table: str | None = None, kind: str = "all", protect: tuple[str, ...] = (), min_population: int = 0) -> str:
    """The pushed-down query of a category, or of one class of it, in a region."""
    table = table or _TABLE.get(category, "osm_nodes")
    if not table.replace("_", "").isalnum():
        raise ValueError(f"not a table name: {table}")
    conditions = [f"region = {_quoted(region)}", f"({_CONDITIONS[category]})"]
    if (own := class_condition(category, kind)) is not None:
        conditions.append(f"({own})")
    if protect:
        conditions.append(f"tags->>'protect_class' IN ({_quoted(*protect)})")
    if min_population > 0:
        conditions.append(f"CAST(NULLIF(regexp_replace(tags->>'population', '[^0-9]', '', 'g'), '') AS bigint) >= {int(min_population)}")
    return f"SELECT osm_id, tags::text AS tags, ST_X(ST_Centroid(geom)) AS lon, ST_Y(ST_Centroid(geom)) AS lat FROM {table} WHERE {' AND '.join(conditions)}"


def read_relational(spark: SparkSession, url: str, category: str, region: str, table: str | None = None, partitions: int = 8, bounds: tuple[int, int] = (0, 1 << 40), kind: str = "all", **options: str) -> DataFrame:
    """The category (or a class of it) over JDBC, in parallel ranges of ids."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({relational_query(category, region, table, kind)}) t", partitionColumn="osm_id", lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions), **options)
    return reader.load().withColumn("tags", F.from_json("tags", "map<string,string>"))


# --- transit -----------------------------------------------------------------------------------------

FEED_FILES = ("agency", "stops", "routes", "trips", "stop_times", "shapes", "calendar")


def read_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The files of a feed that are there, all columns strings.  A path that ends in .zip is unpacked to the shared folder first; its files may stand in a folder of the archive."""
    if path.lower().endswith(".zip"):
        folder = Scratch(spark, "feed").root
        files.unzip(spark, path, folder, tuple(f"{n}.txt" for n in FEED_FILES))
        path = folder
    out = {}
    for name in FEED_FILES:
        fs, at = files.place(spark, f"{path}/{name}.txt")
        if fs.exists(at):
            out[name] = spark.read.option("header", True).option("inferSchema", False).csv(f"{path}/{name}.txt")
    for need in ("stops", "routes", "trips", "stop_times"):
        if need not in out:
            raise FileNotFoundError(f"{path}/{need}.txt")
    return out


# --- sinks -------------------------------------------------------------------------------------------


def upsert(table: DataFrame | None, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after an upsert: new rows replace old ones of the same keys; of several the last by `order` wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return last if table is None else table.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def import_dataset(spark: SparkSession, rows: DataFrame, path: str, dataset: str, feature_key: str = "feature_id") -> int:
    """Replaces one dataset's partition of a document table; returns its number of rows."""
    keyed = rows.withColumn("dataset_key", F.lit(dataset)).dropDuplicates([feature_key])
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_key").parquet(path)
    return spark.read.parquet(path).where(F.col("dataset_key") == dataset).count()


def split_by_geometry(df: DataFrame) -> dict[str, DataFrame]:
    """Points, lines, polygons and the rest, as formats with one geometry type a file need them."""
    g = F.coalesce("gtype", F.lit(""))
    return {"points": df.where(g.isin("Point", "MultiPoint")), "lines": df.where(g.isin("LineString", "MultiLineString")), "polygons": df.where(g.isin("Polygon", "MultiPolygon")), "others": df.where(~g.isin("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"))}


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """A table per value, as tiers and regions are published."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def summary_page(title: str, summary: DataFrame) -> str:
    """An HTML table of a summary, all of its rows: they pass through the driver, one partition at a time."""
    import html

    rows = summary.toLocalIterator()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in summary.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
