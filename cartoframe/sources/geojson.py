"""GeoJSON layers: one FeatureCollection a file, or one feature a line.

The layer schema is feature_id, osm_type, tags, gtype, coords, parts, lon, lat:
coords are the point, the line, or the outer ring (of several the first); parts are
the polygons with their holes; lon and lat the point or the middle of the box.
Geometry that cannot be read is null, and the row survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoframe.functions import geo as G
from cartoframe.runtime import Scratch
from cartoframe.sources import files

_FEATURE = "struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def _positions(points: Column) -> Column:
    return F.transform(F.filter(points, lambda p: F.size(p) >= 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))


def _layer(features: DataFrame) -> DataFrame:
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.from_json(text, "array<double>")
    line = F.from_json(text, "array<array<double>>")
    ring = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    parts = F.when(kind == "Polygon", F.array(F.transform(ring, _positions))).when(kind == "MultiPolygon", F.transform(many, lambda part: F.transform(part, _positions)))
    coords = F.when(kind == "Point", _positions(F.array(point))).when(kind.isin("LineString", "MultiPoint"), _positions(line)).when(kind.isin("Polygon", "MultiLineString"), _positions(F.get(ring, F.lit(0)))).when(kind == "MultiPolygon", _positions(F.get(F.get(many, F.lit(0)), F.lit(0))))
    out = features.select(F.coalesce(F.col("f.id"), F.col("f.properties")["@id"]).alias("feature_id"), F.col("f.properties")["osm_type"].alias("osm_type"), F.col("f.properties").alias("tags"), kind.alias("gtype"), coords.alias("coords"), parts.alias("parts"))
    out = out.withColumn("coords", F.when(F.size("coords") > 0, F.col("coords"))).withColumn("parts", F.when(F.col("coords").isNotNull(), F.col("parts")))
    centre = F.when(F.col("parts").isNotNull(), G.bbox_centre(F.flatten(F.flatten("parts")))).when(F.col("coords").isNotNull(), G.bbox_centre(F.col("coords")))
    return out.withColumn("__c", centre).withColumn("lon", F.col("__c.lon")).withColumn("lat", F.col("__c.lat")).drop("__c")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollections, one a file: a file is read by one task.  Layers that are large are better kept a feature a line."""
    raw = spark.read.schema(f"type string, features array<{_FEATURE}>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return _layer(raw.select(F.explode("features").alias("f")).where("f is not null"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A feature a line: files are split among tasks.  Lines that are no features are skipped."""
    text = spark.read.text(path).select(F.from_json(F.regexp_replace(F.regexp_replace("value", r"^[\x1e\s]+", ""), r",\s*$", ""), _FEATURE).alias("f"))
    return _layer(text.where("f is not null and f.type = 'Feature'"))


def feature_json(df: DataFrame) -> DataFrame:
    """One column of feature texts."""
    at = lambda p: F.array(p["lon"], p["lat"])
    points = F.transform("coords", at)
    if "parts" in df.columns:
        whole = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, at)))
        areas = F.when(F.col("parts").isNotNull(), F.when(F.col("gtype") == "MultiPolygon", F.to_json(whole)).otherwise(F.to_json(F.get(whole, F.lit(0)))))
    else:
        areas = F.lit(None).cast("string")
    shape = F.when(areas.isNotNull(), areas).when(F.col("gtype") == "Point", F.to_json(F.get(points, F.lit(0)))).when(F.col("gtype") == "Polygon", F.concat(F.lit("["), F.to_json(points), F.lit("]"))).otherwise(F.to_json(points))
    geometry = F.when(F.col("coords").isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"type":"'), F.col("gtype"), F.lit('","coordinates":'), shape, F.lit("}")))
    # explicit nulls among the properties stay
    tags = F.when(F.col("tags").isNull(), F.lit("{}")).otherwise(F.to_json("tags", {"ignoreNullFields": "false"}))
    quoted = F.to_json(F.array(F.col("feature_id").cast("string")))
    name = F.when(F.col("feature_id").isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return df.select(F.concat(F.lit('{"type":"Feature","id":'), name, F.lit(',"properties":'), tags, F.lit(',"geometry":'), geometry, F.lit("}")).alias("value"))


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    feature_json(df).write.mode(mode).text(path)


def write_collection(df: DataFrame, path: str) -> None:
    """One FeatureCollection in one file: features are written by all tasks, then their files are joined byte by byte."""
    spark = df.sparkSession
    scratch = f"{Scratch(spark, 'collection').root}/lines"
    feature_json(df).select(F.concat(F.lit(","), "value")).write.text(scratch)
    files.join(spark, scratch, path, b'{"type":"FeatureCollection","features":[\n', b"]}\n", skip=1)


def root_issues(spark: SparkSession, path: str) -> DataFrame:
    """file, message for files whose root is no FeatureCollection, or one without a list of features."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.from_json("value", "struct<type:string,features:string>").alias("r"))
    message = F.when(F.col("r.type").isNull(), "No type at the root").when(F.col("r.type") != "FeatureCollection", F.concat(F.lit("Root is "), "r.type", F.lit(", not FeatureCollection"))).when(~F.coalesce(F.ltrim("r.features").startswith("["), F.lit(False)), "No list of features")
    return raw.select("file", message.alias("message")).where("message is not null")
