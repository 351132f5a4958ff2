"""One handle for a layer, wherever it is kept: analyses take a handle and run on any source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoframe.operators import ways
from cartoframe.runtime import Scratch
from cartoframe.sources import categories, geojson, pbf, tables


@dataclass(frozen=True)
class Handle:
    """kind: table, geojson, collection, pbf, themed, history, relational; place: its path or address; options: of the reader."""

    kind: str
    place: str
    region: str = ""
    options: dict = field(default_factory=dict)


def _of_extract(spark: SparkSession, h: Handle, category: str) -> DataFrame:
    """A category of an extract, with the geometry of nodes and ways."""
    elements = Scratch(spark, "extract").table(pbf.read_pbf(spark, h.place, **h.options))
    found = categories.load(elements, category)
    nodes = elements.where("osm_type = 'node'").select(F.col("id").alias("node_id"), "lon", "lat")
    refs = found.where("osm_type = 'way'").select(F.col("id").alias("way_id"), F.posexplode("node_refs").alias("pos", "node_id"))
    lines = ways.assemble(refs, nodes).select(F.lit("way").alias("osm_type"), F.col("way_id").alias("id"), "coords")
    layer = found.select(*[c for c in found.columns if c not in ("node_refs", "members")]).join(lines, ["osm_type", "id"], "left").withColumnRenamed("id", "feature_id")
    point = F.when(F.col("lon").isNotNull(), F.array(F.struct("lon", "lat")))
    return layer.withColumn("gtype", F.when(F.col("coords").isNotNull(), ways.geometry_type(F.col("coords"), F.col("tags"))).when(F.col("lon").isNotNull(), "Point")).withColumn("coords", F.coalesce("coords", point))


def _of_layer(read: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, Handle, str], DataFrame]:
    def run(spark: SparkSession, h: Handle, category: str) -> DataFrame:
        layer = read(spark, h.place)
        kind = F.coalesce("osm_type", F.when(F.col("gtype") == "Point", "node").otherwise("way"))
        return categories.load(layer.withColumn("osm_type", kind), category)

    return run


KINDS: dict[str, Callable[[SparkSession, Handle, str], DataFrame]] = {
    "table": lambda spark, h, category: categories.load(spark.read.parquet(h.place), category),
    "geojson": _of_layer(geojson.read_lines),
    "collection": _of_layer(geojson.read_collection),
    "pbf": _of_extract,
    "themed": lambda spark, h, category: tables.read_themed(spark, h.place, category, **h.options),
    "history": lambda spark, h, category: categories.load(tables.read_history(spark, h.place, **h.options), category),
    "relational": lambda spark, h, category: tables.read_relational(spark, h.place, category, h.region, **h.options),
}


def open_layer(spark: SparkSession, handle: Handle, category: str) -> DataFrame:
    """The category's layer of a source.  An unknown kind is an error, as is a source that is not there."""
    if handle.kind not in KINDS:
        raise ValueError(f"source: {', '.join(sorted(KINDS))}, not {handle.kind}")
    return KINDS[handle.kind](spark, handle, category)
