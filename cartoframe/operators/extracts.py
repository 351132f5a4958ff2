"""Extracts as element tables: rolled forward by change files, and cut to regions.

Elements have the columns of sources.pbf.ELEMENTS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoframe.operators.spatial import matches
from cartoframe.runtime import Scratch
from cartoframe.streaming.changes import last_operations

COLUMNS = ("osm_type", "id", "version", "lon", "lat", "tags", "node_refs", "members")


def apply_diffs(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """The elements after the changes (columns of sources.diffs.CHANGES): the last operation on each element wins, in order of sequence and place.

    A deletion removes, anything else replaces.  An operation on a version older
    than the extract's changes nothing, so diffs may be applied again.
    """
    named = changes.withColumn("__key", F.concat_ws(":", "osm_type", F.col("osm_id").cast("string")))
    last = last_operations(named, "__key", "sequence", "seq_pos")
    last = last.select("__key", "osm_type", F.col("osm_id").alias("id"), "op", "version", "lon", "lat", "tags", "node_refs", "members")
    keyed = elements.select(*COLUMNS).withColumn("__key", F.concat_ws(":", "osm_type", F.col("id").cast("string")))
    have = keyed.select("__key", F.col("version").alias("__have"))
    fresh = last.join(have, "__key", "left").where("__have is null or version is null or version >= __have").drop("__have")
    kept = keyed.join(fresh.select("__key"), "__key", "left_anti").select(*COLUMNS)
    return kept.unionByName(fresh.where("op <> 'delete'").select(*COLUMNS))


def cut_regions(elements: DataFrame, areas: DataFrame) -> DataFrame:
    """`region` and the elements of each region, ways complete.

    A region has the nodes inside, the ways with such a node, all nodes of those
    ways, and the relations with a member among all these.  areas: region, coords
    (or rings).  An element of several regions is in each.
    """
    scratch = Scratch(elements.sparkSession, "regions")
    nodes = elements.where("osm_type = 'node' and lon is not null and lat is not null")
    inside = matches(nodes.select("id", "lon", "lat"), areas).select(F.col("area.region").alias("region"), "id").distinct()
    inside = scratch.table(inside)
    refs = scratch.table(elements.where("osm_type = 'way'").select(F.col("id").alias("way"), F.explode(F.array_distinct("node_refs")).alias("id")))
    ways = scratch.table(refs.join(inside, "id").select("region", "way").distinct())
    own = inside.union(ways.join(refs, "way").select("region", "id")).distinct().select("region", F.lit("node").alias("osm_type"), "id")
    own = scratch.table(own.union(ways.select("region", F.lit("way"), "way")))
    members = elements.where("osm_type = 'relation'").select(F.col("id").alias("relation"), F.explode("members").alias("m")).select("relation", F.col("m.type").alias("osm_type"), F.col("m.ref").alias("id")).distinct()
    relations = members.join(own, ["osm_type", "id"]).select("region", F.lit("relation").alias("osm_type"), F.col("relation").alias("id")).distinct()
    return own.union(relations).join(elements.select(*COLUMNS), ["osm_type", "id"]).select("region", *COLUMNS)
