"""Routing graphs as tables: the artifact that searches read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoframe.operators import network


def build(refs: DataFrame, nodes: DataFrame, path: str, profile: str = "car") -> None:
    """Edges and nodes of a profile under path/profile=..., written once and read by every search."""
    edges = network.build_by_nodes(refs, nodes)
    edges.write.mode("overwrite").parquet(f"{path}/profile={profile}/edges")
    used = edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    nodes.join(used, "node_id", "left_semi").select("node_id", "lon", "lat").write.mode("overwrite").parquet(f"{path}/profile={profile}/nodes")


def load(spark: SparkSession, path: str, profile: str = "car") -> tuple[DataFrame, DataFrame]:
    """(edges, nodes); a missing graph is an error."""
    return spark.read.parquet(f"{path}/profile={profile}/edges"), spark.read.parquet(f"{path}/profile={profile}/nodes")


def validate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, nodes, edges without a node, edges without a length, loops."""
    known = nodes.select(F.col("node_id").alias("__n")).distinct()
    ends = edges.select(F.explode(F.array("u", "v")).alias("__n")).distinct().join(known, "__n", "left_anti")
    a = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum((F.coalesce(F.col("length_m"), F.lit(0.0)) <= 0).cast("long")), F.lit(0)).alias("without_length"), F.coalesce(F.sum((F.col("u") == F.col("v")).cast("long")), F.lit(0)).alias("loops"))
    return a.join(nodes.agg(F.count(F.lit(1)).alias("nodes")), F.lit(True)).join(ends.agg(F.count(F.lit(1)).alias("lost_nodes")), F.lit(True))


def clean(spark: SparkSession, path: str, profile: str) -> bool:
    """Deletes a profile's graph; False if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/profile={profile}")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
