"""Synthetic feature layers over the driver's tables, as SQL that Spark and DuckDB run alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (tables, SQL)
SQL = {
    "geo_points": "select c_custkey as feature_id, -100e0 + (c_custkey*7919 % 10000)/1e3 as lon, 35e0 + (c_custkey*104729 % 7000)/1e3 as lat, c_name as name, c_nationkey as admin_id, cast(floor(abs(c_acctbal)*100e0) as bigint) as population, c_mktsegment as segment, c_acctbal as balance from customer",
    "geo_refs": "select s_suppkey as ref_id, -100e0 + (s_suppkey*15485863 % 10000)/1e3 as lon, 35e0 + (s_suppkey*32452843 % 7000)/1e3 as lat, s_name as name, s_nationkey as admin_id, s_acctbal as value from supplier",
    "geo_nodes": "select p_partkey as node_id, -100e0 + (p_partkey*6700417 % 10000)/1e3 as lon, 35e0 + (p_partkey*2147483 % 7000)/1e3 as lat, p_name as name, p_type as ptype, p_brand as ref, p_size as sz from part",
    "geo_ways": "select l_orderkey as way_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as pos, l_partkey as node_id from lineitem",
    "geo_way_tags": "select o_orderkey as way_id, case o_orderstatus when 'F' then 'motorway' when 'O' then 'primary' else 'tertiary' end as highway, case when o_orderkey % 5 = 0 then '65 mph' when o_orderkey % 5 = 1 then '100' when o_orderkey % 5 = 2 then 'signals' end as maxspeed, o_orderpriority as ref, o_orderkey % 7 = 0 as bridge from orders",
    "geo_admin": "select n_nationkey as admin_id, n_name as name, n_regionkey as parent_id, -100e0 + (n_nationkey % 5)*2e0 as min_lon, -98e0 + (n_nationkey % 5)*2e0 as max_lon, 35e0 + floor(n_nationkey/5)*1.4e0 as min_lat, 36.4e0 + floor(n_nationkey/5)*1.4e0 as max_lat from nation",
    "geo_history": "select o_custkey as osm_id, o_orderkey as version_id, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to, case o_orderstatus when 'F' then 'CREATION' when 'O' then 'TAG' else 'GEOMETRY' end as contrib_type from orders",
    "geo_changes": "select event_id as seq_pos, user_id as osm_id, cast(floor(event_id/1000) as bigint) as sequence, event_type, case when event_type='error' then 'delete' else 'upsert' end as op, value, ts from events",
    # a tagged layer of points: the amenity, shop and place keys a row has depend on its id
    "geo_tagged": "select p_partkey as feature_id, p_partkey % 13 as k, p_name as pname, case p_partkey % 6 when 0 then 'restaurant' when 1 then 'cafe' when 2 then 'hospital' when 3 then 'school' when 4 then 'bench' end as amenity, case when p_partkey % 9 = 0 then 'supermarket' end as shop, case p_partkey % 7 when 0 then 'museum' when 1 then 'hotel' end as tourism, case when p_partkey % 4 = 0 then 'Mo-Fr' end as opening_hours, p_size as sz, p_retailprice as price from part",
    "geo_places": "select c_custkey as feature_id, -100e0 + (c_custkey*7919 % 10000)/1e3 as lon, 35e0 + (c_custkey*104729 % 7000)/1e3 as lat, c_name as name, case c_custkey % 4 when 0 then 'city' when 1 then 'town' when 2 then 'village' else 'suburb' end as place, case c_custkey % 5 when 0 then cast(c_custkey*137 as varchar(20)) when 1 then concat('~', cast(c_custkey as varchar(20)), ',000') when 2 then concat(cast(c_custkey % 900 as varchar(20)), '.123+') when 3 then 'unknown' end as population, c_nationkey as admin_id from customer",
}


def layer(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """With `by`, a column of the table, its rows are dealt by that first, which later steps by the same column under any name make use of."""
    sql = SQL[name]
    table = re.search(r"from (\w+)$", sql)[1]
    spark_sql = sql.replace("varchar(20)", "string")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(f"{spark_sql[: -len(table)]}{{t}}", t=rows.repartition(by) if by else rows)


def ctes(*names: str) -> str:
    """WITH list of the layers, for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def tagged(df: DataFrame, *keys: str, name: str = "tags") -> DataFrame:
    """A tag map of columns, without those that are null."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (x.split("=") if "=" in x else (x, x) for x in keys)]), lambda e: e["v"].isNotNull())
    return df.withColumn(name, F.map_from_entries(entries))


def way_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartoframe.operators import ways

    return ways.assemble(layer(spark, sf_dir, "geo_ways"), layer(spark, sf_dir, "geo_nodes"))


#: Haversine in SQL, for oracles: kilometres between (x1, y1) and (x2, y2).
def hav(x1: str, y1: str, x2: str, y2: str, radius: float = 6371.0) -> str:
    return f"(2e0*{radius}*asin(CASE WHEN {x1} IS NOT NULL AND {x2} IS NOT NULL THEN least(1e0, sqrt(pow(sin(radians({y2}-{y1})/2), 2) + cos(radians({y1}))*cos(radians({y2}))*pow(sin(radians({x2}-{x1})/2), 2))) END))"
