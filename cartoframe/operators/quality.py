"""Data quality: one select per rule, unioned; references are anti joins, duplicates a window."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys whose features should have a name, and keys that make a way an area.
NAMED_KEYS = ("amenity", "shop", "tourism", "leisure", "office", "building", "highway", "railway", "aeroway", "waterway", "place", "historic", "natural")
POLYGON_KEYS = ("building", "landuse", "natural", "leisure", "amenity", "area", "boundary", "place")

ISSUE = ("issue_type", "level", "message", "element_type", "element_id")


def _any_key(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, keys))), F.lit(False))


def _issue(df: DataFrame, kind: str, level: int, message: Column | str, element: str, key: str) -> DataFrame:
    return df.select(F.lit(kind).alias("issue_type"), F.lit(level).alias("level"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(element).alias("element_type"), F.col(key).cast("long").alias("element_id"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, element: str, key: str, order: str | None = None) -> DataFrame:
    """Every occurrence of an id but the first."""
    extra = df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    repeated = extra.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__k"))
    return _issue(repeated, "duplicate", 1, F.concat(F.lit(f"Duplicate {element} ID "), F.col(key).cast("string")), element, key)


def coordinates(nodes: DataFrame, key: str = "id", min_lon: float = -180.0, max_lon: float = 180.0, min_lat: float = -90.0, max_lat: float = 90.0) -> DataFrame:
    """Missing, out of bounds, and null island."""
    lon, lat = F.col("lon"), F.col("lat")
    missing = _issue(nodes.where("lon is null or lat is null or isnan(lon) or isnan(lat)"), "coordinate", 1, "Invalid/missing location", "node", key)
    outside = _issue(nodes.where(~(lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat))), "coordinate", 1, "Out-of-bounds coordinates", "node", key)
    island = _issue(nodes.where("lon = 0 and lat = 0"), "coordinate", 1, "Null Island (0, 0) coordinates", "node", key)
    return _all([missing, outside, island])


def way_geometry(ways: DataFrame, key: str = "id", refs: str = "node_refs", tags: str = "tags") -> DataFrame:
    """Fewer than two nodes; polygon tags on a way that is not closed."""
    n = F.coalesce(F.size(F.col(refs)), F.lit(0))
    short = _issue(ways.where(n < 2), "geometry", 1, F.concat(F.lit("Degenerate way with "), n.cast("string"), F.lit(" node(s)")), "way", key)
    unclosed = ways.where(n >= 2).where(_any_key(F.col(tags), POLYGON_KEYS) & (F.element_at(refs, 1) != F.element_at(refs, -1)))
    return _all([short, _issue(unclosed, "geometry", 2, "Unclosed polygon-tagged way", "way", key)])


def way_references(refs: DataFrame, nodes: DataFrame, way_key: str = "way_id", node_key: str = "node_id", pos: str = "pos") -> DataFrame:
    """One issue a way: its first reference to a node that is not there.  refs: (way, pos, node)."""
    lost = refs.join(nodes.select(F.col(node_key)).distinct(), node_key, "left_anti")
    first = lost.groupBy(way_key).agg(F.min_by(node_key, pos).alias("ref"))
    return _issue(first, "reference", 1, F.concat(F.lit("Way references unknown node "), F.col("ref").cast("string")), "way", way_key)


def relation_references(members: DataFrame, nodes: DataFrame, ways: DataFrame, key: str = "relation_id") -> DataFrame:
    """One issue a relation.  members: (relation_id, pos, type n/w/r, ref); nodes and ways have `id`."""
    lost = members.where("type = 'n'").join(nodes.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").unionByName(members.where("type = 'w'").join(ways.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti"))
    first = lost.groupBy(key).agg(F.min_by(F.struct("type", "ref"), "pos").alias("m"))
    what = F.when(F.col("m.type") == "n", "node").otherwise("way")
    return _issue(first, "reference", 1, F.concat(F.lit("Relation references unknown "), what, F.lit(" "), F.col("m.ref").cast("string")), "relation", key)


def tag_rules(df: DataFrame, element: str, key: str = "id", tags: str = "tags", required: tuple[str, ...] = ()) -> DataFrame:
    """Empty values, named features without a name, missing required tags."""
    t = F.col(tags)
    empty = df.select(key, F.explode(F.map_entries(t)).alias("e")).where("e.value = ''")
    parts = [_issue(empty, "tag", 3, F.concat(F.lit("Empty value for tag '"), F.col("e.key"), F.lit("'")), element, key)]
    nameless = _any_key(t, NAMED_KEYS) & ~F.coalesce(F.map_contains_key(t, "name"), F.lit(False))
    parts.append(_issue(df.where(nameless), "tag", 2, "Missing 'name' tag on named feature", element, key))
    for r in required:
        parts.append(_issue(df.where(~F.coalesce(F.map_contains_key(t, r), F.lit(False))), "tag", 2, f"Missing required tag '{r}'", element, key))
    return _all(parts)


def verify_layer(df: DataFrame, key: str = "feature_id", tags: str = "tags") -> DataFrame:
    """Rules of a feature layer: missing geometry, lines and rings that are too short, points out of range, no properties."""
    n = F.coalesce(F.size("coords"), F.lit(0))
    p = F.element_at(F.col("coords"), 1)
    missing = _issue(df.where(F.col("gtype").isNull() | (n == 0)), "geometry", 1, "Missing geometry", "feature", key)
    short = _issue(df.where(((F.col("gtype") == "LineString") & (n == 1)) | ((F.col("gtype") == "Polygon") & (n > 0) & (n < 4))), "geometry", 1, "Invalid geometry structure", "feature", key)
    point = df.where((F.col("gtype") == "Point") & (n > 0)).where(~(p["lon"].between(-180, 180) & p["lat"].between(-90, 90)))
    empty = df.where(F.coalesce(F.size(F.map_keys(tags)), F.lit(0)) == 0)
    return _all([missing, short, _issue(point, "coordinate", 1, "Coordinates out of range", "feature", key), _issue(empty, "tag", 3, "Empty properties", "feature", key)])


def verify_all(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """All rules over nodes (id, lon, lat, tags), ways (id, node_refs, tags), relations (id, members, tags)."""
    refs = ways.select(F.col("id").alias("way_id"), F.posexplode("node_refs").alias("pos", "node_id"))
    located = nodes.where("lon is not null and lat is not null")
    parts = [duplicates(nodes, "node", "id"), duplicates(ways, "way", "id"), coordinates(nodes), way_geometry(ways), way_references(refs, nodes.select(F.col("id").alias("node_id"))), tag_rules(located, "node", required=required), tag_rules(ways, "way", required=required)]
    if relations is not None:
        members = relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m")).select("relation_id", "pos", F.substring("m.type", 1, 1).alias("type"), "m.ref")
        parts += [relation_references(members, nodes, ways), tag_rules(relations, "relation", required=required)]
    return _all(parts)


def summary(issues: DataFrame) -> DataFrame:
    """One row: counts by kind and by level."""
    n = lambda c, v: F.coalesce(F.sum((F.col(c) == v).cast("long")), F.lit(0))
    return issues.agg(F.count(F.lit(1)).alias("total_issues"), *[n("issue_type", k).alias(f"{k}_issues") for k in ("geometry", "tag", "reference", "coordinate", "duplicate")], *[n("level", k).alias(f"level_{k}") for k in (1, 2, 3)])


def tag_coverage(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Elements, share with tags in percent, mean number of tags."""
    k = F.coalesce(F.size(F.map_keys(tags)), F.lit(0))
    n = F.count(F.lit(1))
    return df.agg(n.alias("elements"), F.when(n > 0, F.round(F.sum((k > 0).cast("long")) / n * 100, 2)).otherwise(0.0).alias("tag_coverage_pct"), F.when(n > 0, F.round(F.sum(k) / n, 4)).otherwise(0.0).alias("avg_tags"))


def require_fresh(artifacts: DataFrame, days: float, now: Column, name: str = "name", made: str = "made_at") -> DataFrame:
    """The artifacts with age_days; the query fails if any is older than `days` or has no date."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(made).cast("timestamp"))) / 8.64e10
    out = artifacts.withColumn("age_days", age)
    return out.where(F.coalesce(F.assert_true(F.coalesce(F.col("age_days") < days, F.lit(False)), F.concat(F.lit("stale: "), F.col(name).cast("string"))).isNull(), F.lit(True)))


def stale(artifacts: DataFrame, days: float, now: Column, made: str = "made_at") -> DataFrame:
    return artifacts.withColumn("age_days", (F.unix_micros(now) - F.unix_micros(F.col(made).cast("timestamp"))) / 8.64e10).where(F.coalesce(F.col("age_days") > days, F.lit(True)))


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Occurrence number of each id, for callers that keep the first."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(order)))
