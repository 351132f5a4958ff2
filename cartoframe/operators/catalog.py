"""Region catalog, vocabulary, gazetteer, extract inventory: joins on dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoframe.functions import parse as P
from cartoframe.operators import distance as D

LEVELS = ("planet", "continent", "country", "subnational", "feature")


def with_path_parts(regions: DataFrame, path: str = "path") -> DataFrame:
    """level, continent and parent from a path such as europe/germany/berlin."""
    parts = F.split(path, "/")
    n = F.size(parts)
    level = F.when(F.col(path) == "", "planet").when(n == 1, "continent").when(n == 2, "country").when(n == 3, "subnational").otherwise("feature")
    return regions.withColumn("level", level).withColumn("continent", parts[0]).withColumn("parent", F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), n - 1), "/")))


def resolve(names: DataFrame, regions: DataFrame, aliases: DataFrame | None = None, groups: DataFrame | None = None, qualifier: str | None = None, strict: bool = False) -> DataFrame:
    """query, path, how, n for each name asked for: alias, then named group, then the region's own name.

    regions: name, path, continent; aliases: alias, name; groups: group, name.
    A name on several continents is ambiguous: all of its regions come back, `n`
    says how many, and `strict` makes it an error.  Unknown names come back
    without a path.  `qualifier` keeps one continent.
    """
    asked = names.select(F.col("query"), P.region_name(F.col("query")).alias("key"))
    own = regions.select(P.region_name(F.col("name")).alias("key"), "path", "continent")
    if qualifier:
        own = own.where(P.region_name(F.col("continent")) == qualifier.lower().replace(" ", "").replace("-", ""))
    if aliases is not None:
        a = aliases.select(P.region_name(F.col("alias")).alias("key"), P.region_name(F.col("name")).alias("to"))
        asked = asked.join(a, "key", "left").select("query", F.coalesce("to", "key").alias("key"), F.when(F.col("to").isNotNull(), "alias").alias("how"))
    else:
        asked = asked.withColumn("how", F.lit(None).cast("string"))
    if groups is not None:
        g = groups.select(P.region_name(F.col("group")).alias("key"), P.region_name(F.col("name")).alias("member"))
        asked = asked.join(g, "key", "left").select("query", F.coalesce("member", "key").alias("key"), F.when(F.col("member").isNotNull(), "group").otherwise(F.col("how")).alias("how"))
    found = asked.join(own, "key", "left").select("query", "path", "continent", F.when(F.col("path").isNull(), "unknown").otherwise(F.coalesce("how", F.lit("direct"))).alias("how"), "key")
    found = found.withColumn("n", F.when(F.col("path").isNull(), 0).otherwise(F.count("path").over(Window.partitionBy("query", "key"))).cast("long"))
    if strict:
        found = found.where(F.coalesce(F.assert_true(F.col("n") == 1, F.concat(F.lit("ambiguous or unknown: "), "query")).isNull(), F.lit(True)))
    return found.drop("key")


def leaves(regions: DataFrame, path: str = "path") -> DataFrame:
    """Regions that no other region lies in: an anti join with all parents."""
    parents = regions.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split(F.col(path), "/"), F.lit(1), k), "/"))).alias("__p"), F.size(F.split(path, "/")).alias("__n")).where("__n > 1").select("__p").distinct()
    return regions.join(parents, F.col(path) == F.col("__p"), "left_anti")


def subregion_leaves(regions: DataFrame, under: str, path: str = "path") -> DataFrame:
    """The finest regions below one, itself if it has none."""
    return leaves(regions, path).where((F.col(path) == under) | F.col(path).startswith(f"{under}/"))


def cached_regions(regions: DataFrame, cache: DataFrame) -> DataFrame:
    """Regions with was_in_cache and the cached path."""
    return regions.join(cache.select(F.col("path"), F.col("file"), F.lit(True).alias("hit")), "path", "left").withColumn("was_in_cache", F.coalesce("hit", F.lit(False))).drop("hit")


def geocode(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Offline: the most populous place of that name; a name without one is an error.  gazetteer: name, lon, lat, population."""
    w = Window.partitionBy("key").orderBy(F.desc_nulls_last("population"), "lon", "lat")
    best = gazetteer.withColumn("key", F.lower(F.trim("name"))).withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "lon", "lat")
    out = names.withColumn("key", F.lower(F.trim("query"))).join(best, "key", "left").drop("key")
    return out.where(F.coalesce(F.assert_true(F.col("lon").isNotNull(), F.concat(F.lit("not found: "), "query")).isNull(), F.lit(True)))


def reverse_geocode(points: DataFrame, gazetteer: DataFrame, key: str, place_key: str) -> DataFrame:
    return D.nearest(points, gazetteer, key, place_key).select(key, F.col("ref.name").alias("name"), F.round("distance_km", 6).alias("distance_km"))


def normalise_term(c: Column) -> Column:
    """Lower case; separators and white space are single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", " "))


def match_vocabulary(terms: DataFrame, vocabulary: DataFrame, key: str | None = None, limit: int | None = None) -> DataFrame:
    """query, key, value, confidence, rank of what a query may mean: the best of a value and its synonyms.

    1 for the value itself, .9 for a synonym, .65 if all words of the query are
    in the term, .5 if one is a part of the other.  vocabulary: key, value,
    synonyms.  Queries meet only terms that they share a piece or a word with.
    """
    v = vocabulary.select("key", "value", normalise_term(F.col("value")).alias("v"), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), normalise_term).alias("s"))
    if key:
        v = v.where(F.col("key") == key.strip().lower())
    q = terms.select("query", normalise_term(F.col("query")).alias("q")).where("q <> ''")
    t = v.select("key", "value", "v", F.explode(F.array_distinct(F.filter(F.concat(F.array("v"), F.col("s")), lambda x: x != ""))).alias("t"))
    # a part of a text begins with one of the text's pieces; a query whose words are all in a term shares its first word
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(c, i, n)))))
    inside_term = q.select("*", F.substring("q", 1, 3).alias("g")).join(t.select("*", F.explode(pieces(F.col("t"))).alias("g")), "g")
    inside_query = q.select("*", F.explode(pieces(F.col("q"))).alias("g")).join(t.select("*", F.substring("t", 1, 3).alias("g")), "g")
    words = q.select("*", F.split("q", " ")[0].alias("g")).join(t.select("*", F.explode(F.split("t", " ")).alias("g")), "g")
    met = inside_term.unionByName(inside_query).unionByName(words).select("query", "q", "key", "value", "v", "t").distinct()
    every = F.size(F.array_except(F.split("q", " "), F.split("t", " "))) == 0
    scored = met.withColumn("confidence", F.when(F.col("q") == F.col("t"), F.when(F.col("t") == F.col("v"), 1.0).otherwise(0.9)).when(every, 0.65).when(F.contains("t", "q") | F.contains("q", "t"), 0.5).otherwise(0.0)).where("confidence > 0")
    scored = scored.groupBy("query", "key", "value").agg(F.max("confidence").alias("confidence"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("confidence"), "key", "value")))
    return (ranked.where(F.col("rank") <= limit) if limit else ranked).select("query", "key", "value", "confidence", "rank")


def tag_values(vocabulary: DataFrame, key: str) -> DataFrame:
    return vocabulary.where(F.col("key") == key).select("value").distinct()


def inventory(artifacts: DataFrame, now: Column, max_age_h: float) -> DataFrame:
    """One row: extracts, bytes, ages in hours, how many are stale, and the verdict.  artifacts: name, bytes, made_at."""
    age = P.age_hours(F.col("made_at").cast("timestamp"), now)
    a = artifacts.withColumn("age_h", age).agg(F.count(F.lit(1)).alias("extracts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("age_h").alias("newest_h"), F.max("age_h").alias("oldest_h"), F.coalesce(F.sum((F.coalesce(F.col("age_h"), F.lit(1e18)) > max_age_h).cast("long")), F.lit(0)).alias("stale"))
    return a.withColumn("verdict", F.when(F.col("extracts") == 0, "empty").when(F.col("stale") == 0, "fresh").when(F.col("stale") < F.col("extracts"), "partly stale").otherwise("stale"))


def state_fips(queries: DataFrame, states: DataFrame) -> DataFrame:
    """query, fips by name, abbreviation or code.  states: name, abbr, fips."""
    keyed = states.select(F.explode(F.array(F.lower("name"), F.lower("abbr"), F.col("fips"))).alias("key"), "fips").distinct()
    return queries.withColumn("key", F.lower(F.trim("query"))).join(keyed, "key", "left").select("query", "fips")
