"""Edit history: rows valid in [valid_from, valid_to), contributions, change windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("CREATION", "DELETION", "TAG", "GEOMETRY", "TAG_GEOMETRY")


def as_of(df: DataFrame, moment: Column) -> DataFrame:
    return df.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def window(df: DataFrame, since: Column | None, until: Column | None) -> DataFrame:
    """Edits that began in [since, until); an open end is allowed, two are an error."""
    if since is None and until is None:
        raise ValueError("an edit window needs a beginning or an end")
    if since is not None:
        df = df.where(F.col("valid_from") >= since)
    return df.where(F.col("valid_from") < until) if until is not None else df


def latest(df: DataFrame) -> DataFrame:
    return df.where("status = 'latest'") if "status" in df.columns else df.where("valid_to is null")


def extract(df: DataFrame, as_of_time: Column | None = None, since: Column | None = None, until: Column | None = None, match: Column | None = None) -> DataFrame:
    """One category at a moment, over a window, or now."""
    df = as_of(df, as_of_time) if as_of_time is not None else window(df, since, until) if since is not None or until is not None else latest(df)
    return df.where(match) if match is not None else df


def changes(df: DataFrame, since: Column | None, until: Column | None, kinds: tuple[str, ...] = (), tag_key: str | None = None) -> DataFrame:
    if bad := set(kinds) - set(KINDS):
        raise ValueError(f"unknown kinds of contribution: {sorted(bad)}")
    df = window(df, since, until)
    if kinds:
        df = df.where(F.col("contrib_type").isin(*kinds))
    return df.where(F.coalesce(F.map_contains_key("tags", tag_key), F.lit(False))) if tag_key else df


def change_counts(df: DataFrame, user: str | None = None) -> DataFrame:
    """One row: edits, edits of each kind, objects, and editors if there is a column of them."""
    n = lambda k: F.coalesce(F.sum((F.col("contrib_type") == k).cast("long")), F.lit(0)).alias(k.lower())
    who = [F.countDistinct(user).alias("editors")] if user else []
    return df.agg(F.count(F.lit(1)).alias("edits"), *map(n, KINDS), F.countDistinct("osm_id").alias("objects"), *who)


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of versions of one object from two histories that were valid at the same time."""
    x, y = a.select(key, F.struct(*a.columns).alias("a")), b.select(key, F.struct(*b.columns).alias("b"))
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    return x.join(y, key).where((F.col("a.valid_from") < F.coalesce("b.valid_to", far)) & (F.col("b.valid_from") < F.coalesce("a.valid_to", far)))
