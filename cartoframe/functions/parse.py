"""Parsers of tag values, as Column expressions.  A value that cannot be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _try(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def number(value: Column) -> Column:
    return _try(F.trim(value), "double")


def population(value: Column) -> Column:
    """The general parser: ~ ≈ ≅ before and + after go; commas are thousands where there is no dot, and one dot before exactly three digits is, too; then digits and a leading minus stay."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(value), r"^[~≈≅]+", ""), r"\++$", "")
    clean = F.when(clean.contains(",") & ~clean.contains("."), F.replace(clean, F.lit(","), F.lit(""))).when(clean.rlike(r"^[^.,]*\.[0-9]{3}$"), F.replace(clean, F.lit("."), F.lit(""))).otherwise(clean)
    signed = F.regexp_extract(clean, r"^[^0-9-]*(-?)", 1)
    return _try(F.concat(signed, F.regexp_replace(clean, "[^0-9]", "")), "bigint")


def population_digits(value: Column) -> Column:
    """The scan's parser: all but digits goes."""
    return _try(F.regexp_replace(value, "[^0-9]", ""), "bigint")


def population_positive(value: Column) -> Column:
    """The tiers' parser: digits only, and 0 is unknown."""
    n = population_digits(value)
    return F.when(n > 0, n)


def population_plain(value: Column) -> Column:
    """The readiness parser: an integer without commas, else null."""
    clean = F.trim(F.replace(value, F.lit(","), F.lit("")))
    return F.when(clean.rlike(r"^[+-]?[0-9]+$"), _try(clean, "bigint"))


def _truncated(c: Column) -> Column:
    n = _try(c, "double")
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("int")


def speed_limit(value: Column) -> Column:
    """km/h, truncated; miles an hour are converted."""
    low = F.lower(value)
    miles = _try(F.trim(F.replace(low, F.lit("mph"), F.lit(""))), "double") * 1.60934
    plain = F.trim(F.replace(F.replace(value, F.lit("km/h"), F.lit("")), F.lit("kmh"), F.lit("")))
    return F.when(low.contains("mph"), F.floor(miles).cast("int")).otherwise(_truncated(plain))


def lanes(value: Column) -> Column:
    return _truncated(F.trim(value))


levels = lanes


def height(value: Column) -> Column:
    return _try(F.trim(F.replace(F.replace(value, F.lit("m"), F.lit("")), F.lit("ft"), F.lit(""))), "double")


def truthy(value: Column) -> Column:
    """yes, true or 1, in any case."""
    return F.coalesce(F.lower(F.trim(value)).isin("yes", "true", "1"), F.lit(False))


def region_name(value: Column) -> Column:
    """Lower case without separators and a leading "the"."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"^the[\s_-]+", ""), r"[\s_.'-]+", "")


def slug(value: Column) -> Column:
    """ASCII words joined with hyphens; umlauts and common accents are transliterated."""
    s = F.lower(value)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("æ", "ae"), ("ø", "oe"), ("å", "aa")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.translate(s, "áàâãéèêëíìîïóòôõúùûçñ", "aaaaeeeeiiiioooouuucn")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(value: Column, sep: str = ";") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(value, sep), lambda x: F.trim(x)), lambda x: x != "")


def replication_path(sequence: Column) -> Column:
    """5090 -> 000/005/090"""
    s = F.lpad(sequence.cast("string"), 9, "0")
    return F.concat_ws("/", F.substring(s, 1, 3), F.substring(s, 4, 3), F.substring(s, 7, 3))


def state_text(value: Column) -> Column:
    """key=value lines as a map; comment lines and lines without = are skipped, backslashes before colons go."""
    lines = F.filter(F.split(value, "\n"), lambda x: x.contains("=") & ~F.ltrim(x).startswith("#"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.replace(F.trim(F.regexp_replace(x, "^[^=]*=", "")), F.lit("\\:"), F.lit(":")).alias("v"))
    return F.map_from_entries(F.transform(lines, entry))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def country(tags: Column, keys: tuple[str, ...] = ("addr:country", "is_in:country", "ISO3166-1", "country")) -> Column:
    """The first filled of the keys, else the last part of is_in."""
    last = F.get(F.reverse(tokens(tags["is_in"], ",")), F.lit(0))
    return first_filled(*[tags[k] for k in keys], last)


def age_hours(moment: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(moment)) / 3.6e9
