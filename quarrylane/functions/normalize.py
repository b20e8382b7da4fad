"""Text to typed values, as column expressions. Missing or unusable input gives NULL unless stated."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrylane.functions import vocabulary as v

SQFT = 10.7639


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _found(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def _nonblank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


# -- warehouse side ---------------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _to_ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def ascii_key(c: Column) -> Column:
    """The part of canonical_key that follows the reduction to ASCII."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", " "), r"\s+", " "))


def canonical_key(c: Column | str) -> Column:
    """Accents and other non-ASCII characters dropped, lower case, punctuation to blanks, blanks collapsed; NULL gives ''.

    There is no built-in for the decomposition, so that step alone is a vectorised UDF, on texts that need it.
    """
    c = col(c)
    plain = F.when(c.rlike(r"[^\x00-\x7F]"), _to_ascii(c)).otherwise(c)
    return F.coalesce(ascii_key(plain), F.lit(""))


def iso_date(c: Column | str) -> Column:
    """The date that the text begins with; NULL for impossible dates too."""
    return _found(F.trim(col(c)), r"^(\d{4}-\d{2}-\d{2})").try_cast("date")


def safe_double(c: Column | str) -> Column:
    """A plain decimal or scientific number, else NULL (type suffixes are not numbers)."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"(?i)^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"), t.try_cast("double"))


def property_type(sub: Column | str, kind: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for name, words in v.PROPERTY_TYPES.items() for w in words for x in (w, name)])
    look = lambda c: F.when(col(c).isNotNull(), F.try_element_at(table, F.lower(F.trim(col(c)))))
    return F.coalesce(look(sub), look(kind), F.lit("Other"))


def _count_label(n: Column) -> Column:
    return F.when(n <= 4, F.concat(n.cast("string"), F.lit("BR"))).otherwise("5BR+")


def bedroom_from_label(c: Column | str) -> Column:
    """Labels like 2 B/R; NULL only for missing or blank text."""
    t = F.lower(F.trim(col(c)))
    n = _found(t, r"^(\d+)\s*b/?r$").try_cast("long")
    many = F.when(_found(t, r"^(\d+)\s*b/?r$").isNotNull(), F.coalesce(_count_label(n), F.lit("5BR+")))
    return F.when(t.isNull() | (t == ""), None).when(t == "studio", "Studio").when(t.isin(*v.NO_BEDROOM), "Other").otherwise(F.coalesce(many, F.lit("Other")))


def bedroom_from_rooms(rooms: Column | str, sub: Column | str) -> Column:
    """Bedroom type from a room count and a sub-type; never NULL."""
    rooms = col(rooms).cast("double")
    n = F.when(~F.isnan(rooms), rooms.cast("int"))
    return F.when(F.lower(F.trim(col(sub))) == "studio", "Studio").when(n.isNull(), "Unknown").when(n <= 0, "Studio").otherwise(_count_label(n))


def per_sqft(value: Column | str, sqm: Column | str) -> Column:
    """Value per square foot; NULL when either is missing or zero."""
    value, sqm = col(value), col(sqm)
    return F.when((value != 0) & (sqm != 0), value / (sqm * F.lit(SQFT)))


def row_uid(dataset: str, file: Column | str, row: Column | str) -> Column:
    return F.concat_ws(":", F.lit(dataset), col(file), col(row).cast("string"))


def stable_id(uid: Column | str) -> Column:
    """A 60-bit number from the SHA-1 of a text."""
    return F.conv(F.substring(F.sha1(col(uid).cast("binary")), 1, 15), 16, 10).cast("bigint")


def slugify(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("project"))


def display_name(key: Column | str) -> Column:
    return F.initcap(col(key))


def building_suffix(raw: Column | str, key: Column | str) -> Column:
    """Struct (master_key, label, method) of a project name, given the name and its canonical key.

    A trailing number of the key splits first; else the first kind of spaced hyphen found before any parenthesis.
    """
    raw, key = col(raw), col(key)
    filler = "|".join(v.FILLER_WORDS)
    pattern = rf"^(.+?)\s+(?:(?:{filler})\s+)?(\d{{1,4}})$"
    numbered = F.struct(F.trim(_found(key, pattern)).alias("master_key"), _found(key, pattern, 2).alias("label"), F.lit("trailing_number").alias("method"))
    region = F.substring_index(raw, "(", 1)
    out = F.when(_found(key, pattern).isNotNull(), numbered)
    for sep in v.HYPHENS:
        head = canonical_key(F.substring_index(raw, sep, 1))
        tail = F.trim(F.regexp_replace(F.trim(F.substring(raw, F.instr(raw, F.lit(sep)) + len(sep), F.length(raw))), r"\)+$", ""))
        split = F.struct(head.alias("master_key"), tail.alias("label"), F.lit("hyphen_split").alias("method"))
        out = out.when((F.instr(region, F.lit(sep)) > 0) & (head != "") & (tail != ""), split)
    whole = F.struct(F.coalesce(key, F.lit("")).alias("master_key"), F.lit(None).cast("string").alias("label"), F.lit("none").alias("method"))
    return out.otherwise(whole)


# -- catalogue side ---------------------------------------------------------------------------------------------------


def clean(c: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(col(c), r"\s+", " ")), F.lit(""))


def split_names(c: Column | str) -> Column:
    """Names separated by comma, slash, semicolon, bar or " and " (candidate side)."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"[,/;|]| and ")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def split_aliases(c: Column | str) -> Column:
    """Names separated by comma, slash, semicolon or the word and, in any case (catalogue side)."""
    parts = F.split(F.coalesce(F.trim(col(c)), F.lit("")), r"(?i)\s*(?:,|/|;|\band\b)\s*")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def normalize_alias(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", " ")


def status(c: Column | str) -> Column:
    c, out = col(c), F.when(F.lit(False), "")
    for name, pattern in v.STATUS_PATTERNS:
        out = out.when(c.rlike(f"(?i){pattern}"), name)
    return out.otherwise("other")


def first_int(c: Column | str) -> Column:
    return F.regexp_replace(_found(c, r"([\d,]+)"), ",", "").try_cast("long")


def total_units(c: Column | str) -> Column:
    """Struct (units, raw): the number in "a total of N units", and the trimmed text."""
    n = F.regexp_replace(_found(c, r"(?i)total of\s+([\d,]+)\s+units"), ",", "").try_cast("long")
    return F.struct(n.alias("units"), F.nullif(F.trim(col(c)), F.lit("")).alias("raw"))


def _month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, v.MONTHS)), F.lower(F.substring(name, 1, 3))), F.lit(0))


def fuzzy_date(c: Column | str) -> Column:
    """June 2015 to 2015-06, Q1 2025 to 2025-Q1, a bare year to itself, in this order."""
    names = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in v.MONTH_NAMES)
    month = rf"(?i)\b({names})\s+(\d{{4}})\b"
    by_month = F.concat_ws("-", _found(c, month, 2), F.lpad(_month_number(_found(c, month)).cast("string"), 2, "0"))
    quarter = r"(?i)\bQ([1-4])\s+(\d{4})\b"
    by_quarter = F.concat(_found(c, quarter, 2), F.lit("-Q"), _found(c, quarter))
    return F.coalesce(F.when(_found(c, month).isNotNull(), by_month), by_quarter, _found(c, r"\b((?:19|20)\d{2})\b"))


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def money(c: Column | str) -> Column:
    return _number(_found(c, r"(?i)AED\s*([\d,]+)"))


def project_value(c: Column | str) -> Column:
    """Struct (aed, usd) of "AED 1,000 (USD 0.3m)"."""
    usd = _found(c, r"(?i)USD\s*([\d.]+)\s*m").try_cast("double") * F.lit(1e6)
    return F.struct(money(c).alias("aed"), usd.alias("usd"))


def size_sqft(c: Column | str) -> Column:
    return _number(_found(c, r"(?i)([\d,]+(?:\.\d+)?)\s*sq\.?\s*ft"))


def transaction_date(c: Column | str) -> Column:
    """31st Jul 2026 as a date; NULL when there is no such day."""
    p = r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\s+(\d{4})"
    text = F.concat_ws("-", _found(c, p, 3), F.lpad(_month_number(_found(c, p, 2)).cast("string"), 2, "0"), F.lpad(_found(c, p), 2, "0"))
    return F.when(_month_number(_found(c, p, 2)).isNotNull(), text.try_cast("date"))


def coordinates(html: Column | str) -> Column:
    p = r"maps/embed/v1/place\?[^\"'<>]*?q=(-?\d{1,3}\.\d+),(-?\d{1,3}\.\d+)"
    return F.struct(_found(html, p).try_cast("double").alias("lat"), _found(html, p, 2).try_cast("double").alias("lng"))


def area_type(c: Column | str) -> Column:
    key = F.lower(F.trim(col(c)))
    return F.when(key.rlike(r"\bmall\b"), "mall").when(key.isin(*v.LANDMARKS), "landmark").otherwise("community")


def looks_blocked(html: Column | str) -> Column:
    head = F.lower(F.substring(col(html), 1, 5000))
    out = F.lit(False)
    for mark in v.BLOCK_MARKS:
        out = out | F.contains(head, F.lit(mark))
    return F.coalesce(out, F.lit(False))


def word_to_int(c: Column | str) -> Column:
    at = F.nullif(F.array_position(F.array(*map(F.lit, v.NUMBER_WORDS)), F.lower(F.trim(col(c)))), F.lit(0))
    return F.coalesce(at.cast("int"), F.trim(col(c)).try_cast("int"))


def elapsed(start: Column | str, end: Column | str) -> Column:
    s = F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))
    minutes, hours = F.format_string("%dm %ds", F.floor(s / 60), s % 60), F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60))
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, minutes).when(s.isNotNull(), hours)


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)
