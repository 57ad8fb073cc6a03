"""Lenient casts: values that don't fit become null, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YES, NO = ["true", "1", "yes", "t", "y", "כן"], ["false", "0", "no", "f", "n", "לא"]


def first_value(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def first_list(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in columns])


def as_str(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def as_bool(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(YES), True).when(word.isin(NO), False)


def as_int(c: Column) -> Column:
    return c.try_cast("double").try_cast("int")


def as_list(c: Column) -> Column:
    """``['a', 'b']``, ``a; b`` or ``a, b`` as a list of trimmed items without quotes."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\[|\]$", "")
    items = F.when(bare.contains(";"), F.split(bare, ";")).otherwise(F.split(bare, ","))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"^['\"]+|['\"]+$", "")), lambda x: x != "")


def iso_date(c: Column) -> Column:
    """``YYYY-MM-DD`` from an ISO prefix or from milliseconds of at least 12 digits."""
    return F.when(c.rlike(r"^\d{12,}$"), F.date_format(F.timestamp_millis(c.try_cast("bigint")), "yyyy-MM-dd")).when(
        c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10)
    )


def ymd(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.replace(F.substring(c, 1, 10), F.lit("-"), F.lit("")).try_cast("int"))


def ymd_to_iso(c: Column) -> Column:
    digits = c.cast("string")
    parts = [F.substring(digits, at, size) for at, size in ((1, 4), (5, 2), (7, 2))]
    return F.when((F.length(digits) == 8) & digits.rlike("^[0-9]+$"), F.concat_ws("-", *parts)).otherwise("")


def last_names(names: Column) -> Column:
    return F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.element_at(F.split(F.trim(n), r"\s+"), -1))


def source_url(prefix: str, path: Column, name: Column) -> Column:
    """prefix + path/name with single slashes, percent-encoded; null when both are missing."""
    joined = F.regexp_replace(F.concat_ws("/", as_str(F.replace(path, F.lit("\\"), F.lit("/"))), as_str(name)), "/{2,}", "/")
    encoded = F.replace(F.replace(F.url_encode(F.ltrim(joined, F.lit("/"))), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.when(joined != "", F.concat(F.lit(prefix), encoded))


def section_sort_key(c: Column) -> Column:
    """Numbered sections by number and suffix, then the others by text."""
    n = F.regexp_extract(c, r"^(\d+)", 1)
    return F.struct((n == "").cast("int").alias("kind"), F.coalesce(n.try_cast("int"), F.lit(0)).alias("number"), F.regexp_replace(c, r"^\d+", "").alias("suffix"))
