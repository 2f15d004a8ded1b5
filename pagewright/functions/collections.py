"""Arrays, maps, JSON and hashes as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import col


def inferred_confidence(anchors: str | Column, span: str | Column) -> Column:
    """Confidence of an inferred value: more with anchors, less with the span between them, from 0.6 to 0.9."""
    raw = F.lit(0.64) + F.lit(0.05) * F.least(col(anchors), F.lit(5)) - F.least(F.lit(0.1), F.lit(0.005) * col(span))
    return F.bround(F.greatest(F.lit(0.6), F.least(F.lit(0.9), raw)), 3)


def date_candidates(days: Column, months: Column, years: Column) -> Column:
    """All valid dates of the product of days, months and years."""
    one = lambda y, m: F.transform(days, lambda d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))
    dates = F.flatten(F.transform(years, lambda y: F.flatten(F.transform(months, lambda m: one(y, m)))))
    return F.array_sort(F.array_distinct(F.filter(dates, lambda x: x.isNotNull())))


def content_hash(rows: Column) -> Column:
    """SHA-256 of an array's sorted JSON."""
    return F.sha2(F.to_json(F.array_sort(rows)), 256)


def encode_values(values: Column) -> Column:
    """A map as the base64 of ``key=value`` pairs in key order."""
    pairs = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e.key, F.lit("="), F.url_encode(e.value)))
    return F.base64(F.array_join(pairs, "&").cast("binary"))


def decode_values(encoded: str | Column) -> Column:
    """The map of ``encode_values``."""
    return F.transform_values(F.str_to_map(F.unbase64(col(encoded)).cast("string"), F.lit("&"), F.lit("=")), lambda _, v: F.url_decode(v))


def changed_keys(sent: Column, received: Column) -> Column:
    """The keys that were sent and came back otherwise, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(sent, lambda k, v: ~F.element_at(received, k).eqNullSafe(v))))


def leaf_strings(json: str | Column, depth: int = 2) -> Column:
    """The distinct scalar values of a JSON object with objects nested up to ``depth``, sorted."""
    plain = F.map_values(F.from_json(col(json), "map<string,string>"))
    for _ in range(depth - 1):
        plain = F.flatten(F.transform(plain, lambda v: F.when(v.startswith("{"), F.map_values(F.from_json(v, "map<string,string>"))).otherwise(F.array(v))))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda v: v.isNotNull())))
