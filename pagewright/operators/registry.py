"""Registries of books kept from run to run: date anchors merged, audited, united and forgotten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.joins import three_way_merge

#: Fixed value: so many readings of a run may replace what is stored.
OVERRIDE = 2
ANCHORS = "array<struct<number:int,day:date>>"


def extremes(anchors: Column) -> Column:
    """The first and the last anchor of a sorted array; one alone as it is."""
    return F.when(F.size(anchors) > 1, F.array(anchors[0], F.element_at(anchors, -1))).otherwise(anchors)


def falls(anchors: Column) -> Column:
    """Whether a date of a sorted array lies before the one ahead of it."""
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(anchors) - 1, F.lit(1))), lambda k: (k < F.size(anchors)) & (F.get(anchors, k).day < F.get(anchors, k - 1).day))


def merged_anchors(stored: Column, observed: Column) -> Column:
    """What stays of a book's stored and observed anchors (arrays sorted by number), and why: a struct of anchors and action.

    Without contradiction the extremes of both: new, extended or unchanged. Another date for a stored number, or dates that
    would fall, contradict: then two readings or more replace what is stored (corrected), and fewer leave it (conflict).
    """
    stored = F.coalesce(stored, F.array().cast(ANCHORS))
    both = F.array_sort(F.concat(F.filter(stored, lambda p: ~F.exists(observed, lambda o: o.number == p.number)), observed))
    differs = F.exists(observed, lambda o: F.exists(stored, lambda p: (p.number == o.number) & (p.day != o.day)))
    against = differs | falls(both)
    kept = extremes(both)
    action = F.when(against, F.when(F.size(observed) < OVERRIDE, "conflict").otherwise("corrected")).when(stored == kept, "unchanged").when(F.size(stored) > 0, "extended").otherwise("new")
    return F.struct(F.when(action == "conflict", stored).when(action == "corrected", extremes(observed)).otherwise(kept).alias("anchors"), action.alias("action"))


def united_anchors(server: Column, local: Column) -> Column:
    """The extremes of two entries' anchors; null if they contradict each other."""
    differs = F.exists(local, lambda o: F.exists(server, lambda p: (p.number == o.number) & (p.day != o.day)))
    both = F.array_sort(F.array_distinct(F.concat(server, local)))
    return F.when(~differs & ~falls(both), extremes(both))


def observed_anchors(rows: DataFrame, book: str, log: str, number: str, day: str) -> DataFrame:
    """Each book's anchors, one for each log number (its first row's), and why they are no use: two dates for a number, or falling dates."""
    single = rows.groupBy(book, log).agg(F.min(number).alias(number), F.min(day).alias(day), F.count_distinct(day).alias("_kinds"))
    books = single.where(F.col(day).isNotNull()).groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(number).cast("int").alias("number"), F.col(day).alias("day")))).alias("anchors"), F.max("_kinds").alias("_kinds"))
    problem = F.when(F.col("_kinds") > 1, "two dates").when(falls(F.col("anchors")), "falling dates")
    return books.withColumn("problem", problem).drop("_kinds")


def audit_dates(observed: DataFrame, stored: DataFrame, book: str) -> DataFrame:
    """What to do with each observed book's stored anchors: conflict, or the merge's action; and what would be stored."""
    rows = observed.join(stored.select(book, F.col("anchors").alias("stored")), book, "left").withColumn("_m", merged_anchors(F.col("stored"), F.col("anchors")))
    action = F.when(F.col("problem").isNotNull(), "conflict").when(F.col("_m.action") == "unchanged", "confirmed").otherwise(F.col("_m.action"))
    return rows.select(book, action.alias("action"), F.when(F.col("problem").isNull(), F.col("_m.anchors")).otherwise(F.col("stored")).alias("anchors"))


def not_in_fleet(stored: DataFrame, fleet: DataFrame, supported: DataFrame, book: str, number: str) -> DataFrame:
    """Entries whose number is none of the fleet's and whose book nothing supports."""
    return stored.join(fleet.select(number).distinct(), number, "left_anti").join(supported.select(book).distinct(), book, "left_anti")


def fleet_by_number(fleet: DataFrame, number: str, name: str) -> DataFrame:
    """The fleet's names by their number; numbers of several names are left out."""
    return fleet.groupBy(number).agg(F.min(name).alias(name), F.count_distinct(name).alias("_n")).where("_n = 1").drop("_n")


def applied(stored: DataFrame, removed: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """A registry after a report: removed keys are gone, changed ones replaced or added."""
    return stored.join(removed.select(key), key, "left_anti").join(changed.select(key), key, "left_anti").unionByName(changed.select(*stored.columns))


def synchronised_dates(base: DataFrame, local: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """Both copies' anchors merged by ``three_way_merge``; where both changed, what unites them, else the server's."""
    merged = three_way_merge(base, local, server, key, "anchors")
    both = merged.where("decision = 'server_wins'").select(key).join(local.select(key, F.col("anchors").alias("_l")), key).join(server.select(key, F.col("anchors").alias("_s")), key)
    united = both.select(key, united_anchors(F.col("_s"), F.col("_l")).alias("_u"))
    out = merged.join(united, key, "left")
    decision = F.when(F.col("_u").isNotNull(), "united").otherwise(F.col("decision"))
    return out.select(key, F.coalesce("_u", "merged").alias("merged"), decision.alias("decision"))


def forgotten(rows: DataFrame, folder: str, gone: Sequence[str], below: bool = False) -> tuple[DataFrame, DataFrame]:
    """What stays and what is forgotten of rows in the named folders, with ``below`` also of those under them."""
    hit = F.col(folder).isin(*gone)
    if below:
        for name in gone:
            hit = hit | F.col(folder).startswith(f"{name}/")
    hit = F.coalesce(hit, F.lit(False))
    return rows.where(~hit), rows.where(hit)
