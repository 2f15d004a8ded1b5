"""Duplicates, votes, consensus and statistics over groups of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import dates


def flag_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """All rows of a repeated key are flagged, and the first of each key marked; rows with a null key are no duplicates."""
    known = ~F.isnull(keys[0])
    for k in keys[1:]:
        known = known & ~F.isnull(k)
    group = Window.partitionBy(*keys)
    return df.withColumns({"is_duplicate": known & (F.count("*").over(group) > 1), "is_first": known & (F.row_number().over(group.orderBy(*order)) == 1)})


def survivors(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chosen: Column, blank: Column) -> DataFrame:
    """Purge: chosen rows go, but of a wholly chosen group the first row stays, a row that isn't blank before others."""
    group = Window.partitionBy(*keys)
    first = F.row_number().over(group.orderBy(blank.cast("int"), *order)) == 1
    spared = F.bool_and(chosen).over(group) & first
    return df.withColumn("spared", spared).where(~chosen | F.col("spared")).drop("spared")


def group_books(df: DataFrame, key: str, number: str, value: str) -> DataFrame:
    """Per book: its rows in number order, their count and range."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(number).alias("first_number"), F.max(number).alias("last_number"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(number, value))), lambda x: x[value]), ",").alias("in_order"))


def mode_by(df: DataFrame, keys: Sequence[str], value: str, ties: str = "least") -> DataFrame:
    """The commonest value of each group with its votes; ties to the least or the greatest value. Nulls don't vote."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    tie = F.asc(value) if ties == "least" else F.desc(value)
    order = Window.partitionBy(*keys).orderBy(F.desc("votes"), tie)
    return counts.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def digit_vote(df: DataFrame, key: str, number: str, weight: str, size: int) -> DataFrame:
    """A weighted vote by position over numbers of ``size`` digits: each digit is the heaviest at its place, ties to the smallest.

    A result that nobody observed gives way to the heaviest observed number. Votes are counted for what is returned. Weights
    are whole. All sums of a key are taken in one aggregate of numbers alone; the heaviest number (the smallest of equals) is
    the largest of weight and complement in one number.
    """
    return vote_of_sums(weight_sums(df, key, number, weight), key, number, size)


def weight_sums(df: DataFrame, key: str, number: str, weight: str) -> DataFrame:
    """The weight (w) and count (n) of each key's numbers."""
    return df.groupBy(key, number).agg(F.sum(weight).cast("long").alias("w"), F.count("*").alias("n"))


def vote_of_sums(rows: DataFrame, key: str, number: str, size: int) -> DataFrame:
    """``digit_vote`` of numbers that are summed up already."""
    most = 10**size
    sums = [F.sum(F.when(F.substring(number, k, 1) == str(d), F.col("w"))).alias(f"_{k}_{d}") for k in range(1, size + 1) for d in range(10)]
    books = rows.groupBy(key).agg(*sums, F.max(F.col("w") * most + (most - 1 - F.col(number).cast("long"))).alias("_top"))
    first = lambda k: F.array_max(F.array(*[F.when(F.col(f"_{k}_{d}").isNotNull(), F.struct(F.col(f"_{k}_{d}").alias("w"), F.lit(-d).alias("o"), F.lit(str(d)).alias("digit"))) for d in range(10)])).digit
    voted, heaviest = F.concat(*[first(k) for k in range(1, size + 1)]), F.lpad((most - 1 - F.col("_top") % most).cast("string"), size, "0")
    books = books.select(key, voted.alias("_voted"), heaviest.alias("_heaviest"))
    books = books.withColumnRenamed(key, "_key")
    met = rows.select(key, number, "n").join(books, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").where((F.col(number) == F.col("_voted")) | (F.col(number) == F.col("_heaviest")))
    own = F.struct((F.col(number) == F.col("_voted")).alias("voted"), F.col(number).alias("winner"), F.col("n").alias("support"))
    return met.groupBy(key).agg(F.max(own).alias("b")).select(key, "b.winner", "b.support")


def unanimous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value of each group in which all rows that have one agree."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("kinds"), F.min(value).alias(value)).where("kinds = 1").drop("kinds")


def consensus(df: DataFrame, keys: Sequence[str], value: str, least_rows: int = 3, least_votes: int = 2, share: tuple[int, int] = (3, 5)) -> DataFrame:
    """The mode of each group with enough readings, votes and share."""
    totals = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("readings"))
    enough = (F.col("readings") >= least_rows) & (F.col("votes") >= least_votes) & (F.col("votes") * share[1] >= F.col("readings") * share[0])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    totals = totals.withColumnsRenamed({k: f"_{k}" for k in keys})
    return mode_by(df, keys, value).join(totals, same).drop(*[f"_{k}" for k in keys]).where(enough)


def supported_values(df: DataFrame, keys: Sequence[str], value: str, evidence: str, least: int = 2) -> DataFrame:
    """The values of each group that ``least`` different pieces of evidence support."""
    return df.groupBy(*keys, value).agg(F.count_distinct(evidence).alias("support")).where(F.col("support") >= least)


def rollup_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by both, by either, and of all, in one pass of grouping sets."""
    sets = [[F.col(outer), F.col(inner)], [F.col(outer)], [F.col(inner)], []]
    return df.groupingSets(sets, F.col(outer), F.col(inner)).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def run_wall(df: DataFrame, keys: Sequence[str], start: str, seconds: str) -> DataFrame:
    """Wall time of each run: from the first start to the last end, or the sum where a start is missing; and its ratio to the measured sum."""
    span = F.max(F.col(start) + F.col(seconds)) - F.min(start)
    wall = F.when(F.count(start) == F.count("*"), span).otherwise(F.sum(seconds))
    return df.groupBy(*keys).agg(wall.alias("wall"), F.sum(seconds).alias("measured")).withColumn("factor", F.try_divide("wall", "measured"))


def dominant_month_cascade(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Fills missing dates with the end of the group's commonest month (ties to the latest), or of the whole run's."""
    month = df.withColumn("month", F.trunc(date, "MM"))
    own = mode_by(month, keys, "month", "greatest").select(*keys, F.col("month").alias("own_month"))
    run = mode_by(month.withColumn("run", F.lit(1)), ["run"], "month", "greatest").select(F.col("month").alias("run_month"))
    filled = df.join(own, list(keys), "left").join(F.broadcast(run), how="left")  # one row
    method = F.when(F.col(date).isNotNull(), "read").when(F.col("own_month").isNotNull(), "group_month").when(F.col("run_month").isNotNull(), "run_month")
    return filled.withColumns({"filled": F.coalesce(F.col(date), F.last_day("own_month"), F.last_day("run_month")), "method": method}).drop("own_month", "run_month")


def distinct_summary(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Counts of rows and of each flag for each group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def run_consensus(df: DataFrame, book: str, value: str, least_votes: int = 12, least_books: int = 3, share: tuple[int, int] = (9, 10)) -> DataFrame:
    """The value of a whole run, if it has votes, books and share enough and beats every other; one row or none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("votes"), F.count_distinct(book).alias("books"))
    best = counts.agg(F.sum("votes").alias("readings"), F.min(F.struct(-F.col("votes"), F.col(value), F.col("books"))).alias("b"), F.max("votes").alias("most"), F.count("*").alias("kinds"))
    tops = counts.groupBy("votes").agg(F.count("*").alias("alike")).withColumnRenamed("votes", "most")
    rows = best.join(tops, "most").select(F.col(f"b.{value}").alias(value), F.col("most").alias("votes"), F.col("b.books").alias("books"), "readings", "alike")
    enough = (F.col("alike") == 1) & (F.col("votes") >= least_votes) & (F.col("books") >= least_books) & (F.col("votes") * share[1] >= F.col("readings") * share[0])
    return rows.where(enough).drop("alike")


def adopt_run_value(df: DataFrame, book: str, value: str, alternatives: str, consensus: DataFrame, distance: int = 2) -> DataFrame:
    """Readings far from the run's value take it if they have it among their alternatives; others that far are for review. A reading that its book has twice is left alone.

    Adds adopted and method: kept, adopted or review.
    """
    twice = df.where(F.col(value).isNotNull()).groupBy(F.col(book).alias("_b"), F.col(value).alias("_v")).agg((F.count("*") >= 2).alias("_twice"))
    rows = df.join(twice, (F.col(book) == F.col("_b")) & (F.col(value) == F.col("_v")), "left").join(F.broadcast(consensus.select(F.col(value).alias("_run"))), how="left")  # one row at most
    far = F.coalesce((F.abs(F.col(value) - F.col("_run")) >= distance) & ~F.col("_twice"), F.lit(False))
    has = F.array_contains(alternatives, F.col("_run"))
    method = F.when(far & has, "adopted").when(far, "review").otherwise("kept")
    return rows.withColumns({"method": method, "adopted": F.when(far & has, F.col("_run")).otherwise(F.col(value))}).drop("_b", "_v", "_twice", "_run")


def fit_to_run(df: DataFrame, book: str, year: str, month: str, alternatives: str, direct: Column, aligned: Column, consensus: DataFrame, as_of: Column, distance: int = 2) -> DataFrame:
    """``df`` with ``adopted`` and ``method`` for the year of each page, given the run's (``consensus``, one row or none).

    A year that its book has by two direct readings stays (``kept``). Else an aligned page takes the run's year if its own is
    ``distance`` away or more and the run's is among its ``alternatives`` (``adopted``); a page whose month the run has with
    that year takes it too, if its own is as far or its month begins before the time that needs review (``month_fit``); other
    aligned ones that far are for ``review``. The last two only while the run's year is ``as_of``'s or the one before. Nulls stay.
    """
    known = df.where(F.col(year).isNotNull())
    twice = known.where(direct).groupBy(F.col(book).alias("_b"), F.col(year).alias("_y")).agg((F.count("*") >= 2).alias("_twice"))
    run = consensus.select(F.col(year).alias("_run"))
    months = known.join(F.broadcast(run), F.col(year) == F.col("_run"), "left_semi").where(F.col(month).isNotNull()).agg(F.collect_set(month).alias("_months"))  # twelve at most
    rows = df.join(twice, F.col(book).eqNullSafe(F.col("_b")) & (F.col(year) == F.col("_y")), "left").join(F.broadcast(run), how="left").join(F.broadcast(months))
    recent = F.col("_run").between(F.year(as_of) - 1, F.year(as_of))
    open_ = F.coalesce((F.col(year) != F.col("_run")) & ~F.coalesce("_twice", F.lit(False)), F.lit(False))
    far = F.abs(F.col(year) - F.col("_run")) >= distance
    old = F.make_date(year, month, F.lit(1)) < dates.review_start(as_of)
    fits = recent & F.array_contains("_months", F.col(month)) & (far | old)
    no = lambda c: F.coalesce(c, F.lit(False))
    method = F.when(~open_, "kept").when(no(aligned & far & F.array_contains(alternatives, F.col("_run"))), "adopted").when(no(fits), "month_fit").when(no(aligned & far & recent), "review").otherwise("kept")
    return rows.withColumns({"method": method, "adopted": F.when(method.isin("adopted", "month_fit"), F.col("_run")).otherwise(F.col(year))}).drop("_b", "_y", "_twice", "_run", "_months")


def purgeable_pages(reports: DataFrame, report: str, pages: str, number: str, blank: str, identity: Sequence[str]) -> DataFrame:
    """Nested reports as one row a page: report, ``place`` in it, number, ``duplicated`` (within all reports), ``blank`` and the identity fields as trimmed texts.

    A page without a number is no duplicate. Reports may hold no pages.
    """
    flat = reports.select(F.col(report), F.posexplode(pages).alias("place", "_p"))
    rows = flat.select(report, "place", F.col(f"_p.{number}").alias("number"), F.coalesce(F.col(f"_p.{blank}"), F.lit(False)).alias("blank"), *[F.trim(F.coalesce(F.col(f"_p.{c}").cast("string"), F.lit(""))).alias(c) for c in identity])
    return flag_duplicates(rows, ["number"], [report, "place"]).withColumnRenamed("is_duplicate", "duplicated").drop("is_first")
