"""Batches, jobs and their pages: searches, matches, states, positions and samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import stored


def number_query(text: str) -> Callable[[Column], Column] | None:
    """The predicate of a search: seven digits are that number, and one to six digits behind ``bit:`` or ``bitácora:`` a part of it; anything else is no query."""
    found = re.fullmatch(r"([0-9]{7})|(?:bit|bit[aá]cora)\s*:\s*([0-9]{1,7})", text.strip(), re.IGNORECASE)
    if found is None:
        return None
    wanted = found[1] or found[2]
    return lambda number: number == wanted if len(wanted) == 7 else number.contains(wanted)


def new_batch(now: DataFrame, before: DataFrame, key: str, name: str, pages: str, expected: Column) -> DataFrame:
    """Of the batches that weren't there before, the one of each name nearest to its expected pages; ambiguous if several are."""
    fresh = now.join(before.select(key), key, "left_anti").withColumn("_far", F.abs(F.col(pages) - expected))
    near = fresh.groupBy(name, "_far").agg(F.count("*").alias("n"), F.min(key).alias("_id")).groupBy(name).agg(F.min(F.struct("_far", "n", "_id")).alias("b"))
    return near.select(name, F.when(F.col("b.n") == 1, F.col("b._id")).alias("found"), F.when(F.col("b.n") == 1, "found").otherwise("ambiguous").alias("verdict"))


def resolved(rows: DataFrame, known: DataFrame, key: str, value: str, prefixes: Mapping[str, str], default: str) -> DataFrame:
    """A dimension's value for each row, else that of the first prefix its key has."""
    by_prefix = F.lit(default)
    for prefix, v in reversed(prefixes.items()):
        by_prefix = F.when(F.col(key).startswith(prefix), v).otherwise(by_prefix)
    return rows.join(known.select(key, F.col(value).alias("_v")), key, "left").withColumn(value, F.coalesce("_v", by_prefix)).drop("_v")


def shares(rows: DataFrame, causes: str, name: str) -> DataFrame:
    """How often each cause of an array column occurs, and its share of all in per cent."""
    counts = rows.select(F.explode(causes).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select(name, "n", F.bround(F.col("n") * 100.0 / F.col("_all"), 2).alias("share"))  # one row


def event_counts(rows: DataFrame, key: str, order: Column, kind: str, flags: Mapping[str, Column], at: Column) -> DataFrame:
    """Each job's events, those of each flag, its last event's kind and the last time."""
    return rows.groupBy(key).agg(F.count("*").alias("events"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.max_by(kind, order).alias(f"last_{kind.removeprefix('event_')}"), F.max(at).alias("last_at"))


def rotation(rows: DataFrame, turn: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows that were seen longest ago, those never seen first, with their place."""
    first = rows.orderBy(F.asc_nulls_first(turn), key).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_first(turn), key)))  # at most n rows


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Each row's place in its group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def last_of_each(rows: DataFrame, keys: Sequence[str], position: str, value: str, out: str) -> DataFrame:
    """The value of each key's last row and its position."""
    return rows.groupBy(*keys).agg(F.max_by(value, position).alias(out), F.max(position).alias("position"))


def unchanged(rows: DataFrame, remote: DataFrame, key: str, values: Sequence[str], confirmed: str) -> DataFrame:
    """Confirmed rows whose values are the same remotely."""
    there = remote.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_{v}") for v in values])
    cond = F.col(key) == F.col("_k")
    for v in values:
        cond = cond & F.col(v).eqNullSafe(F.col(f"_{v}"))
    return rows.where(confirmed).join(there, cond, "left_semi")


def global_positions(rows: DataFrame, report: str, order: Sequence[str]) -> DataFrame:
    """Each row's place among all rows, reports in their order (null first).

    The reports' sizes are dealt by ranges of reports; each range sums its own, and a small table of the ranges' totals says
    what comes before it. No window holds all reports.
    """
    sizes = rows.groupBy(F.col(report).alias("_report")).agg(F.count("*").alias("_n"))
    dealt = stored(sizes.repartitionByRange("_report").withColumn("_range", F.spark_partition_id()), "report-sizes")
    totals = dealt.groupBy("_range").agg(F.sum("_n").alias("_total"))
    earlier = totals.withColumn("_earlier", F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).drop("_total")  # a row for each range
    within = dealt.withColumn("_within", F.sum("_n").over(Window.partitionBy("_range").orderBy("_report").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    before = within.join(F.broadcast(earlier), "_range").select("_report", (F.col("_earlier") + F.col("_within")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(report).orderBy(*order))
    return rows.withColumn("_own", own).join(before, F.col(report).eqNullSafe(F.col("_report"))).withColumn("position", F.col("_before") + F.col("_own")).drop("_own", "_before", "_report")


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by a hash of the seed and the key."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def first_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in the given order, with its place: a distinct that keeps the order."""
    first = rows.groupBy(*keys).agg(F.min(order).alias(order))
    return first.select(*keys, order)


def unanimous_value(rows: DataFrame, key: str, values: Column, out: str) -> DataFrame:
    """The value of each key that all its elements agree on, or null."""
    each = rows.select(key, F.explode_outer(values).alias("_v")).groupBy(key).agg(F.count_distinct("_v").alias("_n"), F.min("_v").alias("_v"))
    return each.select(key, F.when(F.col("_n") == 1, F.col("_v")).alias(out))


def marked_for_review(pages: DataFrame, final: DataFrame, keys: Sequence[str], required: Sequence[str], out: str = "review") -> DataFrame:
    """Pages with a flag: their final row lacks a required value, or there is none."""
    whole = F.lit(True)
    for c in required:
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    good = final.where(whole).select(*keys).distinct().withColumn("_good", F.lit(True))
    return pages.join(good, list(keys), "left").withColumn(out, F.col("_good").isNull()).drop("_good")


def index_values(fields: Mapping[str, Column], controlled: Sequence[str], discrepancy: Column, status: str, other_status: str) -> Column:
    """A record as a map of the controlled fields that have a value, and its status."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), c.cast("string").alias("v")) for k, c in fields.items() if k in controlled])
    pairs = F.filter(entries, lambda p: F.coalesce(p.v, F.lit("")) != "")
    return F.map_concat(F.map_from_entries(pairs), F.create_map(F.lit("status"), F.when(discrepancy, other_status).otherwise(status)))


def run_summary(parts: DataFrame, run: str, counts: Sequence[str]) -> DataFrame:
    """A run's summary: the sums of its parts' counts, as JSON."""
    sums = parts.groupBy(run).agg(F.count("*").alias("parts"), *[F.sum(c).alias(c) for c in counts])
    return sums.select(run, F.to_json(F.struct("parts", *counts)).alias("json"))


def match_paths(rows: DataFrame, path: str, by: str) -> DataFrame:
    """How many rows each way of matching found."""
    return rows.groupBy(by, path).agg(F.count("*").alias("n"))


def control_keys(rows: DataFrame, key: str, done: Column, order: str, n: int) -> DataFrame:
    """The ``n`` keys that came first of those of which any row is done: key and its first place."""
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.bool_or(done).alias("_done")).where("_done").drop("_done").orderBy("first", key).limit(max(0, n))


def plan_report(plans: DataFrame, batch: str, page: str, columns: Mapping[str, Column], separator: Column, writable: Column, notes: str) -> DataFrame:
    """What would be written, all batches in one report of texts: the batch (if a plan has several), the page, the columns, the action and the notes.

    Separators are never written; a page that can't be is blocked. Nulls are empty.
    """
    several = plans.agg(F.count_distinct(batch).alias("_batches"))
    action = F.when(separator, "separator").when(writable, "write").otherwise("blocked")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = plans.join(F.broadcast(several))  # one row
    named = F.when(F.col("_batches") > 1, text(F.col(batch))).otherwise("")
    return rows.select(named.alias("batch"), text(F.col(page)).alias("page"), *[text(c).alias(n) for n, c in columns.items()], action.alias("action"), F.array_join(F.coalesce(notes, F.array().cast("array<string>")), " | ").alias("notes"))
