"""Per-book kernels whose steps read what earlier steps of the same pass have repaired.

Rows are dealt by key and sorted within the tasks; a task takes many books at once and hands each to its kernel, so that
neither a call nor a group is spent on one book. Rows without a key don't take part; books hold a bounded run of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import fuzzy

#: Fixed values, in millionths: what it costs to give a row a day that it doesn't name itself, and each day of distance.
UNSEEN, FAR = 500_000, 10_000


def repair_days(days: Sequence[int], firsts: Sequence[int], lengths: Sequence[int], strengths: Sequence[int], named: Sequence[Sequence[int]]) -> list[int]:
    """The cheapest days whose dates never fall, by dynamic programming over the days of each row's month.

    ``firsts`` are the day numbers of the months' first days, ``strengths`` what changing a day costs, ``named`` the other
    days that a row's own reading allows. Keeping a day costs nothing; another one costs its strength, its distance, and
    more if the row doesn't name it. A month that lies before all states of the row above cuts the chain, which begins anew
    with the month's whole costs. Ties go to the earliest date.
    """
    table: list[tuple[int, np.ndarray, np.ndarray | None]] = []
    for day, first, length, strength, own in zip(days, firsts, lengths, strengths, named, strict=True):
        d = np.arange(1, length + 1)
        cost = strength + FAR * np.abs(d - day) + UNSEEN
        cost[[x - 1 for x in own if 1 <= x <= length]] -= UNSEEN
        cost[day - 1] = 0
        start, back = first, None
        if table:
            before, totals, _ = table[-1]
            reach = np.minimum(first + d - before, len(totals))  # so many states of the row above are no later
            open_ = reach > 0
            if open_.any():
                least = np.minimum.accumulate(totals)
                place = np.maximum.accumulate(np.where(np.append(True, totals[1:] < least[:-1]), np.arange(len(totals)), 0))
                at = reach[open_] - 1
                start, back, cost = first + int(np.flatnonzero(open_)[0]), place[at], cost[open_] + least[at]
        table.append((start, cost, back))
    out, at = [], None
    for k in range(len(table) - 1, -1, -1):
        start, totals, back = table[k]
        at = int(np.argmin(totals)) if at is None else at
        out.append(start + at - firsts[k] + 1)
        at = None if back is None else int(back[at])
    return out[::-1]


def best_dates(options: Sequence[Sequence[int]], changes: Sequence[Sequence[int]], outside: Sequence[Sequence[int]]) -> list[int]:
    """Which of each row's dates (day numbers, the read one first) to take: 0 for all unless that makes fewer falls.

    ``changes`` counts the components that a date changes, ``outside`` the years it lies outside the usual window. Paths
    are compared by years outside, falls, changes and the days they jump; ties go to the earlier option.
    """
    table: list[list[tuple[tuple[int, int, int, int], int]]] = []
    for row, change, out in zip(options, changes, outside, strict=True):
        if not table:
            table.append([((o, 0, c, 0), -1) for c, o in zip(change, out, strict=True)])
            continue
        new = []
        for date, c, o in zip(row, change, out, strict=True):
            steps = [((t[0] + o, t[1] + (date < p), t[2] + c, t[3] + abs(date - p)), k) for k, ((t, _), p) in enumerate(zip(table[-1], options[len(table) - 1], strict=True))]
            new.append(min(steps))
        table.append(new)
    keep = [0] * len(options)
    if len(options) < 2:
        return keep
    at = min(range(len(table[-1])), key=lambda k: (table[-1][k][0], k))
    best = table[-1][at][0]
    falls = sum(b[0] < a[0] for a, b in zip(options, options[1:], strict=False))
    if not falls or best[1] >= falls or best[:2] >= (sum(o[0] for o in outside), falls):
        return keep
    path = []
    for row in reversed(table):
        path.append(at)
        at = row[at][1]
    return path[::-1]


def same_book(left: int, right: int) -> bool:
    return left // 50 == right // 50


def gaps_that_fit(pages: Sequence[int], numbers: Sequence[int | None], blank: Sequence[bool], fields: Sequence[bool]) -> list[list[int] | None]:
    """For each unread row its gap and number, if its run of unread rows fits exactly between two read numbers of one book.

    A gap is named by the page and the number before it. Blank rows are passed over; a jump in the page numbers ends a
    run, and so does a row that has no field for a number. Rows are in page order.
    """
    out: list[list[int] | None] = [None] * len(pages)
    before, at, run = None, 0, []
    for k, (page, number, empty, field) in enumerate(zip(pages, numbers, blank, fields, strict=True)):
        if k and page != pages[k - 1] + 1:
            before, run = None, []
        if empty:
            continue
        if number is None:
            if before is not None and field:
                run.append(k)
            else:
                before, run = None, []
            continue
        if before is not None and run and number - before == len(run) + 1 and same_book(before, number):
            for i, row in enumerate(run, 1):
                out[row] = [at, before, before + i]
        before, at, run = number, page, []
    return out


def next_fit(sizes: Sequence[int], limit: int) -> list[int]:
    """The part of each section, in order: a section that doesn't fit opens a part; a larger one has parts of its own."""
    parts, used, out = 0, 0, []
    for size in sizes:
        if used and used + size > limit:
            parts, used = parts + 1, 0
        out.append(parts)
        used += size
        if used >= limit:
            parts, used = parts + -(-used // limit), 0
    return out


def by_book(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], out: str, kernel: Callable[..., list], least: int = 1 << 14) -> DataFrame:
    """``df`` with a new last column: ``kernel`` takes each group's input columns as lists, in order, and gives its values.

    ``out`` is the column's name and type. Books are cut out of batches of about ``least`` rows.
    """
    rows = df.where(F.col(keys[0]).isNotNull())
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", {out}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (*batches, None):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or (batch is not None and sum(b.num_rows for b in held) < least):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            names = list(zip(*[table.column(k).to_pylist() for k in keys], strict=True))
            starts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
            stop = table.num_rows if batch is None else starts[-1]
            columns = [table.column(c).to_pylist() for c in inputs]
            values: list = []
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if b <= stop:
                    values += kernel(*[c[a:b] for c in columns])
            if stop:
                yield from table.slice(0, stop).append_column(name, pa.array(values, arrow)).combine_chunks().to_batches()
            held = table.slice(stop).to_batches() if stop < table.num_rows else []

    name, kind = out.split(" ", 1)
    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}[kind]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def repair_days_by_book(df: DataFrame, keys: Sequence[str], order: Sequence[str], date: str, strength: str, named: str) -> DataFrame:
    """``repair_days`` over each book's dated rows: ``repaired_day`` beside them. ``strength`` is in units, ``named`` an array of days."""
    first = F.datediff(F.trunc(date, "MM"), F.lit("1970-01-01").cast("date"))
    rows = df.where(F.col(date).isNotNull()).withColumns({"_day": F.dayofmonth(date), "_first": first, "_length": F.dayofmonth(F.last_day(date)), "_cost": F.bround(F.col(strength) * 1_000_000).cast("long")})
    kernel = lambda day, first, length, cost, own: repair_days(day, first, length, cost, [[x for x in o or () if x is not None] for o in own])
    return by_book(rows, keys, order, ["_day", "_first", "_length", "_cost", named], "repaired_day int", kernel).drop("_day", "_first", "_length", "_cost")


def best_dates_by_book(df: DataFrame, keys: Sequence[str], order: Sequence[str], options: str, changes: str, outside: str) -> DataFrame:
    """``best_dates`` over each book's rows that have options: ``chosen`` (from 0) beside them. ``options`` is an array of dates, the read one first."""
    numbers = F.transform(options, lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")))
    return by_book(df.where(F.size(options) > 0).withColumn("_numbers", numbers), keys, order, ["_numbers", changes, outside], "chosen int", best_dates).drop("_numbers")


def fill_gaps(df: DataFrame, keys: Sequence[str], page: str, number: str, reading: str, blank: str, field: str | None = None) -> DataFrame:
    """``df`` with ``filled``: unread numbers that fit exactly between two read ones of a file.

    A run is filled if none of its numbers is read anywhere in the run of files, no earlier gap takes one of them, and each
    row's reading doesn't contradict its number. ``field``: whether a row has a field for a number at all (by default each has).
    """
    rows = df.withColumn("_field", F.coalesce(F.col(field), F.lit(False)) if field else F.lit(True))
    gap = by_book(rows, keys, [page], [page, number, blank, "_field"], "_gap array<long>", gaps_that_fit).where("_gap IS NOT NULL")
    gap = gap.select(*keys, page, reading, F.col("_gap")[0].alias("_at"), F.col("_gap")[1].alias("_before"), F.col("_gap")[2].alias("_new"))
    known = df.where(F.col(number).isNotNull()).select(F.col(number).alias("_new")).distinct().withColumn("_known", F.lit(True))
    marked = gap.join(known, "_new", "left").withColumn("_ok", F.col("_known").isNull() & fuzzy.agrees_with(reading, "_new"))
    # two gaps that share a number lie between the same read numbers, which no gap holds: they are the same gap twice
    good = marked.groupBy(*keys, "_at", "_before").agg(F.bool_and("_ok").alias("_ok")).where("_ok")
    first = good.groupBy("_before").agg(F.min(F.struct(*keys, "_at")).alias("_first"))
    won = first.select(*[F.col(f"_first.{k}").alias(k) for k in (*keys, "_at")])
    filled = gap.join(won, [*keys, "_at"], "left_semi").select(*keys, page, F.col("_new").alias("_fill"))
    return df.join(filled, [*keys, page], "left").withColumn("filled", F.coalesce(F.col(number), F.col("_fill"))).drop("_fill")


def pack_sections(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, limit: int) -> DataFrame:
    """``next_fit`` over the sections of each group: ``part`` beside them."""
    return by_book(df, keys, order, [size], "part int", lambda sizes: next_fit(sizes, limit))


def smoothed_pace(df: DataFrame, keys: Sequence[str], order: str, sample: str, faster: float = 0.8, slower: float = 0.5) -> DataFrame:
    """An asymmetric moving average over each group's ordered samples: a faster sample weighs more than a slower one.

    Rows stream by; a task holds one average, not a group.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + ", pace double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pace, done = None, None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, x in zip(zip(*columns[:-1], strict=True), columns[-1], strict=True):
                if key != now:
                    done += [] if now is None else [(*now, pace)]
                    now, pace = key, None
                if x is not None:
                    pace = x if pace is None else x * faster + pace * (1 - faster) if x < pace else x * slower + pace * (1 - slower)
            if len(done) >= 1 << 14:
                yield frame(done)
                done = []
        yield frame(done + ([] if now is None else [(*now, pace)]))

    kinds = [pa.field(f.name, pa.string() if f.dataType.typeName() == "string" else pa.int64()) for f in df.select(*keys).schema] + [pa.field("pace", pa.float64())]
    frame = lambda rows: pa.RecordBatch.from_pylist([dict(zip([k.name for k in kinds], r, strict=True)) for r in rows], schema=pa.schema(kinds))
    rows = df.select(*[F.col(k).cast("long") if dict(df.dtypes)[k] != "string" else F.col(k) for k in keys], order, F.col(sample).cast("double").alias(sample))
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, sample).mapInArrow(run, schema.replace(" int,", " bigint,"))


def overtaken(df: DataFrame, keys: Sequence[str], at: str, pending: Column) -> DataFrame:
    """Pending events of a group after which another one of it was done: the group's last done time is aggregated first, so no group is sorted."""
    last = df.where(~pending).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(at).alias("_last"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(last, cond, "left").withColumn("overtaken", pending & F.coalesce(F.col("_last") > F.col(at), F.lit(False))).drop("_last", *[f"_{k}" for k in keys])
